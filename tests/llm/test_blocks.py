"""Cutting texts into words: the same words as a pattern finds, in memory that stays near the text's own size."""

import re
import tracemalloc

import numpy as np
import pytest

from chalkline.llm import blocks as B


@pytest.mark.parametrize("cut, pattern", [(B.words_of, rb"[^\x20\x09-\x0D]+"), (B.letter_runs, rb"[A-Za-z\x80-\xff]+")])
def test_runs_are_those_of_the_pattern(cut, pattern):
    random = np.random.default_rng(8)
    for _ in range(300):
        offsets = B.offsets_of(random.integers(0, 6, random.integers(0, 8)))
        data = random.choice(np.frombuffer(b"a \nB0\xc3", np.uint8), offsets[-1])
        for lower in (False, True):
            words, firsts = cut(data, offsets, lower)
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = [re.findall(pattern, t.lower() if lower else t) for t in texts]
            assert words.to_pylist() == sum(found, [])
            assert firsts.tolist() == B.offsets_of(np.array([len(x) for x in found], np.int64)).tolist()


def test_cutting_takes_few_bytes_for_each_byte_of_text():
    data = np.frombuffer(b"some words of usual length here " * 2**16, np.uint8)
    offsets = np.array([0, len(data)])
    tracemalloc.start()
    B.words_of(data, offsets, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)
