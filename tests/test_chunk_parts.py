"""Tasks turn their Arrow batches into Python objects in parts; results do not depend on the parts."""

import numpy as np
import pyarrow as pa
import pytest

from chalkline.operators import chunking
from chalkline.operators.embedding import HashedWords, _bucket

KEYS = {"filename": "f", "class_num": "7", "subject": "s", "chapter": None}


def batch(n):
    rows = [
        KEYS | {"segment": i, "text": f"{i} words go on. " * 300, "crossing": [], "entry": None if i % 5 == 4 else 0}
        | {"leading": i == 0, "first_sequence": 10 * i}
        for i in range(n)
    ]
    rows[1]["crossing"] = [{"chunk_sequence": 9, "content": "over the edge"}]
    kinds = [(name, pa.string()) for name in KEYS] + [("segment", pa.int32()), ("text", pa.string())]
    kinds += [("crossing", pa.list_(pa.struct([("chunk_sequence", pa.int32()), ("content", pa.string())])))]
    kinds += [("entry", pa.int32()), ("leading", pa.bool_()), ("first_sequence", pa.int32())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


@pytest.mark.parametrize("step", [chunking._chunks, chunking._spans])
def test_a_batch_is_worked_on_in_parts(step, monkeypatch):
    cutter, given = chunking.Cutter(), batch(20)
    whole = pa.Table.from_batches(step(cutter)(iter([given])))
    monkeypatch.setattr(chunking, "PART_BYTES", 12000)
    parts = list(step(cutter)(iter([given])))
    assert len(parts) == 10
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_parts_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(chunking, "PART_BYTES", 100)
    monkeypatch.setattr(chunking, "PART_ROWS", 3)
    texts = ["x" * n for n in (500, 0, 40, 60, 1, 0, 0, 0, 0, 99, 2)] + [None]
    parts = list(chunking._parts([pa.RecordBatch.from_pydict({"text": texts}), pa.RecordBatch.from_pydict({"text": []})]))
    assert [row["text"] for part in parts for row in part] == texts
    assert all(len(part) <= 3 and (len(part) == 1 or sum(len(row["text"] or "") for row in part) <= 100) for part in parts)


def test_words_are_counted_at_their_places():
    texts = ["b aé B b_c", "", "a1 2"]
    found = HashedWords(dimension=7).encode(texts)
    want = np.zeros((3, 7), np.float32)
    for row, text in enumerate(texts):
        for word in HashedWords._WORD.findall(text.lower()):
            want[row, _bucket(word, 7)] += 1
    assert found.dtype == np.float32 and (found == want).all()
