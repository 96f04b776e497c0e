"""Work on distinct words once, wherever they occur, and bring the answers back to each place.

Each task cuts its texts into words, keeps the places as codes into the block's own list of distinct
words, and sends every distinct word to the partition its hash names, with what the block knows of
it. There equal words of all blocks meet, once per block however often they occur, so a very
frequent word is no hot key. The partition solves each distinct word and answers every block in its
own order; the codes travel with the answers, and the texts are put together by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm import blocks as B

ASKED, PLACES, ANSWERED, KNOWN = 0, 1, 2, 3  # kinds of parcels

#: Cuts the bytes of texts into words: (data, offsets) to (words, first word of each text).
Cut = Callable[[np.ndarray, np.ndarray], tuple[pa.LargeBinaryArray, np.ndarray]]
#: Rows of a block, first word of each text, codes, and the number of distinct words, to a weight of each of these.
Weigh = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, int], np.ndarray]
#: Rows of a block, first word of each text, codes and distinct words to what the block keeps.
Keep = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], tuple]
#: Distinct words, their summed weights and, if any are given, payloads of KNOWN parcels, to (values, how many values each word has).
Solve = Callable[..., tuple[np.ndarray, np.ndarray]]
#: What the block kept, first word of each text, codes, all values, and by code where its values start and
#: how many there are, to rows of the result.
Finish = Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]], pa.RecordBatch]


def homes_of(words: pa.Array, count: int) -> np.ndarray:
    return (B.word_hashes(words) % np.uint64(count)).astype(np.int64)


def asked(words: pa.Array, weights: np.ndarray | None, block: bytes, homes: np.ndarray, count: int) -> list[tuple]:
    """One parcel per partition that gets any of these distinct words."""
    order = np.argsort(homes, kind="stable")
    bounds = np.searchsorted(homes[order], np.arange(count + 1))
    rows = []
    for home in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[home] : bounds[home + 1]]
        data, offsets = B.text_bytes(words.take(pa.array(own)))
        weight = None if weights is None else B.narrow(weights[own])
        rows.append((int(home), block, ASKED, B.pack(data.tobytes(), B.narrow(np.diff(offsets)), weight)))
    return rows


def met(parcels: list[tuple[bytes, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray | None, list[tuple[bytes, int]]]:
    """Distinct words of many parcels, the code of each word sent, summed weights, and each block's share."""
    texts, weights, blocks = [], [], []
    for block, payload in parcels:
        data, lengths, weight = B.unpack(payload)
        texts.append(B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths)))
        weights.append(weight)
        blocks.append((block, len(lengths)))
    coded = pa.concat_arrays(texts).dictionary_encode()
    codes = coded.indices.to_numpy()
    summed = None
    if weights[0] is not None:
        summed = np.bincount(codes, np.concatenate(weights).astype(np.float64), len(coded.dictionary)).astype(np.int64)
    return coded.dictionary, codes, summed, blocks


def _blocks(batches: Iterator[pa.RecordBatch], key: str, text: str, cut: Cut) -> Iterator[tuple]:
    for batch in B.text_blocks(batches, text):
        words, firsts = cut(*B.text_bytes(batch.column(text)))
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        ids = batch.column(key)
        name = hashlib.blake2b(f"{ids[0]}/{ids[-1]}/{len(ids)}/".encode(), digest_size=12)
        name.update(memoryview(np.ascontiguousarray(B.text_bytes(distinct)[0])))
        yield batch, firsts, codes, distinct, name.digest()


def _place(block: bytes, kept, firsts: np.ndarray, codes: np.ndarray, homes: np.ndarray, count: int) -> tuple:
    return _home(block, count), block, PLACES, B.pack(kept, B.narrow(firsts), B.planes(codes), B.narrow(homes))


def placed(payload: bytes) -> tuple:
    """What the block kept, first word of each text, codes, and the home of each distinct word, of a PLACES parcel."""
    kept, firsts, codes, homes = B.unpack(payload)
    return kept, firsts.astype(np.int64), B.from_planes(codes).astype(np.int64), homes


def once(table: DataFrame, key: str, text: str, cut: Cut, keep: Keep, weigh: Weigh | None = None) -> DataFrame:
    """ASKED and PLACES parcels of all blocks from one reading, to be written where several rounds need them."""
    count = B.partitions(table)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, firsts, codes, distinct, block in _blocks(batches, key, text, cut):
            weights, homes = weigh(batch, firsts, codes, len(distinct)) if weigh else None, homes_of(distinct, count)
            yield B.parcels(asked(distinct, weights, block, homes, count))
            yield B.parcels([_place(block, keep(batch, firsts, codes, distinct), firsts, codes, homes, count)])

    return table.mapInArrow(both, B.PARCEL)


def by_position(
    table: DataFrame, key: str, text: str, cut: Cut, solve: Solve, keep: Keep, finish: Finish, schema: str, weigh: Weigh | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """The rows that ``finish`` makes of each block of rows of ``table``.

    ``table`` is read twice, once for the words and once for their places, which halves what is shuffled.
    It should be a scan of files: a block is known by its ids and words, and if a second reading dealt the
    rows to blocks otherwise, the job would fail rather than mix blocks up.
    """
    count = B.partitions(table)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, firsts, codes, distinct, block in _blocks(batches, key, text, cut):
            weights = weigh(batch, firsts, codes, len(distinct)) if weigh else None
            yield B.parcels(asked(distinct, weights, block, homes_of(distinct, count), count))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, firsts, codes, distinct, block in _blocks(batches, key, text, cut):
            kept = keep(batch, firsts, codes, distinct)
            yield B.parcels([_place(block, kept, firsts, codes, homes_of(distinct, count), count)])

    return answered(table.mapInArrow(ask, B.PARCEL), table.mapInArrow(places, B.PARCEL), solve, finish, schema, known)


def answered(
    sent: DataFrame, kept: DataFrame, solve: Solve, finish: Finish, schema: str, known: DataFrame | None = None
) -> DataFrame:
    """The rows that ``finish`` makes of each block of PLACES parcels in ``kept``, from the answers to ``sent``, the ASKED ones."""
    count, informed = B.partitions(sent), known is not None

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parcels, held = 0, [], []
        for batch in batches:
            here = batch.column("target")[0].as_py() if batch.num_rows else here
            for _, block, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == KNOWN:
                    held.append(payload)
                else:
                    parcels.append((block, payload))
        if not parcels:
            return
        distinct, codes, summed, sizes = met(parcels)
        del parcels
        values, lengths = solve(distinct, summed, held) if informed else solve(distinct, summed)
        starts = B.offsets_of(lengths)[:-1]
        at = 0
        for block, size in sizes:
            own = codes[at : at + size]
            at += size
            found = values[B.gather(starts[own], lengths[own])]
            payload = B.pack(here, B.planes(found), B.narrow(lengths[own]))
            yield B.parcels([(_home(block, count), block, ANSWERED, payload)])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, answers = None, [], {}
        for batch in batches:
            for _, name, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != block:
                    yield from _assembled(places, answers, finish)
                    block, places, answers = name, [], {}
                if kind == PLACES:
                    places.append(payload)
                else:
                    home, *found = B.unpack(payload)
                    answers[home] = found
        yield from _assembled(places, answers, finish)

    sent = sent.unionAll(known) if informed else sent
    answers = B.deliver(sent, count).mapInArrow(answer, B.PARCEL)
    back = B.deliver(answers.unionAll(kept), count)
    return back.sortWithinPartitions("block", "kind").mapInArrow(assemble, schema)


def _home(block: bytes, count: int) -> int:
    return int.from_bytes(block[:4], "big") % count


def _assembled(places: list[bytes], answers: dict[int, tuple], finish: Finish) -> Iterator[pa.RecordBatch]:
    """One block; blocks equal in ids and words, of repeated rows, have the same answers."""
    found = [answers[home] for home in sorted(answers)]
    values = np.concatenate([B.from_planes(x[0]) for x in found]) if found else np.zeros(0, np.int64)
    lengths = np.concatenate([x[1].astype(np.int64) for x in found]) if found else np.zeros(0, np.int64)
    for payload in places:
        kept, firsts, codes, homes = placed(payload)
        if len(lengths) != len(homes):
            raise RuntimeError("a block has words without answers")
        # Answers come by home; codes count words in the order of the block.
        order = np.argsort(homes, kind="stable")
        starts, sizes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        starts[order], sizes[order] = B.offsets_of(lengths)[:-1], lengths
        yield finish(kept, firsts, codes, values, (starts, sizes))
