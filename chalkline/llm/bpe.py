"""Byte-level BPE encoding and decoding through distinct words."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.llm.words import by_position

ENCODED = "doc_id long, ids binary, n_tokens long"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@cache
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: the bytes of all ids, and where each id starts. Bounded by the vocabulary."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), B.offsets_of(np.array([len(x) for x in table], np.int64))


def cut_before_single_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Pieces whose matches of the pattern are those of the whole text.

    A blank between two other characters that are not white space always begins a match, so a text is cut
    before each. Three-byte white space, U+0085 and U+00A0 begin with the lead bytes below; next to these
    nothing is cut, nor next to control characters.
    """
    if not len(data):
        return B.slices(data, np.zeros(1, np.int64)), np.zeros(len(offsets), np.int64)
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    lead = np.isin(padded, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
    solid = (padded > 0x20) & (padded != 0x7F)
    before = solid[2:-2] & ~lead[1:-3] & ~lead[:-4]
    cut = (data == 0x20) & before & (solid & ~lead)[4:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return B.slices(data, np.append(starts, len(data))), np.searchsorted(starts, offsets)


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (little-endian unsigned 32-bit), n_tokens.

    Every distinct pre-token is encoded once in the whole table. A null or empty text has no ids; rows with
    equal or null doc_id each give a row; other columns are not read. ``ranks`` is a file that every
    executor has at the same path.
    """

    def finish(kept, firsts, codes, values, found):
        ids, ends = _ids(firsts, codes, values, found)
        return pa.RecordBatch.from_arrays(
            [kept[0], B.slices(ids.view(np.uint8), 4 * ends).cast(pa.binary()), pa.array(np.diff(ends))],
            names=["doc_id", "ids", "n_tokens"],
        )

    return _through_words(docs, ranks, pattern, doc_id, text, finish, ENCODED)


def round_trip_digests(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``encode`` and ``decode`` of every text, returned as digests of the ids and of the decoded bytes."""

    def finish(kept, firsts, codes, values, found):
        ids, ends = _ids(firsts, codes, values, found)
        data, places = _decoded(ids, ends, ranks)
        return pa.RecordBatch.from_arrays(
            [kept[0], pa.array(np.diff(ends)), _sha256(ids.view(np.uint8), 4 * ends), _sha256(data, places)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _through_words(docs, ranks, pattern, doc_id, text, finish, DIGESTS)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the decoded ``text`` of rows of ``encode``. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        for batch in batches:
            for part in B.text_blocks([batch], "ids"):
                data, offsets = B.text_bytes(part.column("ids"))
                decoded, places = _decoded(data.view("<u4") if len(data) else np.zeros(0, "<u4"), offsets // 4, ranks)
                texts = [x.decode("utf-8", "replace") for x in B.slices(decoded, places).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _through_words(docs, ranks, pattern, doc_id, text, finish, schema) -> DataFrame:
    def keep(batch, firsts, codes, distinct):
        return (batch.column("doc_id"),)

    def solve(distinct, _):
        encoder = _encoder(ranks, pattern)
        ids = [encoder.encode_ordinary(piece.decode("utf-8", "replace")) for piece in distinct.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for piece in ids for i in piece), np.uint32, int(lengths.sum())), lengths

    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return by_position(table, "doc_id", "text", cut_before_single_blanks, solve, keep, finish, schema)


def _ids(firsts, codes, values, found) -> tuple[np.ndarray, np.ndarray]:
    starts, sizes = found
    lengths = sizes[codes]
    ids = values[B.gather(starts[codes], lengths)].astype("<u4")
    return ids, B.offsets_of(lengths)[firsts]


def _decoded(ids: np.ndarray, ends: np.ndarray, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _token_bytes(ranks)
    lengths = (offsets[1:] - offsets[:-1])[ids]
    return data[B.gather(offsets[ids], lengths)], B.offsets_of(lengths)[ends]


def _sha256(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
