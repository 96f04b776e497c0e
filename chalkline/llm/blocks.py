"""Texts as flat byte arrays inside tasks, and the rows that carry arrays between tasks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 12 * 1024 * 1024
COMPRESSION = 5

# [\x20\x09-\x0D]
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# [^\x00-\x40\x5B-\x60\x7B-\x7F]: letters, and every byte of a character beyond ASCII
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_random = np.random.default_rng(20240229)
BYTE_CODE = _random.integers(1, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64

#: Arrays on their way to a task: ``target`` is the partition, ``payload`` what ``pack`` made.
PARCEL = "target int, block binary, kind int, payload binary"
_PARCEL_ARROW = pa.schema(
    [("target", pa.int32()), ("block", pa.binary()), ("kind", pa.int32()), ("payload", pa.binary())]
)


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=COMPRESSION).compress(pickle.dumps(values, protocol=5))


def unpack(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def planes(values: np.ndarray) -> tuple[str, bytes]:
    """Integers with their first bytes together, then their second and so on, which compresses better."""
    small = np.ascontiguousarray(narrow(values))
    return small.dtype.str, small.view(np.uint8).reshape(len(small), small.itemsize).T.tobytes()


def from_planes(stored: tuple[str, bytes]) -> np.ndarray:
    kind, raw = np.dtype(stored[0]), np.frombuffer(stored[1], dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def parcels(rows: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), field.type) for column, field in zip(columns, _PARCEL_ARROW, strict=True)],
        schema=_PARCEL_ARROW,
    )


def partitions(table: DataFrame) -> int:
    return int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deliver(table: DataFrame, count: int) -> DataFrame:
    """Each parcel to the partition it names."""
    return table.repartitionById(count, F.col("target"))


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (null: empty), and where each row starts; one offset more than rows."""
    kind = pa.binary() if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pa.large_binary()
    column = pc.fill_null(column.cast(kind).cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """Adjoining slices of bytes as an Arrow array, without a copy."""
    offsets = np.ascontiguousarray(offsets, dtype=np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 single bytes. Indexing would make an 8-byte index of every byte first."""
    found = data.tobytes().translate(table.view(np.uint8).tobytes())
    return np.frombuffer(found, table.dtype)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and where each text's words start."""
    if lower:
        data = looked_up(LOWER, data)
    return runs_of(data, offsets, looked_up(~WHITE, data))


def runs_of(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The longest runs of ``solid`` bytes of all texts in order, and where each text's runs start."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    # A run ends at the last solid byte before another run or a byte that is not solid.
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    kept = offsets_of(np.flatnonzero(last) - starts + 1)
    return slices(data[solid], kept), np.searchsorted(starts, offsets)


def letter_runs(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The runs of ASCII letters, in lower case if asked, and bytes of characters beyond ASCII, as ``runs_of``."""
    return runs_of(looked_up(LOWER, data) if lower else data, offsets, looked_up(LETTER, data))


def mixed(values: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(count: int) -> np.ndarray:
    """BASE to the powers 0 to count - 1, modulo 2**64."""
    factors = np.full(max(count, 1), BASE, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word; words are not empty."""
    data, offsets = text_bytes(words)
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    lengths = np.diff(offsets)
    places = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    terms = BYTE_CODE[data] * powers(int(lengths.max()))[places]
    return mixed(np.add.reduceat(terms, offsets[:-1]) + lengths.astype(np.uint64))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each slice, one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
