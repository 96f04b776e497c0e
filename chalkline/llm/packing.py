"""Packing of documents into sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.llm.words import by_position
from chalkline.session import scratch_path

LENGTH = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 10  # of each dimension in a curve key
_VOCABULARY = 2**16

_TOKENS = "row long, doc_id long, curve long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _directions() -> np.ndarray:
    """A random direction for each token id, the same everywhere."""
    return np.random.default_rng(7).standard_normal((_VOCABULARY, DIMENSIONS)).astype(np.float32)


def _places(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each document's hashed token vector, projected to few dimensions, as whole numbers of BITS bits."""
    sums = np.zeros((len(ends) - 1, DIMENSIONS), dtype=np.float64)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        sums[full] = np.add.reduceat(_directions()[ids], ends[:-1][full], axis=0, dtype=np.float64)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(length > 0, length, 1)
    return np.minimum((unit + 1) / 2 * 2**BITS, 2**BITS - 1).astype(np.int64)


def hilbert_key(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of points with whole coordinates, by Skilling's transform."""
    x = places.astype(np.int64).copy()
    dimensions = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dimensions):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dimensions):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


def _cut(data: np.ndarray, offsets: np.ndarray):
    return B.words_of(data, offsets, lower=False)


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, curve, n, ids of every row: its ids and the end id, and its place on the curve.

    The tokenizer never joins characters across white space, so each distinct word is encoded once.
    ``row`` is a number of the row in this table; ids are little-endian unsigned 16-bit integers.
    """

    def keep(batch, firsts, codes, distinct):
        return (batch.column("doc_id"),)

    def solve(distinct, _):
        found = _tokenizer(tokenizer)
        ids, lengths = [], []
        # Words of a part are joined by blanks, which the tokenizer drops, and told apart by their offsets.
        for word in distinct.to_pylist():
            own = found.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            ids.extend(own)
            lengths.append(len(own))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def finish(kept, firsts, codes, values, found):
        starts, sizes = found
        lengths = sizes[codes]
        words = values[B.gather(starts[codes], lengths)].astype(np.int64)
        ends = B.offsets_of(lengths)[firsts]
        curve = hilbert_key(_places(words, ends))
        n = np.diff(ends) + 1
        places = B.offsets_of(n)
        ids = np.empty(places[-1], "<u2")
        last = np.zeros(len(ids), dtype=bool)
        last[places[1:] - 1] = True
        ids[last], ids[~last] = END_ID, words
        return pa.RecordBatch.from_arrays(
            [kept[0], pa.array(curve), pa.array(n), B.slices(ids.view(np.uint8), 2 * places).cast(pa.binary())],
            names=["doc_id", "curve", "n", "ids"],
        )

    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, curve long, n long, ids binary"
    rows = by_position(table, "doc_id", "text", _cut, solve, keep, finish, schema)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "curve", "n", "ids")


def _running(batches):
    """Rows of one sorted partition with the tokens that lie before each in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = before + np.cumsum(batch.column("n").to_numpy(), dtype=np.int64)
        if len(ends):
            starts = np.concatenate([[before], ends[:-1]])
            before = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.full(len(ends), part, np.int32)), pa.array(starts), pa.array(ends)],
                names=["row", "part", "start", "end"],
            )


def _sliced(length: int):
    def run(batches):
        for batch in batches:
            for part in B.text_blocks([batch], "ids"):
                data, offsets = B.text_bytes(part.column("ids"))
                first, n = part.column("first").to_numpy(), part.column("n").to_numpy()
                count = (first + n - 1) // length - first // length + 1
                owner = np.repeat(np.arange(len(n)), count)
                sequence = B.gather(first // length, count)
                begin = np.maximum(sequence * length, first[owner])
                stop = np.minimum((sequence + 1) * length, (first + n)[owner])
                at = offsets[:-1][owner] // 2 + begin - first[owner]
                wide = np.frombuffer(data.tobytes(), "<u2").astype("<u4")
                crc = [zlib.crc32(wide[a : a + size]) for a, size in zip(at.tolist(), (stop - begin).tolist(), strict=True)]
                columns = [
                    part.column("doc_id").take(pa.array(owner)), pa.array(begin - first[owner]), pa.array(stop - begin),
                    pa.array(crc, pa.int64()), pa.array(n[owner]), pa.array(sequence), pa.array(begin % length),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def positions(tokens: DataFrame) -> DataFrame:
    """row and first: the token of the whole curve at which each row's tokens begin.

    Only keys and lengths are sorted, by curve, doc_id and row, so copies, which share a place on the curve,
    still spread over the ranges. Each range sums up on its own; one row per range goes to the driver's plan.
    """
    spark = tokens.sparkSession
    path = scratch_path(spark, "curve-order")
    order = ["curve", F.col("doc_id").asc_nulls_last(), "row"]
    (
        tokens.select("curve", "doc_id", "row", "n")
        .repartitionByRange(B.partitions(tokens), *order)
        .sortWithinPartitions(*order)
        .select("row", "n")
        .mapInArrow(_running, "row long, part int, start long, end long")
        .write.parquet(path)
    )
    placed = spark.read.schema("row long, part int, start long, end long").parquet(path)
    totals = placed.groupBy("part").agg(F.max("end").alias("total"))  # a row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    return placed.join(F.broadcast(shifts), "part").select("row", (F.col("start") + F.col("shift")).alias("first"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents follow each other along a Hilbert curve through the projections of their token vectors, so
    sequences hold documents of like words, and are cut where a sequence is full. All sequences but the last
    are full. A null or empty text is its end id alone; rows with equal or null doc_id are documents of their
    own; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "curve-tokens")
    tokenized(docs, tokenizer, doc_id, text).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(_TOKENS).parquet(path)
    placed = tokens.select("row", "doc_id", "n", "ids").join(positions(tokens), "row")
    return placed.select("doc_id", "first", "n", "ids").mapInArrow(_sliced(length), _PIECES)


def packed_documents(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The sequences themselves: sequence_id, ids, doc_ids (of its pieces in order)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "curve-tokens")
    tokenized(docs, tokenizer, doc_id, text).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(_TOKENS).parquet(path)
    placed = tokens.select("row", "doc_id", "n", "ids").join(positions(tokens), "row")
    last = F.floor((F.col("first") + F.col("n") - 1) / length)
    parts = placed.select("*", F.explode(F.sequence(F.floor(F.col("first") / length), last)).alias("sequence_id"))
    begin = F.greatest(F.col("sequence_id") * length, F.col("first"))
    stop = F.least((F.col("sequence_id") + 1) * length, F.col("first") + F.col("n"))
    piece = F.substring(F.col("ids"), ((begin - F.col("first")) * 2 + 1).cast("int"), ((stop - begin) * 2).cast("int"))
    held = parts.select("sequence_id", F.struct(begin.alias("at"), "doc_id", piece.alias("ids")).alias("piece"))
    return held.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select(
        "sequence_id",
        F.aggregate("pieces", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
        F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"),
    )
