"""Exact top-k vector search as a Spark job.

Every question is scored against every vector, as a flat index does, but the pairs never become
rows: each task multiplies its Arrow batches with the question matrix and keeps its best k per
question. Two window steps then merge those short lists; the first one is salted, so a batch with
few questions does not end in a few tasks. Vectors stay where they are stored in every case: many
questions are broadcast block by block, each after a first pass over a sample of the vectors that
says what score a hit needs at least.

Rough scores in single precision pick the candidates, with a margin for their error; what is kept is computed
in double precision and stored as float32, the precision of the vectors. Equal scores are ordered by ascending
id. That makes the ranking independent of how the corpus is split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.vectors import l2_normalize
from chalkline.session import scratch_path

INNER_PRODUCT, L2 = "inner_product", "l2"

# At most this many questions, and this many vector bytes, are broadcast at once; more go in blocks.
MAX_BROADCAST_QUESTIONS = 8192
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

# Hits are broadcast to the chunk table up to this many rows (about 32 bytes each).
MAX_BROADCAST_HITS = 1_000_000

# One vector in so many takes part in the first pass; the most salts that short lists are merged by.
SAMPLED = 64
_MAX_SALTS = 1024
_SCORE_BLOCK = 256
_HIT_SCHEMA = "query_id long, faiss_id long, score float"


@dataclass(frozen=True)
class Hits:
    """Ranked hits, and how many rows they can be at most (None when no bound is known)."""

    frame: DataFrame
    max_rows: int | None


class BestK:
    """Running best k vectors of each question; ``least`` is a score that the k-th best is known to reach."""

    def __init__(
        self, question_ids: np.ndarray, questions: np.ndarray, k: int, metric: str, least: np.ndarray | None = None
    ) -> None:
        self.question_ids, self.questions = question_ids, questions.astype(np.float64)
        self.rough = questions.astype(np.float32)
        self.k, self.sign = k, (1.0 if metric == INNER_PRODUCT else -1.0)
        self.squares = (self.questions**2).sum(axis=1)
        self.lengths = np.sqrt(self.squares)
        empty = (np.empty(0, np.float32), np.empty(0, np.int64))
        self.best = [empty for _ in question_ids]
        self.least = np.full(len(question_ids), -np.inf) if least is None else least.astype(np.float64)
        self.floor = self.least.copy()

    def add(self, ids: np.ndarray, vectors: np.ndarray, asking: np.ndarray | None = None) -> None:
        """``asking`` names the questions, by place, that these vectors can matter to; all if not given."""
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.einsum("ij,ij->i", vectors, vectors)
        if not np.isfinite(squares).all():
            # A vector that is not finite has no score, and must not push others out of the batch.
            finite = np.isfinite(vectors).all(axis=1)
            ids, vectors = ids[finite], vectors[finite]
        if not len(ids) or not len(self.question_ids):
            return
        exact = (vectors.astype(np.float64) ** 2).sum(axis=1)
        longest = math.sqrt(exact.max())
        # Sums of so many products in single precision are off by this share at most.
        error = 2 * (vectors.shape[1] + 4) * float(np.finfo(np.float32).eps)
        narrow = longest < 1e15 and self.lengths.max() < 1e15  # products stay within single precision
        every = np.arange(len(self.question_ids)) if asking is None else asking
        for low in range(0, len(every), _SCORE_BLOCK):
            block = every[low : low + _SCORE_BLOCK]
            if narrow:
                rough = self.rough[block] @ vectors.T
            else:
                rough = self.questions[block] @ vectors.T.astype(np.float64)
            margin = error * self.lengths[block] * longest
            if self.sign < 0:
                rough = 2 * rough - self.squares[block, None] - exact[None, :]
                margin = 2 * margin + error * (self.squares[block] + exact.max())
            floor = self.floor[block]
            if rough.shape[1] > self.k:
                # The k-th best of this batch is a floor as good as the k-th best so far.
                kth = np.partition(rough, rough.shape[1] - self.k, axis=1)[:, -self.k]
                floor = np.maximum(floor, kth - margin)
            # The candidates' final scores are rounded to single precision.
            slack = floor - margin - 1e-6 * (1.0 + np.where(np.isfinite(floor), np.abs(floor), 0))
            rows, columns = np.nonzero(rough >= slack[:, None])
            if len(rows):
                self._merge(block, rows, columns, ids, vectors)

    def _merge(self, block, rows, columns, ids, vectors) -> None:
        edges = np.searchsorted(rows, np.arange(rows[0], rows[-1] + 2))
        for at in range(len(edges) - 1):
            picked = columns[edges[at] : edges[at + 1]]
            if not len(picked):
                continue
            row = int(block[int(rows[0]) + at])
            score = self._scores(self.questions[row], vectors[picked].astype(np.float64))
            reached = score >= self.least[row]
            score = np.concatenate((self.best[row][0], score[reached]))
            found = np.concatenate((self.best[row][1], ids[picked][reached]))
            order = np.lexsort((found, -score))[: self.k]
            self.best[row] = (score[order], found[order])
            if len(order) == self.k:
                self.floor[row] = max(score[order[-1]], self.least[row])

    def _scores(self, question: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Higher is better; a row's score does not depend on its neighbours."""
        if self.sign > 0:
            return (vectors * question).sum(axis=1).astype(np.float32)
        return -((vectors - question) ** 2).sum(axis=1).astype(np.float32)

    def batch(self) -> pa.RecordBatch:
        counts = [len(found) for _, found in self.best]
        score = np.concatenate([s for s, _ in self.best]) if counts else np.empty(0, np.float32)
        found = np.concatenate([f for _, f in self.best]) if counts else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.question_ids, counts), pa.int64()),
                pa.array(found, pa.int64()),
                pa.array(score * np.float32(self.sign), pa.float32()),
            ],
            names=["query_id", "faiss_id", "score"],
        )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return np.empty((0, 0), np.float32)
    dimension, rest = divmod(len(values), len(column))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (lengths != dimension).any():
        raise ValueError("all vectors must have the same number of dimensions")
    return values.reshape(len(column), dimension)


def _scan(questions: Broadcast, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, least = questions.value
        best = BestK(ids, matrix, k, metric, least)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)))
        yield best.batch()

    return run


def merged(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """The best k of each question from the tasks' own best k; ``rank`` counts from 0."""
    order = [F.desc("score") if metric == INNER_PRODUCT else F.asc("score"), F.asc("faiss_id")]
    salted = Window.partitionBy("query_id", "salt").orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    # About the root of the number of lists, so that either step merges as many.
    shuffles = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(_MAX_SALTS, max(8, math.isqrt(shuffles) * 4))
    # The limit is on the bare row number, so Spark cuts each group before it shuffles.
    return (
        partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn("place", F.row_number().over(salted))
        .filter(F.col("place") <= k)
        .withColumn("place", F.row_number().over(whole))
        .filter(F.col("place") <= k)
        .select(
            "query_id",
            "faiss_id",
            F.col("score").cast("double").alias("score"),
            (F.col("place") - 1).alias("rank"),
        )
    )


@dataclass(frozen=True)
class Asked:
    """Questions ``query_id, vector`` as a written table, and how many there are."""

    frame: DataFrame
    n_questions: int
    n_blocks: int

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and vectors of one block after the other, each small enough to be broadcast."""
        for at in range(self.n_blocks):
            part = self.frame.where(F.col("block") == at) if self.n_blocks > 1 else self.frame
            few = part.select("query_id", "vector").toArrow()
            if few.num_rows:
                yield few.column("query_id").to_numpy(), _matrix(few.column("vector"))


def asked(questions: DataFrame, metric: str = INNER_PRODUCT, max_broadcast: int = MAX_BROADCAST_QUESTIONS) -> Asked:
    """``questions(query_id, embedding)`` ready to be sent out, in blocks by a hash of their ids.

    They are written once, so that whatever encodes them runs once; sizes come from the written table. Questions are scaled to
    unit length for the inner product only; those without a vector take no part.
    """
    spark = questions.sparkSession
    vector = F.col("embedding")
    scaled = l2_normalize(vector) if metric == INNER_PRODUCT else vector.cast("array<float>")
    path = scratch_path(spark, "questions")
    questions.select(F.col("query_id").cast("long").alias("query_id"), scaled.alias("vector")).write.parquet(path)
    table = spark.read.schema("query_id long, vector array<float>").parquet(path).where(F.col("vector").isNotNull())
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension")).first()
    most = max(1, min(max_broadcast, MAX_BROADCAST_BYTES // max(1, 4 * size["dimension"])))
    if size["rows"] <= most:
        return Asked(table, size["rows"], 1)
    blocks = math.ceil(size["rows"] / most)
    while True:
        # A hash does not deal evenly, so there are as many blocks as it takes for the fullest to fit.
        dealt = table.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        fullest = dealt.groupBy("block").count().agg(F.max("count")).first()[0]
        if fullest <= most or blocks >= 2 * size["rows"]:
            break
        blocks = math.ceil(blocks * max(1.2, fullest / most))
    path = scratch_path(spark, "question-blocks")
    dealt.write.partitionBy("block").parquet(path)
    table = spark.read.schema("query_id long, vector array<float>, block int").parquet(path)
    return Asked(table, size["rows"], blocks)


def _floors(hits: DataFrame, ids: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The k-th best score of each question among some vectors, or nothing where there are fewer."""
    last = hits.where(F.col("rank") == k - 1).select("query_id", "score").toArrow()
    order = np.argsort(ids)
    least = np.full(len(ids), -np.inf)
    found = last.column("score").to_numpy()
    at = order[np.searchsorted(ids[order], last.column("query_id").to_numpy())]
    least[at] = found if metric == INNER_PRODUCT else -found
    return least


def top_k(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = INNER_PRODUCT,
    max_broadcast: int = MAX_BROADCAST_QUESTIONS,
) -> Hits:
    """Best k of ``corpus(faiss_id, embedding)`` for each of ``questions(query_id, embedding)``.

    Rows without a vector take no part. The result has ``query_id, faiss_id, score, rank``. Ids of questions are
    unique. The corpus should be a stored table or cheap to compute: it is read once for each block of questions,
    and one vector in SAMPLED of it once more if there are several blocks, whose tasks then keep only what
    can be among the best k of all. The sample decides nothing but the floor, so results are exact.
    """
    vector = F.col("embedding")
    corpus = corpus.filter(vector.isNotNull()).select(
        F.col("faiss_id").cast("long").alias("faiss_id"), vector.cast("array<float>").alias("vector")
    )
    sent = asked(questions, metric, max_broadcast)
    sample = corpus.where(F.pmod(F.xxhash64("faiss_id"), F.lit(SAMPLED)) == 0)
    partial = [corpus.limit(0).mapInArrow(_nothing, _HIT_SCHEMA)] if not sent.n_questions else []
    for ids, matrix in sent.blocks():
        least = None
        if sent.n_blocks > 1:
            first = _sent(corpus, (ids, matrix, None))
            least = _floors(merged(sample.mapInArrow(_scan(first, k, metric), _HIT_SCHEMA), k, metric), ids, k, metric)
            first.unpersist()
        block = _sent(corpus, (ids, matrix, least))
        partial.append(corpus.mapInArrow(_scan(block, k, metric), _HIT_SCHEMA))
    found = partial[0]
    for more in partial[1:]:
        found = found.unionAll(more)
    return Hits(merged(found, k, metric), sent.n_questions * k)


def _sent(corpus: DataFrame, value: tuple) -> Broadcast:
    return corpus.sparkSession.sparkContext.broadcast(value)


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield BestK(np.empty(0, np.int64), np.empty((0, 1)), 1, INNER_PRODUCT).batch()


def with_chunk_rows(hits: Hits, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunk row; a hit whose id has no chunk row is dropped.

    Should an id come twice in ``chunks``, its row with the smallest chunk id is taken. The hits
    are broadcast only when their number is bounded; the chunks then stay where they are.
    """
    found = as_small(hits, hits.frame)
    fields = [name for name in chunks.columns if name != "faiss_id"]
    first = Window.partitionBy("query_id", "faiss_id").orderBy(F.col("chunk_id").asc_nulls_last())
    return (
        chunks.join(found, "faiss_id")
        .withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") == 1)
        .select("query_id", "faiss_id", *fields, "score", "rank")
    )


def as_small(hits: Hits, rows: DataFrame) -> DataFrame:
    """``rows``, at most one for each of ``hits``, with a broadcast hint where the number of hits is bounded."""
    if hits.max_rows is not None and hits.max_rows <= MAX_BROADCAST_HITS:
        return F.broadcast(rows)
    return rows
