"""Vectors stored in blocks that exact search can skip.

Near vectors are stored together, at most BLOCK_ROWS in a row of the table, with their mean, the largest distance
from it, and the range of their lengths. By the triangle inequality these bound the score that any
vector of the block can have for a question. A first pass over a sample of the blocks gives every question a
score that its k-th best hit reaches at least; a block whose bound stays below it is not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.search import INNER_PRODUCT, MAX_BROADCAST_QUESTIONS, BestK, Hits, _floors, _matrix, asked, merged
from chalkline.session import scratch_path

BLOCK_ROWS = 1024
SAMPLE_ROWS = 4096  # vectors that the cells are found by; they decide how well blocks skip, never a result
MAX_CELLS = 256
_ROUNDS = 6
SAMPLED = 16  # one block in so many takes part in the first pass

BLOCKS = (
    "block long, ids array<long>, vectors array<float>, mean array<float>, radius double, shortest double, longest double"
)
_HIT_SCHEMA = "query_id long, faiss_id long, score float"


def _cells(corpus: DataFrame, wanted: int) -> np.ndarray:
    """Middles of some cells, by a few rounds of moving them to the mean of their vectors, over a bounded sample."""
    few = corpus.orderBy(F.xxhash64("faiss_id"), "faiss_id").limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = _matrix(few.column("vector")).astype(np.float64)
    sample = sample[np.isfinite(sample).all(axis=1)]
    count = min(MAX_CELLS, max(1, wanted), len(sample))
    if not count:
        return np.zeros((0, 0))
    middles = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(_ROUNDS):
        nearest = _nearest(sample, middles)
        for cell in range(count):
            own = sample[nearest == cell]
            if len(own):
                middles[cell] = own.mean(axis=0)
    return middles


def _nearest(vectors: np.ndarray, middles: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        distance = (middles**2).sum(axis=1) - 2 * (vectors @ middles.T)
    return np.argmin(np.nan_to_num(distance, nan=np.inf, posinf=np.inf, neginf=np.inf), axis=1)


def _block(number: int, ids: np.ndarray, vectors: np.ndarray) -> tuple:
    exact = vectors.astype(np.float64)
    lengths = np.sqrt((exact**2).sum(axis=1))
    mean = exact.mean(axis=0).astype(np.float32)
    # Rounded up, so that the bound holds for the stored mean as it is.
    radius = np.sqrt(((exact - mean.astype(np.float64)) ** 2).sum(axis=1).max()) * (1 + 1e-9)
    return number, ids, vectors.ravel(), mean, radius, lengths.min(), lengths.max()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.float32()), *[pa.float64()] * 3]
    names = ["block", "ids", "vectors", "mean", "radius", "shortest", "longest"]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def vector_blocks(corpus: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``corpus(faiss_id, embedding)`` as blocks; rows without a vector or with one that is not finite have no score and are left out.

    Every vector goes to the cell whose middle is nearest. Vectors are shuffled once, by cell and, so that a
    large cell is not one task's, by a hash of their id as well; tasks cut what they get, cell by cell.
    """
    spark = corpus.sparkSession
    vector = F.col("embedding").cast("array<float>")
    corpus = corpus.where(F.col("embedding").isNotNull()).select(F.col("faiss_id").cast("long").alias("faiss_id"), vector.alias("vector"))
    rows = corpus.count()
    middles = _cells(corpus, rows // block_rows)
    shared = spark.sparkContext.broadcast(middles)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = min(parts, max(1, rows // max(1, 4 * block_rows * len(middles))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = _nearest(_matrix(batch.column(1)).astype(np.float64), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "faiss_id", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray]] = []
        cell, size = None, 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            if not held:
                return
            ids, vectors = (np.concatenate([part[at] for part in held]) for at in (0, 1))
            held.clear()
            done = 0
            while len(ids) - done >= max(least, 1):
                upto = min(done + block_rows, len(ids))
                yield _record([_block(number, ids[done:upto], vectors[done:upto])])
                number, done = number + 1, upto
            size = len(ids) - done
            if size:
                held.append((ids[done:], vectors[done:]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            finite = np.isfinite(vectors).all(axis=1)
            cells, ids, vectors = cells[finite], ids[finite], vectors[finite]
            for one in np.unique(cells):
                if one != cell:
                    yield from flush(1)
                    cell = one
                own = cells == one
                held.append((ids[own], vectors[own]))
                size += int(own.sum())
                if size >= block_rows:
                    yield from flush(block_rows)
        yield from flush(1)

    placed = corpus.mapInArrow(place, "cell int, faiss_id long, vector array<float>")
    dealt = placed.repartition(parts, "cell", F.pmod(F.xxhash64("faiss_id"), F.lit(pieces)))
    return dealt.sortWithinPartitions("cell").mapInArrow(cut, BLOCKS)


def _bounds(questions: np.ndarray, mean: np.ndarray, radius: np.ndarray, longest: np.ndarray, metric: str) -> np.ndarray:
    """The highest score (question, block) that a vector of each block can have, with room for rounding."""
    lengths = np.sqrt((questions**2).sum(axis=1))[:, None]
    if metric == INNER_PRODUCT:
        bound = np.minimum(questions @ mean.T + lengths * radius, lengths * longest)
    else:
        square = (questions**2).sum(axis=1)[:, None] - 2 * questions @ mean.T + (mean**2).sum(axis=1)
        bound = -(np.maximum(np.sqrt(np.maximum(square, 0)) - radius - 1e-6 * (1 + longest + lengths), 0) ** 2)
    return bound + 1e-6 * (1 + np.abs(bound))


def _scan(questions: Broadcast, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, least = questions.value
        best = BestK(query_ids, matrix, k, metric, least)
        for batch in batches:
            if not batch.num_rows or not len(query_ids):
                continue
            mean = _matrix(batch.column("mean")).astype(np.float64)
            radius, longest = (batch.column(name).to_numpy() for name in ("radius", "longest"))
            bounds = _bounds(best.questions, mean, radius, longest, metric)
            # The most promising block first; it raises the floors for the others.
            for at in np.argsort(-bounds.max(axis=0), kind="stable"):
                asking = np.flatnonzero(bounds[:, at] >= best.floor - 1e-6 * (1 + np.abs(np.nan_to_num(best.floor, neginf=0))))
                if len(asking):
                    ids = batch.column("ids")[int(at)].values.to_numpy()
                    vectors = batch.column("vectors")[int(at)].values.to_numpy().reshape(len(ids), -1)
                    best.add(ids, vectors, asking)
        yield best.batch()

    return run


def top_k_blocks(
    questions: DataFrame, blocks: DataFrame, k: int = 5, metric: str = INNER_PRODUCT, max_broadcast: int = MAX_BROADCAST_QUESTIONS
) -> Hits:
    """As ``search.top_k``, over stored ``vector_blocks``: the same hits, without scoring blocks that cannot matter.

    Questions go out in blocks of bounded size; stored vectors stay where they are.
    """
    spark = blocks.sparkSession
    sent = asked(questions, metric, max_broadcast)
    fields = ["ids", "vectors", "mean", "radius", "longest"]
    sample = blocks.where(F.pmod(F.xxhash64("block"), F.lit(SAMPLED)) == 0).select(*fields)
    found = None
    for ids, matrix in sent.blocks():
        first = spark.sparkContext.broadcast((ids, matrix, None))
        least = _floors(merged(sample.mapInArrow(_scan(first, k, metric), _HIT_SCHEMA), k, metric), ids, k, metric)
        first.unpersist()
        block = spark.sparkContext.broadcast((ids, matrix, least))
        part = blocks.select(*fields).mapInArrow(_scan(block, k, metric), _HIT_SCHEMA)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], _HIT_SCHEMA)
    return Hits(merged(found, k, metric), sent.n_questions * k)


def skipped_share(
    questions: DataFrame, blocks: DataFrame, hits: Hits, k: int, metric: str = INNER_PRODUCT, max_broadcast: int = MAX_BROADCAST_QUESTIONS
) -> DataFrame:
    """One row: questions times vectors, how many of these pairs the final floors of ``hits`` rule out, and their share.

    It reads what describes the blocks, not the vectors. A search skips about as many, fewer while its floors are still low.
    """
    spark = blocks.sparkSession
    stored = scratch_path(spark, "hits")
    hits.frame.write.parquet(stored)
    final = spark.read.schema(hits.frame.schema).parquet(stored)
    described = blocks.select("mean", "radius", "longest", F.size("ids").cast("long").alias("n"))
    counted = None
    sent = asked(questions, metric, max_broadcast)
    for ids, matrix in sent.blocks():
        own = final.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "query_id long")), "query_id")
        shared = spark.sparkContext.broadcast((matrix.astype(np.float64), _floors(own, ids, k, metric)))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asking, least = shared.value
            for batch in batches:
                if batch.num_rows:
                    radius, longest, n = (batch.column(name).to_numpy() for name in ("radius", "longest", "n"))
                    bounds = _bounds(asking, _matrix(batch.column("mean")).astype(np.float64), radius, longest, metric)
                    skipped = int(((bounds < least[:, None]) * n).sum())
                    yield pa.RecordBatch.from_pydict({"pairs": [int(n.sum()) * len(asking)], "skipped": [skipped]})

        part = described.mapInArrow(count, "pairs long, skipped long")
        counted = part if counted is None else counted.unionAll(part)
    if counted is None:
        counted = spark.createDataFrame([], "pairs long, skipped long")
    total = counted.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return total.withColumn("share", F.when(F.col("pairs") > 0, F.col("skipped") / F.col("pairs")).otherwise(F.lit(0.0)))
