"""Exact duplicates by sorting the texts themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.session import scratch_path

SPLITTER_CHARS = 32
WHITE = " \t\n\x0b\x0c\r"

_RUNS = "doc_id long, text_sha256 string, part int, run long, first_id long, first_chars long, size long, edge binary"
_RUNS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int64()),
     ("first_id", pa.int64()), ("first_chars", pa.int64()), ("size", pa.int64()), ("edge", pa.binary())]
)


def _runs(batches):
    """Rows of one sorted partition with the run of equal texts each belongs to.

    The first and the last run may go on in a neighbouring partition; one row of each carries its text.
    A run's ids wait until it ends; its rows in one partition are bounded by the partition.
    """
    part, number = TaskContext.get().partitionId(), 0
    ids, digests = [], []  # of the open run, as arrays
    opened = None  # (text, first id, first chars) of the open run

    def closed(edge: bool) -> pa.RecordBatch:
        text, first_id, first_chars = opened
        doc_id = pa.concat_arrays(ids)
        n = len(doc_id)
        columns = [
            doc_id,
            pa.array([digests[0]] * n, pa.string()),
            pa.array(np.full(n, part, np.int32)),
            pa.array(np.full(n, number)),
            pa.array([first_id] * n, pa.int64()),
            pa.array([first_chars] * n, pa.int64()),
            pa.array(np.full(n, n)),
            pa.array([text] + [None] * (n - 1), pa.binary()) if edge else pa.nulls(n, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_RUNS_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("norm").cast(pa.binary())
        equal = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.concatenate([[True], ~equal]))
        ends = np.append(heads[1:], len(texts))
        doc_ids, chars, sha = batch.column("doc_id"), batch.column("chars"), batch.column("text_sha256")
        at = 0
        if opened is not None and texts[0].as_py() == opened[0]:
            ids.append(doc_ids.slice(0, ends[0]))
            at = 1
        if at < len(heads):
            if opened is not None:
                yield closed(number == 0)
                number += 1
            whole = slice(at, len(heads) - 1)  # runs that lie inside this batch; the last one stays open
            first = heads[whole]
            if len(first):
                sizes = ends[whole] - first
                rows = np.arange(first[0], ends[whole][-1])
                run = np.repeat(np.arange(len(first)), sizes)
                edge = pa.nulls(len(rows), pa.binary())
                if number == 0:
                    edge = pa.array([texts[int(first[0])].as_py()] + [None] * (len(rows) - 1), pa.binary())
                lead = pa.array(first[run])
                columns = [
                    doc_ids.slice(rows[0], len(rows)), sha.slice(rows[0], len(rows)),
                    pa.array(np.full(len(rows), part, np.int32)), pa.array(number + run),
                    doc_ids.take(lead), chars.take(lead), pa.array(sizes[run]), edge,
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_RUNS_ARROW)
                number += len(first)
            last = int(heads[-1])
            opened = (texts[last].as_py(), doc_ids[last].as_py(), chars[last].as_py())
            ids, digests = [doc_ids.slice(last)], [sha[last].as_py()]
    if opened is not None:
        yield closed(True)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without white space; null counts as empty. Of equal texts the one with
    the most code points stays, then the smallest doc_id (null last); of equal rows with one doc_id all are
    marked kept, for they cannot be told apart. Other columns are not read.

    The rows are range-partitioned by sampled splitters and sorted by content, so equal texts are neighbours,
    and neighbours are compared in full. Splitters hold the first characters, a hash, the length and the id:
    they stay short, and a text that fills much of the table spreads over partitions. What partitions share at
    their edges, two runs each, is then put together.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "").alias("norm"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
    )
    # UTF-8 order of the first characters; equal texts have equal splitter columns up to the hash.
    order = [
        F.substring("norm", 1, SPLITTER_CHARS),
        F.xxhash64("norm"),
        F.col("chars").desc(),
        F.col("doc_id").asc_nulls_last(),
    ]
    within = [order[0], order[1], F.col("norm"), *order[2:]]
    path = scratch_path(spark, "content-runs")
    (
        rows.repartitionByRange(B.partitions(docs), *order)
        .sortWithinPartitions(*within)
        .select("doc_id", "norm", "chars", F.sha2("norm", 256).alias("text_sha256"))
        .mapInArrow(_runs, _RUNS)
        .write.parquet(path)
    )
    runs = spark.read.schema(_RUNS).parquet(path)

    # At most two runs of each partition: compared by their texts, joined by number.
    edges = runs.where(F.col("edge").isNotNull()).select("part", "run", "first_id", "first_chars", "size", "edge")
    best = F.struct(-F.col("first_chars"), F.col("first_id").isNull(), F.col("first_id"))
    joined = edges.groupBy("edge").agg(
        F.min_by("first_id", best).alias("edge_id"),
        F.sum("size").alias("edge_size"),
        F.collect_list(F.struct("part", "run")).alias("parts"),
    )
    spread = joined.select("edge_id", "edge_size", F.inline("parts")).select("part", "run", "edge_id", "edge_size")
    found = runs.drop("edge").join(F.broadcast(spread), ["part", "run"], "left")
    keep = F.when(F.col("edge_size").isNull(), F.col("first_id")).otherwise(F.col("edge_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("edge_size", "size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
