"""Question batches to filtered hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.search import INNER_PRODUCT, as_small, top_k, with_chunk_rows

# Width of the net, hits kept for an answer, for a quiz and by the filter alone, and
# the value that switches a filter off.
NET = 100
ANSWER_K = 3
QUIZ_K = 5
FILTER_K = 7
ANY = "All"


def _off(target: Column) -> Column:
    return F.coalesce(target, F.lit("")).isin("", ANY)


def subject_matches(subject: Column, target: Column) -> Column:
    """Prefix match that ignores case; always true when the target is off."""
    return _off(target) | F.lower(subject.cast("string")).startswith(F.lower(target))


def class_matches(class_: Column, target: Column) -> Column:
    return _off(target) | (class_.cast("string") == target)


def filter_hits(hits: DataFrame, k: int = FILTER_K) -> DataFrame:
    """First k hits of each question, by rank, among those that match its targets.

    ``hits`` carries ``target_subject`` and ``target_class``. Ranks are kept as they are, so they
    have gaps where hits were dropped.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.filter(subject_matches(F.col("subject"), F.col("target_subject")))
        .filter(class_matches(F.col("class"), F.col("target_class")))
        .withColumn("place", F.row_number().over(by_rank))
        .filter(F.col("place") <= k)
        .drop("place")
    )


def retrieve(
    questions: DataFrame,
    corpus: DataFrame,
    chunks: DataFrame,
    k: int = ANSWER_K,
    net: int = NET,
    metric: str = INNER_PRODUCT,
    targets: DataFrame | None = None,
    **search_options,
) -> DataFrame:
    """Wide-net search: best ``net`` of the whole corpus, then the metadata filter, then first k.

    The filter comes after the net, as in the index this stands for, so fewer than k rows may
    come back although the corpus holds more matches. ``targets`` holds the two targets of each
    question where ``questions`` does not.

    The net meets only ids, subjects and classes; texts are fetched for the k rows left. An id and a chunk
    id name one row of ``chunks``.
    """
    hits = top_k(questions, corpus, k=net, metric=metric, **search_options)
    targets = (questions if targets is None else targets).select(
        "query_id", "target_subject", "target_class"
    )
    narrow = with_chunk_rows(hits, chunks.select("faiss_id", "chunk_id", "subject", "class"))
    kept = filter_hits(narrow.join(targets, "query_id"), k).drop("subject", "class")
    kept = as_small(hits, kept.withColumnsRenamed({"faiss_id": "_id", "chunk_id": "_chunk"}))
    same = (F.col("faiss_id") == F.col("_id")) & F.col("chunk_id").eqNullSafe(F.col("_chunk"))
    fields = [name for name in chunks.columns if name != "faiss_id"]
    return chunks.join(kept, same).select(
        "query_id", "faiss_id", *fields, "score", "rank", "target_subject", "target_class"
    )
