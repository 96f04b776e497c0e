"""Fingerprints that keep every shingle hash below a threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions.binding import let
from chalkline.llm import blocks as B

WORDS = 5
FRACTION = 1 / 16
LEAST = 32  # hashes that a short text keeps beyond the threshold
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1
_SKETCH = "struct<bound:bigint,hashes:array<bigint>>"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words in lower case, as often as they occur.

    Fewer words make one shingle of the whole sequence; no words make none.
    """

    def runs(found: Column) -> Column:
        head = F.slice(found, F.lit(1), F.greatest(F.size(found) - (words - 1), F.lit(1)))
        full = F.transform(head, lambda word, at: F.xxhash64(word, *[F.get(found, at + i) for i in range(1, words)]))
        short = F.transform(F.slice(found, 1, 1), lambda _: F.xxhash64(found))
        return F.when(F.size(found) >= words, full).otherwise(short)

    return let(F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda word: word != ""), runs)


def sketch(text: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """struct(bound, hashes): every distinct shingle hash up to ``bound``, in order.

    The bound is the fixed fraction of all hashes. Where fewer than ``least`` hashes lie below it the bound is
    that of the ``least``-th smallest, and a text with no more shingles keeps them all, so that short
    texts are compared without sampling. Sketches of parts merge: union the hashes up to the smaller bound.
    """
    limit = _LOWEST + int(fraction * 2**64)

    def kept(hashes: Column) -> Column:
        def chosen(below: Column) -> Column:
            enough = F.struct(F.lit(limit).alias("bound"), F.array_sort(below).alias("hashes"))
            first = let(
                F.array_sort(F.array_distinct(hashes)),
                lambda every: F.struct(
                    F.when(F.size(every) <= least, F.lit(_HIGHEST)).otherwise(F.get(every, F.lit(least - 1))).alias("bound"),
                    F.slice(every, 1, least).alias("hashes"),
                ),
            )
            return F.when(F.size(below) >= least, enough).otherwise(first)

        return let(F.array_distinct(F.filter(hashes, lambda value: value <= limit)), chosen)

    return let(shingle_hashes(text), kept).cast(_SKETCH)


def fingerprint_text(value: Column) -> Column:
    """A sketch as text: its bound and hashes in hexadecimal."""
    digits = F.transform(F.concat(F.array(value["bound"]), value["hashes"]), lambda h: F.lower(F.hex(h)))
    return F.array_join(digits, ",")


def _shared(left: Column, right: Column) -> tuple[Column, Column]:
    bound = F.least(left["bound"], right["bound"])
    return tuple(F.filter(s["hashes"], lambda value: value <= bound) for s in (left, right))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingle sets; two texts without words are alike."""
    a, b = _shared(left, right)
    return let(
        F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("any")),
        lambda n: F.when(n["any"] == 0, F.lit(1.0)).otherwise(n["both"] / n["any"]),
    )


def containment(left: Column, right: Column) -> Column:
    """Estimated share of the left text's shingles that the right text has; 1 if the left has no words.

    Both are read up to the smaller bound, which is never below the fixed fraction; so texts of very unequal
    lengths compare.
    """
    a, b = _shared(left, right)
    return let(
        F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(a).alias("own")),
        lambda n: F.when(n["own"] == 0, F.lit(1.0)).otherwise(n["both"] / n["own"]),
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its ``sketch`` for every row; null texts count as empty. No shuffle."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), sketch(F.coalesce(F.col(text), F.lit(""))).alias("sketch")
    )


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, own, next_text, next_own: a row, its sketch, and those of the next row by doc_id.

    After the last row comes the first. Null texts are empty, null ids come last, rows with one doc_id follow
    each other by their texts. Rows go to ranges of ids, whose bounds are approximate quantiles, and the first
    row of each range goes to the range before as well; so texts are shuffled once, and no window holds more
    than a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    count = B.partitions(docs)
    shares = [i / count for i in range(1, count)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 20 * count)).first()[0] or []
    bounds = sorted(set(bounds))
    block = _range_of(F.col("doc_id"), bounds).alias("block")
    # Ids and hashes only, one row per range.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"))
    heads = rows.select(block, place.alias("place")).groupBy("block").agg(F.min("place").alias("place")).collect()
    heads = sorted((row["block"], row["place"]["doc_id"], row["place"]["hash"]) for row in heads)
    wanted = [(heads[i - 1][0], *heads[i][1:]) for i in range(len(heads))]
    table = F.broadcast(spark.createDataFrame(wanted, "block int, head_id long, hash long"))
    matches = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("hash"))
    copies = rows.join(table, matches).groupBy("block", "doc_id", "text").agg(F.lit(True).alias("copy"))
    both = rows.select(block, "doc_id", "text", F.lit(False).alias("copy")).unionByName(copies)
    order = Window.partitionBy("block").orderBy("copy", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    follow = F.lead(F.struct("text", "own")).over(order)
    ahead = both.withColumn("own", sketch(F.col("text"))).withColumn("next", follow).where(~F.col("copy"))
    return ahead.select("doc_id", "text", "own", F.col("next.text").alias("next_text"), F.col("next.own").alias("next_own"))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """The number of bounds that are not above the value; null is above all. Two steps of about a root each."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    fine = F.array(
        *[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)]
    )
    part = F.size(F.filter(coarse, lambda b: b <= value))
    within = F.size(F.filter(F.get(fine, part - 1), lambda b: b <= value))
    return F.when(value.isNull(), F.lit(len(bounds))).when(part == 0, F.lit(0)).otherwise((part - 1) * step + within)


def fingerprints_and_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's sketch (own) beside those of its edited text (changed) and of the next row (following).

    The edited text has the last half of the code points, rounded down, replaced by as many of the next row's
    first ones, or all it has. An empty text is its own edited text. Other columns are not read.
    """
    rows = with_next(docs, doc_id, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        sketch(F.col("edited")).alias("changed"),
        F.col("next_own").alias("following"),
    )
