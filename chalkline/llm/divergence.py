"""How far the sources of a language differ in the words they use.

Counts are whole numbers and shares are whole billionths, so every result is exact. The pairs of sources are
a product of the sparse table of counts with itself, built row by row: each source scatters its terms
through an index by term into one accumulator with a cell for every other source. Terms that a source lacks
have a small share, too, and are settled by a correction that needs each source's counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.operators.joins import join_small
from chalkline.session import scratch_path

LEAST_DOCS = 10  # documents of a language that have a kept term
ADDED = 2  # to every count
TOP_TERMS = 10
POSTINGS = 1 << 16  # of a slice of the index by term, about; a slice is one task's work
_BLOCK_BYTES = 4 * 1024 * 1024  # of texts that are counted at once
_DIGITS, _STEP = 3, 1000  # a share has three times three digits
_CELLS = 1 << 20  # of a correction that are held at once


@dataclass(frozen=True)
class Profiles:
    """kept: lang, term, source, n, lang_n. groups: lang, source, place, total, n_terms, lang_total."""

    kept: DataFrame
    groups: DataFrame


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.text_blocks(batches, "text", _BLOCK_BYTES):
        words, firsts = B.letter_runs(*B.text_bytes(batch.column("text")))
        if not len(words):
            continue
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
        # A word of a document once, with the number of its places there.
        places, times = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        langs, sources = (batch.column(name).dictionary_encode() for name in ("lang", "source"))
        pairs = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        group, one, of = np.unique(pairs, return_index=True, return_inverse=True)
        cells = of[places // size] * size + places % size
        order = np.argsort(cells, kind="stable")
        cells, starts = np.unique(cells[order], return_index=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").take(pa.array(one[cells // size])),
                batch.column("source").take(pa.array(one[cells // size])),
                coded.dictionary.take(pa.array(cells % size)).cast(pa.binary()),
                pa.array(np.add.reduceat(times[order], starts)),
                pa.array(np.diff(np.append(starts, len(order)))),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def profiles(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS
) -> Profiles:
    """Counts of the kept terms of every (lang, source) of ``docs``.

    Nulls count as empty. A language keeps the terms that at least ``least_docs`` of its rows have; repeated
    rows count each. Counts are added up in each task, then by (lang, term, source), so neither a large
    source nor a frequent term is one task's work. Groups without any kept term have a total of 0. Only the
    three columns are read; a very long text is a block of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = (
        rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    of_term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    path = scratch_path(spark, "kept-terms")
    summed.where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n").write.parquet(path)
    kept = spark.read.schema("lang string, term binary, source string, n long, lang_n long").parquet(path)

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    every = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = every.select(
        "lang",
        "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in ("total", "n_terms", "lang_total")],
    )
    path = scratch_path(spark, "groups")
    groups.write.parquet(path)
    return Profiles(kept, spark.read.schema(groups.schema).parquet(path))


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + the whole billionths of (count + 2) / (total + 2 * n_terms), by long division, which cannot overflow."""
    of = total + ADDED * n_terms
    rest, found = count + ADDED, F.lit(0).cast("long")
    for _ in range(_DIGITS):
        rest = rest * _STEP
        found = found * _STEP + F.call_function("div", rest, of)
        rest = rest % of
    return found + 1


def _shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    rest, found = count + ADDED, np.int64(0)
    for _ in range(_DIGITS):
        rest = rest * _STEP
        found = found * _STEP + rest // of
        rest = rest % of
    return found + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _correction(shares: np.ndarray, base: np.ndarray, own: int) -> np.ndarray:
    """What terms with these shares in group ``own`` add against every group that lacks them, beyond two bases."""
    found = np.zeros(len(base), np.int64)
    values, times = np.unique(shares, return_counts=True)
    step = max(1, _CELLS // len(base))
    for low in range(0, len(values), step):
        some = values[low : low + step, None]
        found += (times[low : low + step, None] * (_gap(some, base) - _gap(base[own], base))).sum(axis=0)
    return found


def _accumulate(postings: pa.Table, groups: pa.Table) -> pa.Table:
    """Rows (lang, own, sums, mirrored) of one slice of a language's terms.

    sums[j] adds to the divergence of groups own and j; mirrored[j] adds to that of j and own.
    """
    order = np.argsort(groups.column("place").to_numpy())
    names = groups.column("source").combine_chunks().take(pa.array(order))
    total, n_terms = (groups.column(name).to_numpy()[order] for name in ("total", "n_terms"))
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    none = np.zeros(len(order), np.int64)
    of = total + ADDED * n_terms
    base = _shares(none, np.maximum(of, 1))
    if len(order) and groups.column("slice")[0].as_py() == 0:
        rows += [(i, n_terms * _gap(base[i], base), none) for i in range(len(order))]
    if postings.num_rows:
        group = pc.index_in(postings.column("source"), value_set=names).to_numpy()
        term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        by_term = np.lexsort((group, term))
        group, term = group[by_term], term[by_term]
        p = _shares(postings.column("n").to_numpy()[by_term], of[group])
        starts = np.searchsorted(term, np.arange(term[-1] + 2))
        by_group = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[by_group], np.arange(len(order) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            own = by_group[bounds[i] : bounds[i + 1]]
            lengths = np.diff(starts)[term[own]]
            met = B.gather(starts[:-1][term[own]], lengths)
            peer, mine, theirs = group[met], np.repeat(p[own], lengths), p[met]
            sums = none.copy()
            both = _gap(mine, theirs) - _gap(mine, base[peer]) - _gap(base[i], theirs) + _gap(base[i], base[peer])
            np.add.at(sums, peer, both)
            single = _correction(p[own], base, int(i))
            rows.append((int(i), sums + single, single))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * len(order)
    lang = groups.column("lang")[0].as_py() if len(order) else ""
    cells = [np.concatenate([row[at] for row in rows] or [none]) for at in (1, 2)]
    return pa.table(
        {
            "lang": pa.array([lang] * len(rows), pa.string()),
            "own": pa.array([row[0] for row in rows], pa.int32()),
            "sums": pa.ListArray.from_arrays(ends, cells[0]),
            "mirrored": pa.ListArray.from_arrays(ends, cells[1]),
        }
    )


def pair_divergence(found: Profiles, postings: int = POSTINGS) -> DataFrame:
    """lang, source, item, value, rank of every two sources of a language.

    The index by term is dealt out in slices of about ``postings`` entries by a hash of the term. A task scatters
    the rows of one slice into accumulators, a row at a time; it never holds more than the slice and one
    number per source. Partial accumulators of the slices are added up.
    """
    spark = found.kept.sparkSession
    slices = max(1, math.ceil(found.kept.count() / postings))
    dealt = found.kept.select(
        "lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice")
    )
    every = found.groups.select(
        "lang", "source", "place", "total", "n_terms", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    )
    partial = (
        dealt.groupBy("lang", "slice")
        .cogroup(every.groupBy("lang", "slice"))
        .applyInArrow(_accumulate, "lang string, own int, sums array<long>, mirrored array<long>")
    )
    path = scratch_path(spark, "accumulators")
    partial.write.parquet(path)
    partial = spark.read.schema(partial.schema).parquet(path)
    straight = partial.select("lang", "own", F.posexplode("sums").alias("peer", "value"))
    turned = partial.select("lang", F.col("own").alias("peer"), F.posexplode("mirrored").alias("own", "value"))
    cells = straight.unionByName(turned).where("own <> peer").groupBy("lang", "own", "peer").agg(F.sum("value").alias("value"))
    named = found.groups.select("lang", F.col("place").alias("own"), "source")
    items = found.groups.select("lang", F.col("place").alias("peer"), F.col("source").alias("item"))
    cells = join_small(join_small(cells, named, ["lang", "own"]), items, ["lang", "peer"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return cells.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def leading_terms(found: Profiles, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank of the ``top`` terms that a source uses more than its language does."""
    groups = found.groups.drop("place")
    joined = join_small(found.kept, groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("n_terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    over = joined.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (
        over.select("lang", "source", "term", value.alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.col("term").cast("string").alias("item"), "value", "rank")
    )


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: both reports in one table."""
    found = profiles(docs, lang, source, text)
    parts = {"pair": pair_divergence(found), "term": leading_terms(found)}
    pair, term = (
        part.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        for name, part in parts.items()
    )
    return pair.unionByName(term)
