"""Boilerplate lines: those that many pages of one site share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.binding import let
from chalkline.session import scratch_path

MAX_RATIO = 0.02
LEAST_PAGES = 2  # a line of a single page is shared with nobody
BROADCAST_BYTES = 32 * 1024 * 1024
_KEY_BYTES = 64  # of one boilerplate line in a broadcast: host, 16 bytes of digest and what holds them


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO
) -> DataFrame:
    """host, line_key, n_pages, n_host_pages of the lines on more than ``max_ratio`` of a host's pages.

    Rows of a host with equal texts are one page, so copies of a page do not make its lines boilerplate; null
    texts of a host are one page without lines. A line counts once per page, trimmed of blanks; blank lines
    never count. The ratio alone decides, but for lines of a single page. Pages without a host form one host
    of their own. Pages and lines are known by 128-bit digests.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).withColumn("page", _key(F.col("text")))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_host_pages"))
    trimmed = F.transform(_lines(F.col("text")), lambda line: F.trim(line))
    lines = pages.select("host", "page", F.explode(F.array_distinct(trimmed)).alias("line")).where(F.col("line") != "")
    counts = (
        lines.select("host", "page", _key(F.col("line")).alias("line_key"))
        .distinct()
        .groupBy("host", "line_key")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= LEAST_PAGES)
    )
    totals = totals.withColumnRenamed("host", "total_host")
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("n_pages") > max_ratio * F.col("n_host_pages"))
        .select("host", "line_key", "n_pages", "n_host_pages")
    )


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs``, all columns and rows, without the boilerplate lines of each row's host in ``text``.

    The lines left keep their order and spelling. A null or empty text stays as it is, as does every text
    that holds no boilerplate; a text of nothing else becomes empty. Equal rows stay equal rows. A very long
    text is cut into lines in its task; nothing but digests of lines leaves it. Columns of any name pass.

    The boilerplate lines are written first. While they fit ``broadcast_bytes`` they go to the texts, one
    sorted array per host; otherwise lines, texts and hosts meet by shuffles, a line at a time.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "boilerplate")
    found = boilerplate_lines(docs, host, text, max_ratio)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    longest = found.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("host")), F.lit(0))).first()
    rows = docs.select(
        F.struct(*[docs[name] for name in docs.columns]).alias("row"), docs[host].alias("host"), docs[text].alias("text")
    )
    few = longest[0] * (_KEY_BYTES + longest[1]) <= broadcast_bytes
    cleaned = _by_host(rows, found) if few else _by_line(rows, found)
    return cleaned.select(
        *[F.col("cleaned").alias(text) if name == text else F.col("row")[name].alias(name) for name in docs.columns]
    )


def _among(keys: Column, key: Column) -> Column:
    """Whether a sorted array has a key, by halving: an array function would compare it with every element."""
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(keys) + 1)).cast("int"))
    every = F.struct(F.lit(0).alias("low"), F.size(keys).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        upper = F.get(keys, middle) <= key
        return F.struct(
            F.when(upper, middle).otherwise(state["low"]).alias("low"),
            F.when(upper, state["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(halvings, every, halve, lambda state: F.get(keys, state["low"]) == key)


def _by_host(rows: DataFrame, found: DataFrame) -> DataFrame:
    hosts = found.groupBy(F.col("host").alias("known_host")).agg(F.sort_array(F.collect_set("line_key")).alias("keys"))
    joined = rows.join(F.broadcast(hosts), F.col("host").eqNullSafe(F.col("known_host")), "left")
    keyed = F.transform(
        _lines(F.col("text")), lambda line: F.struct(line.alias("line"), _key(F.trim(line)).alias("key"))
    )
    left = F.filter(keyed, lambda item: ~_among(F.col("keys"), item["key"]))
    kept = F.concat_ws("\n", F.transform(left, lambda item: item["line"]))
    bare = F.col("keys").isNull() | F.col("text").isNull()
    return joined.withColumn("cleaned", F.when(bare, F.col("text")).otherwise(kept))


def _by_line(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Only places of lines are shuffled with the boilerplate; a text meets those of its own lines.

    Rows are known by digests of host and text, for equal pages lose equal lines.
    """
    page = F.unhex(F.sha2(F.to_json(F.struct(F.col("host").alias("h"), F.col("text").alias("t"))), 256))
    marked = rows.withColumn("page", page)
    lines = marked.select("page", "host", F.posexplode(_lines(F.col("text"))).alias("at", "line")).select(
        "page", "host", "at", _key(F.trim("line")).alias("line_key")
    )
    known = found.select(F.col("host").alias("known_host"), F.col("line_key").alias("known_key"))
    hits = (
        lines.join(known, F.col("host").eqNullSafe(F.col("known_host")) & (F.col("line_key") == F.col("known_key")))
        .groupBy(F.col("page").alias("hit"))
        .agg(F.collect_set("at").alias("places"))
    )
    joined = marked.join(hits, F.col("page") == F.col("hit"), "left")

    def without(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("places"))
        return F.concat_ws("\n", F.transform(left, lambda at: F.get(parts, at)))

    kept = let(_lines(F.col("text")), without)
    return joined.withColumn("cleaned", F.when(F.col("places").isNull(), F.col("text")).otherwise(kept))
