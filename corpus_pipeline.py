"""The corpus pipeline: documents through stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import jaccard, lines, packing, pii, quality
from chalkline.llm.queries import documents, quality_labels, word_tokenizer
from chalkline.session import scratch_path, tune


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Ids held out for its test teach it nothing here either."""
    spark = tune(spark)
    model = quality.fit(documents(spark, sf_dir), quality_labels(spark, sf_dir))
    scored = quality.score(docs, model, name="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; n_chars follows the text."""
    return _counted(lines.drop_boilerplate(docs, host="source"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingles connect: that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by marks; n_chars follows the text."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences along the curve."""
    return packing.pack(docs, word_tokenizer())


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: The classifier's votes are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what each returns is written and read again."""
    docs = documents(tune(spark), sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        found = stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
    return docs
