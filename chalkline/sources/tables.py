"""Readers and writers of the library's tables (parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.schemas import CHUNKS, EMBEDDINGS, RAW_PAGES

EMPTY_SUBJECT = "__empty__"
CHUNK_PARTITIONS = ["class_num", "subject"]


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With the schema given, nothing is inferred: a class ``07`` stays text, also as a folder."""
    return spark.read.schema(schema).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RAW_PAGES)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    subject = F.when(F.col("subject") == EMPTY_SUBJECT, F.lit("")).otherwise(F.col("subject"))
    return read_table(spark, path, CHUNKS).withColumn("subject", subject).select(*CHUNKS.fieldNames())


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, EMBEDDINGS)


def write_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Partitioned by class and subject.

    The rebalance hint groups rows by folder, so that tasks do not each write into every folder,
    and splits a folder that holds much of the table over several tasks and files. A folder name
    cannot be empty, and null has one of its own, so an empty subject is stored under another name.
    """
    subject = F.when(F.col("subject") == "", F.lit(EMPTY_SUBJECT)).otherwise(F.col("subject"))
    chunks = chunks.withColumn("subject", subject)
    balanced = chunks.hint("rebalance", *[F.col(name) for name in CHUNK_PARTITIONS])
    balanced.write.mode("overwrite").partitionBy(*CHUNK_PARTITIONS).parquet(path)


def write_if_absent(table: DataFrame, path: str) -> None:
    """Does nothing, not even compute the table, when the path already holds one."""
    write_table(table, path, mode="ignore")
