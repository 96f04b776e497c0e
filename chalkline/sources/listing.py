"""Files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Names and sizes of the files with the suffix, by name. Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
        .orderBy("name")
    )
