"""The manifest as a JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators.search import INNER_PRODUCT
from chalkline.schemas import MANIFEST

_BROKEN = "_broken"


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """path, the manifest's fields and ``error`` of every manifest file; of a file that is broken off or no JSON object, the error alone.

    Unknown fields are dropped and two absent fields take their defaults. A manifest without a model is an error, too, for
    nothing could be searched by it.
    """
    found = (
        spark.read.schema(T.StructType([*MANIFEST.fields, T.StructField(_BROKEN, T.StringType())]))
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .json(list(paths))
        .withColumn("path", F.col("_metadata.file_path"))
    )
    error = F.when(F.col(_BROKEN).isNotNull(), "the manifest is not a whole JSON object").when(
        F.col("embedding_model").isNull(), "the manifest names no embedding model"
    )
    found = found.withColumn("error", error)
    given = {name: F.when(F.col("error").isNull(), F.col(name)) for name in MANIFEST.fieldNames()}
    given["normalize_embeddings"] = F.when(F.col("error").isNull(), F.coalesce("normalize_embeddings", F.lit(True)))
    given["metric"] = F.when(F.col("error").isNull(), F.coalesce("metric", F.lit(INNER_PRODUCT)))
    return found.withColumns(given).select("path", *MANIFEST.fieldNames(), "error")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The fields of one manifest; a file that is none stops the job with its path and what is wrong."""
    found = read_manifests(spark, path)
    broken = F.raise_error(F.concat("path", F.lit(": "), "error"))
    checked = F.when(F.col("error").isNull(), F.col("embedding_model")).otherwise(broken)
    return found.withColumn("embedding_model", checked).select(*MANIFEST.fieldNames())
