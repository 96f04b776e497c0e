"""Libraries that are rebuilt as pages change, encoding only texts that are new.

A root folder holds one folder per version with that version's tables, and the encoded texts by the digest of
their content, one batch per version and model. A version counts from the moment its manifest is there, which is
written last; what a build that broke off has left behind is written over by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators.chunking import chunk_table
from chalkline.operators.embedding import HashedWords, ModelFactory, embed
from chalkline.operators.index import content_digest, index_table, manifest
from chalkline.operators.joins import join_small
from chalkline.plans.library import Library
from chalkline.session import sparing_disk
from chalkline.sources.manifest import read_manifests, write_manifest
from chalkline.sources.tables import write_chunks, write_table

_ENCODED = "digest binary, embedding array<float>"


@dataclass(frozen=True)
class Update:
    """A finished version, and how many texts had to be encoded for it."""

    library: Library
    version: int
    n_chunks: int
    n_encoded: int


def finished_versions(spark: SparkSession, root: str) -> DataFrame:
    """version, embedding_model, normalize_embeddings, num_vectors of the versions with a manifest, one row each.

    A manifest that cannot be read stops the job, for the next version would take its number.
    """
    found = read_manifests(spark, f"{root}/v*/manifest")
    number = F.regexp_extract("path", r"/v([0-9]+)/manifest(?:/[^/]*)?$", 1).cast("int").alias("version")
    broken = F.raise_error(F.concat("path", F.lit(": "), "error"))
    model = F.when(F.col("error").isNull(), F.col("embedding_model")).otherwise(broken).alias("embedding_model")
    return found.select(number, model, "normalize_embeddings", "num_vectors")


def _versions(spark: SparkSession, root: str) -> list:
    try:
        return finished_versions(spark, root).orderBy("version").collect()  # one row a version
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return []
        raise


def current(spark: SparkSession, root: str) -> Library | None:
    """The newest finished version."""
    versions = _versions(spark, root)
    return Library(spark, f"{root}/v{versions[-1]['version']}") if versions else None


def new_texts(index: DataFrame, known: DataFrame | None) -> DataFrame:
    """digest, text of the texts of ``index`` that ``known(digest)`` does not have, each content once.

    Digests and ids find them; the texts stay where they are unless a great many are new.
    """
    keys = index.select(content_digest(F.col("text")).alias("digest"), "faiss_id")
    if known is not None:
        keys = keys.join(known.select("digest"), "digest", "left_anti")
    first = keys.groupBy("digest").agg(F.min("faiss_id").alias("faiss_id"))
    return join_small(index.select("faiss_id", "text"), first, "faiss_id").select("digest", "text")


def update_library(
    pages: DataFrame,
    root: str,
    factory: ModelFactory = HashedWords,
    model_name: str = "hashed-words",
    normalize: bool = True,
    catalog: str = "local",
    schema: str = "default",
    source_table: str = "chunks",
    created_at: Column | None = None,
) -> Update:
    """A new version of the library below ``root`` from all of its cleaned pages.

    Pages are chunked and indexed anew, which is cheap beside the model; vectors are taken over by the content they
    belong to, whatever the chunk's id has become, as far as an earlier version has them by the same model and
    normalization. Every version keeps all of its tables, so most of the disk is theirs.
    """
    spark = pages.sparkSession
    with sparing_disk(spark):
        versions = _versions(spark, root)
        version = versions[-1]["version"] + 1 if versions else 1
        library = Library(spark, f"{root}/v{version}")

        def batch(number: int) -> str:
            return f"{root}/encoded/v{number}"

        write_chunks(chunk_table(pages), library.path("chunks"))
        write_table(index_table(library.chunks()), library.path("index"))
        index = library.index()
        same = [v["version"] for v in versions if (v["embedding_model"], v["normalize_embeddings"]) == (model_name, normalize)]
        known = spark.read.schema(_ENCODED).parquet(*map(batch, same)) if same else None
        encoded = embed(new_texts(index, known), "digest", "text", factory, model_name, normalize)
        write_table(encoded, batch(version))
        encoded = spark.read.schema(_ENCODED).parquet(*map(batch, [*same, version]))
        ids = index.select("faiss_id", content_digest(F.col("text")).alias("digest"))
        write_table(ids.join(encoded, "digest").select("faiss_id", "embedding"), library.path("vectors"))
        write_table(ids, library.path("contents"))
        described = manifest(
            library.vectors(), model_name, catalog, schema, source_table, normalize, created_at,
            index_file="vectors", chunks_file="index",
        )
        write_manifest(described, library.path("manifest"))
        return Update(library, version, index.count(), spark.read.schema(_ENCODED).parquet(batch(version)).count())
