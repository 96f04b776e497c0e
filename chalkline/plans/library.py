"""End-to-end jobs: pages to a searchable library, and questions to prompts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.text import strip
from chalkline.operators.chunking import chunk_table
from chalkline.operators.embedding import HashedWords, ModelFactory, embed
from chalkline.operators.index import content_digest, index_table, manifest
from chalkline.operators.prompts import answer_prompts
from chalkline.operators.retrieval import ANSWER_K, retrieve
from chalkline.sources.manifest import read_manifest, write_manifest
from chalkline.schemas import MANIFEST
from chalkline.sources.tables import read_chunks, write_chunks, write_table


@dataclass(frozen=True)
class Library:
    """The tables of one index below a folder."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def chunks(self) -> DataFrame:
        return read_chunks(self.spark, self.path("chunks"))

    def index(self) -> DataFrame:
        return self.spark.read.parquet(self.path("index"))

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self.path("vectors"))

    def manifest(self) -> DataFrame:
        return read_manifest(self.spark, self.path("manifest"))


def build_library(
    pages: DataFrame,
    folder: str,
    factory: ModelFactory = HashedWords,
    model_name: str = "hashed-words",
    normalize: bool = True,
    catalog: str = "local",
    schema: str = "default",
    source_table: str = "chunks",
    created_at: Column | None = None,
) -> Library:
    """Cleaned pages -> chunks -> index table -> vectors -> manifest, each written once.

    Every step reads what the step before has written, so nothing is computed twice and a lost
    executor costs one step at most. The vectors are made from the index table, and so carry its
    ids without another join. The manifest is emptied first and written last: a folder whose build
    broke off has no manifest, and none of its tables counts as finished.
    """
    library = Library(pages.sparkSession, folder)
    write_manifest(library.spark.createDataFrame([], MANIFEST), library.path("manifest"))
    write_chunks(chunk_table(pages), library.path("chunks"))
    write_table(index_table(library.chunks()), library.path("index"))
    _write_vectors(library, factory, model_name, normalize)
    described = manifest(
        library.vectors(), model_name, catalog, schema, source_table, normalize, created_at,
        index_file="vectors", chunks_file="index",
    )
    write_manifest(described, library.path("manifest"))
    return library


def _contents(library: Library) -> DataFrame:
    return library.index().select("faiss_id", content_digest(F.col("text")).alias("digest"))


def _write_vectors(library: Library, factory: ModelFactory, model: str, normalize: bool) -> None:
    """Vectors, and then the digests of the texts they were made from."""
    write_table(embed(library.index(), "faiss_id", "text", factory, model, normalize), library.path("vectors"))
    write_table(_contents(library), library.path("contents"))


def build_vectors(library: Library, factory: ModelFactory = HashedWords) -> bool:
    """The vectors of a finished library, by the model and normalization its manifest names.

    Nothing is done, and false returned, when as many vectors are there as the manifest and the index table
    have, and every text is the one its vector was made from; vectors that are missing, half written or of other
    texts are made anew. Only ids and digests are compared.
    """
    described = library.manifest().first()
    if described is None:
        raise ValueError("the library has no finished manifest; build it first")
    try:
        found = library.vectors().count()
        made = library.spark.read.schema("faiss_id long, digest binary").parquet(library.path("contents"))
        now = _contents(library).withColumnRenamed("digest", "now")
        changed = not made.join(now, "faiss_id", "full").where(~F.col("digest").eqNullSafe(F.col("now"))).isEmpty()
    except AnalysisException:
        found, changed = None, True
    if found == described["num_vectors"] == library.index().count() and not changed:
        return False
    _write_vectors(library, factory, described["embedding_model"], described["normalize_embeddings"])
    return True


def search_library(
    library: Library,
    questions: DataFrame,
    k: int = ANSWER_K,
    factory: ModelFactory = HashedWords,
) -> DataFrame:
    """Hits of text questions ``query_id, question, target_subject, target_class``.

    The manifest names the model, so that questions and chunks go through the same one, and the
    metric. Question texts are stripped; null counts as empty.
    """
    described = library.manifest().first()
    asked = questions.select("query_id", strip(F.col("question")).alias("asked"))
    vectors = embed(
        asked, "query_id", "asked", factory, described["embedding_model"], normalize=False
    )
    return retrieve(
        vectors, library.vectors(), library.index(), k, metric=described["metric"], targets=questions
    )


def ask(library: Library, questions: DataFrame, **options) -> DataFrame:
    return answer_prompts(questions, search_library(library, questions, **options))
