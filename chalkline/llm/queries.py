"""The registered queries of this package: each applies one operator to whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm import bpe, brown, divergence, exact, jaccard, lines, merkle, packing, pii, quality, sketch, suffix, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUALITY_FOLDS = 5
SCORING_FOLDS = 10
TAMPERED_FOLD = 5
TOXICITY_FOLDS, TOXICITY_HELD_OUT = 4, 2


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The quality labels, without those held out."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(fold(QUALITY_FOLDS) != 0)
    return labels.select("doc_id", F.col("quality").alias("label"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, quality_labels(spark, folder)))
    return scored.select(
        "doc_id",
        (fold(QUALITY_FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(documents(spark, folder))


def op3_class_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text").withColumn("train", fold(SCORING_FOLDS) != 0)
    scored = brown.score(docs, brown.fit(docs, "train"), "train")
    held_out = (fold(SCORING_FOLDS) == 0).alias("held_out")
    return scored.select(
        "doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.drop_boilerplate(documents(spark, folder).select("doc_id", "source", "text"))
    left = F.length("text").cast("long").alias("n_left")
    return cleaned.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), left)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(documents(spark, folder), ranks, public_tokenizers.PATTERN)


def op6_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), word_tokenizer())


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.drop_repeats(documents(spark, folder)).drop("kept")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = sketch.fingerprints_and_edits(documents(spark, folder))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch.fingerprint_text(F.col("own")).alias("fingerprint"),
        sketch.fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        sketch.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        sketch.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(documents(spark, folder))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked_documents(documents(spark, folder))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth document's text is put in lower case after the manifest was made."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = merkle.row_digest([lowered if name == "text" else F.col(name) for name in merkle.FIELDS])
    tampered = F.when(fold(TAMPERED_FOLD) == 0, changed)
    found = merkle.proofs(documents(spark, folder), carried={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    proof = F.sha2(merkle.proof_text(F.col("path")), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = fold(TOXICITY_FOLDS) == TOXICITY_HELD_OUT
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out)
    docs = documents(spark, folder).select("doc_id", "text")
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_exact_dedup,
        op3_class_scoring,
        op4_line_dedup,
        op5_bpe,
        op6_curve_packing,
        op7_repeated_passages,
        op8_fingerprints,
        op9_personal_data,
        op10_jaccard_join,
        op11_source_divergence,
        op12_merkle_manifest,
        op13_toxicity,
    )
}


def registered() -> dict[str, Query]:
    return dict(QUERIES)
