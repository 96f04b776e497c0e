"""Inputs that once lost rows or texts: NaN, null, another time zone, a second build."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chalkline.functions import text
from chalkline.operators import conversation, prompts, search
from chalkline.plans.library import Library, ask, build_library, build_vectors
from chalkline.session import tune
from chalkline.sources import tables

PAGES = "filename string, class_num string, subject string, chapter string, page_num int, page_text string"


def page(chapter: str, words: str):
    return ("f.pdf", "6", "science", chapter, 1, words)


@pytest.mark.parametrize("metric", ["inner_product", "l2"])
@pytest.mark.parametrize("odd", [[math.nan] * 2, [1.0, math.nan], [None, 1.0], [math.inf, 0.0]])
def test_vectors_that_are_not_finite_push_out_no_hit(spark, metric, odd):
    rows = [(i, [1.0, i / 100]) for i in range(50)] + [(100 + i, odd) for i in range(7)]
    corpus = spark.createDataFrame(rows, "faiss_id long, embedding array<float>").coalesce(1)
    questions = spark.createDataFrame([(1, [1.0, 0.25])], "query_id long, embedding array<float>")
    found = [r["faiss_id"] for r in search.top_k(questions, corpus, 5, metric=metric).frame.collect()]
    assert len(found) == 5 and max(found) < 50


def test_second_build_replaces_the_vectors(spark, tmp_path):
    question = spark.createDataFrame([(1, "volcano", "science", "6")], "query_id long, question string, target_subject string, target_class string")
    for words in ("river delta " * 40, "volcano ash " * 40):
        library = build_library(spark.createDataFrame([page("1", words), page("2", words)], PAGES), str(tmp_path))
    assert library.vectors().count() == library.index().count() == library.manifest().first()["num_vectors"]
    assert "volcano" in ask(library, question).first()["messages"][1]["content"]
    assert build_vectors(library) is False
    row = library.manifest().first()
    assert library.spark.read.parquet(library.path(row["faiss_index_file"])).count() == row["num_vectors"]


def test_half_written_vectors_are_made_anew(spark, tmp_path):
    build_library(spark.createDataFrame([page(str(i), "river delta " * 40) for i in range(4)], PAGES), str(tmp_path))
    library = Library(spark, str(tmp_path))
    part = library.vectors().limit(1).collect()
    spark.createDataFrame(part, library.vectors().schema).write.mode("overwrite").parquet(library.path("vectors"))
    assert build_vectors(library) is True
    assert library.vectors().count() == library.index().count()


def test_null_targets_and_questions_leave_whole_prompts(spark):
    asked = spark.createDataFrame([(1, None, None, None), (2, "q", "s", None)], "query_id long, question string, target_subject string, target_class string")
    hits = spark.createDataFrame([(2, 1, "t")], "query_id long, rank int, text string")
    rows = {r["query_id"]: r for r in prompts.answer_prompts(asked, hits).collect()}
    assert rows[1]["error"] and rows[1]["messages"] is None
    assert rows[2]["error"] is None and "q" in rows[2]["messages"][1]["content"]


def test_null_reply_keeps_its_exchange(spark):
    pairs = spark.createDataFrame([(1, 0, "a", None), (1, 2, None, "b")], "conv_id long, turn long, user_text string, reply string")
    row = conversation.transcript_segments(pairs, "T").first()
    assert row["n_pairs"] == 2 and row["text"].count("**T:**") == 2


def test_utc_text_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        tune(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Kolkata"
        row = spark.range(1).select(text.utc_text(F.timestamp_seconds(F.lit(1_704_067_200))).alias("x")).first()
        assert row["x"] == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("given", ["co-op studies 2b", "social_science", "they're", "", "x1y é"])
def test_title_capitalises_each_run_of_letters(value, given):
    assert value(text.title, x=given) == given.replace("_", " ").title()


def test_empty_subject_survives(spark, tmp_path):
    row = ("c", "t", "6", "", "1", 0, "f", 1)
    names = ["chunk_id", "content", "class_num", "subject", "chapter", "chunk_sequence", "source_file", "word_count"]
    from chalkline.schemas import CHUNKS

    given = dict(zip(names, row, strict=True))
    chunks = spark.createDataFrame([tuple(given[name] for name in CHUNKS.fieldNames())], CHUNKS)
    tables.write_chunks(chunks, str(tmp_path / "chunks"))
    assert tables.read_chunks(spark, str(tmp_path / "chunks")).first()["subject"] == ""
