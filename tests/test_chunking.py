import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chalkline.operators import chunking, ingest
from chalkline.schemas import CHAPTER_KEYS


def pack(text, size=400, overlap=50):
    """The rule, told directly: cut, then pack from the left with a list of pieces."""
    pieces = [text]
    for separator in chunking.SEPARATORS:
        cut = []
        for piece in pieces:
            if len(piece) >= size:
                head, *rest = piece.split(separator)
                cut += [p for p in [head] + [separator + r for r in rest] if p]
            else:
                cut.append(piece)
        pieces = cut
    chunks, window = [], []
    for piece in pieces:
        if window and len("".join(window)) + len(piece) > size:
            chunks.append("".join(window))
            while window and (len("".join(window)) > overlap or len("".join(window)) + len(piece) > size):
                window.pop(0)
        window.append(piece)
    chunks.append("".join(window))
    return [c.strip() for c in chunks if c.strip()]


def page_frame(spark, chapters):
    rows = [
        ("f" + name, "6", "s", name, number, text)
        for name, pages in chapters.items()
        for number, text in pages.items()
    ]
    return spark.createDataFrame(
        rows, "filename string, class_num string, subject string, chapter string, page_num int, page_text string"
    )


def chunk_lists(frame):
    out = {}
    for row in frame.collect():
        out.setdefault(row["chapter"], []).append((row["chunk_sequence"], row["content"]))
    for found in out.values():
        found.sort()
        assert [at for at, _ in found] == list(range(len(found)))
    return {chapter: [text for _, text in found] for chapter, found in out.items()}


def random_page(rng, kind):
    if kind == "periodic":
        return "abcd efgh. " * rng.randint(1, 30)
    if kind == "long words":
        return " ".join("x" * rng.choice([5, 40, 349, 350, 399, 400, 401, 900]) for _ in range(rng.randint(1, 6)))
    if kind == "tiny":
        return "y" * rng.randint(1, 8)
    if kind == "lines":
        return "line of ten\n" * rng.randint(1, 40)
    parts = ["a", "b ", ". ", "\n", "\n\n", " ", "é" * 30]
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 800)))


@pytest.fixture(scope="module")
def chapters():
    rng = random.Random(7)
    kinds = ["periodic", "long words", "tiny", "lines", "mixed"]
    made = {}
    for number in range(30):
        numbers = rng.sample(range(1, 300), rng.randint(1, 50))
        pages = {n: random_page(rng, kinds[number % len(kinds)]).strip() for n in numbers}
        pages = {n: text for n, text in pages.items() if text}
        if pages:
            made[str(number)] = pages
    return made


@pytest.mark.parametrize("pages, segments", [(1, 1), (1, 5), (2, 1024), (7, 3), (60, 2), (1024, 1024)])
def test_segments_do_not_change_the_chunks(spark, chapters, pages, segments):
    found = chunk_lists(
        chunking.split_chapters(
            page_frame(spark, chapters), pages_per_segment=pages, segments_per_block=segments
        )
    )
    for name, pages in chapters.items():
        whole = "\n\n".join(text for _, text in sorted(pages.items()))
        assert found[name] == pack(whole), name


def test_other_sizes(spark, chapters):
    found = chunk_lists(
        chunking.split_chapters(page_frame(spark, chapters), size=120, overlap=30, pages_per_segment=3)
    )
    for name, pages in chapters.items():
        whole = "\n\n".join(text for _, text in sorted(pages.items()))
        assert found[name] == pack(whole, 120, 30), name


@pytest.mark.parametrize(
    "text, expected",
    [
        ("short", ["short"]),
        ("w" * 500, ["w" * 500]),
        ("   ", []),
        ("", []),
        (". \n\nx\n\n. ", [". \n\nx\n\n."]),
    ],
)
def test_edge_texts(spark, text, expected):
    found = chunk_lists(chunking.split_chapters(page_frame(spark, {"1": {1: text}})))
    assert found.get("1", []) == expected


def test_chunk_sizes(spark, chapters):
    prose = {"1": {n: "Some words that make a line. " * 30 for n in range(1, 20)}}
    for chunk in chunk_lists(chunking.split_chapters(page_frame(spark, prose)))["1"]:
        assert 0 < len(chunk) <= 400


def test_chunk_table(spark):
    rows = chunking.chunk_table(page_frame(spark, {"3": {2: "two words", 1: "first page"}})).collect()
    assert [tuple(r) for r in rows] == [
        ("c6_s_ch3_0", "first page\n\ntwo words", "6", "s", "3", 0, "f3", 4)
    ]


def test_chapter_segments(spark):
    pages = page_frame(spark, {"1": {3: "c", 1: "a", 2: "b"}})
    assert [r["text"] for r in ingest.chapter_segments(pages).collect()] == ["a\n\nb\n\nc"]
    parts = ingest.chapter_segments(pages, pages_per_segment=2).orderBy("segment").collect()
    assert [(r["segment"], r["n_pages"], r["text"]) for r in parts] == [(0, 1, "a"), (1, 2, "b\n\nc")]


def test_clean_pages_keeps_numbers_and_long_pages(spark):
    pages = page_frame(spark, {"1": {1: "x" * 100, 2: " " + "y" * 101, 3: "z" * 98 + "   " + "z"}})
    assert [(r["page_num"], len(r["page_text"])) for r in ingest.clean_pages(pages).collect()] == [(2, 101)]


def test_number_pages(spark):
    files = spark.createDataFrame([("f", ["a", "b"])], "filename string, pages array<string>")
    assert [tuple(r) for r in ingest.number_pages(files).collect()] == [("f", 1, "a"), ("f", 2, "b")]


def test_text_is_shuffled_once(spark, chapters):
    frame = chunking.split_chapters(page_frame(spark, chapters), pages_per_segment=7)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2  # the segments, and their spans


def test_rows_without_file_fields_are_chapters_of_their_own(spark):
    pages = page_frame(spark, {"1": {1: "named"}}).unionByName(
        page_frame(spark, {"2": {1: "unnamed"}}).withColumn("chapter", F.lit(None).cast("string"))
    )
    found = {r["content"]: r["chapter"] for r in chunking.split_chapters(pages).collect()}
    assert found["unnamed"] is None and found["named"] is not None and len(found) == 2
    assert set(CHAPTER_KEYS) < set(chunking.split_chapters(pages).columns)
    assert isinstance(pages.toPandas(), pd.DataFrame)
