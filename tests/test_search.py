import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import retrieval, search


def frame(spark, name, ids, matrix, partitions=3):
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(partitions)


def brute(query_ids, queries, ids, corpus, k, metric):
    queries, corpus = queries.astype(np.float32).astype(float), corpus.astype(np.float32).astype(float)
    if metric == search.INNER_PRODUCT:
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        queries = (queries / np.where(lengths > 0, lengths, 1)).astype(np.float32).astype(float)
        scores = (queries @ corpus.T).astype(np.float32)
    else:
        scores = ((queries[:, None] - corpus[None]) ** 2).sum(axis=2).astype(np.float32)
    out = set()
    for row, query in enumerate(query_ids):
        key = -scores[row] if metric == search.INNER_PRODUCT else scores[row]
        for rank, at in enumerate(np.lexsort((ids, key))[:k]):
            out.add((int(query), int(ids[at]), rank, round(float(scores[row][at]), 5)))
    return out


def rows_of(hits):
    return {(r["query_id"], r["faiss_id"], r["rank"], round(r["score"], 5)) for r in hits.frame.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(700, 16))
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    corpus[300:420] = corpus[5]  # many equal vectors
    corpus[10] = 0
    ids = rng.permutation(5000)[:700]
    queries = rng.normal(size=(40, 16))
    queries[0], queries[1] = corpus[5] * 3, 0
    return np.arange(40) + 100, queries, ids, corpus


@pytest.mark.parametrize("metric", [search.INNER_PRODUCT, search.L2])
@pytest.mark.parametrize("options", [{}, {"max_broadcast": 11}, {"max_broadcast": 25}])
@pytest.mark.parametrize("k", [1, 100, 1000])
def test_equals_brute_force(spark, data, metric, options, k):
    query_ids, queries, ids, corpus = data
    hits = search.top_k(
        frame(spark, "query_id", query_ids, queries),
        frame(spark, "faiss_id", ids, corpus, 5),
        k,
        metric,
        **options,
    )
    assert rows_of(hits) == brute(query_ids, queries, ids, corpus, k, metric)
    assert hits.max_rows == 40 * k


def test_broadcast_is_bounded_by_bytes(spark, data, monkeypatch):
    query_ids, queries, ids, corpus = data
    monkeypatch.setattr(search, "MAX_BROADCAST_BYTES", 39 * 16 * 4)
    hits = search.top_k(frame(spark, "query_id", query_ids, queries), frame(spark, "faiss_id", ids, corpus), 5)
    assert search.asked(frame(spark, "query_id", query_ids, queries)).n_blocks > 1
    assert rows_of(hits) == brute(query_ids, queries, ids, corpus, 5, search.INNER_PRODUCT)


def test_splits_do_not_change_the_ranking(spark, data):
    query_ids, queries, ids, corpus = data
    runs = [
        search.top_k(frame(spark, "query_id", query_ids, queries), frame(spark, "faiss_id", ids, corpus, n), 100)
        for n in (1, 2, 40)
    ]
    first, *others = [sorted(map(tuple, run.frame.collect())) for run in runs]
    assert all(other == first for other in others)


def test_rows_without_vector_take_no_part(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, None)], "faiss_id long, embedding array<float>")
    questions = spark.createDataFrame([(7, [1.0]), (8, None)], "query_id long, embedding array<float>")
    assert rows_of(search.top_k(questions, corpus, 5)) == {(7, 1, 0, 1.0)}
    none = corpus.limit(0)
    assert rows_of(search.top_k(questions, none, 5)) == set()
    assert rows_of(search.top_k(questions.limit(0), corpus, 5)) == set()


def test_mixed_dimensions_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "faiss_id long, embedding array<float>").coalesce(1)
    questions = spark.createDataFrame([(7, [1.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="same number of dimensions"):
        search.top_k(questions, corpus, 5).frame.collect()


def test_missing_rows_use_up_a_rank_and_repeated_ids_count_once(spark):
    corpus = frame(spark, "faiss_id", [1, 2, 3], np.array([[1.0, 0], [0.8, 0.6], [0, 1.0]]))
    questions = frame(spark, "query_id", [9], np.array([[2.0, 0]]))
    chunks = spark.createDataFrame(
        [(1, "a", "t1"), (3, "c", "t3"), (3, "b", "t3 again")], "faiss_id long, chunk_id string, text string"
    )
    found = search.with_chunk_rows(search.top_k(questions, corpus, 3), chunks).orderBy("rank").collect()
    assert [(r["faiss_id"], r["chunk_id"], r["rank"]) for r in found] == [(1, "a", 0), (3, "b", 2)]


@pytest.fixture(scope="module")
def library(spark):
    angles = np.linspace(0, 1.5, 12)
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = [
        (i, f"k{i}", f"text {i}", "social_science" if i % 2 else "Science", "07" if i % 3 else "7")
        for i in range(12)
    ]
    chunks = spark.createDataFrame(
        rows, "faiss_id long, chunk_id string, text string, subject string, class string"
    )
    return frame(spark, "faiss_id", range(12), vectors), chunks


@pytest.mark.parametrize(
    "subject, class_, expected",
    [
        (None, None, [0, 1, 2]),
        ("", "All", [0, 1, 2]),
        ("All", "", [0, 1, 2]),
        ("SCI", None, [0, 2, 4]),
        ("social", None, [1, 3, 5]),
        ("science", "7", [0]),
        ("ience", None, []),
        (None, "7", [0, 3]),
        (None, "07", [1, 2, 4]),
        ("all", None, []),
    ],
)
def test_retrieve_filters_after_the_net(spark, library, subject, class_, expected):
    corpus, chunks = library
    question = spark.createDataFrame(
        [(1, [1.0, 0.0], subject, class_)],
        "query_id long, embedding array<float>, target_subject string, target_class string",
    )
    found = retrieval.retrieve(question, corpus, chunks, k=3, net=6).orderBy("rank").collect()
    # The net holds ids 0 to 5 in this order, and ranks keep the gaps the filter leaves.
    assert [r["faiss_id"] for r in found] == [i for i in expected if i < 6]
    assert [r["rank"] for r in found] == [r["faiss_id"] for r in found]


def test_empty_result_keeps_its_columns(spark, library):
    corpus, chunks = library
    question = spark.createDataFrame(
        [(1, [1.0, 0.0], "none", None)],
        "query_id long, embedding array<float>, target_subject string, target_class string",
    )
    found = retrieval.retrieve(question, corpus, chunks)
    assert found.count() == 0
    assert {"query_id", "faiss_id", "text", "score", "rank"} <= set(found.columns)


def test_plan_limits_early_and_joins_no_pairs(spark, library):
    corpus, chunks = library
    question = spark.createDataFrame(
        [(1, [1.0, 0.0], None, None)],
        "query_id long, embedding array<float>, target_subject string, target_class string",
    )
    found = retrieval.retrieve(question, corpus, chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "SortAggregate" not in plan
    # Texts are read once, for the last join, and are in no shuffle.
    assert all("text#" not in line for line in plan.splitlines() if "Exchange" in line or "Window" in line)
    assert found.select(F.max("rank")).first()[0] == 2


def test_retrieve_takes_the_first_of_rows_that_share_an_id(spark):
    corpus = frame(spark, "faiss_id", [1, 2], np.array([[1.0, 0], [0.8, 0.6]]))
    rows = [(1, "b", "t1 again", "s", "7"), (1, "a", "t1", "s", "7"), (2, None, "t2", None, None)]
    chunks = spark.createDataFrame(rows, "faiss_id long, chunk_id string, text string, subject string, class string")
    question = spark.createDataFrame(
        [(1, [1.0, 0.0], None, None)],
        "query_id long, embedding array<float>, target_subject string, target_class string",
    )
    found = retrieval.retrieve(question, corpus, chunks).orderBy("rank").collect()
    assert [(r["faiss_id"], r["chunk_id"], r["text"]) for r in found] == [(1, "a", "t1"), (2, None, "t2")]


def test_blocks_of_questions_leave_the_vectors_where_they_are(spark, data, tmp_path):
    query_ids, queries, ids, corpus = data
    frame(spark, "faiss_id", ids, corpus).write.parquet(str(tmp_path / "corpus"))
    stored = spark.read.parquet(str(tmp_path / "corpus"))
    for options in ({}, {"max_broadcast": 9}):
        plan = search.top_k(frame(spark, "query_id", query_ids, queries), stored, 5, **options).frame._jdf.queryExecution().executedPlan().toString()
        assert all("vector#" not in line and "embedding#" not in line for line in plan.splitlines() if "Exchange" in line)


def test_questions_are_worked_out_once(spark, tmp_path):
    from pyspark.sql.functions import udf

    counted = spark.sparkContext.accumulator(0)

    @udf("array<float>")
    def encode(n):
        counted.add(1)
        return [float(n), 1.0]

    questions = spark.range(50).select(F.col("id").alias("query_id"), encode("id").alias("embedding"))
    corpus = frame(spark, "faiss_id", [1, 2, 3], np.array([[1.0, 0], [0.8, 0.6], [0, 1.0]]))
    for limit in (8192, 7):
        before = counted.value
        search.top_k(questions, corpus, 2, max_broadcast=limit).frame.collect()
        assert counted.value - before == 50


def test_long_and_broken_vectors(spark):
    rows = [(1, [1e30, 1e30]), (2, [1e-30, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0, 4.0]), (6, [3e18, 4e18])]
    corpus = spark.createDataFrame(rows, "faiss_id long, embedding array<float>").coalesce(1)
    questions = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, embedding array<float>")
    found = search.top_k(questions, corpus, 9).frame.orderBy("rank").collect()
    assert [r["faiss_id"] for r in found] == [1, 6, 5, 2]
    near = search.top_k(questions, corpus, 9, search.L2).frame.orderBy("rank").collect()
    assert [r["faiss_id"] for r in near][:2] == [2, 5]
