import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.operators import search, vector_blocks
from test_search import brute, frame, rows_of


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16)) * 4
    corpus = middles[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.3
    corpus[100:180] = corpus[3]  # equal vectors
    corpus[7] = 0
    ids = rng.permutation(9000)[:1500]
    queries = np.vstack([middles[:8] + rng.normal(size=(8, 16)) * 0.2, rng.normal(size=(6, 16)), np.zeros((1, 16)), corpus[3:4]])
    return np.arange(len(queries)) + 50, queries, ids, corpus


@pytest.fixture(scope="module")
def stored(spark, clustered, tmp_path_factory):
    _, _, ids, corpus = clustered
    path = str(tmp_path_factory.mktemp("blocks") / "blocks")
    broken = spark.createDataFrame([(9998, None), (9999, [float("nan")] * 16)], "faiss_id long, embedding array<float>")
    vector_blocks.vector_blocks(frame(spark, "faiss_id", ids, corpus).unionAll(broken), 64).write.parquet(path)
    return spark.read.schema(vector_blocks.BLOCKS).parquet(path)


def test_blocks_hold_every_vector_within_what_they_say(stored, clustered):
    _, _, ids, corpus = clustered
    vectors = dict(zip(ids.tolist(), corpus.astype(np.float32), strict=True))
    seen = []
    for row in stored.collect():
        held = np.array(row["vectors"], np.float32).reshape(len(row["ids"]), -1)
        assert len(held) <= 64
        for i, v in zip(row["ids"], held, strict=True):
            assert (v == vectors[i]).all()
            assert np.linalg.norm(v.astype(float) - np.array(row["mean"])) <= row["radius"] + 1e-12
            assert row["shortest"] - 1e-9 <= np.linalg.norm(v.astype(float)) <= row["longest"] + 1e-9
        seen += row["ids"]
    assert sorted(seen) == sorted(ids.tolist())
    assert stored.select(F.count_distinct("block")).first()[0] == stored.count()


@pytest.mark.parametrize("metric", [search.INNER_PRODUCT, search.L2])
@pytest.mark.parametrize("k, limit", [(1, 8192), (10, 5), (200, 8192), (2000, 8192)])
def test_same_hits_as_brute_force(spark, clustered, stored, metric, k, limit):
    query_ids, queries, ids, corpus = clustered
    asked = frame(spark, "query_id", query_ids, queries)
    hits = vector_blocks.top_k_blocks(asked, stored, k, metric, limit)
    assert rows_of(hits) == brute(query_ids, queries, ids, corpus, k, metric)


@pytest.mark.parametrize("metric", [search.INNER_PRODUCT, search.L2])
def test_skipped_pairs_hold_no_hit_and_are_many(spark, clustered, stored, metric):
    query_ids, queries, ids, corpus = clustered
    asked = frame(spark, "query_id", query_ids, queries)
    hits = vector_blocks.top_k_blocks(asked, stored, 10, metric)
    row = vector_blocks.skipped_share(asked, stored, hits, 10, metric).first()
    assert row["pairs"] == len(query_ids) * len(ids)
    assert row["share"] == pytest.approx(row["skipped"] / row["pairs"]) and row["share"] > 0.3
    few = vector_blocks.skipped_share(asked, stored, hits, 10, metric, max_broadcast=5).first()
    assert few == row


def test_blocks_that_cannot_matter_are_not_scored(clustered, stored, monkeypatch):
    """Run in this process: with floors known, the scan looks at fewer vectors than there are."""
    query_ids, queries, ids, corpus = clustered
    questions = (queries[:8] / np.linalg.norm(queries[:8], axis=1, keepdims=True)).astype(np.float32)
    looked = []
    add = search.BestK.add
    monkeypatch.setattr(search.BestK, "add", lambda self, i, v, asking=None: (looked.append(len(i) * len(asking)), add(self, i, v, asking)))
    scores = np.sort(questions.astype(float) @ corpus.astype(np.float32).T.astype(float), axis=1)[:, -10]

    class Sent:
        value = (query_ids[:8], questions, scores.astype(np.float32))

    table = stored.select("ids", "vectors", "mean", "radius", "longest").toArrow()
    list(vector_blocks._scan(Sent, 10, search.INNER_PRODUCT)(iter(table.to_batches())))
    assert 0 < sum(looked) < 0.5 * len(ids) * 8


def test_nothing_to_search(spark, stored):
    none = frame(spark, "query_id", [], np.zeros((0, 16))).limit(0)
    assert vector_blocks.top_k_blocks(none, stored, 3).frame.count() == 0
    assert vector_blocks.skipped_share(none, stored, vector_blocks.top_k_blocks(none, stored, 3), 3).first()["share"] == 0
    empty = vector_blocks.vector_blocks(spark.createDataFrame([], "faiss_id long, embedding array<float>"))
    assert empty.count() == 0
    one = frame(spark, "query_id", [1], np.ones((1, 16)))
    assert vector_blocks.top_k_blocks(one, empty, 3).frame.count() == 0


def test_vectors_are_in_no_exchange_of_a_search(spark, clustered, stored):
    query_ids, queries, *_ = clustered
    for limit in (8192, 5):
        hits = vector_blocks.top_k_blocks(frame(spark, "query_id", query_ids, queries), stored, 3, max_broadcast=limit)
        plan = hits.frame._jdf.queryExecution().executedPlan().toString()
        assert all("vectors#" not in line for line in plan.splitlines() if "Exchange" in line)
