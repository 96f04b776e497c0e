"""The quality classifier: votes against a plain count of neighbours, what it learns, and the query."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import quality, queries


@pytest.fixture(scope="module")
def labelled():
    random.seed(12)
    words = ["".join(random.choice("abcdeo") for _ in range(random.randint(2, 6))) for _ in range(300)]
    make = lambda n, end: " ".join(random.choice(words) + end for _ in range(n))
    return [(i, make(random.randint(5, 90), "&&&" if i % 4 == 0 else ""), i % 4 != 0) for i in range(400)]


def fit(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if y is None else float(y)) for i, _, y in rows], "doc_id long, label double")
    return quality.fit(docs, labels)


def test_votes_equal_a_plain_count(spark, labelled):
    model = fit(spark, labelled)
    rows = [(i, t) for i, t, _ in labelled[:60]] + [(900, "zz qq"), (901, ""), (902, "ab " * 5000)]
    found = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        data = text.encode()
        cells = np.zeros(quality.FEATURES)
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            cells[((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 21] += 1
        words = text.split()
        if words:
            share = sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words)
            cells[quality.TRIGRAMS + sum(share >= bound for bound in quality.REPEATED)] = 1
        grams = np.log1p(cells[: quality.TRIGRAMS]) * model.weights
        unit = lambda v: v / (np.linalg.norm(v) or 1)
        vector = unit(unit(np.append(unit(grams), cells[quality.TRIGRAMS :])) @ model.axes)
        votes = sorted(((float(vector @ other), label) for other, label in zip(model.vectors, model.labels, strict=True)), reverse=True)
        bound = votes[quality.NEIGHBOURS - 1][0] - 1e-6
        power = [(max(cosine, 0) ** quality.SHARPNESS, label) for cosine, label in votes if cosine >= bound]
        want = (sum(p * y for p, y in power) + quality.PRIOR_WEIGHT * model.prior) / (sum(p for p, _ in power) + quality.PRIOR_WEIGHT)
        assert found[i] == pytest.approx(want, abs=2e-3), text[:40]


def test_scores_every_row_and_learns(spark, docs, nothing, texts):
    noisy = [(1000 + i, "&&& ".join(t.split(" ")), 0.0) for i, t in texts[:40]]
    rows = [(i, t, 1.0) for i, t in texts[:40]] + noisy + [(2000, "x", None), (2001, "", 1.0), (None, "y", 1.0)]
    model = fit(spark, rows)
    assert len(model.labels) == 81
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "source", "row", "n", "score"]
    found = scored.collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if not r["text"]} == {model.prior}
    bad = spark.createDataFrame([("ab&&& cdé&&& ab&&& abc&&& e&&& dd&&&",)], "text string")
    assert quality.score(bad, model).first()["score"] < 0.5 < min(r["score"] for r in found if r["doc_id"] in range(10))
    assert quality.score(nothing, model).count() == 0
    empty = fit(spark, [(1, "x", None)])
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}


def test_sample_is_bounded_and_goes_by_ids(spark, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, float(y)) for i, _, y in labelled], "doc_id long, label double")
    assert len(quality.fit(docs, labels, sample_rows=50).labels) == 50
    one, two = (quality.fit(docs.repartition(n), labels, sample_rows=50) for n in (1, 7))
    assert sorted(map(tuple, one.vectors.round(3))) == sorted(map(tuple, two.vectors.round(3)))


def test_query_learns_only_from_its_folds(spark, tmp_path, labelled):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(y) if not held(i) else 1 - int(y), 0) for i, _, y in labelled]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op1_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(labelled) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    truth = {i: y for i, _, y in labelled}
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(right) > 0.95 * len(right)


def test_no_text_is_shuffled(spark, tmp_path, labelled):
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    scored = quality.score(docs.withColumn("more", F.lit(1)), fit(spark, labelled))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
