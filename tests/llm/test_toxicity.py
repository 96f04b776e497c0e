"""The recurrent network against a plain one, its gradients against differences, and what it learns."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from chalkline.llm import blocks as B
from chalkline.llm import queries, toxicity


def texts_of(rows):
    return pa.array([t.encode() for t in rows], pa.large_binary())


@pytest.fixture(scope="module")
def labelled():
    random.seed(8)
    words = ["".join(random.choice("abcdeo") for _ in range(random.randint(2, 6))) for _ in range(300)]
    make = lambda n: [random.choice(words) for _ in range(n)]
    rows = []
    for i in range(500):
        text = make(random.randint(3, 200))
        if i % 5 == 0:
            for _ in range(3):
                text.insert(random.randrange(len(text) + 1), random.choice(["zanker", "Zankung", "zankfu"]))
        rows.append((i, " ".join(text) + "." * (i % 3), i % 5 == 0))
    return rows


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.train(texts_of([t for _, t, _ in labelled]), np.array([float(y) for *_, y in labelled]), 0.2)


def plain_score(text, model):
    """One window, one word, one gate at a time."""
    words, _ = B.letter_runs(*B.text_bytes(texts_of([text])), lower=False)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    rows = toxicity._inputs(toxicity._words(words, model.known), model.weights).astype(np.float64)
    best, start, H = -np.inf, 0, toxicity.HIDDEN
    while True:
        window = rows[start : start + toxicity.WINDOW]
        sides = []
        for way, order in (("ahead", range(len(window))), ("back", range(len(window) - 1, -1, -1))):
            state, states = np.zeros(H), [None] * len(window)
            for at in order:
                given = window[at] @ w[f"{way}_in"] + w[f"{way}_bias"]
                gate = sigmoid(given[: 2 * H] + state @ w[f"{way}_gates"])
                fresh = np.tanh(given[2 * H :] + (gate[H:] * state) @ w[f"{way}_state"])
                state = (1 - gate[:H]) * fresh + gate[:H] * state
                states[at] = state
            sides.append(np.array(states))
        states = np.hstack(sides)
        look = np.exp(np.tanh(states @ w["look_in"]) @ w["look"])
        best = max(best, float((look / look.sum()) @ states @ w["out"] + w["out_bias"][0]))
        if start + toxicity.WINDOW >= len(rows):
            return sigmoid(best)
        start += toxicity.STRIDE


def test_scores_equal_a_plain_network(model, labelled):
    texts = [t for _, t, _ in labelled[:40]] + ["a", "zanker " * 47, "ab " * 48, "cd " * 49, "ef é漢 " * 400]
    found = toxicity.score_texts(texts_of(texts), model)
    assert found == pytest.approx([plain_score(t, model) for t in texts], abs=1e-4)


def test_windows_overlap_and_cover_every_word():
    sizes = [0, 1, 47, 48, 49, 80, 81, 500]
    firsts = B.offsets_of(np.array(sizes))
    starts, lengths, bounds = toxicity._windows(firsts)
    for i, size in enumerate(sizes):
        own = list(zip(starts[bounds[i] : bounds[i + 1]] - firsts[i], lengths[bounds[i] : bounds[i + 1]], strict=True))
        assert {w for s, n in own for w in range(s, s + n)} == set(range(size))
        assert all(s == k * toxicity.STRIDE and (n == toxicity.WINDOW or k == len(own) - 1) for k, (s, n) in enumerate(own))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    words = B.slices(np.frombuffer(b"abacabadabAcab", np.uint8), np.array([0, 2, 5, 9, 12, 14]))
    model = toxicity._fresh(np.sort(B.word_hashes(toxicity._lower(words)))[:3], 0.5)
    weights = {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float64) for k, v in model.weights.items()}
    weights["words"][0] = 0
    known = toxicity._words(words, model.known)
    grid = rng.integers(0, 5, (4, toxicity.WINDOW))
    grid[1, 30:], grid[2, 1:] = 5, 5
    labels = np.array([1.0, 0, 1, 0])

    def loss():
        p = 1 / (1 + np.exp(-toxicity._logits(toxicity._inputs(known, weights), grid, weights)))
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    slopes = toxicity._gradients(known, grid, labels, weights)
    for name, value in weights.items():
        steep = np.argsort(-np.abs(slopes[name]).ravel())[:3]
        for at in steep:
            place = np.unravel_index(at, value.shape)
            old, step = value[place], 2e-2
            value[place] = old + step
            more = loss()
            value[place] = old - step
            less = loss()
            value[place] = old
            assert slopes[name][place] == pytest.approx((more - less) / (2 * step), rel=0.05, abs=2e-4), name


def test_learns_and_is_the_same_again(model, labelled):
    random.seed(9)
    clean = [" ".join(t.split()[:50]) for _, t, y in labelled if not y]
    bad = [t.replace(" ", " zankelt ", 3) for t in clean]  # a word it has not seen
    assert (toxicity.score_texts(texts_of(clean), model) < 0.3).mean() > 0.95
    assert (toxicity.score_texts(texts_of(bad), model) >= 0.3).mean() > 0.8
    assert (toxicity.score_texts(texts_of(["word " * 20000 + "zankung zanker " + "word " * 20000]), model) >= 0.3).all()
    again = toxicity.train(texts_of([t for _, t, _ in labelled]), np.array([float(y) for *_, y in labelled]), 0.2)
    assert all((again.weights[k] == model.weights[k]).all() for k in model.weights)


def test_every_row_is_scored(spark, docs, nothing, texts, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(40)] + [(None, 1.0), (41, None)], "doc_id long, label double")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "source", "row", "n", "score"]
    rows = found.collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not (r["text"] or "").strip()} == {0.5}
    for r in rows:
        if r["text"] and r["doc_id"] is not None and r["doc_id"] < 20:
            assert r["score"] == pytest.approx(toxicity.score_texts(texts_of([r["text"]]), model)[0], abs=1e-6)
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(nothing, labels)
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect() if not r["text"]} == {0.5}
    assert empty.prior == 0.5


def test_query_learns_only_from_its_folds(spark, tmp_path, labelled):
    import zlib

    spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    # Labels of held-out rows are turned round; whoever learns from them learns nothing.
    marks = [(i, int(y) if not held(i) else 1 - int(y), 0) for i, _, y in labelled]
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op13_toxicity(spark, str(tmp_path)).collect()
    truth = {i: y for i, _, y in labelled}
    assert len(rows) == len(labelled) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(right) > 0.9 * len(right)
