"""The source divergence audit against brute force in whole numbers."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from chalkline.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, slice int, own int"


def brute(rows, least=divergence.LEAST_DOCS, top=divergence.TOP_TERMS):
    docs = collections.defaultdict(collections.Counter)
    counts = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    found = []
    p = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    gap = lambda a, b: (a - b) ** 2 // (a + b)
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (one, s), c in counts.items() if one == lang}
        totals = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        whole = sum(totals.values())
        for s, c in groups.items():
            shares = {t: p(c[t], totals[s], len(kept)) for t in kept}
            pairs = [(sum(gap(shares[t], p(o[t], totals[x], len(kept))) for t in kept), x) for x, o in groups.items() if x != s]
            terms = []
            for t in kept:
                q = p(sum(o[t] for o in groups.values()), whole, len(kept))
                if c[t] and shares[t] > q:
                    terms.append((gap(shares[t], q), t))
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                found += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    """Three languages, one without kept terms; nulls, empties, groups without terms, copies, ties, one long text."""
    random.seed(3)
    words = ["".join(random.choice("abcdé漢") for _ in range(random.randint(1, 3))) for _ in range(60)]
    made = []
    for i in range(240):
        some = words[: 20 + 8 * (i % 5)]
        text = " ".join(random.choice(some).upper() if i % 7 == 0 else random.choice(some) for _ in range(random.randint(0, 40)))
        made.append((text + ", x1y_z" * (i % 3), ["en", "fr", None][i % 3] if i < 200 else "en", f"s{i * i % 6}" if i % 11 else None))
    made += [(None, "en", "empty"), ("", "en", "empty"), ("12 34 -- {}", "de", "a"), ("nur hier", "de", "b"), ("ab " * 30000, "fr", "long")]
    return made + [("same same é", "en", "copies")] * 40 + [("twin a", "en", "t1"), ("twin a", "en", "t2")]


@pytest.mark.parametrize("postings", [divergence.POSTINGS, 7])
def test_equals_brute_force(spark, rows, monkeypatch, postings):
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "_CELLS", 5)
    table = spark.createDataFrame([(i, *row, "t", 1, 2) for i, row in enumerate(rows)], SCHEMA).repartition(7)
    found = divergence.audit(table)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert sorted(map(tuple, found.collect())) == want
    assert {r[0] for r in want} == {"en", "fr", "", "de"} and any(r[4] == 0 for r in want if r[0] == "de")


def test_slices_do_not_change_the_sums(spark, rows):
    table = spark.createDataFrame([(i, *row, "t", 1, 2) for i, row in enumerate(rows)], SCHEMA)
    found = divergence.profiles(table)
    one, many = (sorted(map(tuple, divergence.pair_divergence(found, size).collect())) for size in (10**6, 3))
    assert one == many


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    big = [(5 * 10**11, 10**13, 10**6), (0, 10**13, 10**6), (7, 9, 1), (0, 0, 1), (9 * 10**14, 9 * 10**14, 3)]
    table = spark.createDataFrame(big, "n long, total long, v long")
    found = [r[0] for r in table.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert found == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in big]
    np = divergence.np
    assert [int(divergence._shares(np.int64(n), np.int64(t + 2 * v))) for n, t, v in big] == found
