"""The pipeline, stage by stage, against brute force over what the stage before it kept."""

from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from chalkline.llm import pii, quality, queries
from test_lines import brute as without_boilerplate
from test_pii import base_spans, redacted

tokenizers = pytest.importorskip("public_tokenizers")


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good pages with a banner, near copies, repeated rows, personal data, empty and null texts, and noise."""
    random.seed(21)
    words = ["".join(random.choice("abcdeo") for _ in range(random.randint(2, 7))) for _ in range(300)]
    make = lambda n: [random.choice(words) for _ in range(n)]
    rows = [(i, "shared banner\n" + " ".join(make(random.randint(30, 90)))) for i in range(60)]
    base = make(120)
    for i in range(60, 66):
        near = list(base)
        near[random.randrange(120)] = "other"
        rows.append((i, " ".join(near)))
    rows += [(70 + i, " ".join(make(20)) + f" mail a{i}@b{i}.org or +1 017 555 77{i}3") for i in range(6)]
    rows += [(80, None), (81, ""), (3, rows[3][1]), (82, "shared banner")] + [(100 + i, " ".join(w + "&&&" for w in make(40))) for i in range(40)]
    path = tmp_path_factory.mktemp("pipeline")
    table = [(i, t, "en", "s0" if i % 2 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i < 100), 0) for i, _ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    bag = lambda table: sorted(map(tuple, table.select(columns).collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    docs = queries.documents(spark, folder)
    paths = iter(f"{folder}/stage{i}" for i in range(9))

    def kept(name, table):
        found = stages[name](spark, table, folder)
        assert name == "packing" or found.columns == columns
        path = next(paths)
        found.write.parquet(path)
        return spark.read.schema(found.schema).parquet(path)

    good = kept("quality", docs)
    scores = quality.score(docs, quality.fit(docs, queries.quality_labels(spark, folder))).where(f"score >= {quality.THRESHOLD}")
    assert bag(good) == bag(scores) and {r[0] for r in bag(good)} == {r[0] for r in bag(docs) if r[0] < 100}

    clean = kept("lines", good)
    want = without_boilerplate([(r, r[1], r[3]) for r in bag(good)])
    assert bag(clean) == sorted(((r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in want), key=repr)
    assert not any("banner" in (r[1] or "") for r in bag(clean))

    single = kept("near_duplicates", clean)
    rows, groups = bag(clean), []
    for row in rows:
        own = shingles(row[1])
        near = [g for g in groups if own and any(shingles(o[1]) and 100 * len(own & shingles(o[1])) >= 75 * len(own | shingles(o[1])) for o in g)]
        groups = [g for g in groups if g not in near] + [[row, *itertools.chain.from_iterable(near)]]
    assert bag(single) == sorted((min(g, key=lambda r: r[0]) for g in groups), key=repr)
    assert len(bag(single)) == len(rows) - 6  # five near copies and a repeated row

    hidden = kept("personal_data", single)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(single).collect()}
    assert all(set(base_spans(r[1] or "")) <= set(spans[r[0]].split(",")) | {""} for r in bag(single))
    want = [(r[0], r[1] and redacted(r[1], spans[r[0]]), *r[2:4]) for r in bag(single)]
    assert [r[:4] for r in bag(hidden)] == sorted(want, key=repr) and not any("@" in (r[1] or "") for r in bag(hidden))

    packed = kept("packing", hidden).collect()
    tokenizer = tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer).encode
    lengths = {r[0]: len(encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in bag(hidden)}
    found = {}
    for piece in packed:
        found[piece["doc_id"]] = found.get(piece["doc_id"], 0) + piece["length"]
    assert found == lengths
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, packed))
