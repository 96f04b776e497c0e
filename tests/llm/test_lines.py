"""Boilerplate lines against brute force and against the query's SQL."""

from __future__ import annotations

import collections

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from chalkline.llm import lines, oracles, queries


def ordered(rows):
    return sorted(rows, key=repr)


def brute(rows, ratio=lines.MAX_RATIO):
    """(id, text, host) -> (id, text left): contents of a host count once, lines of one content never go."""
    contents, pages = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in rows:
        contents[host].add(text)
        for line in (text or "").split("\n"):
            if line.strip(" "):
                pages[host, line.strip(" ")].add(text)
    boiler = {k for k, found in pages.items() if len(found) >= 2 and len(found) > ratio * len(contents[k[0]])}
    clean = lambda t, h: t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in boiler)
    return [(i, clean(t, h)) for i, t, h in rows]


@pytest.fixture(scope="module")
def odd_rows():
    """Padded and numbered lines, lines that start and end with their own place, null texts and hosts, copies."""
    rows = [(i, f"  shared banner  \n2024 edition 2\nown {i}\n{i} of 3", "a") for i in range(40)]
    rows += [(100 + i, "\n".join([*(f"boiler {n}" for n in range(500)), f"page {i}", "\t tab"]), "b") for i in range(40)]
    rows += [(200 + i, "a copied page\nwith a second line", "c") for i in range(30)] + [(240, "a copied page ", "c"), (241, "alone", "c")]
    rows += [(300, None, "a"), (301, None, None), (302, "host less\nline", None), (303, "host less", None), (304, "", "a"), (305, " \n\n ", "a")]
    rows += [(306, "x\r\ny", "d"), (307, "x\r\nz", "d"), (None, "own 1", "a"), (308, "only line", "e"), (0, "again\nown 7", "a"), (0, "again\nown 7", "a")]
    return rows + [(400 + i, f"one in many {i}\n" + ("rare" if i < 2 else "common") + f"\n{'long ' * 20000 if i == 5 else i}", "f") for i in range(150)]


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_both_ways_equal_brute_force(spark, odd_rows, limit):
    table = spark.createDataFrame(odd_rows, "doc_id long, text string, source string").repartition(5)
    found = lines.drop_boilerplate(table, broadcast_bytes=limit)
    assert found.columns == table.columns
    want = brute(odd_rows)
    assert ordered((r["doc_id"], r["text"]) for r in found.collect()) == ordered(want)
    assert (0, "own 0\n0 of 3") in want and any("page" in (t or "") and "boiler" not in t for _, t in want)


def test_query_equals_its_sql(spark, odd_rows, tmp_path):
    table = spark.createDataFrame(odd_rows, "doc_id long, text string, source string").repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op4_line_dedup(spark, str(tmp_path))
    database = duckdb.connect()
    database.register("documents", pd.DataFrame(odd_rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    wanted = database.execute(oracles.LINES)
    assert found.columns == [d[0] for d in wanted.description]
    assert ordered(tuple(r) for r in found.collect()) == ordered(wanted.fetchall())


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, -1])
def test_columns_named_as_the_operator_names_its_own(spark, limit):
    names = ["row", "host", "text", "page", "keys", "known_host", "hit", "places", "cleaned", "at", "line", "source"]
    rows = [(f"r{i}", "h", f"banner\nown {i}", *["x"] * 8, "s") for i in range(4)]
    table = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
    found = lines.drop_boilerplate(table, broadcast_bytes=limit)
    assert found.columns == names
    assert ordered(map(tuple, found.collect())) == ordered((r[0], r[1], f"own {r[0][1:]}", *r[3:]) for r in rows)


def test_both_ways_on_the_shared_table(docs, nothing, texts):
    want = brute([(i, t, f"s{(i or 0) % 2}") for i, t in texts])
    assert any(left != text for (_, left), (_, text) in zip(want, texts, strict=True))
    for limit in (lines.BROADCAST_BYTES, -1):
        found = lines.drop_boilerplate(docs, broadcast_bytes=limit)
        assert ordered((r["doc_id"], r["text"]) for r in found.collect()) == ordered(want)
    assert lines.drop_boilerplate(nothing).count() == 0


def test_copies_of_a_page_do_not_condemn_its_lines(spark):
    rows = [(i, f"banner\nown {i}", "a") for i in range(60)] + [(100 + i, "a copied page\nwith a second line", "a") for i in range(30)]
    rows += [(200, None, "a"), (201, None, "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, table, "").collect()}
    assert found == {i: t if t is None or i >= 100 else f"own {i}" for i, t, _ in rows}
    (line,) = lines.boilerplate_lines(table).collect()
    assert (line["n_pages"], line["n_host_pages"]) == (60, 62)  # sixty pages, the copied one, and null
