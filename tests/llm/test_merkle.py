"""The Merkle manifest against a tree built by hand."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chalkline.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, leaf string, alone int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row[:5]))


def climb(leaves):
    """The root of some leaves, and of each leaf the siblings on either side, level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            low = at[i] // 16 * 16
            path.append((nodes[low : at[i]], nodes[at[i] + 1 : low + 16]))
            at[i] //= 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes or [None])[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    parts = {}
    for name in names:
        own = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        parts[name] = (own, *climb([leaf_of(r) for r in own]))
    root, above = climb([parts[name][1] for name in names])
    found = []
    for name, up in zip(names, above, strict=True):
        own, subroot, paths = parts[name]
        for row, path in zip(own, paths, strict=True):
            path = path + up
            lower = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of((*row[:4], lower)) if bad else leaf_of(row)
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*("".join(before + after) for before, after in path))
            found.append((row[0], leaf_of(row), subroot, root, proof, node, node == root))
    return sorted(found, key=repr)


def odd_rows():
    """Sources of 1, 16, 17, 256, 257 and 700 rows, one without a name, one with an empty one; nulls, repeated rows and ids."""
    sizes = {"one": 1, "run": 16, "more": 17, "full": 256, "over": 257, "hot": 700, "é": 3, "Z": 2, "": 2, None: 5}
    rows = [(7 * i + at, name, "en", i, f"Text {i} Of É{at}") for at, (name, size) in enumerate(sizes.items()) for i in range(size)]
    rows += [(None, "hot", None, None, None), (None, "hot", "x", 1, ""), (5, "hot", "a", 1, None), (5, "hot", "a", 1, ""), (5, "hot", "a", 1, "")]
    return rows + [(99, "run", "de", -3, "LONG " * 50000), (-4, None, None, None, "NULL-ish - 3:abc")]


@pytest.mark.parametrize("parts", ["3", "40"])
def test_query_equals_a_tree_built_by_hand(spark, tmp_path, parts):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "t", 1, "l", 0) for r in rows], SCHEMA)
    table.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(rows)
    assert sorted(map(tuple, found), key=repr) == want
    assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize("rows", [[(1, "a", "en", 2, "Ab")], [(1, "a", "en", 2, "Ab"), (2, None, "en", 2, "Ab")], [(2, "a", None, 0, ""), (1, "a", None, 0, "")]])
def test_small_trees(spark, rows):
    table = spark.createDataFrame([(*r, "t", 1, "l", 0) for r in rows], SCHEMA)
    found = merkle.proofs(table).select("doc_id", "leaf", "subroot", "root", "path", merkle.fold(F.col("leaf"), F.col("path")).alias("again"))
    for row in found.collect():
        ((_, leaf, subroot, root, _, _, _),) = [w for w in brute(rows) if w[0] == row["doc_id"]]
        assert (row["leaf"], row["subroot"], row["root"], row["again"]) == (leaf, subroot, root, root)


def test_empty_table(spark):
    found = merkle.proofs(spark.createDataFrame([], SCHEMA), carried={"more": F.lit(1)})
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path", "more"] and found.count() == 0


def test_distances_double_and_large_sides_stay(spark, monkeypatch):
    """With no broadcast allowed the rounds join by shuffles, and paths are the same."""
    rows = odd_rows()
    table = spark.createDataFrame([(*r, "t", 1, "l", 0) for r in rows], SCHEMA)
    want = {w[:4] for w in brute(rows)}
    monkeypatch.setattr(merkle, "join_small", lambda large, small, on: large.join(small, on))
    assert {(r["doc_id"], r["leaf"], r["subroot"], r["root"]) for r in merkle.proofs(table).collect()} == want
