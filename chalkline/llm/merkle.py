"""A Merkle manifest of a dataset: a digest of every row, one of the whole, and each row's proof.

Rows are the leaves of one tree per source, whose roots are the leaves of a tree of sources. Every FANOUT
consecutive nodes make a parent. What a proof needs on its way up, the siblings on either side at each level,
is gathered by pointer jumping: every inner node holds the siblings on the way to some ancestor, and
in each round takes over what that ancestor holds, which doubles the distance, until all have reached the
root. A run of leaves meets its parent's segments once, in the last join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.operators.joins import join_small
from chalkline.session import scratch_path

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SOURCES = "*"  # the tree of sources; no other tree has this name
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(fields: list[Column]) -> Column:
    """A row's leaf: each field as its length in bytes, a colon and itself, or a dash if null."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(framed, fields))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["before"], node, level["after"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path from the leaf up, left to right, as one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


def _stored(table: DataFrame, name: str) -> DataFrame:
    spark = table.sparkSession
    path = scratch_path(spark, f"merkle-{name}")
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``place``, from 0, among those of their ``tree`` in the order of ``order``.

    Rows are range partitioned by tree and order, so a large tree lies in many tasks; the numbers of rows
    of a tree in earlier ranges, one row per range and tree, give the offsets.
    """
    row = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(B.partitions(rows), "tree", *order).sortWithinPartitions("tree", *order)
    part, at = F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    ranged = _stored(ranged.select("*", part, at), "order")
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    offsets = spans.select("part", "tree", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    placed = join_small(ranged, offsets, ["part", "tree"])
    return placed.withColumn("place", F.col("at") + F.col("offset")).select(*rows.columns, "place")


def _runs(nodes: DataFrame, place: str, members: list[str]) -> DataFrame:
    """tree, run, members: the nodes of each run of FANOUT places in order; ``alone`` if the tree has one node."""
    run = F.floor(F.col(place) / FANOUT).cast("long").alias("run")
    member = F.struct(F.col(place).alias("place"), *members)
    found = nodes.select("tree", run, member.alias("member")).groupBy("tree", "run")
    found = found.agg(F.sort_array(F.collect_list("member")).alias("members"))
    # Only a tree of one node has a first run of one.
    return found.withColumn("alone", (F.col("run") == 0) & (F.size("members") == 1))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _step(digests: Column, at: Column) -> Column:
    """The siblings on either side of the node at a place of its run."""
    return F.struct(
        _joined(F.slice(digests, F.lit(1), at)).alias("before"),
        _joined(F.slice(digests, at + 2, F.size(digests))).alias("after"),
    )


def _parents(runs: DataFrame) -> DataFrame:
    whole = F.transform("members", lambda member: member["digest"])
    return runs.where(~F.col("alone")).select("tree", F.col("run").alias("place"), digest(_joined(whole)).alias("digest"))


def _climbed(nodes: DataFrame, level: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Steps from each node to its parent, the roots, and the number of levels; nodes are at ``level``."""
    steps, roots = [], []
    while not nodes.isEmpty():
        runs = _stored(_runs(nodes, "place", ["digest"]), f"level-{level}")
        digests = F.transform("members", lambda member: member["digest"])
        child = runs.where(~F.col("alone")).select(
            "tree", F.lit(level).alias("level"), "run", digests.alias("digests"), F.posexplode("members").alias("at", "member")
        )
        steps.append(
            child.select(
                "tree", "level", F.col("member.place").alias("place"), F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"),
                F.col("run").alias("up_place"), F.array(_step(F.col("digests"), F.col("at"))).cast(_PATH).alias("path"),
            )
        )
        roots.append(
            runs.where("alone").select("tree", F.lit(level).alias("level"), F.get("members", F.lit(0))["digest"].alias("digest"))
        )
        nodes = _parents(runs)
        level += 1
    if not steps:
        return None, None, level
    for more in steps[1:]:
        steps[0] = steps[0].unionByName(more)
    for more in roots[1:]:
        roots[0] = roots[0].unionByName(more)
    return steps[0], roots[0], level


def _jumped(steps: DataFrame, root_level: int, levels: int) -> DataFrame:
    """Every inner node's whole path to the root, and its source's root, by doubling distances.

    In a round, a node whose ancestor is not the root takes over that ancestor's path and ancestor. Nodes of a
    distance share few ancestors, which are broadcast where they are few; else adaptive execution splits the
    side on which they repeat.
    """
    done = (F.col("up_tree") == _SOURCES) & (F.col("up_level") == root_level)
    jumps, distance = _stored(steps, "jumps"), 1
    while distance < levels:
        # Only these can be an ancestor at this distance or beyond.
        above = jumps.where((F.col("tree") == _SOURCES) | (F.col("level") > distance)).select(
            *[F.col(name).alias(f"up_{name}") for name in ("tree", "level", "place")],
            *[F.col(name).alias(f"next_{name}") for name in ("up_tree", "up_level", "up_place", "path", "subroot")],
        )
        met = join_small(jumps.where(~done), above, ["up_tree", "up_level", "up_place"])
        moved = met.select(
            "tree", "level", "place", *[F.col(f"next_{name}").alias(name) for name in ("up_tree", "up_level", "up_place")],
            F.concat("path", "next_path").alias("path"), F.coalesce("subroot", "next_subroot").alias("subroot"),
        )
        jumps = _stored(jumps.where(done).unionByName(moved), "jumps")
        distance *= 2
    return jumps


def proofs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: tuple[str, ...] = FIELDS,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row of ``docs``, and the ``carried`` columns.

    ``path`` has the siblings before and after the node at each level from the leaf to the root. Leaves of a
    source ascend by doc_id, null first, then by digest, so rows that repeat an id, or a whole row, have places,
    too. A null source is one of its own, before all others; null fields and empty texts have digests that
    differ. Texts are read once and only digests leave the scan, so long texts cost their hashing. An empty
    table has no rows and no root. ``carried`` columns are made from ``docs`` in the same scan.
    """
    carried = carried or {}
    # Names of trees: nothing for the null source, which so comes first, else a mark and the source.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("")).alias("tree")
    leaf = row_digest([F.col(name) for name in fields]).alias("leaf")
    extra = [value.alias(name) for name, value in carried.items()]
    leaves = _stored(docs.select(tree, F.col(doc_id).alias("doc_id"), leaf, *extra), "leaves")
    leaves = _placed(leaves, ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    runs = _stored(_runs(leaves, "place", ["doc_id", "digest", *carried]), "leaf-runs")

    steps, roots, levels = _climbed(_parents(runs), 1)
    alone = runs.where("alone").select("tree", F.lit(0).alias("level"), F.get("members", F.lit(0))["digest"].alias("digest"))
    tops = _stored(alone if roots is None else alone.unionByName(roots), "source-roots")
    sources = _stored(_placed(tops, ["level"]).select(F.col("tree").alias("source"), "level", "digest"), "sources")
    sources = _placed(sources.withColumn("tree", F.lit(_SOURCES)), ["source"])
    top_steps, top_roots, top_level = _climbed(_stored(sources.select("tree", "place", "digest"), "tree-of-sources"), 0)
    root_row = None if top_roots is None else top_roots.select("level", "digest").first()
    root_level, root = (0, None) if root_row is None else root_row

    nothing = F.lit(None).cast("string").alias("subroot")
    up = sources.select(
        F.col("source").alias("tree"), "level", F.lit(0).cast("long").alias("place"), F.lit(_SOURCES).alias("up_tree"),
        F.lit(0).alias("up_level"), F.col("place").alias("up_place"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("subroot"),
    )
    for some in (steps, top_steps):
        if some is not None:
            up = up.unionByName(some.select("*", nothing))
    jumps = _jumped(up, root_level, levels + 1 + top_level)

    to_level = F.when(F.col("alone"), F.lit(0)).otherwise(F.lit(1))
    starts = runs.select("tree", to_level.alias("level"), F.col("run").alias("place"), "members", "alone")
    met = starts.join(jumps.select("tree", "level", "place", "path", "subroot"), ["tree", "level", "place"])
    digests = F.transform("members", lambda member: member["digest"])
    each = met.select("alone", "path", "subroot", digests.alias("digests"), F.posexplode("members").alias("at", "member"))
    own = F.when(F.col("alone"), F.array().cast(_PATH)).otherwise(F.array(_step(F.col("digests"), F.col("at"))).cast(_PATH))
    return each.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("member.digest").alias("leaf"),
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.concat(own, "path").alias("path"),
        *[F.col(f"member.{name}").alias(name) for name in carried],
    )
