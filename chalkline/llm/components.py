"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.session import scratch_path


def saved(table: DataFrame, name: str) -> DataFrame:
    """The table written to the shared scratch folder and read again, which cuts its lineage."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """id and label of every id in links of ``u`` and ``v``; ids that links connect, and no others, have one label.

    In each round every id takes its smallest neighbour, if smaller, as parent and then its parent's parent;
    links are moved to parents, and those that have become loops are dropped. The ids left at least halve
    per round, and a star of any size needs one.
    """
    edges = links.where("u != v").select("u", "v")
    parents = []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low"))
        parent = saved(parent.select("id", F.least("id", "low").alias("label")), "parents")
        above = parent.select(F.col("id").alias("label"), F.col("label").alias("up"))
        parents.append(parent.join(above, "label").select("id", F.col("up").alias("label")))
        at_u = parents[-1].select(F.col("id").alias("u"), F.col("label").alias("a"))
        at_v = parents[-1].select(F.col("id").alias("v"), F.col("label").alias("b"))
        moved = edges.join(at_u, "u").join(at_v, "v").where("a != b")
        edges = saved(moved.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
        if edges.isEmpty():
            break
    found = parents[0]
    for parent in parents[1:]:
        top = parent.select(F.col("id").alias("label"), F.col("label").alias("top"))
        found = found.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    return saved(found, "components")
