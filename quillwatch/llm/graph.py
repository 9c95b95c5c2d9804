"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.sources.shared import materialize


def _nearest(edges: DataFrame) -> DataFrame:
    """u, v in both directions and m, the least of u and all its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of all nodes of the edges a, b (different numbers).

    Large-star and small-star steps in turn make every component a star around its least node. Each step is a grouping and a join, written to
    the shared folder; the driver sees a count and a checksum of the edges only.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    before = None
    while True:
        large = _nearest(edges).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        # Small star: every node u with its smaller neighbours, all tied to the least of them.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u")
        edges = materialize(tied.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
                            .where("a != b").distinct(), "star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root after more edges: only the roots that they tie together are gone through again."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    tied = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = materialize(components(tied), "moved")
    if moved.isEmpty():
        return roots
    nodes = roots.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    again = moved.select(F.col("node").alias("root"), F.col("root").alias("least"))
    return materialize(nodes.join(again, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "components")
