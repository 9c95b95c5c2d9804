"""Merkle manifest of a dataset: a tree of hashes per group of rows, one root over the groups, and for every row the proof that it belongs to the root.

Rows are numbered within their group from range partitions and the counts of those, so no task holds a group. The digits of a number become columns; within a
block of fanout^levels numbers, which is the unit that is shuffled, they are grouped away one after the other, from the last on: each step nests the nodes of a run
in a struct with their hash. Blocks of blocks are rolled up in the same way until every group is one node. Proofs come from the nested structs: a transform walks
down a block and notes the siblings on both sides at every step, an explode gives its rows. Proofs of a block meet the block by a grouping on
its number; there is no join. What is joined is only the count of each range partition, while numbering.

Trees of groups of different sizes share the passes: a level hashes only the groups that still have more than one node, the others pass through.

Defined cases: nulls of hashed columns are the text "-"; the null group comes first and is a group like others; rows are in order of their order column, nulls
first, equal ones by leaf, and fully equal rows are leaves each; an empty table has no rows and no root. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.sources.shared import materialize

#: Steps of a block: it holds fanout^LEVELS nodes.
LEVELS = 8
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length and value, so that no two rows give the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g and others) with number (from 0, by `order` within g) and total of g."""
    by = [F.col(c).asc_nulls_first() for c in ["g", *order]]
    laid = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = laid.groupBy("g", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select(F.col("g").alias("_g"), F.col("part").alias("_part"), (before - F.col("first")).alias("shift"), F.sum("held").over(group).alias("total")), "counts")
    joined = laid.join(counts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    return joined.withColumn("number", F.col("place") + F.col("shift")).drop("part", "place", "shift", "_g", "_part")


def _rolled(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """g, total, number, h, load to g, total, block, node: the nested struct of each block."""
    digit = [F.floor(F.col("number") / fanout**i) % fanout for i in range(levels)]
    rows = nodes.select("g", "total", F.floor(F.col("number") / fanout**levels).alias("block"), *[d.alias(f"d{i}") for i, d in enumerate(digit)], F.struct("h", "load").alias("node"))
    rows = rows.repartition("g", "block")
    for i in range(levels):
        keys = ["g", "total", "block", *[f"d{k}" for k in range(levels - 1, i, -1)]]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{i}", "node"))).alias("run"))
        kids = F.transform("run", lambda x: x["node"])
        rows = rows.select(*keys, kids.alias("kids"))
        h = F.when(F.col("total") > fanout**i, F.sha2(F.array_join(F.transform("kids", lambda x: x["h"]), ""), 256)).otherwise(F.col("kids")[0]["h"])
        rows = rows.select(*keys, F.struct(h.alias("h"), "kids").alias("node"))
    return rows


def _passes(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of blocks, from the leaves' blocks to one block per group. One number is read per call, the size of the largest group."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    made, size = [], fanout**levels
    while True:
        blocks = materialize(_rolled(nodes, fanout, levels), "blocks")
        made.append(blocks)
        if most <= size:
            return made
        most = -(-most // size)
        nodes = blocks.select("g", F.ceil(F.col("total") / size).alias("total"), F.col("block").alias("number"), F.col("node.h").alias("h"), F.col("block").alias("load"))


def _walk(node: Column, path: Column, total: Column, fanout: int, level: int) -> Column:
    """Leaves below a node of `level`, each with its path: siblings to the left and right, the nearest first."""
    if level == 0:
        return F.array(F.struct(node["h"].alias("h"), node["load"].alias("load"), path.alias("path")))
    kids = node["kids"]

    def down(kid: Column, at: Column) -> Column:
        text = lambda part: F.array_join(F.transform(part, lambda x: x["h"]), "")
        step = F.struct(text(F.slice(kids, F.lit(1), at)).alias("left"), text(F.slice(kids, at + 2, F.size(kids))).alias("right"))
        longer = F.when(total > fanout**(level - 1), F.concat(F.array(step), path)).otherwise(path)
        return _walk(kid, longer, total, fanout, level - 1)
    return F.flatten(F.transform(kids, down))


def _descended(passes: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """g, h, load, path, up of all leaves. tops: g, path and up (a struct handed down) of every group."""
    rows = tops.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in enumerate(reversed(passes)):
        none = {"path": F.lit(None).cast(rows.schema["path"].dataType), "up": F.lit(None).cast(rows.schema["up"].dataType)}
        both = blocks.withColumns(none).unionByName(rows.select("g", "block", "path", "up"), allowMissingColumns=True)
        known = lambda c: F.first(c, ignorenulls=True).alias(c)
        met = both.groupBy("g", "block").agg(*[known(c) for c in ("total", "node", "path", "up")])
        found = F.explode(_walk(F.col("node"), F.col("path"), F.col("total"), fanout, levels)).alias("leaf")
        rows = met.select("g", "up", found).select("g", "up", "leaf.*")
        if k < len(passes) - 1:
            rows = materialize(rows.select("g", F.col("load").alias("block"), "path", "up"), "proofs")
    return rows


def manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, carry: Column, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """carry (a struct of the caller's, per row), leaf, subroot, root, path (array of left, right: the siblings' hashes, level by level) of every row of docs.

    fanout: nodes of a run. levels: steps of a block; fanout^levels leaves are the most that one row holds nested.
    """
    leaves = materialize(docs.select(group.alias("g"), order.alias("o"), leaf.alias("h"), carry.alias("load"), F.monotonically_increasing_id().alias("row")), "leaves")
    lower = _passes(_numbered(leaves, ["o", "h", "row"]), fanout, levels)
    groups = lower[-1].select(F.lit(0).alias("g"), F.col("g").alias("o"), F.col("node.h").alias("h")).withColumn("load", F.struct(F.col("o").alias("g"), F.col("h").alias("subroot")))
    upper = _passes(_numbered(groups, ["o"]), fanout, levels)
    roots = upper[-1].select("g", F.array().cast(PATH).alias("path"), F.struct(F.col("node.h").alias("root")).alias("up"))
    tops = _descended(upper, roots, fanout, levels)
    tops = materialize(tops.select(F.col("load.g").alias("g"), "path", F.struct("load.subroot", "up.root").alias("up")), "subroots")
    rows = _descended(lower, tops, fanout, levels)
    return rows.select(F.col("load").alias("carry"), F.col("h").alias("leaf"), F.col("up.subroot").alias("subroot"), F.col("up.root").alias("root"), "path")
