"""Exact order statistics of keys of any size: no task sorts or holds a key's rows.

Medians are selected, not sorted for: rows are counted per range of values, the range that holds the middle is cut into ranges again, and so on; each
round is a count with map-side combining, and only rows of the chosen range are looked at again. Ranks come from range partitions: distinct values are dealt out
in order, and a value's rank is its place in its partition plus the counts of the partitions before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.sources.shared import materialize

#: A round tells 2^DIGIT ranges of a key apart.
DIGIT = 12


def _on(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [c(x).eqNullSafe(c(y)) for x, y in zip(left, right, strict=True)])


def doubled_medians(rows: DataFrame, keys: list[str], value) -> DataFrame:
    """keys and ``twice``: two times the median of whole numbers per key (so it is one itself). Nulls do not count; a key without values has no row.

    A key's values must lie within 2^62 of each other."""
    held = materialize(rows.select(*keys, c(value).cast("bigint").alias("_v")).filter("_v IS NOT NULL"), "values")
    stats = materialize(held.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")), "spans")
    span = stats.agg(F.max(c("_hi") - c("_lo"))).first()[0]
    names = [f"_k{i}" for i in range(len(keys))]
    middle = F.array_distinct(F.array(F.floor((c("_n") - 1) / 2), F.floor(c("_n") / 2)))
    targets = stats.select(*[c(k).alias(n) for k, n in zip(keys, names, strict=True)], "_lo", F.explode(middle).alias("_rank")).withColumns({"_which": c("_rank"), "_in": F.lit(0).cast("bigint")})
    rounds = max(1, -(-int(span or 0).bit_length() // DIGIT))
    for shift in range(DIGIT * (rounds - 1), -1, -DIGIT):
        at = lambda n: F.shiftright(c("_v") - c("_lo"), n)  # noqa: B023, E731
        inside = F.lit(True) if shift + DIGIT >= 63 else at(shift + DIGIT) == c("_in")
        counts = held.join(targets, _on(keys, names)).filter(inside).groupBy(*names, "_lo", "_which", "_rank", at(shift).alias("_range")).agg(F.count("*").alias("_held"))
        upto = F.sum("_held").over(Window.partitionBy(*names, "_which").orderBy("_range"))
        chosen = counts.withColumn("_upto", upto).filter("_upto > _rank AND _upto - _held <= _rank")
        targets = materialize(chosen.select(*names, "_lo", "_which", (c("_rank") - (c("_upto") - c("_held"))).alias("_rank"), c("_range").alias("_in")), "middle")
    found = targets.groupBy(*names).agg(F.sum(c("_in") + c("_lo")).alias("_sum"), F.count("*").alias("_of"))
    return found.select(*[c(n).alias(k) for k, n in zip(keys, names, strict=True)], (c("_sum") * (2 / c("_of")).cast("bigint")).alias("twice"))


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their place within the group by ``order``, from 0. Rows are dealt out by range, so a large group takes many tasks."""
    by = [*[c(g).asc_nulls_first() for g in group], *order]
    laid = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "laid-out")
    laid = laid.withColumns({"_part": F.shiftright("_place", 33), "_place": c("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    names = [f"_g{i}" for i in range(len(group))]
    counts = laid.groupBy(*group, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[c(g).alias(n) for g, n in zip(group, names, strict=True)], c("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - c("_first")).alias("_shift"))
    joined = laid.join(materialize(counts, "range-counts"), _on([*group, "_part"], [*names, "_p"]))
    return joined.withColumn(name, c("_place") + c("_shift")).drop("_place", "_part", "_p", "_shift", *names)


def dense_ranks(rows: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """rows with the dense rank of ``value`` within the group, the largest first; nulls come last."""
    values = numbered(rows.select(*group, value).distinct(), group, [c(value).desc_nulls_last()], "_n")
    names = [f"_q{i}" for i in range(len(group) + 1)]
    side = values.select(*[c(x).alias(n) for x, n in zip([*group, value], names, strict=True)], (c("_n") + 1).alias(name))
    return rows.join(side, _on([*group, value], names)).select(*rows.columns, name)
