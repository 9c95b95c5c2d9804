"""Ordered per-key computations that stay parallel when one key holds most of the rows.

A window partitioned by the key alone puts a hot key into a single task. Here every key is cut into
time slices: the heavy window runs per (key, slice), one summary row per slice carries what crosses
the borders and is put in front of its slice, so the heavy rows are shuffled once. The summary has at
most one row per key and slice, however many events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, micros

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR
SLICE = "_slice"


def slice_of(ts, width: int) -> Column:
    return F.floor(micros(ts) / width).cast("bigint")


def _sliced(df: DataFrame, ts, width) -> DataFrame:
    key = ts if isinstance(ts, Column) else slice_of(ts, width)
    return df.withColumn(SLICE, key)


def _with_carry(d: DataFrame, carry: DataFrame) -> DataFrame:
    """Put one carry row in front of every (key, slice); ``_row`` is 0 for it and 1 for real rows."""
    return (d.withColumn("_row", F.lit(1))
            .unionByName(carry.withColumn("_row", F.lit(0)), allowMissingColumns=True))


def _before(keys):
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys, ts, order, sums: dict, width: int = HOUR) -> DataFrame:
    """Inclusive running sums per key in ``order``. ``ts`` may be a ready slice column."""
    d = _sliced(df, ts, width)
    for name, value in sums.items():
        d = d.withColumn(f"_v_{name}", F.coalesce(c(value).cast("bigint"), F.lit(0)))
    totals = d.groupBy(*keys, SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carry = totals.select(*keys, SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(_before(keys)), F.lit(0)).alias(f"_v_{n}") for n in sums])
    local = Window.partitionBy(*keys, SLICE).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_carry(d, carry).withColumns({n: F.sum(f"_v_{n}").over(local) for n in sums})
    return out.filter("_row = 1").drop(SLICE, "_row", *[f"_v_{n}" for n in sums])


def running_max(df: DataFrame, keys, ts, order, maxes: dict, width: int = HOUR, strict: bool = True) -> DataFrame:
    """Running maximum per key over the preceding rows (``strict``) or including the row itself."""
    d = _sliced(df, ts, width)
    for name, value in maxes.items():
        d = d.withColumn(f"_v_{name}", c(value))
    tops = d.groupBy(*keys, SLICE).agg(*[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes])
    carry = tops.select(*keys, SLICE, *[F.max(f"_t_{n}").over(_before(keys)).alias(f"_v_{n}") for n in maxes])
    local = Window.partitionBy(*keys, SLICE).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    out = _with_carry(d, carry).withColumns({n: F.max(f"_v_{n}").over(local) for n in maxes})
    return out.filter("_row = 1").drop(SLICE, "_row", *[f"_v_{n}" for n in maxes])


def previous(df: DataFrame, keys, ts, order, cols: dict, width: int = HOUR) -> DataFrame:
    """``lag`` by one row per key in ``order``; adds one column per entry of ``cols``."""
    d = _sliced(df, ts, width).withColumn("_pack", F.struct(*[c(v).alias(n) for n, v in cols.items()]))
    last = d.groupBy(*keys, SLICE).agg(F.max_by("_pack", F.struct(*[c(o) for o in order])).alias("_last"))
    carry = last.select(*keys, SLICE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_pack"))
    prev = F.lag("_pack").over(Window.partitionBy(*keys, SLICE).orderBy("_row", *order))
    out = _with_carry(d, carry).withColumn("_lagged", prev).filter("_row = 1")
    return out.withColumns({n: F.col("_lagged")[n] for n in cols}).drop(SLICE, "_row", "_pack", "_lagged")


def halo(df: DataFrame, ts, lookback_us: int, width: int) -> DataFrame:
    """Copy each row into every later slice that can still see it.

    A range frame over (key, ``_slice``) is then complete for the rows flagged ``_home``; rows are
    copied only when they lie within ``lookback_us`` of a border.
    """
    us = micros(ts)
    home = F.floor(us / width).cast("bigint")
    last = F.floor((us + lookback_us) / width).cast("bigint")
    return (df.withColumn("_h", home).withColumn(SLICE, F.explode(F.sequence(home, last)))
            .withColumn("_home", F.col(SLICE) == F.col("_h")).drop("_h"))


def range_counts(df: DataFrame, keys, ts, lookback_us: int, counts: dict, width: int = HOUR) -> DataFrame:
    """Per row: how many rows of the key satisfy each condition in [ts - lookback, ts]."""
    h = halo(df, ts, lookback_us, width).withColumn("_us", micros(ts))
    w = Window.partitionBy(*keys, SLICE).orderBy("_us").rangeBetween(-lookback_us, 0)
    for name, cond in counts.items():
        h = h.withColumn(name, F.sum(cond.cast("bigint")).over(w))
    return h.filter("_home").drop("_home", "_us", SLICE)


def range_distinct(df: DataFrame, keys, ts, value, lookback_us: int, name: str, width: int = HOUR) -> DataFrame:
    """Per row: distinct non-null values of the key in [ts - lookback, ts], without collecting sets.

    A value is alive from each occurrence until it is repeated or leaves the frame. With +1 at the
    start and -1 at the end of those intervals a running sum gives the count of live values.
    """
    k = [c(x) for x in keys]
    occ = df.filter(c(value).isNotNull()).select(*k, micros(ts).alias("_us"), c(value).alias("_val")).distinct()
    # An occurrence that is repeated within the frame hands over to the repeat, so it ends there.
    nxt = previous(occ.withColumn("_neg", -F.col("_us")), keys + ["_val"], F.floor(F.col("_neg") / width).cast("bigint"),
                   ["_neg"], {"_next": F.col("_us")}, width)
    ends = F.least(F.coalesce(F.col("_next"), F.col("_us") + lookback_us + 1), F.col("_us") + lookback_us + 1)
    spans = nxt.select(*k, F.explode(F.array(
        F.struct(F.col("_us").alias("_at"), F.lit(1).alias("_d")),
        F.struct(ends.alias("_at"), F.lit(-1).alias("_d")))).alias("_x")).select(*keys, "_x.*")
    steps = spans.groupBy(*keys, "_at").agg(F.sum("_d").alias("_d"))
    rows = df.withColumn("_at", micros(ts))
    marks = steps.select(*keys, "_at", "_d", F.lit(0).alias("_q")).unionByName(
        rows.select(*keys, "_at", F.lit(0).cast("bigint").alias("_d"), F.lit(1).alias("_q")).distinct())
    live = running(marks, keys, F.floor(F.col("_at") / width).cast("bigint"), ["_at", "_q"], {name: F.col("_d")}, width)
    live = live.filter("_q = 1").select(*[c(x).alias(f"_l_{x}") for x in keys], c("_at").alias("_l_at"), name)
    on = [rows[x].eqNullSafe(live[f"_l_{x}"]) for x in keys] + [rows["_at"] == live["_l_at"]]
    return rows.join(live, on, "left").drop("_at", "_l_at", *[f"_l_{x}" for x in keys])
