"""Windows anchored at their first event.

A window opens at the first event of a key and lasts ``width`` from it; the next event at or after its
end opens the next one. Neither tumbling nor session windows express this, and the chain of openings is
sequential by nature, so the work is arranged to keep it parallel:

* time is cut into buckets of the window's width, so a bucket holds at most one opening;
* a silence of at least one width restarts the chain, so runs of busy buckets are independent;
* a run that fits one window opens once, at its first event: no per-event work at all;
* an ordinary run is folded inside the JVM over its distinct instants; so is one of more than ``fold_limit``
  instants, up to ``FOLD_MOST``, that lasts fewer than ``fold_limit`` widths and so opens no more windows than those;
* a longer run (a hot key that is never silent) is resolved by pointer
  doubling: each instant points at the opening that would follow it, and pointers are composed over
  blocks of 2, 4, 8... buckets. Only instants that can start a block are kept, so level k holds about
  1/2^k of the rows, and no task ever sees the whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, from_micros, micros
from quillwatch.sources.shared import materialize

#: Openings of a run that is folded in one row: their list is copied as it grows, so longer runs take the other way. Instants of such a run, 8 bytes each.
FOLD_LIMIT, FOLD_MOST = 20_000, 1 << 20


def _runs(ticks: DataFrame, keys, width: int) -> DataFrame:
    """One row per (key, bucket): its bounds and the run of busy buckets it belongs to."""
    b = ticks.groupBy(*keys, "_b").agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_b")
    fresh = F.coalesce(c("lo") - F.lag("hi").over(w) >= width, F.lit(True))
    b = b.withColumn("fresh", fresh).withColumn("run", F.max(F.when(c("fresh"), c("lo"))).over(w))
    whole = Window.partitionBy(*keys, "run")
    return b.drop("fresh").withColumns({"run_n": F.sum("n").over(whole), "run_hi": F.max("hi").over(whole),
                                        "next_lo": F.lead("lo").over(whole.orderBy("_b")),
                                        "b0": F.min("_b").over(whole)})


def _fold(ticks: DataFrame, keys, width: int) -> DataFrame:
    """Greedy openings of ordinary runs, inside the JVM."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("opens"))

    def step(acc, t):
        opens = acc["last"].isNull() | (t >= acc["last"] + width)
        return F.when(opens, F.struct(t.alias("last"), F.concat(acc["opens"], F.array(t)).alias("opens"))).otherwise(acc)

    folded = F.aggregate(F.array_sort(F.collect_list("_us")), start, step, lambda acc: acc["opens"])
    return ticks.groupBy(*keys, "run").agg(folded.alias("o")).select(*keys, F.explode("o").alias("anchor"))


def _pointers(ticks: DataFrame, buckets: DataFrame, keys, width: int) -> DataFrame:
    """For every instant of a hot run: the opening that follows a window opened there."""
    k = [*keys, "run", "b0"]
    none = F.lit(None).cast("bigint")
    seen = ticks.select(*k, "_b", c("_us").alias("pos"), c("_us").alias("open"), none.alias("src"), none.alias("src_b"))
    later = buckets.select(*k, "_b", c("next_lo").alias("pos"), c("next_lo").alias("open"), none.alias("src"), none.alias("src_b")).filter("pos IS NOT NULL")
    asks = ticks.select(*k, (c("_b") + 1).alias("_b"), (c("_us") + width).alias("pos"), none.alias("open"), c("_us").alias("src"), c("_b").alias("src_b"))
    w = Window.partitionBy(*k, "_b").orderBy(c("pos").desc()).rangeBetween(Window.unboundedPreceding, 0)  # running, so each row is read once
    nxt = seen.unionByName(later).unionByName(asks).withColumn("x", F.min("open").over(w)).filter("src IS NOT NULL")
    lows = buckets.select(*[c(x).alias(f"_q_{x}") for x in keys], c("_b").alias("_q_b"), "lo")
    on = [c(x) == c(f"_q_{x}") for x in keys] + [c("src_b") == c("_q_b")]
    bucket = lambda t: F.floor(c(t) / width).cast("bigint") - c("b0")
    return nxt.join(lows, on).select(*keys, "run", c("src").alias("e"), (c("src_b") - c("b0")).alias("r"),
                                     (c("src") == c("lo")).alias("first"), "x", bucket("x").alias("xr"))


def _double(ticks: DataFrame, buckets: DataFrame, keys, width: int) -> DataFrame:
    k = [*keys, "run"]
    span = buckets.agg(F.max(c("_b") - c("b0"))).first()[0]
    levels = [materialize(_pointers(ticks, buckets, keys, width), "pointers-0")]
    while (1 << (len(levels) - 1)) <= span:
        n = len(levels)
        block = lambda x: F.shiftright(c(x), n)
        edge = F.shiftleft(block("r"), n)
        entry = (c("r") == edge) | ((c("r") == edge + 1) & c("first"))
        prev = levels[-1]
        hop = prev.select(*[c(x).alias(f"_q_{x}") for x in k], c("e").alias("_q_e"), c("x").alias("x2"), c("xr").alias("xr2"))
        on = [c(x) == c(f"_q_{x}") for x in k] + [c("x") == c("_q_e")]
        inside = F.coalesce(block("xr") == block("r"), F.lit(False))
        up = prev.filter(entry).join(hop, on, "left").select(
            *k, "e", "r", "first", F.when(inside, c("x2")).otherwise(c("x")).alias("x"), F.when(inside, c("xr2")).otherwise(c("xr")).alias("xr"))
        levels.append(materialize(up, f"pointers-{n}"))
    opens = buckets.select(*k, c("run").alias("e")).distinct()
    for n in range(len(levels) - 2, -1, -1):
        t = levels[n].select(*[c(x).alias(f"_q_{x}") for x in k], c("e").alias("_q_e"), "r", "x", "xr")
        on = [c(x) == c(f"_q_{x}") for x in k] + [c("e") == c("_q_e")]
        same = F.coalesce(F.shiftright(c("xr"), n + 1) == F.shiftright(c("r"), n + 1), F.lit(False))
        step = opens.join(t, on, "left")
        opens = step.select(*k, F.explode(F.when(same, F.array("e", "x")).otherwise(F.array("e"))).alias("e"))
    return opens.select(*keys, c("e").alias("anchor"))


def anchors(df: DataFrame, keys, ts, width_us: int, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Openings (key, ``anchor`` in microseconds). Keys must not be NULL."""
    ticks = materialize(df.select(*keys, micros(ts).alias("_us")).distinct(), "ticks").withColumn("_b", F.floor(c("_us") / width_us).cast("bigint"))
    buckets = materialize(_runs(ticks, keys, width_us), "buckets")
    single = c("run_hi") - c("run") < width_us
    folds = (c("run_n") <= fold_limit) | ((c("run_n") <= FOLD_MOST) & (c("run_hi") - c("run") < fold_limit * width_us))
    out = buckets.filter(single & (c("lo") == c("run"))).select(*keys, c("run").alias("anchor"))
    marks = buckets.select(*[c(x).alias(f"_q_{x}") for x in keys], c("_b").alias("_q_b"), "run", "b0", folds.alias("folds"), single.alias("single"))
    on = [c(x) == c(f"_q_{x}") for x in keys] + [c("_b") == c("_q_b")]
    many = ticks.join(marks.filter("NOT single"), on).select(*keys, "_us", "_b", "run", "b0", "folds")
    out = out.unionByName(_fold(many.filter("folds"), keys, width_us))
    hot = buckets.filter(~single & ~folds)
    if not hot.isEmpty():
        out = out.unionByName(_double(many.filter("NOT folds"), hot, keys, width_us))
    return out


def assign(df: DataFrame, keys, ts, width_us: int, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Add ``window_start``: the opening of the window each row falls in.

    A bucket sees at most two openings, its own and the previous bucket's, so rows find theirs by an
    equi-join on (key, bucket) with a table far smaller than the events.
    """
    a = anchors(df, keys, ts, width_us, fold_limit).withColumn("_b", F.floor(c("anchor") / width_us).cast("bigint"))
    none = F.lit(None).cast("bigint")
    seen = (a.select(*keys, "_b", c("anchor").alias("own"), none.alias("old"))
            .unionByName(a.select(*keys, (c("_b") + 1).alias("_b"), none.alias("own"), c("anchor").alias("old")))
            .groupBy(*keys, "_b").agg(F.max("own").alias("own"), F.max("old").alias("old"))
            .select(*[c(x).alias(f"_q_{x}") for x in keys], c("_b").alias("_q_b"), "own", "old"))
    rows = df.withColumn("_us", micros(ts)).withColumn("_b", F.floor(c("_us") / width_us).cast("bigint"))
    on = [c(x) == c(f"_q_{x}") for x in keys] + [c("_b") == c("_q_b")]
    start = F.when(c("own") <= c("_us"), c("own")).otherwise(c("old"))
    return rows.join(seen, on).withColumn("window_start", from_micros(start)).drop("_us", "_b", "_q_b", "own", "old", *[f"_q_{x}" for x in keys])
