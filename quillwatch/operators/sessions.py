"""Per-key state machines over history: lockouts, rate limits, heartbeats, registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, from_micros, micros, seconds
from quillwatch.operators import anchored, split

# Attempts before a lock, its length, batch limit and heartbeat timeout.
MAX_ATTEMPTS, LOCK_S = 5, 15 * 60
MAX_PER_SECOND = 100_000
DARK_AFTER_S = 90


def lockouts(attempts: DataFrame, keys, failed, ok, attempts_allowed: int = MAX_ATTEMPTS, lock_s: int = LOCK_S, width: int = split.DAY) -> DataFrame:
    """Failure count since the last success at each failure, and until when it locks.

    A success always clears the count and every failure at or beyond the limit renews the lock, so the
    count is the running number of failures minus its value at the last success: two sliced running
    computations instead of a walk through the key's history."""
    order = ["ts", "event_id"]
    rows = attempts.filter(failed | ok)
    d = split.running(rows, keys, "ts", order, {"_fails": failed.cast("int")}, width)
    d = split.running_max(d, keys, "ts", order, {"_cleared": F.when(ok, c("_fails"))}, width)
    d = d.filter(failed).withColumn("failures", c("_fails") - F.coalesce("_cleared", F.lit(0)))
    until = F.when(c("failures") >= attempts_allowed, c("ts") + seconds(lock_s))
    return d.withColumn("locked_until", until).drop("_fails", "_cleared")


def lockouts_expiring(attempts: DataFrame, keys, failed, ok, attempts_allowed: int = MAX_ATTEMPTS, lock_s: int = LOCK_S, width: int = split.DAY) -> DataFrame:
    """The persistent variant: an expired lock also resets the count.

    While locked every failure renews the lock, so it can only expire across a silence of ``lock_s``.
    Failures are grouped into bursts without such a silence or a success inside; only the burst sizes
    are folded in order (their number is bounded by time, not by failures), which gives each burst the
    count it starts from."""
    order, lock_us = ["ts", "event_id"], lock_s * split.SECOND
    d = split.running(attempts.filter(failed | ok), keys, "ts", order, {"_run": ok.cast("int")}, width).filter(failed).withColumn("_us", micros("ts"))
    d = split.previous(d, [*keys, "_run"], "ts", order, {"_prev": c("_us")}, width)
    fresh = c("_prev").isNull() | (c("_us") - c("_prev") >= lock_us)
    d = split.running_max(d, [*keys, "_run"], "ts", order, {"_burst": F.when(fresh, c("_us"))}, width, strict=False)
    bursts = d.groupBy(*keys, "_run", "_burst").agg(F.count("*").alias("n"))
    one = F.struct(c("_burst").alias("b"), c("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("acc"), F.array().cast("array<struct<b:bigint,base:bigint>>").alias("out"))
    step = lambda s, x: F.struct(F.when(s["acc"] + x["n"] >= attempts_allowed, F.lit(0).cast("bigint")).otherwise(s["acc"] + x["n"]).alias("acc"),
                                 F.concat(s["out"], F.array(F.struct(x["b"].alias("b"), s["acc"].alias("base")))).alias("out"))
    bases = (bursts.groupBy(*keys, "_run").agg(F.aggregate(F.array_sort(F.collect_list(one)), start, step, lambda s: s["out"]).alias("o"))
             .select(*keys, "_run", F.explode("o").alias("x")).select(*[c(k).alias(f"_k_{k}") for k in keys], c("_run").alias("_k_run"), c("x.b").alias("_k_b"), "x.base"))
    nth = split.running(d, [*keys, "_run", "_burst"], "ts", order, {"_nth": F.lit(1)}, width)
    on = [c(k) == c(f"_k_{k}") for k in keys] + [c("_run") == c("_k_run"), c("_burst") == c("_k_b")]
    out = nth.join(bases, on).withColumn("failures", c("base") + c("_nth"))
    return out.withColumn("locked_until", F.when(c("failures") >= attempts_allowed, c("ts") + seconds(lock_s))).drop(
        "_run", "_us", "_prev", "_burst", "_nth", "base", "_k_run", "_k_b", *[f"_k_{k}" for k in keys])


def limit_batches(batches: DataFrame, keys, size, limit: int = MAX_PER_SECOND, width_us: int = split.SECOND) -> DataFrame:
    """Accept or refuse whole batches: windows open at a key's first batch and last ``width_us``; a batch
    that would exceed the limit is refused and not counted.

    The fold runs per (key, window). A refused batch never counts, so a batch larger than what is left
    is simply skipped; one window of one sender is one second of its batches."""
    w = anchored.assign(batches, keys, "ts", width_us)
    item = F.struct(micros("ts").alias("us"), c("batch_id"), c(size).cast("bigint").alias("n"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<batch_id:bigint,accepted:boolean>>").alias("out"))

    def step(s, x):
        fits = s["used"] + x["n"] <= limit
        return F.struct(F.when(fits, s["used"] + x["n"]).otherwise(s["used"]).alias("used"),
                        F.concat(s["out"], F.array(F.struct(x["batch_id"].alias("batch_id"), fits.alias("accepted")))).alias("out"))

    done = w.groupBy(*keys, "window_start").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda s: s["out"]).alias("o"))
    return done.select(*keys, "window_start", F.explode("o").alias("x")).select(*keys, "window_start", "x.*")


def dark_periods(beats: DataFrame, key="agent_id", after_s: int = DARK_AFTER_S, width: int = split.DAY) -> DataFrame:
    """Silences longer than the timeout between two heartbeats of an agent."""
    prev = split.previous(beats, [key], "ts", ["ts"], {"_p": micros("ts")}, width)
    gap = micros("ts") - c("_p")
    return prev.filter(gap > after_s * split.SECOND).select(key, from_micros(c("_p") + after_s * split.SECOND).alias("dark_from"), c("ts").alias("revived_at"))


def dark_now(beats: DataFrame, now: str, keys=("agent_id",), after_s: int = DARK_AFTER_S) -> DataFrame:
    last = beats.groupBy(*keys).agg(F.max("ts").alias("last_heartbeat"))
    return last.withColumn("is_dark", c("last_heartbeat") < F.lit(now).cast("timestamp_ntz") - seconds(after_s))


def registry(registrations: DataFrame, beats: DataFrame, now: str, keys=("tenant_id", "hostname")) -> DataFrame:
    """One row per host of a tenant with its newest registration and whether it is alive."""
    keys = list(keys)
    rest = [x for x in registrations.columns if x not in keys]
    latest = registrations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("x")).select(*keys, "x.*")
    return latest.join(dark_now(beats, now, keys), keys, "left").withColumn("active", ~F.coalesce("is_dark", F.lit(True)))
