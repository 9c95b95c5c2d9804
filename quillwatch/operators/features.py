"""Behavioural features and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, micros
from quillwatch.operators import ranks, split
from quillwatch.operators.risk import ANOMALY_FLOOR, BEACON_FLOOR, EXFIL_FLOOR
from quillwatch.sources.shared import materialize

FIVE_MINUTES = 5 * split.MINUTE
# Shape of the beacon vector.
MIN_INTERVALS, VECTOR_LENGTH = 3, 128


def recent_counts(events: DataFrame) -> DataFrame:
    """Failures, connections and process starts of the user in the last five minutes, row included."""
    return split.range_counts(events, ["tenant_id", "user_name"], "ts", FIVE_MINUTES, {
        "failed_auth_5m": c("event_type") == "auth_failure", "connections_5m": c("event_type") == "network_connect",
        "processes_5m": c("event_type") == "process_create"})


def recent_destinations(events: DataFrame) -> DataFrame:
    return split.range_distinct(events, ["tenant_id", "user_name"], "ts", "dst_ip", FIVE_MINUTES, "unique_dst_5m")


def interarrival(events: DataFrame, keys=("src_ip", "dst_ip"), width: int = split.DAY) -> DataFrame:
    """Seconds since the previous connection of the pair (NULL for its first)."""
    prev = split.previous(events, list(keys), "ts", ["ts", "event_id"], {"prev_us": micros("ts")}, width)
    return prev.withColumn("gap_s", F.round((micros("ts") - c("prev_us")) / 1000000, 6)).drop("prev_us")


def daily_bytes(flows: DataFrame, key="asset") -> DataFrame:
    return flows.groupBy(key, "day").agg(F.sum("bytes").alias("bytes"))


def baseline_30d(daily: DataFrame, key="asset") -> DataFrame:
    """Mean of the 30 days before each day. Rows are per key and day, so a frame stays small."""
    day = F.unix_date("day")
    w = Window.partitionBy(key).orderBy("_d").rangeBetween(-30, -1)
    return daily.withColumn("_d", day).withColumn("baseline", F.round(F.avg("bytes").over(w), 6)).drop("_d")


def outliers(daily: DataFrame, key="asset") -> DataFrame:
    """z-score and MAD distance of each day against the key's own days. Medians are exact, whatever the number of rows of a key."""
    daily = materialize(daily, "daily")
    alias = lambda df, name: df.select(c(key).alias(f"_{name}_key"), c("twice").alias(name))
    middle = alias(ranks.doubled_medians(daily, [key], "bytes"), "_med2")
    stats = daily.groupBy(key).agg(F.avg("bytes").alias("_mean"), F.stddev_samp("bytes").alias("_sd"))
    d = daily.join(stats, key).join(middle, c(key) == c("__med2_key"))
    spread = alias(ranks.doubled_medians(d.withColumn("_off", F.abs(2 * c("bytes") - c("_med2"))), [key], "_off"), "_mad4")
    d = d.join(spread, c(key) == c("__mad4_key"))
    safe = lambda num, den: F.when(den > 0, F.round(num / den, 6)).otherwise(F.lit(0.0))
    return d.select(key, "day", "bytes", safe(c("bytes") - c("_mean"), F.coalesce(c("_sd"), F.lit(0.0))).alias("zscore"),
                    safe(F.abs(c("bytes") - c("_med2") / 2), c("_mad4") / 4).alias("mad_score"))


def first_seen(events: DataFrame, keys) -> DataFrame:
    """Earliest event of each key combination: a map-side combined minimum, no window."""
    return (events.groupBy(*keys).agg(F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("x"))
            .select(*keys, c("x.ts").alias("first_ts"), c("x.event_id").alias("event_id")))


# ---- model inputs ----------------------------------------------------------------

def log10_or_zero(col) -> Column:
    return F.when(c(col) > 0, F.log10(c(col))).otherwise(F.lit(0.0))


def anomaly_features(events: DataFrame) -> DataFrame:
    """Hour of day 0–1, log volume, five-minute counters."""
    e = recent_destinations(recent_counts(events))
    return e.withColumns({"hour_norm": F.round(F.hour("ts") / 23, 6), "log_bytes": F.round(log10_or_zero("bytes_out"), 6)})


def ueba_features(events: DataFrame, daily: DataFrame) -> DataFrame:
    """Deviation flags of each event against the user's latest earlier day (see ``user_days``)."""
    from quillwatch.operators.enrich import asof_daily
    e = asof_daily(events, ["tenant_id", "user_name"], daily, ["login_hours", "bytes"]) if "bytes" in daily.columns else events
    known = c("baseline_day").isNotNull()
    odd_hour = known & (F.size("login_hours") > 0) & ~F.array_contains(F.coalesce("login_hours", F.array().cast("array<int>")), F.hour("ts"))
    ratio = F.when(known & (c("bytes") > 0) & (c("bytes_out") > 0), F.log10(c("bytes_out") / c("bytes"))).otherwise(F.lit(0.0))
    return e.withColumns({"login_hour_dev": odd_hour.cast("int"), "volume_dev": F.round(ratio, 6)})


def mark_new(events: DataFrame, keys, name: str) -> DataFrame:
    """Flag (0/1) on the first event of each key combination, e.g. a user's first host or country."""
    first = first_seen(events, keys).select(c("event_id"), F.lit(1).alias(name))
    return events.join(first, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def exfil_features(daily: DataFrame, key="asset") -> DataFrame:
    """Volume, 30-day baseline (at least 1), log ratio, weekend flag."""
    b = baseline_30d(daily, key).withColumn("baseline", F.greatest(F.lit(1.0), F.coalesce("baseline", F.lit(0.0))))
    return b.withColumns({"ratio": F.round(F.log10(F.greatest(c("bytes"), F.lit(1)) / c("baseline")), 6), "weekend": F.dayofweek("day").isin(1, 7).cast("int")})


def new_country(events: DataFrame, keys, country: str, days: int = 30, name="geo_dev", width: int = split.DAY) -> DataFrame:
    """1 where the key has earlier events with a country, and none of the last ``days`` in this event's country. Rows without a country get 0.

    The last event of a key and country, and the last of the key in any country, are lags within time slices: no key is walked."""
    known = events.filter(c(country).isNotNull())
    same = split.previous(known, [*keys, country], "ts", ["ts", "event_id"], {"_same": micros("ts")}, width)
    both = split.previous(same, list(keys), "ts", ["ts", "event_id"], {"_any": micros("ts")}, width)
    stale = c("_same").isNull() | (micros("ts") - c("_same") > days * split.DAY)
    out = both.withColumn(name, (c("_any").isNotNull() & stale).cast("int")).drop("_same", "_any")
    return out.unionByName(events.filter(c(country).isNull()).withColumn(name, F.lit(0)))


def destination_reputation(flows: DataFrame, keys, day, bad, half_life_days: int = 7, name="reputation") -> DataFrame:
    """keys, day and the decayed share of bad flows of the destination on the days before: 0 unknown or clean, near 1 bad.

    A decayed count is the pair (sum, time): two of them add up by bringing the older one to the newer time. Against a fixed start a count at day t weighs 2^(t / h), so
    earlier sums are a running sum of one row per destination and day, and the factor of the asking day cancels in the share."""
    span = half_life_days * 500  # sums stay finite: weights begin anew after 500 half-lives
    per = flows.groupBy(*keys, c(day).alias("_day")).agg(F.sum(c(bad).cast("int")).alias("_bad"), F.count("*").alias("_all"))
    per = per.withColumns({"_period": F.floor(F.unix_date("_day") / span), "_w": F.pow(F.lit(2.0), F.pmod(F.unix_date("_day"), F.lit(span)) / half_life_days)})
    before = Window.partitionBy(*keys, "_period").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    bad_sum, all_sum = F.sum(c("_bad") * c("_w")).over(before), F.sum(c("_all") * c("_w")).over(before)
    return per.select(*keys, c("_day").alias("day"), F.coalesce(bad_sum / all_sum, F.lit(0.0)).alias(name))


def exfil_score(ratio) -> Column:
    """Transparent score 0–1 from the log ratio to the baseline: 1 at ten times the usual volume."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(ratio))), 6)


def flagged(anomaly, exfil) -> Column:
    return (c(anomaly) > ANOMALY_FLOOR) | (c(exfil) > EXFIL_FLOOR)


def beacon_stats(gaps: DataFrame, keys=("src_ip", "dst_ip")) -> DataFrame:
    """Interval statistics per pair. Moments combine map-side, so a busy pair costs no memory."""
    g = gaps.filter("gap_s IS NOT NULL").groupBy(*keys).agg(
        F.count("*").alias("intervals"), F.avg("gap_s").alias("_mean"), F.stddev_pop("gap_s").alias("_sd"))
    score = F.when((c("intervals") >= MIN_INTERVALS) & (c("_mean") > 0), F.greatest(F.lit(0.0), 1 - c("_sd") / c("_mean"))).otherwise(F.lit(0.0))
    return g.withColumn("beacon_score", F.round(score, 4)).withColumn("is_beacon", c("beacon_score") > BEACON_FLOOR).withColumn("mean_gap_s", F.round("_mean", 3)).drop("_mean", "_sd")


def beacon_vectors(gaps: DataFrame, keys=("src_ip", "dst_ip"), width: int = split.DAY) -> DataFrame:
    """The first 128 intervals of each pair, zero padded, empty when there are fewer than three.

    Intervals are numbered with the sliced running count and only the first 128 are gathered, so the
    array of a busy pair is bounded by its definition, not by the data."""
    rows = gaps.filter("gap_s IS NOT NULL")
    nth = split.running(rows, list(keys), "ts", ["ts", "event_id"], {"nth": F.lit(1)}, width)
    head = (nth.groupBy(*keys).agg(F.max("nth").alias("intervals"), F.sort_array(F.collect_list(F.when(c("nth") <= VECTOR_LENGTH, F.struct("nth", "gap_s")))).alias("_v")))
    pad = F.slice(F.concat(c("_v.gap_s"), F.array_repeat(F.lit(0.0), VECTOR_LENGTH)), 1, VECTOR_LENGTH)
    return head.select(*keys, "intervals", F.when(c("intervals") >= MIN_INTERVALS, pad).otherwise(F.array().cast("array<double>")).alias("vector"))
