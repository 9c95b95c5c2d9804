"""Dashboard and report aggregates. All are plain groupings, so Spark combines map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import SEVERITIES, c, choose
from quillwatch.operators import ranks
from quillwatch.operators.alerts import minutes_between


def hour_of(ts) -> Column:
    return F.date_trunc("hour", c(ts)).cast("timestamp_ntz")


def bucket(ts, granularity: str) -> Column:
    return F.date_trunc(granularity, c(ts)).cast("timestamp_ntz")


def since(df: DataFrame, ts, now: str, days: int) -> DataFrame:
    return df.filter(c(ts) > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def alert_counts(alerts: DataFrame, granularity="hour") -> DataFrame:
    return alerts.groupBy(bucket("created_at", granularity).alias("hour"), "severity", "tactic").agg(F.count("*").alias("alerts"))


def event_volume(events: DataFrame, granularity="hour") -> DataFrame:
    per = {"minute": 60, "hour": 3600, "day": 86400}[granularity]
    return (events.groupBy("tenant_id", "source_type", bucket("ts", granularity).alias("bucket"))
            .agg(F.count("*").alias("n")).withColumn("avg_eps", F.round(c("n") / per, 6)))


def top_assets(alerts: DataFrame, n: int = 20) -> DataFrame:
    return (alerts.groupBy("hostname").agg(F.count("*").alias("alerts"), F.max("risk_score").alias("max_risk"))
            .orderBy(c("alerts").desc(), c("max_risk").desc(), "hostname").limit(n))


def top_users(events: DataFrame, score: str, n: int = 20) -> DataFrame:
    return (events.groupBy("user_name").agg(F.round(F.max(score), 6).alias("max_score"), F.round(F.avg(score), 6).alias("avg_score"))
            .orderBy(c("max_score").desc(), c("avg_score").desc(), "user_name").limit(n))


def alert_trends(alerts: DataFrame) -> DataFrame:
    """Day by severity as columns."""
    return alerts.groupBy(F.to_date("created_at").alias("day")).pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).fillna(0)


# Lower bounds of the heat-map colour bands.
BANDS = [(101, "very_high"), (21, "high"), (6, "medium"), (1, "low")]


def heat_band(hits) -> Column:
    return choose([(c(hits) >= n, F.lit(name)) for n, name in BANDS], F.lit("none"))


def mitre_heatmap(alerts: DataFrame) -> DataFrame:
    """Hits per tactic and per tactic and technique in one pass (NULL technique = the tactic's total)."""
    return (alerts.filter("tactic IS NOT NULL").rollup("tactic", "technique").agg(F.count("*").alias("hits"), F.grouping("tactic").alias("_all"))
            .filter("_all = 0").drop("_all").withColumn("band", heat_band("hits")))


def user_days(events: DataFrame) -> DataFrame:
    """Per user and day: events, bytes, login hours (a bounded set: at most 24)."""
    login = F.when(c("event_category") == "authentication", F.hour("ts"))
    return events.groupBy("tenant_id", "user_name", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.sum("bytes_out").alias("bytes"), F.array_sort(F.collect_set(login)).alias("login_hours"))


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row aggregates with different columns as one row, without a join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(x).alias(x) for x in out.columns])


def dashboard(alerts: DataFrame, events: DataFrame, agents: DataFrame, now: str) -> DataFrame:
    """Three one-row aggregates side by side; each reads only its own table."""
    a = alerts.agg(F.count_if((c("status") == "open") & (c("severity") == "critical")).alias("open_p1"), F.count_if((c("status") == "open") & (c("severity") == "high")).alias("open_p2"))
    e = since(events, "ts", now, 1).agg(F.count("*").alias("events_24h"))
    g = agents.agg(F.count_if("agent_active").alias("agents_online"), F.count("*").alias("agents_total"))
    return side_by_side(a, e, g)


def tenant_summary(alerts: DataFrame, events: DataFrame) -> DataFrame:
    a = alerts.groupBy("tenant_id").agg(F.count("*").alias("alerts"), F.count_if(c("status") == "open").alias("open_alerts"), F.round(F.avg("risk_score"), 6).alias("avg_risk"))
    e = events.groupBy("tenant_id").agg(F.count("*").alias("events"), F.countDistinct("hostname").alias("hosts"), F.max("ts").alias("last_event"))
    return a.join(e, "tenant_id", "full")


def billing(events: DataFrame, period_s: int, approximate: bool = False) -> DataFrame:
    """Rate, stored bytes and endpoints per tenant. ``approximate`` trades exact host counts for a sketch."""
    hosts = F.approx_count_distinct("hostname", 0.02) if approximate else F.countDistinct("hostname")
    return events.groupBy("tenant_id").agg(F.round(F.count("*") / period_s, 6).alias("avg_eps"), F.sum(F.octet_length("raw")).alias("bytes"), hosts.alias("endpoints"))


def tenant_days(events: DataFrame, now: str, days: int) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return events.filter(c("ts") < cutoff).select("tenant_id", F.to_date("ts").alias("day")).distinct()


def report_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"), F.count_if(c("severity") == "critical").alias("p1"), F.count_if(c("severity") == "high").alias("p2"),
                      F.round(F.avg(minutes_between("created_at", "acknowledged_at")), 6).alias("mean_tta_min"),
                      F.round(F.avg(minutes_between("created_at", "resolved_at")), 6).alias("mean_ttr_min"), F.count_if(c("status") == "open").alias("open_alerts"))


def rank_assets(alerts: DataFrame) -> DataFrame:
    per = alerts.groupBy("tenant_id", "hostname").agg(F.sum("risk_score").alias("risk"))
    return ranks.dense_ranks(per, ["tenant_id"], "risk")


def compare_periods(alerts: DataFrame) -> DataFrame:
    """This month against the previous month with alerts, per tenant."""
    per = alerts.groupBy("tenant_id", bucket("created_at", "month").alias("month")).agg(F.count("*").alias("alerts"))
    prev = F.lag("alerts").over(Window.partitionBy("tenant_id").orderBy("month"))
    return per.withColumn("previous", prev).withColumn("change", c("alerts") - c("previous"))
