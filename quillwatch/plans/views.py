"""The derived views as DataFrames (same formulas as the SQL text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.operators import alerts, enrich, ioc, normalize, risk, rules, split
from quillwatch.plans import view_text as V
from quillwatch.plans.rule_set import RULES
from quillwatch.sources.events import stored
from quillwatch.sources.shared import materialize
from quillwatch.sources.tables import spread, table

NOW = "2024-01-31 00:00:00"


def _derive(df: DataFrame, pairs, keep) -> DataFrame:
    return df.select(*keep, *[F.expr(e).alias(n) for n, e in pairs])


_STORES: dict = {}


def sec_events(spark: SparkSession, d: str) -> DataFrame:
    """The event store of a data folder: derived once per session, then scanned like any event table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _STORES[key] = stored(derive_events(spark, d, by_day=True), "sec-events", ("tenant_id", "event_day"))
    return _STORES[key]


def derive_events(spark: SparkSession, d: str, by_day: bool = False) -> DataFrame:
    """The events with their security columns. With ``by_day`` they come by tenant and day: the few source columns are moved and sorted before the wide ones are made,
    so the writer of the store has nothing to sort. The number of partitions is given, as their size before says little about the work after."""
    base = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    keep = ["event_id", "ts", "user_id", "k", "value"]
    pairs = V.EVENT_COLUMNS
    if by_day:
        days = ["tenant_id", "event_day"]
        base = base.withColumns({"tenant_id": F.expr(dict(pairs)["tenant_id"]), "event_day": F.to_date("ts")})
        base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *days).sortWithinPartitions(*days)
        keep, pairs = [*keep, *days], [x for x in pairs if x[0] != "tenant_id"]
    else:
        base = spread(base)
    user_hash = F.sha2(F.col("user_id").cast("string"), 256)
    cols = _derive(base, pairs, keep).withColumns({
        "ts_received": F.expr("ts + make_dt_interval(0, 0, 0, event_id % 90)"),
        "bytes_out": F.round(F.col("value") * 100).cast("bigint") * 1000,
        "file_hash": F.when(F.col("event_id") % 2 == 0, F.upper(user_hash)).otherwise(user_hash),
        "iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "bsd": F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
                        F.date_format("ts", " HH:mm:ss")),
        "epoch_ms": F.unix_millis(F.col("ts").cast("timestamp")),
        "tab": F.lit("\t"),
    })
    return (cols.withColumn("raw", F.expr(V.RAW))
            .withColumn("fields", F.map_filter(F.create_map(
                F.lit("k"), F.col("k").cast("string"), F.lit("url"), F.col("f_url")), lambda _, v: v.isNotNull()))
            .withColumnRenamed("etype", "event_type"))


def sec_assets(spark, d) -> DataFrame:
    a = _derive(table(spark, d, "supplier"), V.ASSET_COLUMNS, [])
    keys = ["tenant_id", "hostname"]
    first = F.min_by(F.struct(*[x for x in a.columns if x not in keys]), "seen_order").alias("x")
    return a.groupBy(*keys).agg(first).select(*keys, "x.*")


def geo_ranges(spark, d) -> DataFrame:
    start = F.lit(3325256704) + F.col("n_nationkey") * 4
    return table(spark, d, "nation").select(
        start.alias("ip_from"), (start + 3).alias("ip_to"), F.substring("n_name", 1, 2).alias("country"), F.col("n_name").alias("city"))


def ioc_feed(spark, d) -> DataFrame:
    def feed(df, kind, value, source, severity):
        return df.select(F.lit(kind).alias("ioc_type"), value.alias("value"), F.lit(source).alias("source"),
                         F.lit(severity).cast("string").alias("severity"))
    text = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    page = F.col("page_id")
    url = F.concat(F.lit("HTTP://SITE"), text(page % 40), F.lit(".Example.NET/p/"), text(page % 50))
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    pages, supplier = table(spark, d, "pages"), table(spark, d, "supplier")
    return ioc.union_feeds([
        feed(nation.filter("n_nationkey % 5 = 0"), "ip", F.concat(F.lit("203.0.113."), text("n_nationkey")), "feed-ip", None),
        feed(customer.filter("c_custkey % 50 = 0"), "sha256", F.sha2(text("c_custkey"), 256), "feed-hash", "Payload"),
        feed(pages.filter("page_id % 9 = 0"), "url", url, "feed-url", "malware").distinct(),
        feed(supplier.filter("s_suppkey % 7 = 0"), "domain", F.concat(F.lit("Site"), text("s_suppkey"), F.lit(".example.net.")), "feed-domain", None),
    ])


def ioc_set(spark, d) -> DataFrame:
    return ioc.indicator_set(ioc_feed(spark, d))


def alerts_life(spark, d) -> DataFrame:
    a = _derive(table(spark, d, "orders"), V.ALERT_COLUMNS, [])
    after = lambda m: F.expr(f"created_at + make_dt_interval(0, 0, {m}, 0)")
    for m in ("detect_min", "ack_min", "resolve_min"):
        a = a.withColumn(m, F.col(m).cast("int"))
    return a.withColumns({"detected_at": after("detect_min"), "acknowledged_at": after("ack_min"), "resolved_at": after("resolve_min")})


def flow_volume(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("day"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bytes"))


def audit_log(spark, d) -> DataFrame:
    pick = lambda n, a, b, o: F.when(F.col("event_id") % n == 0, a).when(F.col("event_id") % n == 1, b).otherwise(o)
    rows = sec_events(spark, d).select(
        "tenant_id", "event_id", "ts", F.col("user_name").alias("actor_id"),
        F.when(F.col("user_id") % 4 == 0, "service").otherwise("human").alias("actor_type"),
        F.col("event_type").alias("action"), pick(3, "events", "alerts", "rules").alias("resource_type"),
        F.col("src_ip").alias("source_ip"), pick(5, "failure", "denied", "success").alias("result"))
    return split.running(rows, ["tenant_id"], "ts", ["ts", "event_id"], {"chain_seq": F.lit(1)}, split.DAY)


def heartbeats(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 40).alias("agent_id"), "ts")


def agent_batches(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (F.col("user_id") % 40).alias("agent_id"), e.alias("batch_id"), "ts",
        F.when(e % 17 == 0, e - 100).otherwise(e).alias("sequence"), (1 + e % 9).alias("n_events"))


AGENT_COLUMNS = ["ts", "event_type", "event_category", "severity", "hostname", "user_name", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out",
                 "process_name", "process_cmdline", "file_hash", "fields"]


def normalized(spark, d) -> DataFrame:
    """The enriched table: every raw line normalised in one pass and written out. Agents deliver columns, all others only a line."""
    key = (spark.sparkContext.applicationId, d, "normalized")
    if key not in _STORES:
        agent = F.col("source_type").isin(normalize.AGENT_SOURCES)
        lines = sec_events(spark, d).select("event_id", "tenant_id", "source_type", "raw", "ts_received", *[F.when(agent, F.col(x)).alias(x) for x in AGENT_COLUMNS])
        _STORES[key] = stored(normalize.normalize(lines, NOW), "enriched")
    return _STORES[key]


def ioc_lookup(spark, d) -> ioc.Lookup:
    """The indicators and their filter, built once per session."""
    key = (spark.sparkContext.applicationId, d, "indicators")
    if key not in _STORES:
        _STORES[key] = ioc.Lookup(ioc_set(spark, d))
    return _STORES[key]


# ---- detection ---------------------------------------------------------------

def detected(spark, d) -> DataFrame:
    """Events with rule matches, indicator hits and risk."""
    e = ioc.flag(model_scores(sec_events(spark, d)), ioc_lookup(spark, d))
    return risk.score_events(rules.match_all(e, RULES))


def model_scores(events: DataFrame) -> DataFrame:
    return events.withColumns({"anomaly_score": F.col("k") / F.lit(100.0), "ueba_score": (F.col("event_id") % 100) / F.lit(100.0)})


CANDIDATE_COLUMNS = ["event_id", "ts", "tenant_id", "hostname", "user_name", "src_ip", "dst_ip", "rule_matches", "ioc_hit", "anomaly_score", "risk_score", "risk_severity"]


def find_candidates(spark, d) -> DataFrame:
    """One pass over the events, written out: grouping reads the candidates more than once."""
    return materialize(alerts.with_key(risk.candidates(detected(spark, d)).select(CANDIDATE_COLUMNS)), "candidates")


def raw_candidates(spark, d) -> DataFrame:
    """Raw lines to candidates: normalised, assets of the tenant, indicators, rules, risk. Nothing but agent columns and lines is read."""
    e = enrich.with_criticality(normalized(spark, d).withColumn("asset_tags", F.array().cast("array<string>")), sec_assets(spark, d).withColumn("tags", F.split("tag_text", ",")))
    e = e.withColumns({"anomaly_score": F.try_element_at("fields", F.lit("k")).try_cast("double") / 100, "ueba_score": (F.col("event_id") % 100) / F.lit(100.0)})
    scored = risk.score_events(rules.match_all(ioc.flag(e, ioc_lookup(spark, d)), RULES))
    return materialize(alerts.with_key(risk.candidates(scored).select(CANDIDATE_COLUMNS)), "candidates")


def candidates(spark, d) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, "candidates")
    if key not in _STORES:
        _STORES[key] = find_candidates(spark, d)
    return _STORES[key]


def alert_evidence(spark, d) -> DataFrame:
    """The alert-to-event relation, kept with the candidate table."""
    key = (spark.sparkContext.applicationId, d, "evidence")
    if key not in _STORES:
        _STORES[key] = materialize(alerts.evidence(candidates(spark, d)), "evidence")
    return _STORES[key]


def alert_rows(spark, d) -> DataFrame:
    return alerts.assemble(alerts.windows(alert_evidence(spark, d)))
