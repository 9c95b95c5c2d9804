"""Enrichment, aggregation, window and feature queries."""

from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.operators import analytics as an
from quillwatch.operators import enrich, features, split
from quillwatch.plans import views as v
from quillwatch.plans.detection import SEQ_SQL
from quillwatch.plans.registry import query
from quillwatch.plans.rule_set import RULES
from quillwatch.sources.tables import table

txt = lambda x: (c(x) if isinstance(x, str) else x).cast("string")


def assets(spark, d):
    return v.sec_assets(spark, d).withColumn("tags", F.split("tag_text", ","))


def _seed_tags(e):
    return e.withColumn("asset_tags", F.when(c("event_id") % 2 == 0, F.array(F.lit("db"))).otherwise(F.array().cast("array<string>")))


@query("join_asset", """SELECT event_id, asset_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN tag_text IS NULL THEN 'db' WHEN tag_text = 'db,prod' THEN 'db,prod' ELSE 'db,' || tag_text END ELSE coalesce(tag_text, '') END AS tags
 FROM sec_events e LEFT JOIN sec_assets a ON a.tenant_id = e.tenant_id AND lower(a.hostname) = lower(e.hostname)""")
def _(spark, d):
    e = _seed_tags(v.sec_events(spark, d).select("event_id", "tenant_id", "hostname"))
    return enrich.with_assets(e, assets(spark, d)).select("event_id", "asset_id", F.array_join("asset_tags", ",").alias("tags"))


@query("join_criticality", "SELECT event_id, coalesce(criticality, 'unknown') AS asset_criticality FROM sec_events e LEFT JOIN sec_assets a ON a.tenant_id = e.tenant_id AND lower(a.hostname) = lower(e.hostname)")
def _(spark, d):
    e = _seed_tags(v.sec_events(spark, d).select("event_id", "tenant_id", "hostname"))
    return enrich.with_criticality(e, assets(spark, d)).select("event_id", "asset_criticality")


@query("join_geoip", """SELECT event_id, country, city FROM (SELECT event_id, 3325256704 + CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS ip FROM sec_events WHERE dst_ip LIKE '198.%'
 UNION ALL SELECT event_id, NULL FROM sec_events WHERE dst_ip NOT LIKE '198.%') e LEFT JOIN geo_ranges g ON e.ip BETWEEN g.ip_from AND g.ip_to""")
def _(spark, d):
    return enrich.geo_lookup(v.sec_events(spark, d).select("event_id", "dst_ip"), "dst_ip", v.geo_ranges(spark, d)).select("event_id", "country", "city")


_NUM = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


@query("join_locations", f"""WITH a AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN dst_ip ELSE src_ip END AS s, CASE WHEN event_id % 3 = 0 THEN src_ip ELSE dst_ip END AS t FROM sec_events),
 n AS (SELECT event_id, CASE WHEN s NOT LIKE '10.%' THEN {_NUM.format('s')} END AS s, CASE WHEN t NOT LIKE '10.%' THEN {_NUM.format('t')} END AS t FROM a)
 SELECT event_id, x.country AS src_country, x.city AS src_city, y.country AS dst_country FROM n LEFT JOIN geo_ranges x ON n.s BETWEEN x.ip_from AND x.ip_to LEFT JOIN geo_ranges y ON n.t BETWEEN y.ip_from AND y.ip_to""")
def _(spark, d):
    swap = lambda a, b: F.when(c("event_id") % 3 == 0, c(b)).otherwise(c(a))
    e = v.sec_events(spark, d).select("event_id", swap("src_ip", "dst_ip").alias("src_ip"), swap("dst_ip", "src_ip").alias("dst_ip"))
    return enrich.with_locations(e, v.geo_ranges(spark, d)).select("event_id", "src_country", "src_city", "dst_country")


@query("join_asset_ip", """WITH ips AS (SELECT tenant_id, src_ip AS ip, min(event_id) AS e FROM sec_events WHERE hostname IS NULL GROUP BY 1, 2),
 own AS (SELECT e.event_id, e.tenant_id, e.src_ip, a.asset_id FROM sec_events e LEFT JOIN sec_assets a ON a.tenant_id = e.tenant_id AND lower(a.hostname) = lower(e.hostname))
 SELECT event_id, coalesce(CAST(o.asset_id AS VARCHAR), 'ip-' || i.e) AS asset_id FROM own o LEFT JOIN ips i ON o.asset_id IS NULL AND i.tenant_id = o.tenant_id AND i.ip = o.src_ip""")
def _(spark, d):
    e = _seed_tags(v.sec_events(spark, d).select("event_id", "tenant_id", "hostname", "src_ip"))
    named = assets(spark, d).select("tenant_id", "hostname", txt("asset_id").alias("asset_id"), "tags", "criticality", F.lit(None).cast("string").alias("ip"))
    lone = e.filter("hostname IS NULL").groupBy("tenant_id", c("src_ip").alias("ip")).agg(F.min("event_id").alias("e"))
    lone = lone.select("tenant_id", F.lit(None).cast("string").alias("hostname"), F.concat(F.lit("ip-"), txt("e")).alias("asset_id"), F.array(F.lit("seen")).alias("tags"), F.lit("low").alias("criticality"), "ip")
    return enrich.with_assets_by_ip(e, named.unionByName(lone)).select("event_id", "asset_id")


@query("join_user_identity", "SELECT event_id, coalesce(c_name, user_name) AS canonical_user FROM sec_events LEFT JOIN customer ON 'user' || c_custkey = user_name AND 'tenant-' || (c_custkey % 2) = tenant_id")
def _(spark, d):
    users = table(spark, d, "customer").select(F.concat(F.lit("tenant-"), txt(c("c_custkey") % 2)).alias("tenant_id"), F.concat(F.lit("USER"), txt("c_custkey")).alias("login"), c("c_name").alias("canonical_user"))
    return enrich.with_identity(v.sec_events(spark, d).select("event_id", "tenant_id", "user_name"), users).select("event_id", "canonical_user")


@query("join_asset_activity", """SELECT tenant_id, hostname, event_id, ts FROM (SELECT e.tenant_id, e.hostname, e.event_id, e.ts, row_number() OVER (PARTITION BY e.tenant_id, e.hostname ORDER BY e.ts DESC, e.event_id DESC) AS rn
 FROM sec_events e JOIN sec_assets a ON a.tenant_id = e.tenant_id AND lower(a.hostname) = lower(e.hostname)) WHERE rn <= 20""")
def _(spark, d):
    from pyspark.sql import Window
    e = v.sec_events(spark, d).select("tenant_id", "hostname", "event_id", "ts")
    known = assets(spark, d).select(c("tenant_id").alias("_t"), F.lower("hostname").alias("_h"))
    w = Window.partitionBy("tenant_id", "hostname").orderBy(c("ts").desc(), c("event_id").desc())
    return e.join(known, (F.lower("hostname") == c("_h")) & (c("tenant_id") == c("_t")), "left_semi").withColumn("rn", F.row_number().over(w)).filter("rn <= 20").drop("rn")


@query("join_sequence", SEQ_SQL.format("process_create", "network_connect", "2 HOUR"))
def _(spark, d):
    return enrich.sequence(v.sec_events(spark, d), ["tenant_id", "hostname"], c("event_type") == "process_create", c("event_type") == "network_connect", 7200).select("event_id", "hostname", "a_ts")


@query("join_baseline_asof", """WITH days AS (SELECT tenant_id, user_name, CAST(ts AS DATE) AS day, count(*) AS events, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM sec_events GROUP BY 1, 2, 3)
 SELECT e.event_id, max(b.day) AS baseline_day, arg_max(b.events, b.day) AS events, arg_max(b.bytes, b.day) AS bytes FROM sec_events e
 LEFT JOIN days b ON b.tenant_id = e.tenant_id AND b.user_name = e.user_name AND b.day < CAST(e.ts AS DATE) GROUP BY 1""")
def _(spark, d):
    e = v.sec_events(spark, d)
    return enrich.asof_daily(e.select("event_id", "tenant_id", "user_name", "ts"), ["tenant_id", "user_name"], an.user_days(e), ["events", "bytes"]).select("event_id", "baseline_day", "events", "bytes")


_COVERED = ", ".join(f"('{t}')" for t in sorted({t.split(".")[1].upper() for r in RULES for t in r["tags"] if t.lower().startswith("attack.t1")}))


@query("join_coverage_gap", f"SELECT DISTINCT technique FROM (SELECT 'T' || (1000 + p_partkey % 300) AS technique FROM part) WHERE technique NOT IN (SELECT * FROM (VALUES {_COVERED}))")
def _(spark, d):
    tech = table(spark, d, "part").select(F.concat(F.lit("T"), txt(1000 + c("p_partkey") % 300)).alias("technique")).distinct()
    have = [(t.split(".")[1].upper(),) for r in RULES for t in r["tags"] if t.lower().startswith("attack.t1")]
    return enrich.coverage_gap(tech, spark.createDataFrame(have, "technique string"))


@query("agg_entity_nodes", """SELECT kind, id, max(ts) AS last_seen, max(risk_score) AS max_risk FROM (SELECT 'host' AS kind, hostname AS id, ts, risk_score FROM scored UNION ALL SELECT 'user', user_name, ts, risk_score FROM scored
 UNION ALL SELECT 'ip', src_ip, ts, risk_score FROM scored) WHERE id IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return enrich.entity_nodes(v.detected(spark, d))


@query("agg_entity_edges", """SELECT kind, src, dst, count(*) AS n, max(ts) AS last_seen FROM (SELECT 'user_host' AS kind, user_name AS src, hostname AS dst, ts FROM sec_events UNION ALL SELECT 'host_ip', hostname, src_ip, ts FROM sec_events)
 WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    return enrich.entity_edges(v.sec_events(spark, d))


@query("agg_entity_counts", """SELECT (SELECT count(DISTINCT hostname) + count(DISTINCT user_name) + count(DISTINCT src_ip) FROM scored) AS entities, (SELECT max(risk_score) FROM scored WHERE user_name = 'user7') AS risk_user7, 0 AS risk_nobody""")
def _(spark, d):
    n = enrich.entity_nodes(v.detected(spark, d))
    risk_of = lambda kind, key: F.coalesce(F.max(F.when((c("kind") == kind) & (c("id") == key), c("max_risk"))), F.lit(0))
    return n.agg(F.count("*").alias("entities"), risk_of("user", "user7").alias("risk_user7"), risk_of("user", "nobody").alias("risk_nobody"))


@query("agg_lateral_movement", """SELECT tenant_id, user_name, window_start, hosts FROM (SELECT tenant_id, user_name, time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(DISTINCT hostname) AS hosts FROM (
 SELECT tenant_id, ts, 'host-' || (event_id % 40) AS hostname, user_name FROM sec_events) GROUP BY 1, 2, 3) WHERE hosts > 3""")
def _(spark, d):
    e = v.sec_events(spark, d).select("tenant_id", "ts", "user_name", F.concat(F.lit("host-"), txt(c("event_id") % 40)).alias("hostname"))
    return enrich.lateral_movement(e, "24 hours", 3)


# ---- aggregates ---------------------------------------------------------------

@query("agg_alert_counts_hourly", "SELECT date_trunc('hour', created_at) AS hour, severity, tactic, count(*) AS alerts FROM alerts_life GROUP BY 1, 2, 3")
def _(spark, d):
    return an.alert_counts(v.alerts_life(spark, d))


@query("agg_event_volume", "SELECT tenant_id, source_type, date_trunc('hour', ts) AS bucket, count(*) AS n, round(count(*) / 3600.0, 6) AS avg_eps FROM sec_events GROUP BY 1, 2, 3")
def _(spark, d):
    return an.event_volume(v.sec_events(spark, d))


@query("agg_top_assets", "SELECT hostname, count(*) AS alerts, max(risk_score) AS max_risk FROM alerts_life WHERE created_at > TIMESTAMP '2000-06-30' - INTERVAL 90 DAY GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def _(spark, d):
    return an.top_assets(an.since(v.alerts_life(spark, d), "created_at", "2000-06-30 00:00:00", 90))


@query("agg_top_users", "SELECT user_name, round(max(k / 100.0), 6) AS max_score, round(avg(k / 100.0), 6) AS avg_score FROM sec_events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def _(spark, d):
    return an.top_users(v.model_scores(v.sec_events(spark, d)), "anomaly_score")


_PIV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("info", "low", "medium", "high", "critical"))


@query("agg_alert_trends", f"SELECT CAST(created_at AS DATE) AS day, {_PIV} FROM alerts_life GROUP BY 1")
def _(spark, d):
    return an.alert_trends(v.alerts_life(spark, d))


@query("agg_mitre_heatmap", """SELECT *, CASE WHEN hits > 100 THEN 'very_high' WHEN hits > 20 THEN 'high' WHEN hits > 5 THEN 'medium' WHEN hits > 0 THEN 'low' ELSE 'none' END AS band FROM (
 SELECT tactic, technique, count(*) AS hits FROM alerts_life WHERE tactic IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT tactic, NULL, count(*) FROM alerts_life WHERE tactic IS NOT NULL GROUP BY 1)""")
def _(spark, d):
    return an.mitre_heatmap(v.alerts_life(spark, d))


@query("agg_user_daily_baseline", """SELECT tenant_id, user_name, CAST(ts AS DATE) AS day, count(*) AS events, CAST(sum(bytes_out) AS BIGINT) AS bytes,
 coalesce(array_to_string(list_sort(list(DISTINCT hour(ts)) FILTER (event_category = 'authentication')), ','), '') AS hours FROM sec_events GROUP BY 1, 2, 3""")
def _(spark, d):
    u = an.user_days(v.sec_events(spark, d))
    return u.select("tenant_id", "user_name", "day", "events", "bytes", F.array_join(c("login_hours").cast("array<string>"), ",").alias("hours"))


@query("agg_dashboard_cards", """SELECT (SELECT count(*) FROM alerts_life WHERE status = 'open' AND severity = 'critical') AS open_p1, (SELECT count(*) FROM alerts_life WHERE status = 'open' AND severity = 'high') AS open_p2,
 (SELECT count(*) FROM sec_events WHERE ts > TIMESTAMP '2024-01-30') AS events_24h, (SELECT count(*) FROM sec_assets WHERE agent_active) AS agents_online, (SELECT count(*) FROM sec_assets) AS agents_total""")
def _(spark, d):
    return an.dashboard(v.alerts_life(spark, d), v.sec_events(spark, d), v.sec_assets(spark, d), v.NOW)


@query("agg_tenant_summary", """SELECT * FROM (SELECT tenant_id, count(*) AS alerts, count(*) FILTER (status = 'open') AS open_alerts, round(avg(risk_score), 6) AS avg_risk FROM alerts_life GROUP BY 1)
 JOIN (SELECT tenant_id, count(*) AS events, count(DISTINCT hostname) AS hosts, max(ts) AS last_event FROM sec_events GROUP BY 1) USING (tenant_id)""")
def _(spark, d):
    return an.tenant_summary(v.alerts_life(spark, d), v.sec_events(spark, d))


@query("agg_billing", "SELECT tenant_id, round(count(*) / 2592000.0, 6) AS avg_eps, CAST(sum(octet_length(encode(raw))) AS BIGINT) AS bytes, count(DISTINCT hostname) AS endpoints FROM sec_events GROUP BY 1")
def _(spark, d):
    return an.billing(v.sec_events(spark, d), 30 * 86400)


@query("agg_distinct_tenant_days", "SELECT DISTINCT tenant_id, CAST(ts AS DATE) AS day FROM sec_events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def _(spark, d):
    return an.tenant_days(v.sec_events(spark, d), v.NOW, 10)


@query("agg_report_summary", """SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS p1, count(*) FILTER (severity = 'high') AS p2, round(avg(ack_min), 6) AS mean_tta_min,
 round(avg(resolve_min), 6) AS mean_ttr_min, count(*) FILTER (status = 'open') AS open_alerts FROM alerts_life""")
def _(spark, d):
    return an.report_summary(v.alerts_life(spark, d))


# ---- windows -------------------------------------------------------------------

_W = "OVER (PARTITION BY tenant_id, user_name ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW)"


@query("win_failed_auth_5m", f"SELECT event_id, count(*) FILTER (event_type = 'auth_failure') {_W} AS failed_auth_5m FROM sec_events")
def _(spark, d):
    return features.recent_counts(v.sec_events(spark, d)).select("event_id", "failed_auth_5m")


@query("win_conn_proc_5m", f"SELECT event_id, count(*) FILTER (event_type = 'network_connect') {_W} AS connections_5m, count(*) FILTER (event_type = 'process_create') {_W} AS processes_5m FROM sec_events")
def _(spark, d):
    return features.recent_counts(v.sec_events(spark, d)).select("event_id", "connections_5m", "processes_5m")


@query("win_unique_dst_5m", """SELECT a.event_id, count(DISTINCT b.dst_ip) AS unique_dst_5m FROM sec_events a JOIN sec_events b ON a.tenant_id = b.tenant_id AND a.user_name = b.user_name
 AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 5 MINUTE GROUP BY 1""")
def _(spark, d):
    return features.recent_destinations(v.sec_events(spark, d)).select("event_id", "unique_dst_5m")


@query("win_unique_dst_tenant", """SELECT a.event_id, count(DISTINCT b.dst_ip) AS unique_dst FROM sec_events a JOIN sec_events b ON a.tenant_id = b.tenant_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 3 HOUR GROUP BY 1""")
def _(spark, d):
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "ts", "dst_ip")
    return split.range_distinct(e, ["tenant_id"], "ts", "dst_ip", 3 * split.HOUR, "unique_dst").select("event_id", "unique_dst")


@query("win_interarrival", "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_name, dst_ip ORDER BY ts, event_id))) / 1000000.0, 6) AS gap_s FROM sec_events")
def _(spark, d):
    return features.interarrival(v.sec_events(spark, d), ("user_name", "dst_ip")).select("event_id", "gap_s")


_DAILY = "(SELECT asset, day, CAST(sum(bytes) AS BIGINT) AS bytes FROM flow_volume GROUP BY 1, 2)"


@query("win_baseline_30d", f"SELECT asset, day, bytes, round(avg(bytes) OVER (PARTITION BY asset ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS baseline FROM {_DAILY}")
def _(spark, d):
    return features.baseline_30d(features.daily_bytes(v.flow_volume(spark, d)))


@query("win_zscore_mad", f"""WITH d AS {_DAILY}, s AS (SELECT asset, avg(bytes) AS m, stddev_samp(bytes) AS sd, quantile_cont(bytes, 0.5) AS med FROM d GROUP BY 1),
 a AS (SELECT asset, quantile_cont(abs(bytes - med), 0.5) AS mad FROM d JOIN s USING (asset) GROUP BY 1)
 SELECT asset, day, bytes, CASE WHEN sd > 0 THEN round((bytes - m) / sd, 6) ELSE 0 END AS zscore, CASE WHEN mad > 0 THEN round(abs(bytes - med) / mad, 6) ELSE 0 END AS mad_score FROM d JOIN s USING (asset) JOIN a USING (asset)""")
def _(spark, d):
    return features.outliers(features.daily_bytes(v.flow_volume(spark, d)))


@query("win_first_seen", """SELECT tenant_id, user_name, hostname, ts AS first_ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_name, hostname ORDER BY ts, event_id) AS rn FROM sec_events) WHERE rn = 1""")
def _(spark, d):
    return features.first_seen(v.sec_events(spark, d), ["tenant_id", "user_name", "hostname"])


@query("win_rank_assets", "SELECT *, dense_rank() OVER (PARTITION BY tenant_id ORDER BY risk DESC) AS rank FROM (SELECT tenant_id, hostname, CAST(sum(risk_score) AS BIGINT) AS risk FROM alerts_life GROUP BY 1, 2)")
def _(spark, d):
    return an.rank_assets(v.alerts_life(spark, d))


@query("win_seq_gap", """SELECT batch_id, CASE WHEN last IS NULL OR sequence > last THEN 'new' WHEN sequence = last THEN 'duplicate' ELSE 'out_of_order' END AS verdict FROM (
 SELECT batch_id, sequence, max(sequence) OVER (PARTITION BY agent_id ORDER BY ts, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM agent_batches)""")
def _(spark, d):
    b = split.running_max(v.agent_batches(spark, d), ["agent_id"], "ts", ["ts", "batch_id"], {"last": c("sequence")}, split.DAY)
    verdict = F.when(c("last").isNull() | (c("sequence") > c("last")), "new").when(c("sequence") == c("last"), "duplicate").otherwise("out_of_order")
    return b.select("batch_id", verdict.alias("verdict"))


@query("win_period_compare", """SELECT *, lag(alerts) OVER (PARTITION BY tenant_id ORDER BY month) AS previous, alerts - lag(alerts) OVER (PARTITION BY tenant_id ORDER BY month) AS change FROM (
 SELECT tenant_id, date_trunc('month', created_at) AS month, count(*) AS alerts FROM alerts_life GROUP BY 1, 2)""")
def _(spark, d):
    return an.compare_periods(v.alerts_life(spark, d))


# ---- features -------------------------------------------------------------------

@query("feat_anomaly", f"""SELECT event_id, round(hour(ts) / 23.0, 6) AS hour_norm, CASE WHEN bytes_out > 0 THEN round(log10(bytes_out), 6) ELSE 0 END AS log_bytes, count(*) FILTER (event_type = 'auth_failure') {_W} AS failed_auth_5m,
 count(*) FILTER (event_type = 'network_connect') {_W} AS connections_5m, u.unique_dst_5m FROM sec_events JOIN (SELECT a.event_id, count(DISTINCT b.dst_ip) AS unique_dst_5m FROM sec_events a JOIN sec_events b
 ON a.tenant_id = b.tenant_id AND a.user_name = b.user_name AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 5 MINUTE GROUP BY 1) u USING (event_id)""")
def _(spark, d):
    return features.anomaly_features(v.sec_events(spark, d)).select("event_id", "hour_norm", "log_bytes", "failed_auth_5m", "connections_5m", "unique_dst_5m")


@query("feat_ueba", """WITH days AS (SELECT tenant_id, user_name, CAST(ts AS DATE) AS day, CAST(sum(bytes_out) AS BIGINT) AS bytes, list(DISTINCT hour(ts)) FILTER (event_category = 'authentication') AS hours FROM sec_events GROUP BY 1, 2, 3),
 prior AS (SELECT tenant_id, user_name, day, lag(day) OVER w AS bday, lag(bytes) OVER w AS bytes, lag(hours) OVER w AS hours FROM days WINDOW w AS (PARTITION BY tenant_id, user_name ORDER BY day)),
 firsts AS (SELECT tenant_id, user_name, hostname, min((ts, event_id)) AS x FROM sec_events GROUP BY 1, 2, 3)
 SELECT e.event_id, CASE WHEN bday IS NOT NULL AND coalesce(len(hours), 0) > 0 AND NOT list_contains(hours, hour(e.ts)) THEN 1 ELSE 0 END AS login_hour_dev,
 CASE WHEN bday IS NOT NULL AND p.bytes > 0 AND e.bytes_out > 0 THEN round(log10(e.bytes_out / p.bytes), 6) ELSE 0 END AS volume_dev,
 CASE WHEN f.x IS NOT NULL THEN 1 ELSE 0 END AS new_host FROM sec_events e JOIN prior p ON p.tenant_id = e.tenant_id AND p.user_name = e.user_name AND p.day = CAST(e.ts AS DATE)
 LEFT JOIN firsts f ON f.x = (e.ts, e.event_id)""")
def _(spark, d):
    e = v.sec_events(spark, d)
    u = features.ueba_features(e.select("event_id", "tenant_id", "user_name", "hostname", "ts", "bytes_out"), an.user_days(e))
    return features.mark_new(u, ["tenant_id", "user_name", "hostname"], "new_host").select("event_id", "login_hour_dev", "volume_dev", "new_host")


_EXFIL = f"""(SELECT asset, day, bytes, greatest(1.0, coalesce(b, 0)) AS baseline FROM (SELECT *, round(avg(bytes) OVER (PARTITION BY asset ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS b FROM {_DAILY}))"""


@query("feat_exfil", f"SELECT asset, day, bytes, baseline, round(log10(greatest(bytes, 1) / baseline), 6) AS ratio, CASE WHEN isodow(day) > 5 THEN 1 ELSE 0 END AS weekend FROM {_EXFIL}")
def _(spark, d):
    return features.exfil_features(features.daily_bytes(v.flow_volume(spark, d)))


@query("score_exfil_flag", f"SELECT asset, day, round(greatest(0.0, least(1.0, round(log10(greatest(bytes, 1) / baseline), 6))), 6) AS exfil_score, (asset % 100) / 100.0 > 0.75 OR round(log10(greatest(bytes, 1) / baseline), 6) > 0.85 AS flagged FROM {_EXFIL}")
def _(spark, d):
    x = features.exfil_features(features.daily_bytes(v.flow_volume(spark, d)))
    x = x.withColumns({"exfil_score": features.exfil_score("ratio"), "anomaly_score": (c("asset") % 100) / F.lit(100.0)})
    return x.select("asset", "day", "exfil_score", features.flagged("anomaly_score", "exfil_score").alias("flagged"))


_GAPS = "(SELECT user_name, dst_ip, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_name, dst_ip ORDER BY ts, event_id))) / 1000000.0 AS gap_s FROM sec_events)"


@query("score_beacon", f"""SELECT user_name, dst_ip, n AS intervals, score AS beacon_score, score > 0.7 AS is_beacon, round(m, 3) AS mean_gap_s FROM (SELECT *, CASE WHEN n >= 3 AND m > 0 THEN round(greatest(0, 1 - sd / m), 4) ELSE 0 END AS score FROM (
 SELECT user_name, dst_ip, count(*) AS n, avg(gap_s) AS m, stddev_pop(gap_s) AS sd FROM {_GAPS} WHERE gap_s IS NOT NULL GROUP BY 1, 2))""")
def _(spark, d):
    keys = ("user_name", "dst_ip")
    return features.beacon_stats(features.interarrival(v.sec_events(spark, d), keys), keys)


@query("feat_beacon", f"""SELECT user_name, dst_ip, n AS intervals, CASE WHEN n >= 3 THEN 128 ELSE 0 END AS width, CASE WHEN n >= 3 THEN first ELSE NULL END AS first_gap, CASE WHEN n >= 3 THEN CAST(round(total) AS BIGINT) END AS total FROM (
 SELECT user_name, dst_ip, count(*) AS n, arg_min(round(gap_s, 6), (ts, event_id)) AS first, sum(gap_s) FILTER (rn <= 128) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_name, dst_ip ORDER BY ts, event_id) AS rn FROM {_GAPS} WHERE gap_s IS NOT NULL) GROUP BY 1, 2)""")
def _(spark, d):
    keys = ("user_name", "dst_ip")
    b = features.beacon_vectors(features.interarrival(v.sec_events(spark, d), keys), keys)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return b.select(*keys, "intervals", F.size("vector").alias("width"), F.try_element_at("vector", F.lit(1)).alias("first_gap"), F.when(F.size("vector") > 0, F.round(total).cast("bigint")).alias("total"))


@query("score_model_batch", "SELECT vec_id, round(greatest(0.0, least(1.0, list_sum(embedding::DOUBLE[]))), 3) AS score, CAST(NULL AS DOUBLE) AS score_without_model FROM embeddings")
def _(spark, d):
    from quillwatch.operators import models
    e = table(spark, d, "embeddings")
    ones = F.array_repeat(F.lit(1.0), F.size("embedding"))
    return e.select("vec_id", F.round(models.score(ones, "embedding"), 3).alias("score"), models.score(None, "embedding").alias("score_without_model"))


def behaviour(spark, d):
    """Events as numbers, and whether each is one of the planted anomalies: much data or many ports at night, or failures towards a rare port."""
    e = v.sec_events(spark, d)
    hour = F.hour("ts")
    odd = ((hour < 6) & (c("bytes_out") > 400_000)) | ((c("event_type") == "auth_failure") & (c("dst_port") == 8080)) | ((c("k") > 90) & (c("src_port") > 30_000))
    numbers = F.array(*[x.cast("double") for x in (hour, c("bytes_out"), (c("event_type") == "auth_failure").cast("int"), c("dst_port"), c("src_port"), c("k"), F.dayofweek("ts"))])
    return e.select("event_id", numbers.alias("x"), F.coalesce(odd, F.lit(False)).cast("int").alias("label"), (c("event_id") % 4 == 0).alias("held_out"))


def forest_scores(spark, d):
    """A forest fitted on three quarters of the events and scored on all; the planted label of the rest is never seen."""
    from quillwatch.operators import forest
    rows = behaviour(spark, d)
    path = forest.fit(rows.filter("NOT held_out"), "x", "label")
    model = forest.nodes(spark, path) if path else None
    s = F.round(forest.score(model, "x"), 6)
    return rows.select("event_id", "held_out", "label", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


@query("score_model_forest", """SELECT event_id % 4 = 0 AS held_out, CAST(coalesce((hour(ts) < 6 AND bytes_out > 400000) OR (event_type = 'auth_failure' AND dst_port = 8080) OR (k > 90 AND src_port > 30000), false) AS INT) AS label,
 count(*) AS n, true AS mostly_right FROM sec_events GROUP BY 1, 2""")
def _(spark, d):
    """By part and planted label: events, and whether four in five of them are told right."""
    return forest_scores(spark, d).groupBy("held_out", "label").agg(F.count("*").alias("n"), (F.avg((c("predicted") == c("label")).cast("int")) >= 0.8).alias("mostly_right"))


_LOCATED = """(SELECT event_id, tenant_id, user_name, ts, CASE WHEN event_id % 7 <> 0 THEN (['IN', 'US', 'DE'])[1 + (event_id // 5 % 40) // 19] END AS country FROM sec_events)"""


@query("feat_ueba_geo", f"""WITH l AS {_LOCATED}, k AS (SELECT *, lag(ts) OVER (PARTITION BY tenant_id, user_name, country ORDER BY ts, event_id) AS same_ts, lag(ts) OVER (PARTITION BY tenant_id, user_name ORDER BY ts, event_id) AS any_ts FROM l WHERE country IS NOT NULL)
 SELECT event_id, CASE WHEN any_ts IS NOT NULL AND (same_ts IS NULL OR ts - same_ts > INTERVAL 5 DAY) THEN 1 ELSE 0 END AS geo_dev FROM k UNION ALL SELECT event_id, 0 FROM l WHERE country IS NULL""")
def _(spark, d):
    place = F.get(F.array(F.lit("IN"), F.lit("US"), F.lit("DE")), F.floor((F.floor(c("event_id") / 5) % 40) / 19).cast("int"))
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "user_name", "ts", F.when(c("event_id") % 7 != 0, place).alias("country"))
    return features.new_country(e, ["tenant_id", "user_name"], "country", 5).select("event_id", "geo_dev")


@query("feat_exfil_reputation", """WITH p AS (SELECT tenant_id, dst_ip, CAST(ts AS DATE) AS day, count(*) FILTER (k > 80) AS bad, count(*) AS n FROM sec_events GROUP BY 1, 2, 3)
 SELECT a.tenant_id, a.dst_ip, a.day, round(coalesce(sum(b.bad * pow(0.5, (a.day - b.day) / 7.0)) / sum(b.n * pow(0.5, (a.day - b.day) / 7.0)), 0), 4) AS reputation
 FROM p a LEFT JOIN p b ON b.tenant_id = a.tenant_id AND b.dst_ip = a.dst_ip AND b.day < a.day GROUP BY 1, 2, 3""")
def _(spark, d):
    e = v.sec_events(spark, d).select("tenant_id", "dst_ip", F.to_date("ts").alias("on_day"), (c("k") > 80).alias("bad"))
    return features.destination_reputation(e, ["tenant_id", "dst_ip"], "on_day", "bad").withColumn("reputation", F.round("reputation", 4))
