"""Filters, ordering and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, in_cidr, is_private_ip
from quillwatch.operators import filters as flt
from quillwatch.operators import ioc
from quillwatch.plans import views as v
from quillwatch.plans.registry import query

EV = ["event_id", "tenant_id", "ts", "event_type"]


@query("flt_time_range", "SELECT event_id, tenant_id, ts, event_type FROM sec_events WHERE ts >= '2024-01-05' AND ts <= '2024-01-12 06:00:00'")
def _(spark, d):
    return flt.time_range(v.sec_events(spark, d), "2024-01-05", "2024-01-12 06:00:00").select(EV)


@query("flt_equality", "SELECT event_id, tenant_id, ts, event_type FROM sec_events WHERE source_type = 'syslog' AND event_type = 'auth_failure' AND hostname = 'host-9'")
def _(spark, d):
    return flt.equals(v.sec_events(spark, d), source_type="syslog", event_type="auth_failure", hostname="host-9").select(EV)


IP_HIT = "dst_ip IN (SELECT value_norm FROM ioc_set WHERE ioc_type = 'ip')"
ANY_HIT = f"""({IP_HIT} OR src_ip IN (SELECT value_norm FROM ioc_set WHERE ioc_type = 'ip')
 OR lower(file_hash) IN (SELECT value_norm FROM ioc_set WHERE ioc_type = 'sha256')
 OR coalesce(f_url IN (SELECT value_norm FROM ioc_set WHERE ioc_type = 'url'), false))"""


@query("flt_ioc_only", f"SELECT event_id, tenant_id, ts, event_type FROM sec_events WHERE {ANY_HIT}")
def _(spark, d):
    return ioc.keep_hit(v.sec_events(spark, d).select(*EV, "src_ip", "dst_ip", "file_hash", "fields"), v.ioc_lookup(spark, d)).select(EV)


@query("flt_min_severity", "SELECT event_id, severity FROM sec_events WHERE sev_rank >= 3")
def _(spark, d):
    return flt.min_severity(v.sec_events(spark, d), "high").select("event_id", "severity")


@query("flt_tenant", "SELECT event_id, tenant_id, ts, event_type FROM sec_events WHERE tenant_id = 'tenant-1'")
def _(spark, d):
    return flt.for_tenant(v.sec_events(spark, d), "tenant-1").select(EV)


@query("flt_raw_predicate", "SELECT event_id, dst_port FROM sec_events WHERE dst_port >= 443 AND severity IN ('high', 'critical')")
def _(spark, d):
    e = flt.where_allowed(v.sec_events(spark, d), "dst_port", ">=", 443)
    return flt.where_allowed(e, "severity", "in", ["high", "critical"]).select("event_id", "dst_port")


@query("flt_relative_time", "SELECT event_id, ts FROM sec_events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(spark, d):
    return flt.since(v.sec_events(spark, d), "7d", v.NOW).select("event_id", "ts")


@query("flt_private_ip", "SELECT event_id, src_ip LIKE '10.%' AS src_private, dst_ip LIKE '10.%' AS dst_private FROM sec_events")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", is_private_ip("src_ip").alias("src_private"), is_private_ip("dst_ip").alias("dst_private"))


@query("flt_cidr", """SELECT event_id, src_ip FROM sec_events
 WHERE CAST(split_part(src_ip, '.', 2) AS INT) BETWEEN 2 AND 3 OR (dst_ip LIKE '198.51.100.%' AND CAST(split_part(dst_ip, '.', 4) AS INT) BETWEEN 8 AND 15)""")
def _(spark, d):
    return v.sec_events(spark, d).filter(in_cidr("src_ip", "10.2.0.0/15") | in_cidr("dst_ip", "198.51.100.8/29")).select("event_id", "src_ip")


@query("flt_alert_status", "SELECT alert_id, created_at FROM alerts_life WHERE status = 'open' AND severity = 'high' ORDER BY created_at DESC, alert_id DESC LIMIT 100")
def _(spark, d):
    return flt.latest(flt.alert_status(v.alerts_life(spark, d), "open", "high"), 100, "created_at", "alert_id").select("alert_id", "created_at")


@query("flt_asset_attrs", "SELECT tenant_id, hostname, asset_id FROM sec_assets WHERE os_name = 'linux' AND agent_active")
def _(spark, d):
    return flt.asset_attrs(v.sec_assets(spark, d), os_name="linux", agent_active=True).select("tenant_id", "hostname", "asset_id")


@query("ord_events_latest", "SELECT event_id, tenant_id, ts, event_type FROM sec_events WHERE tenant_id = 'tenant-0' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, d):
    return flt.latest(flt.for_tenant(v.sec_events(spark, d), "tenant-0"), 0).select(EV)


@query("ord_page", "SELECT event_id, tenant_id, ts, event_type FROM sec_events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 120")
def _(spark, d):
    return flt.page(v.sec_events(spark, d), 50, 120).select(EV)


@query("ord_chain_tip", "SELECT tenant_id, max(chain_seq) AS chain_seq, arg_max(action, chain_seq) AS action FROM audit_log GROUP BY tenant_id")
def _(spark, d):
    return v.audit_log(spark, d).groupBy("tenant_id").agg(F.max("chain_seq").alias("chain_seq"), F.max_by("action", "chain_seq").alias("action"))


@query("ord_topk_group", """SELECT tenant_id, alert_id, risk_score, rn FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY risk_score DESC, alert_id) AS rn
 FROM alerts_life) WHERE rn <= 10""")
def _(spark, d):
    w = Window.partitionBy("tenant_id").orderBy(c("risk_score").desc(), "alert_id")
    return (v.alerts_life(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 10").withColumn("rn", c("rn").cast("bigint"))
            .select("tenant_id", "alert_id", "risk_score", "rn"))


@query("set_union_feeds", "SELECT ioc_type, source, count(*) AS n FROM ioc_feed GROUP BY ALL")
def _(spark, d):
    return v.ioc_feed(spark, d).groupBy("ioc_type", "source").agg(F.count("*").alias("n"))


OLD = "length(value_norm) % 2 = 0 OR ioc_type = 'url'"
NEW = "length(value_norm) % 3 = 0 OR ioc_type = 'domain'"


@query("set_feed_diff", f"""WITH o AS (SELECT ioc_type, value_norm FROM ioc_set WHERE {OLD}), n AS (SELECT ioc_type, value_norm FROM ioc_set WHERE {NEW})
 SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def _(spark, d):
    s = v.ioc_set(spark, d)
    return ioc.feed_diff(s.filter(OLD), s.filter(NEW))
