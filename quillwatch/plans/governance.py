"""Compliance, audit, tenancy and per-key state queries."""

import datetime as dt

from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.operators import audit, compliance, enrich, filters, sessions, split
from quillwatch.plans import views as v
from quillwatch.plans.registry import query
from quillwatch.sources import events
from quillwatch.sources.event_store import EventStore
from quillwatch.sources.shared import materialize, new_folder
from quillwatch.sources.tables import table

txt = lambda x: (c(x) if isinstance(x, str) else x).cast("string")
# Stated here once more, so that the SQL does not read the engine's own lists.
_CASE = """CASE WHEN regexp_matches(lower({0}), 'scan|probe|recon') THEN 1 WHEN regexp_matches(lower({0}), 'ransomware|malware|virus|worm|trojan|cryptominer') THEN 5
 WHEN regexp_matches(lower({0}), 'phish|spoof|identity') THEN 7 WHEN regexp_matches(lower({0}), 'ddos|dos|flood') THEN 8 WHEN regexp_matches(lower({0}), 'breach|exfil') THEN 11
 WHEN regexp_matches(lower({0}), 'leak|exposure') THEN 12 WHEN regexp_matches(lower({0}), 'defac|tamper') THEN 4 WHEN regexp_matches(lower({0}), 'unauth|privilege|lateral') THEN 3
 WHEN regexp_matches(lower({0}), 'scada|ot/|ics') THEN 9 WHEN regexp_matches(lower({0}), 'iot|embedded') THEN 13 WHEN regexp_matches(lower({0}), 'web app|application|sqli') THEN 10
 WHEN regexp_matches(lower({0}), 'server|dns|mail') THEN 6 WHEN regexp_matches(lower({0}), 'compromi|rootkit|persist') THEN 2 END"""
_CAT = """(SELECT * FROM (VALUES (1, 'Targeted scanning/probing of critical networks or systems'), (2, 'Compromise of critical systems/information'), (3, 'Unauthorised access to IT systems/data'),
 (4, 'Defacement of website or intrusion into a website and related systems'),
 (5, 'Malicious code attacks such as spreading of virus/worm/Trojan/Bots/Spyware/Ransomware/Cryptominers'),
 (6, 'Attacks on servers such as Database, Mail and DNS and Network devices such as Routers'), (7, 'Identity Theft, Spoofing and Phishing attacks'),
 (8, 'Denial of Service (DoS) and Distributed Denial of Service (DDoS) attacks'),
 (9, 'Attacks on Critical infrastructure, SCADA, Operational Technology Systems and Wireless networks'), (10, 'Attacks on Applications such as E-Governance, E-Commerce etc.'),
 (11, 'Data Breach'), (12, 'Data Leak'), (13, 'Attacks on Internet of Things (IoT) devices and associated systems, networks and infrastructure')) t(category, description))"""


@query("comp_certin_category", f"SELECT doc_id, {_CASE.format('text')} AS category FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", compliance.incident_category("text").alias("category"))


_INC = "(SELECT doc_id, text, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts FROM documents)"


def incidents(spark, d):
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), c("doc_id").cast("int"))
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", ts.alias("ts"))


@query("comp_certin_counts", f"SELECT category, description, coalesce(n, 0) AS incidents FROM {_CAT} LEFT JOIN (SELECT {_CASE.format('text')} AS category, count(*) AS n FROM {_INC} WHERE doc_id <= (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 FROM documents) GROUP BY 1) USING (category)")
def _(spark, d):
    i = incidents(spark, d)
    first, last = i.agg(F.min("ts"), F.max("ts")).first()  # the earlier half of the incidents' own period, its middle minute included
    half = first + dt.timedelta(minutes=(last - first) // dt.timedelta(minutes=2) + 1)
    return compliance.category_counts(i, str(first), str(half))


@query("join_catalog_zero_fill", f"SELECT category, description, coalesce(n, 0) AS n FROM {_CAT} LEFT JOIN (SELECT CAST(o_custkey % 17 AS INT) AS category, count(*) AS n FROM orders GROUP BY 1) USING (category)")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy((c("o_custkey") % 17).cast("int").alias("category")).agg(F.count("*").alias("n"))
    return enrich.zero_fill(compliance.catalog(spark), counts, "category", "n")


@query("comp_incident_text", f"""SELECT doc_id, 'CERT-In Incident Report\n========================\nOrganisation : ' || source || '\nIncident ID  : ' || doc_id || '\nCategory No. : ' || i.category || '\nCategory     : ' || description ||
 '\nDetected At  : ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '\nAffected     : ' || lang || '\n\nDescription\n-----------\n' || text || '\n\n[Report generated by quillwatch — submit to incident@cert-in.org.in within 6 hours]\n' AS report
 FROM (SELECT d.*, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, {_CASE.format('text')} AS category FROM documents d) i JOIN {_CAT} k ON k.category = i.category""")
def _(spark, d):
    i = incidents(spark, d).withColumns({"category": compliance.incident_category("text"), "at_text": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "id": txt("doc_id")}).filter("category IS NOT NULL")
    return i.select("doc_id", compliance.incident_text("category", "id", "at_text", "text", "lang", "source", "quillwatch").alias("report"))


@query("comp_dpdp_trail", "SELECT actor_id, actor_type, action, resource_type AS data_category, ts AS accessed_at, event_id % 4 <> 0 AS consent_recorded, CASE WHEN event_id % 4 <> 0 THEN 'ok' ELSE 'warn' END AS consent_class FROM audit_log")
def _(spark, d):
    return compliance.access_trail(v.audit_log(spark, d).withColumn("consent_recorded", c("event_id") % 4 != 0))


@query("comp_dpdp_deadline", """SELECT event_id, CASE WHEN event_id % 20 = 0 THEN false ELSE left_h < 0 END AS overdue, CASE WHEN event_id % 20 = 0 THEN 72 ELSE left_h END AS hours_left FROM (
 SELECT event_id, 72 - CAST(trunc((epoch(TIMESTAMP '2024-01-15') - epoch(date_trunc('second', ts))) / 3600) AS BIGINT) AS left_h FROM sec_events)""")
def _(spark, d):
    text = F.when(c("event_id") % 20 == 0, "last week").otherwise(c("iso"))
    return v.sec_events(spark, d).select("event_id", compliance.deadline(text, "2024-01-15 00:00:00").alias("x")).select("event_id", "x.*")


@query("comp_rbi_privileged", """SELECT actor_id, action, resource_type AS resource, ts, result, source_ip, CASE result WHEN 'success' THEN 'ok' ELSE 'warn' END AS result_class FROM audit_log
 WHERE action IN ('process_create', 'auth_success') AND ts >= '2024-01-10' AND ts < '2024-01-20'""")
def _(spark, d):
    return compliance.privileged_access(v.audit_log(spark, d), ["process_create", "auth_success"], "2024-01-10", "2024-01-20")


@query("comp_rbi_localisation", "SELECT s_suppkey, s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0 AS ok FROM supplier")
def _(spark, d):
    egress = F.when(c("s_suppkey") % 3 == 0, F.array(F.lit("eu-cloud"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "supplier").select("s_suppkey", compliance.localised(c("s_nationkey") % 2 == 0, egress).alias("ok"))


def _dur(x):
    return f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} >= 3600 THEN ({x} // 3600) || 'h ' || ({x} % 3600 // 60) || 'm' WHEN {x} >= 60 THEN ({x} // 60) || 'm ' || ({x} % 60) || 's' ELSE {x} || 's' END"


@query("comp_sebi_metrics", f"""SELECT *, coalesce(mttd_s <= 900, true) AS mttd_ok, coalesce(mtta_s <= 1800, true) AS mtta_ok, coalesce(mttr_s <= 14400, true) AS mttr_ok, {_dur('mttd_s')} AS mttd_text, {_dur('mtta_s')} AS mtta_text, {_dur('mttr_s')} AS mttr_text FROM (
 SELECT tenant_id, severity, CAST(floor(avg(detect_min * 60)) AS BIGINT) AS mttd_s, CAST(floor(avg(ack_min * 60)) AS BIGINT) AS mtta_s, CAST(floor(avg(resolve_min * 60)) AS BIGINT) AS mttr_s,
 count(*) FILTER (severity = 'critical') AS critical_incidents, count(*) FILTER (detect_min > 15) AS mttd_breaches, count(*) FILTER (severity = 'critical' AND resolve_min > 240) AS mttr_breaches FROM alerts_life GROUP BY 1, 2)""")
def _(spark, d):
    return compliance.response_metrics(v.alerts_life(spark, d), "tenant_id", "severity")


@query("comp_retention_check", """SELECT hostname, min(ts) AS oldest, min(ts) <= TIMESTAMP '2024-01-31' - INTERVAL 28 DAY AS covered, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 - count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS missing_days
 FROM sec_events WHERE hostname IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return compliance.retention(v.sec_events(spark, d).filter("hostname IS NOT NULL"), v.NOW, "hostname", days=28)


@query("comp_retention_missing_days", """WITH s AS (SELECT DISTINCT user_name, CAST(ts AS DATE) AS day FROM sec_events), b AS (SELECT user_name, min(day) AS a, max(day) AS z FROM s GROUP BY 1)
 SELECT user_name, day FROM (SELECT user_name, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_name = x.user_name AND s.day = x.day)""")
def _(spark, d):
    return compliance.missing_days(v.sec_events(spark, d), "user_name")


@query("comp_posture", "SELECT 'framework-' || (doc_id % 4) AS framework, count(*) FILTER (quality = 1) AS passing, count(*) FILTER (quality = 0) AS failing, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS score FROM labels GROUP BY 1")
def _(spark, d):
    return compliance.posture(table(spark, d, "labels").select(F.concat(F.lit("framework-"), txt(c("doc_id") % 4)).alias("framework"), (c("quality") == 1).alias("passed")))


@query("comp_report_list", "SELECT alert_id AS report_id, tenant_id, created_at FROM alerts_life WHERE tenant_id = 'tenant-1'")
def _(spark, d):
    return compliance.report_list(v.alerts_life(spark, d).select(c("alert_id").alias("report_id"), "tenant_id", "created_at"), "tenant-1")


# ---- audit ---------------------------------------------------------------------

def chain(spark, d):
    log = v.audit_log(spark, d).select("tenant_id", "event_id", "chain_seq", "action", "actor_id", "ts")
    return audit.build_chain(log)


_TXT = "action || actor_id || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00')"


@query("audit_chain_build", f"""WITH log AS MATERIALIZED (SELECT tenant_id, chain_seq, {_TXT} AS t FROM audit_log),
 links AS (SELECT tenant_id, chain_seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || t) AS row_hash FROM log WHERE chain_seq = 1
  UNION ALL SELECT l.tenant_id, l.chain_seq, k.row_hash, sha256(k.row_hash || l.t) FROM links k JOIN log l ON l.tenant_id = k.tenant_id AND l.chain_seq = k.chain_seq + 1)
 SELECT * FROM links""")
def _(spark, d):
    return chain(spark, d).select("tenant_id", "chain_seq", "prev_hash", "row_hash")


@query("audit_chain_verify", """SELECT tenant_id, chain_seq, event_id % 997 <> 0 AS hash_ok, NOT (lag(event_id, 1, 1) OVER w % 499 = 0 AND lag(event_id, 1, 1) OVER w % 997 <> 0) AS link_ok FROM audit_log
 WINDOW w AS (PARTITION BY tenant_id ORDER BY chain_seq) QUALIFY NOT hash_ok OR NOT link_ok""")
def _(spark, d):
    stored = materialize(chain(spark, d), "chain")
    # Some rows were changed and kept their digest; others were changed and digested anew, which breaks the link of the row that follows.
    tampered = stored.withColumn("action", F.when((c("event_id") % 997 == 0) | (c("event_id") % 499 == 0), F.lit("log_cleared")).otherwise(c("action")))
    tampered = tampered.withColumn("row_hash", F.when((c("event_id") % 499 == 0) & (c("event_id") % 997 != 0), audit.row_digest("prev_hash")).otherwise(c("row_hash")))
    return audit.verify_chain(tampered).select("tenant_id", "chain_seq", "hash_ok", "link_ok")


_HOLES = "(SELECT tenant_id, event_id, chain_seq FROM audit_log WHERE event_id % 501 <> 0 UNION ALL SELECT tenant_id, event_id + 1000000000, chain_seq FROM audit_log WHERE event_id % 777 = 5)"


@query("audit_chain_gaps", f"""SELECT tenant_id, chain_seq, prev_seq, CASE WHEN chain_seq <= prev_seq THEN 'repeat' ELSE 'missing' END AS kind FROM (
 SELECT *, coalesce(lag(chain_seq) OVER (PARTITION BY tenant_id ORDER BY chain_seq, event_id), 0) AS prev_seq FROM {_HOLES}) WHERE chain_seq <> prev_seq + 1""")
def _(spark, d):
    log = v.audit_log(spark, d).select("tenant_id", "event_id", "chain_seq")
    holes = log.filter("event_id % 501 <> 0").unionByName(log.filter("event_id % 777 = 5").withColumn("event_id", c("event_id") + 1000000000))
    return audit.sequence_gaps(holes).select("tenant_id", "chain_seq", "prev_seq", "kind")


@query("win_audit_prev", "SELECT tenant_id, chain_seq, lag(chain_seq) OVER w AS prev_seq, lag(action) OVER w AS prev_action FROM audit_log WINDOW w AS (PARTITION BY tenant_id ORDER BY chain_seq)")
def _(spark, d):
    return audit.with_previous(v.audit_log(spark, d), {"prev_seq": c("chain_seq"), "prev_action": c("action")}).select("tenant_id", "chain_seq", "prev_seq", "prev_action")


@query("audit_query", "SELECT event_id, action, ts FROM audit_log WHERE actor_id = 'user7' AND action IN ('auth_failure', 'auth_success') AND ts >= '2024-01-05' AND ts <= '2024-01-25'")
def _(spark, d):
    return audit.search(v.audit_log(spark, d), "user7", ["auth_failure", "auth_success"], "2024-01-05", "2024-01-25").select("event_id", "action", "ts")


@query("tenant_violation", "SELECT source_type, count(*) AS foreign_rows FROM sec_events WHERE tenant_id <> 'tenant-1' GROUP BY 1")
def _(spark, d):
    return events.foreign_rows(v.sec_events(spark, d), "tenant-1").groupBy("source_type").agg(F.count("*").alias("foreign_rows"))


@query("tenant_canary", """SELECT 'store' AS guard, CAST(0 AS BIGINT) AS leaked, count(*) FILTER (tenant_id = 'tenant-2') AS own FROM sec_events
 UNION ALL SELECT 'none', count(*) FILTER (event_id % 50 = 0 AND tenant_id <> 'tenant-2'), count(*) FILTER (tenant_id = 'tenant-2') FROM sec_events""")
def _(spark, d):
    """Rows planted by another tenant into a tenant's batches: the store's guard refuses each such batch, a folder without it leaks them."""
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "ts")
    own, foreign = e.filter("tenant_id = 'tenant-2'"), e.filter("tenant_id <> 'tenant-2' AND event_id % 50 = 0")
    guarded, bare = EventStore(spark, new_folder(spark, "guarded"), e.schema), EventStore(spark, new_folder(spark, "bare"), e.schema)
    guarded.append(own, "tenant-2")
    bare.append(own.unionByName(foreign))
    try:
        guarded.append(own.unionByName(foreign), "tenant-2")
    except PermissionError:
        pass
    seen = lambda store, name: store.read().agg(F.count_if(c("tenant_id") != "tenant-2").alias("leaked"), F.count_if(c("tenant_id") == "tenant-2").alias("own")).select(F.lit(name).alias("guard"), "leaked", "own")
    return seen(guarded, "store").unionByName(seen(bare, "none"))


@query("tenant_offboard", "SELECT tenant_id, count(*) AS n FROM sec_events WHERE tenant_id <> 'tenant-0' GROUP BY 1")
def _(spark, d):
    kept = events.stored(audit.without_tenant(v.sec_events(spark, d).select("event_id", "tenant_id", "ts", "event_type"), "tenant-0"), "offboarded")
    return kept.groupBy("tenant_id").agg(F.count("*").alias("n"))


_ROLE = "(['super_admin','admin','analyst','viewer','api_key'])[user_id % 5 + 1]"
_ACT = "(['read','write','delete','execute','manage'])[event_id % 5 + 1]"
_RES = "(['events','alerts','rules','assets','playbooks','users','settings','compliance','agents','tenants'])[event_id // 5 % 10 + 1]"


@query("role_permission_matrix", f"""SELECT role, action, resource, count(*) AS violations FROM (SELECT {_ROLE} AS role, {_ACT} AS action, {_RES} AS resource FROM events) WHERE NOT (role = 'super_admin'
 OR (role = 'admin' AND NOT ((action = 'delete' AND resource = 'users') OR (action = 'manage' AND resource = 'settings') OR (action IN ('write', 'delete', 'manage') AND resource = 'tenants')))
 OR (role = 'analyst' AND ((action = 'read' AND resource IN ('events','playbooks','compliance','agents')) OR (action IN ('read','write') AND resource IN ('alerts','rules','assets')) OR (action = 'execute' AND resource = 'playbooks')))
 OR (role = 'viewer' AND action = 'read' AND resource IN ('events','alerts','rules','assets','playbooks','settings','compliance','agents')) OR (role = 'api_key' AND action = 'read' AND resource IN ('events','alerts'))) GROUP BY 1, 2, 3""")
def _(spark, d):
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    e = table(spark, d, "events").select(pick(["super_admin", "admin", "analyst", "viewer", "api_key"], c("user_id") % 5).alias("role"), pick(audit.ACTIONS, c("event_id") % 5).alias("action"),
                                         pick(audit.RESOURCES, F.floor(c("event_id") / 5) % 10).alias("resource"))
    return audit.violations(e.withColumn("n", F.lit(1))).groupBy("role", "action", "resource").agg(F.count("*").alias("violations"))


# ---- per-key state ----------------------------------------------------------------

_ATT = "(SELECT *, event_type = 'auth_failure' AS f FROM sec_events WHERE event_type IN ('auth_failure', 'auth_success'))"


@query("st_brute_force", f"""WITH a AS (SELECT tenant_id, event_id, ts, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS seg FROM {_ATT})
 SELECT event_id, n AS failures, CASE WHEN n >= 5 THEN ts + INTERVAL 15 MINUTE END AS locked_until FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, seg ORDER BY ts, event_id) AS n FROM a WHERE f)""")
def _(spark, d):
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "ts", "event_type")
    return sessions.lockouts(e, ["tenant_id"], c("event_type") == "auth_failure", c("event_type") == "auth_success").select("event_id", "failures", "locked_until")


@query("st_brute_force_expiring", """WITH a AS MATERIALIZED (SELECT tenant_id, event_id, ts, event_type IN ('auth_failure', 'file_access', 'process_create') AS f, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS rn FROM sec_events),
 r AS (SELECT tenant_id, rn, event_id, ts, f, CASE WHEN f THEN 1 ELSE 0 END AS n, CAST(NULL AS TIMESTAMP) AS until FROM a WHERE rn = 1
  UNION ALL SELECT tenant_id, rn, event_id, ts, f, n, CASE WHEN n >= 5 THEN ts + INTERVAL 15 MINUTE END FROM (SELECT a.tenant_id, a.rn, a.event_id, a.ts, a.f,
   CASE WHEN NOT a.f THEN 0 WHEN r.until IS NOT NULL AND a.ts >= r.until THEN 1 ELSE r.n + 1 END AS n FROM r JOIN a ON a.tenant_id = r.tenant_id AND a.rn = r.rn + 1))
 SELECT event_id, CAST(n AS BIGINT) AS failures, until AS locked_until FROM r WHERE f""")
def _(spark, d):
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "ts", "event_type")
    bad = c("event_type").isin("auth_failure", "file_access", "process_create")
    return sessions.lockouts_expiring(e, ["tenant_id"], bad, ~bad).select("event_id", "failures", "locked_until")


@query("st_rate_limit", """WITH w AS (SELECT agent_id, min(ts) AS o FROM agent_batches GROUP BY agent_id UNION ALL SELECT w.agent_id, min(b.ts) FROM w JOIN agent_batches b ON b.agent_id = w.agent_id AND b.ts >= w.o + INTERVAL 12 HOUR GROUP BY w.agent_id),
 x AS MATERIALIZED (SELECT b.agent_id, w.o, b.batch_id, b.n_events AS n, row_number() OVER (PARTITION BY b.agent_id, w.o ORDER BY b.ts, b.batch_id) AS rn FROM agent_batches b JOIN w ON w.agent_id = b.agent_id AND b.ts >= w.o AND b.ts < w.o + INTERVAL 12 HOUR),
 r AS (SELECT agent_id, o, rn, batch_id, CASE WHEN n <= 15 THEN n ELSE 0 END AS used, n <= 15 AS accepted FROM x WHERE rn = 1
  UNION ALL SELECT x.agent_id, x.o, x.rn, x.batch_id, CASE WHEN r.used + x.n <= 15 THEN r.used + x.n ELSE r.used END, r.used + x.n <= 15 FROM r JOIN x ON x.agent_id = r.agent_id AND x.o = r.o AND x.rn = r.rn + 1)
 SELECT agent_id, o AS window_start, batch_id, accepted FROM r""")
def _(spark, d):
    return sessions.limit_batches(v.agent_batches(spark, d), ["agent_id"], "n_events", 15, 12 * split.HOUR)


@query("st_agent_dark", "SELECT agent_id, p + INTERVAL 90 SECOND AS dark_from, ts AS revived_at FROM (SELECT *, lag(ts) OVER (PARTITION BY agent_id ORDER BY ts) AS p FROM heartbeats) WHERE ts > p + INTERVAL 90 SECOND")
def _(spark, d):
    return sessions.dark_periods(v.heartbeats(spark, d))


@query("st_agent_registry", """SELECT tenant_id, hostname, event_id, source_type, last_heartbeat, last_heartbeat >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 90 SECOND AS active FROM (SELECT tenant_id, hostname, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(source_type, (ts, event_id)) AS source_type, max(ts) AS last_heartbeat
 FROM sec_events WHERE hostname IS NOT NULL GROUP BY 1, 2)""")
def _(spark, d):
    e = v.sec_events(spark, d).filter("hostname IS NOT NULL").select("tenant_id", "hostname", "ts", "event_id", "source_type")
    return sessions.registry(e, e.select("tenant_id", "hostname", "ts"), "2024-01-30 20:00:00").select("tenant_id", "hostname", "event_id", "source_type", "last_heartbeat", "active")
