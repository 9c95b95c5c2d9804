"""The derived views as SQL text, for the comparison statements."""

import re

from quillwatch.plans import view_text as V


def _cols(pairs):
    return ",\n  ".join(f"{expr} AS {name}" for name, expr in pairs)


_e = dict(V.EVENT_COLUMNS)
VIEWS = {
    "ev_base": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "ev_cols": f"""SELECT event_id, ts, user_id, k, value, {_cols(V.EVENT_COLUMNS)},
  ts + to_seconds(event_id % 90) AS ts_received,
  CAST(round(value * 100) AS BIGINT) * 1000 AS bytes_out,
  CASE WHEN event_id % 2 = 0 THEN upper(sha256(CAST(user_id AS VARCHAR))) ELSE sha256(CAST(user_id AS VARCHAR)) END AS file_hash,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') AS bsd,
  epoch_us(ts) // 1000 AS epoch_ms, chr(9) AS tab
FROM ev_base""",
    "sec_events": f"SELECT * EXCLUDE (etype), etype AS event_type, {V.RAW} AS raw FROM ev_cols",
    "sec_assets": f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, hostname ORDER BY seen_order) AS rn
  FROM (SELECT {_cols(V.ASSET_COLUMNS)} FROM supplier)) WHERE rn = 1""",
    "geo_ranges": """SELECT 3325256704 + n_nationkey * 4 AS ip_from, 3325256704 + n_nationkey * 4 + 3 AS ip_to,
  substr(n_name, 1, 2) AS country, n_name AS city FROM nation""",
    "ioc_feed": """SELECT 'ip' AS ioc_type, '203.0.113.' || n_nationkey AS value, 'feed-ip' AS source, CAST(NULL AS VARCHAR) AS severity FROM nation WHERE n_nationkey % 5 = 0
  UNION ALL SELECT 'sha256', sha256(CAST(c_custkey AS VARCHAR)), 'feed-hash', 'Payload' FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT DISTINCT 'url', 'HTTP://SITE' || (page_id % 40) || '.Example.NET/p/' || (page_id % 50), 'feed-url', 'malware' FROM pages WHERE page_id % 9 = 0
  UNION ALL SELECT 'domain', 'Site' || s_suppkey || '.example.net.', 'feed-domain', NULL FROM supplier WHERE s_suppkey % 7 = 0""",
    "ioc_set": """SELECT ioc_type, CASE WHEN ioc_type = 'url' THEN lower(regexp_extract(value, '^([^:]*://[^/]*)', 1)) || regexp_replace(value, '^[^:]*://[^/]*', '')
  WHEN ioc_type = 'domain' THEN rtrim(lower(value), '.') WHEN ioc_type = 'sha256' THEN lower(value) ELSE value END AS value_norm,
  min(source) AS source, min(severity) AS severity FROM ioc_feed GROUP BY ALL""",
    "alerts_life": f"""SELECT *, created_at + to_minutes(detect_min) AS detected_at, created_at + to_minutes(ack_min) AS acknowledged_at,
  created_at + to_minutes(resolve_min) AS resolved_at FROM (SELECT {_cols(V.ALERT_COLUMNS)} FROM orders)""",
    "flow_volume": "SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes FROM lineitem",
    "audit_log": """SELECT tenant_id, event_id, ts, user_name AS actor_id,
  CASE WHEN user_id % 4 = 0 THEN 'service' ELSE 'human' END AS actor_type, event_type AS action,
  CASE event_id % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'alerts' ELSE 'rules' END AS resource_type, src_ip AS source_ip,
  CASE event_id % 5 WHEN 0 THEN 'failure' WHEN 1 THEN 'denied' ELSE 'success' END AS result,
  row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS chain_seq FROM sec_events""",
    "heartbeats": "SELECT user_id % 40 AS agent_id, ts FROM events",
    "agent_batches": """SELECT user_id % 40 AS agent_id, event_id AS batch_id, ts, CASE WHEN event_id % 17 = 0 THEN event_id - 100 ELSE event_id END AS sequence,
  1 + event_id % 9 AS n_events FROM events""",
}

# ---- detection views ---------------------------------------------------------
from quillwatch.plans.rule_set import SQL_PREDICATES  # noqa: E402

# The stable rules in their order: id, title, level, first tactic, first technique.
RULE_ROWS = [
    ("r05", "High counter", "critical", "Exfiltration", "T1041"),
    ("r01", "Encoded shell", "high", "Execution", "T1059.001"),
    ("r10", "List of maps", "high", "Impact", None),
    ("r02", "Failed login to ssh", "medium", "Credential Access", "T1110"),
    ("r04", "Outbound to watched range", "medium", "Command and Control", "T1071"),
    ("r07", "Any of several", "medium", "Discovery", "T1083"),
    ("r09", "Missing process", "medium", "Persistence", None),
    ("r03", "No command line", "low", "Defense Evasion", None),
    ("r06", "Host wildcard", "low", "Lateral Movement", None),
    ("r11", "Grouped conditions", "low", "Collection", None),
    ("r08", "Keyword in raw", "info", None, None),
    ("r12", "All exact", "info", None, None),
]

SCORES = "CASE level WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 WHEN 'low' THEN 30 ELSE 10 END"
SEV_OF = "CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high' WHEN {0} >= 40 THEN 'medium' WHEN {0} >= 20 THEN 'low' ELSE 'info' END"


def _lit(x):
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


_rows = [f"SELECT event_id, {i} AS pos, {_lit(key)} AS rule_id, {_lit(title)} AS title, {_lit(level)} AS level, CAST({_lit(tactic)} AS VARCHAR) AS tactic, "
         f"CAST({_lit(technique)} AS VARCHAR) AS technique FROM sec_events WHERE {SQL_PREDICATES[key]}" for i, (key, title, level, tactic, technique) in enumerate(RULE_ROWS)]
VIEWS["rule_hits"] = "\n UNION ALL ".join(_rows)
VIEWS["ioc_cand"] = """SELECT event_id, 0 AS pos, 'ip' AS ioc_type, src_ip AS value_norm FROM sec_events
 UNION ALL SELECT event_id, 1, 'ip', dst_ip FROM sec_events UNION ALL SELECT event_id, 2, 'sha256', lower(file_hash) FROM sec_events
 UNION ALL SELECT event_id, 3, 'url', f_url FROM sec_events WHERE f_url IS NOT NULL"""
VIEWS["ioc_hit_rows"] = "SELECT c.event_id, c.pos, c.ioc_type, c.value_norm, s.source, s.severity FROM ioc_cand c JOIN ioc_set s USING (ioc_type, value_norm)"
VIEWS["scored"] = f"""SELECT *, {SEV_OF.format('risk_score')} AS risk_severity FROM (
 SELECT *, CAST(least(100, floor(raw_score * (CASE asset_criticality WHEN 'critical' THEN 20 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 WHEN 'low' THEN 7 ELSE 5 END) / 10)) AS INTEGER) AS risk_score FROM (
 SELECT e.*, k / 100.0 AS anomaly_score, (event_id % 100) / 100.0 AS ueba_score, coalesce(h.base, 0) AS base, h.r.rule_id AS first_rule, h.r.title AS rule_name, h.r.tactic AS tactic, h.r.technique AS technique, coalesce(h.exfil, false) AS exfil, coalesce(h.n_rules, 0) AS n_rules, h.rule_ids,
  i.event_id IS NOT NULL AS ioc_hit,
  least(100, coalesce(h.base, 0) + CASE WHEN i.event_id IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN k > 75 THEN 15 ELSE 0 END + CASE WHEN event_id % 100 > 80 THEN 10 ELSE 0 END) AS raw_score
 FROM sec_events e LEFT JOIN (SELECT event_id, max({SCORES}) AS base, arg_min(struct_pack(rule_id := rule_id, title := title, tactic := tactic, technique := technique), pos) AS r, bool_or(coalesce(tactic, '') ILIKE '%exfil%') AS exfil, count(*) AS n_rules, string_agg(rule_id, ',' ORDER BY pos) AS rule_ids FROM rule_hits GROUP BY event_id) h USING (event_id)
 LEFT JOIN (SELECT DISTINCT event_id FROM ioc_hit_rows) i USING (event_id)))"""
VIEWS["cand"] = """SELECT *, coalesce(first_rule, '00000000-0000-0000-0000-000000000000') AS rule_key, coalesce(hostname, src_ip, 'unknown') AS entity FROM scored WHERE risk_score >= 40"""
VIEWS["win_open"] = """SELECT tenant_id, rule_key, entity, min(ts) AS opening FROM cand GROUP BY ALL
 UNION ALL SELECT w.tenant_id, w.rule_key, w.entity, min(c.ts) FROM win_open w JOIN cand c ON c.tenant_id = w.tenant_id AND c.rule_key = w.rule_key AND c.entity = w.entity
  AND c.ts >= w.opening + INTERVAL 15 MINUTE GROUP BY ALL"""
VIEWS["ev_win"] = """SELECT c.*, w.opening FROM cand c JOIN win_open w ON c.tenant_id = w.tenant_id AND c.rule_key = w.rule_key AND c.entity = w.entity
 AND c.ts >= w.opening AND c.ts < w.opening + INTERVAL 15 MINUTE"""
VIEWS["alert_win"] = """SELECT tenant_id, rule_key AS rule_id, entity, opening AS window_start, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen, max(risk_score) AS max_risk,
 arg_min(struct_pack(hostname := hostname, user_name := user_name, src_ip := src_ip, dst_ip := dst_ip, rule_name := rule_name, tactic := tactic, technique := technique,
  ioc_hit := ioc_hit, n_rules := n_rules, exfil := exfil, risk_severity := risk_severity, anomaly_score := anomaly_score), (ts, event_id)) AS f FROM ev_win GROUP BY ALL"""

# ---- the same over what the raw lines carry ---------------------------------------
_SAN = "lower(replace(replace(product, ' ', '_'), '-', '_'))"
_AGENT = "source_type = 'linux_ebpf'"


def _carried(column, fmts, kind="VARCHAR", value=None):
    """A column as agents deliver it and as lines of the named formats carry it."""
    return f"CAST(CASE WHEN {_AGENT} THEN {column} WHEN fmt IN ({fmts}) THEN {value or column} END AS {kind}) AS {column}"


VIEWS["norm_events"] = f"""SELECT n.*, coalesce(a.criticality, 'unknown') AS asset_criticality FROM (SELECT event_id, tenant_id, source_type, ts_received, raw,
 CASE WHEN {_AGENT} THEN ts WHEN fmt = 9 THEN ts_received WHEN fmt = 0 THEN make_timestamp(epoch_ms * 1000) ELSE date_trunc('second', ts) END AS ts,
 CASE WHEN {_AGENT} THEN event_type WHEN fmt = 0 THEN {_SAN} || '_' || event_type || '_' || (event_id % 7) WHEN fmt = 1 THEN {_SAN} || '_leef_' || event_type
  WHEN fmt = 2 THEN event_type WHEN fmt IN (3, 4) THEN 'syslog_message' END AS event_type,
 CASE WHEN {_AGENT} THEN event_category WHEN fmt IN (3, 4) THEN 'other' WHEN fmt <> 9 THEN event_category END AS event_category,
 CASE WHEN {_AGENT} OR fmt IN (0, 1, 2, 3) THEN hostname WHEN fmt = 4 THEN coalesce(hostname, '-') END AS hostname,
 CASE WHEN {_AGENT} OR fmt IN (0, 3) THEN process_name WHEN fmt = 4 THEN coalesce(process_name, 'cron') END AS process_name,
 CASE WHEN NOT ({_AGENT}) AND fmt IN (0, 2) THEN event_id % 5000 END AS process_pid,
 {_carried('user_name', '0, 1, 2')}, {_carried('src_ip', '0, 1, 2')}, {_carried('dst_ip', '0, 1, 2')}, {_carried('src_port', '0, 1, 2', 'INT')}, {_carried('dst_port', '0, 1, 2', 'INT')},
 {_carried('protocol', '0, 1, 2', value="'tcp'")}, {_carried('bytes_out', '0, 2', 'BIGINT')}, {_carried('process_cmdline', '2')}, {_carried('k', '0, 2', 'INT')},
 CASE WHEN {_AGENT} THEN file_hash END AS file_hash, CASE WHEN {_AGENT} THEN f_url END AS f_url FROM sec_events) n
 LEFT JOIN sec_assets a ON a.tenant_id = n.tenant_id AND lower(a.hostname) = lower(n.hostname)"""
_CHAIN = ["rule_hits", "ioc_cand", "ioc_hit_rows", "scored", "cand", "win_open", "ev_win", "alert_win"]
for _name in _CHAIN:
    VIEWS[f"norm_{_name}"] = re.sub(rf"\b(?:{'|'.join(_CHAIN)}|sec_events)\b", lambda m: "norm_events" if m[0] == "sec_events" else f"norm_{m[0]}", VIEWS[_name])
