"""Column formulas that mean the same in Spark SQL and in ANSI SQL.

They turn the generic tables into security-shaped ones; both engines evaluate the same text.
"""


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


# (name, formula) over: event_id, user_id, event_type, value, k, ts
EVENT_COLUMNS = [
    ("tenant_id", f"'tenant-' || {s('user_id % 3')}"),
    ("source_type", "CASE event_id % 4 WHEN 0 THEN 'linux_ebpf' WHEN 1 THEN 'syslog' WHEN 2 THEN 'http_intake' ELSE 'network_flow' END"),
    ("kind", "event_type"),
    ("etype", "CASE event_type WHEN 'view' THEN 'file_access' WHEN 'click' THEN 'process_create' WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' ELSE 'network_connect' END"),
    ("event_category", "CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'process' WHEN 'purchase' THEN 'network' ELSE 'authentication' END"),
    ("hostname", f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'host-' || {s('user_id % 40')} END"),
    ("user_name", f"'user' || {s('user_id')}"),
    ("src_ip", f"'10.' || {s('user_id % 4')} || '.' || {s('event_id % 50')} || '.' || {s('1 + user_id % 200')}"),
    ("dst_ip", f"CASE WHEN event_id % 5 = 0 THEN '203.0.113.' || {s('event_id % 20')} ELSE '198.51.100.' || {s('user_id % 30')} END"),
    ("src_port", "CAST(1024 + event_id % 60000 AS INT)"),
    ("dst_port", "CAST(CASE event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 8080 END AS INT)"),
    ("protocol", "CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END"),
    ("process_name", f"CASE event_id % 7 WHEN 0 THEN 'powershell.exe' WHEN 1 THEN NULL ELSE 'proc' || {s('event_id % 7')} END"),
    ("process_cmdline", f"CASE event_id % 7 WHEN 0 THEN 'powershell.exe -enc ' || {s('event_id')} WHEN 1 THEN NULL ELSE 'proc' || {s('event_id % 7')} || ' --id ' || {s('event_id')} END"),
    ("auth_result", "CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' ELSE NULL END"),
    ("asset_criticality", "CASE user_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'unknown' END"),
    ("severity", "CASE WHEN k < 20 THEN 'info' WHEN k < 40 THEN 'low' WHEN k < 60 THEN 'medium' WHEN k < 80 THEN 'high' ELSE 'critical' END"),
    ("sev_rank", "CAST(CASE WHEN k < 20 THEN 0 WHEN k < 40 THEN 1 WHEN k < 60 THEN 2 WHEN k < 80 THEN 3 ELSE 4 END AS INT)"),
    ("f_url", f"CASE WHEN event_id % 13 = 0 THEN 'http://site' || {s('user_id % 40')} || '.example.net/p/' || {s('event_id % 50')} ELSE NULL END"),
    ("fmt", "CAST(CASE WHEN event_id % 101 = 0 THEN 9 ELSE event_id % 5 END AS INT)"),
    ("product", "CASE WHEN event_id % 2 = 0 THEN 'Shield Pro' ELSE 'Gate-7' END"),
    ("message", f"'done in ' || {s('event_id % 90')} || ' ms'"),
]

_CEF_SEV = "CASE sev_rank WHEN 0 THEN 'Unknown' WHEN 1 THEN '2' WHEN 2 THEN 'medium' WHEN 3 THEN '7' ELSE '10' END"
_LEEF_SEV = "CASE sev_rank WHEN 0 THEN 'x' WHEN 1 THEN '2' WHEN 2 THEN 'Informational' WHEN 3 THEN '8' ELSE 'Very-High' END"
_JSON_SEV = ("CASE WHEN event_id % 2 = 0 THEN CASE sev_rank WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN '6' WHEN 3 THEN '8' ELSE '12' END "
             "ELSE CASE sev_rank WHEN 0 THEN '\"Notice\"' WHEN 1 THEN '\"minor\"' WHEN 2 THEN '\"WARN\"' WHEN 3 THEN '\"err\"' ELSE '\"fatal\"' END END")
_PRI = s("32 + CASE sev_rank WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 2 END")
_CAT = "CASE event_category WHEN 'authentication' THEN 'User Login' WHEN 'network' THEN 'Network flow' WHEN 'file' THEN 'file disk' ELSE 'process exec' END"
_HOST = "coalesce(hostname, '-')"
_APP = "coalesce(process_name, '-')"


def _sep_attrs(sep: str) -> str:
    return (f"'src=' || src_ip || {sep} || 'dst=' || dst_ip || {sep} || 'srcPort=' || {s('src_port')} || {sep} || 'dstPort=' || {s('dst_port')}"
            f" || {sep} || 'proto=TCP' || {sep} || 'usrName=' || user_name || coalesce({sep} || 'identSrc=' || hostname, '')"
            f" || {sep} || 'sev=' || {_LEEF_SEV} || {sep} || 'cat=' || {_CAT} || {sep} || 'devTime=' || iso || {sep} || 'policy= p' || {s('k')} || ' '"
            f" || {sep} || 'msg=' || message")


RAW = f"""CASE fmt
 WHEN 0 THEN '<13>Jan 15 10:30:45 relay CEF:0|Acme|' || product || '|6.0|' || etype || ':' || {s('event_id % 7')} || '|Event seen|' || {_CEF_SEV}
   || '|src=' || src_ip || ' dst=' || dst_ip || ' spt=' || {s('src_port')} || ' dpt=' || {s('dst_port')} || ' proto=TCP out=' || {s('bytes_out')}
   || coalesce(' shost=' || hostname, '') || ' suser=' || user_name || coalesce(' sproc=' || process_name, '')
   || ' spid=' || {s('event_id % 5000')} || ' cat=' || {_CAT} || ' rt=' || {s('epoch_ms')} || ' cs1=free text here  k=1 k=' || {s('k')} || ' msg=' || message
 WHEN 1 THEN CASE WHEN event_id % 2 = 0
   THEN 'LEEF:2.0|Initech|' || product || '|7.2|' || etype || '|^|' || {_sep_attrs("'^'")}
   ELSE 'LEEF:1.0|Initech|' || product || '|7.2|' || etype || '|' || {_sep_attrs("tab")} END
 WHEN 2 THEN '{{"timestamp":"' || iso || '","src_ip":"' || src_ip || '","dst_ip":"' || dst_ip || '","src_port":' || {s('src_port')}
   || ',"dst_port":"' || {s('dst_port')} || '","protocol":"TCP","bytes_out":' || {s('bytes_out')} || ',"host":' || coalesce('"' || hostname || '"', 'null')
   || ',"user":"' || user_name || '","type":"' || etype || '","severity":' || {_JSON_SEV} || ',"category":"' || {_CAT}
   || '","cmdline":' || coalesce('"' || process_cmdline || '"', 'null') || ',"k":' || {s('k')} || ',"ok":true,"none":null,"pid":' || {s('event_id % 5000')}
   || ',"message":"' || message || '"}}'
 WHEN 3 THEN '<' || {_PRI} || '>1 ' || iso || ' ' || {_HOST} || ' ' || {_APP} || ' ' || {s('event_id % 5000')} || ' - - ' || message
 WHEN 4 THEN '<' || {_PRI} || '>' || bsd || ' ' || {_HOST} || ' ' || coalesce(process_name, 'cron') || '[' || {s('event_id % 5000')} || ']: ' || message
 ELSE 'CEF:0|broken|line ' || {s('event_id')} END"""

ASSET_COLUMNS = [
    ("tenant_id", f"'tenant-' || {s('s_nationkey % 3')}"),
    ("hostname", f"'HOST-' || {s('s_suppkey % 30')}"),
    ("asset_id", f"'asset-' || {s('s_suppkey')}"),
    ("criticality", "CASE s_nationkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'unknown' END"),
    ("os_name", "CASE s_nationkey % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' ELSE 'macos' END"),
    ("agent_active", "s_nationkey % 4 <> 0"),
    ("tag_text", "CASE WHEN s_suppkey % 2 = 0 THEN 'db,prod' ELSE 'web' END"),
    ("seen_order", "s_suppkey"),
]

ALERT_COLUMNS = [
    ("alert_id", "o_orderkey"),
    ("tenant_id", f"'tenant-' || {s('o_custkey % 3')}"),
    ("rule_id", f"'rule-' || {s('o_custkey % 25')}"),
    ("hostname", f"'host-' || {s('o_custkey % 40')}"),
    ("created_at", "o_orderdate"),
    ("status", "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'false_positive' ELSE 'resolved' END END"),
    ("severity", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END"),
    ("risk_score", "CAST(o_orderkey % 101 AS INT)"),
    ("tactic", "CASE o_custkey % 6 WHEN 0 THEN 'Execution' WHEN 1 THEN 'Persistence' WHEN 2 THEN 'Exfiltration' WHEN 3 THEN 'Discovery' WHEN 4 THEN 'Lateral Movement' ELSE NULL END"),
    ("technique", f"CASE WHEN o_custkey % 6 = 5 THEN NULL ELSE 'T' || {s('1000 + o_custkey % 12')} END"),
    ("case_id", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 ELSE NULL END"),
    ("detect_min", "o_orderkey % 25"),
    ("ack_min", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey % 45 END"),
    ("resolve_min", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 400 ELSE NULL END"),
]
