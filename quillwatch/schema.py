"""The wide event schema. Readers always pass it; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _F, _B = T.StringType(), T.LongType(), T.IntegerType(), T.FloatType(), T.BooleanType()
_TS, _A, _M = T.TimestampType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())

_COLUMNS = [
    ("event_id", _S), ("tenant_id", _S), ("dedup_hash", _L),
    ("ts", _TS), ("ts_received", _TS), ("ingest_lag_ms", _L),
    ("source_type", _S), ("collector_id", _S), ("raw", _S),
    ("host_id", _S), ("hostname", _S), ("host_ip", _S), ("host_fqdn", _S),
    ("asset_criticality", _S), ("asset_tags", _A),
    ("user_name", _S), ("user_id", _S), ("user_domain", _S), ("user_type", _S),
    ("event_type", _S), ("event_category", _S), ("event_action", _S),
    ("src_ip", _S), ("src_ip6", _S), ("src_port", _I), ("dst_ip", _S), ("dst_ip6", _S), ("dst_port", _I),
    ("protocol", _S), ("bytes_in", _L), ("bytes_out", _L), ("packets_in", _L), ("packets_out", _L),
    ("direction", _S),
    ("process_name", _S), ("process_pid", _L), ("process_ppid", _L), ("process_path", _S),
    ("process_cmdline", _S), ("process_hash", _S), ("parent_process", _S),
    ("file_path", _S), ("file_name", _S), ("file_hash", _S), ("file_size", _L), ("file_action", _S),
    ("auth_result", _S), ("auth_method", _S), ("auth_protocol", _S),
    ("src_country", _S), ("src_city", _S), ("src_asn", _L), ("src_asn_name", _S), ("dst_country", _S),
    ("ioc_hit", _B), ("ioc_type", _S), ("ioc_value", _S), ("ioc_feed", _S),
    ("mitre_tactic", _S), ("mitre_technique", _S), ("mitre_sub_tech", _S),
    ("severity", _S), ("severity_score", _I),
    ("anomaly_score", _F), ("ueba_score", _F), ("beacon_score", _F), ("exfil_score", _F),
    ("fields", _M), ("schema_version", _I),
]

EVENT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in _COLUMNS])

# Columns that must be present, and defaults for the rest.
REQUIRED = ["tenant_id", "source_type", "event_type", "ts"]
DEFAULTS = {"collector_id": "unknown", "raw": "", "asset_criticality": "unknown", "severity": "info",
            "severity_score": 0, "dedup_hash": 0, "ioc_hit": False, "schema_version": 1}

# Closed word sets; unknown words fall back to the default.
ENUMS = {
    "severity": (["info", "low", "medium", "high", "critical"], "info"),
    "source_type": (["linux_ebpf", "windows_etw", "syslog", "cloudtrail", "azure_activity_log", "gcp_audit_log", "http_intake", "ot_scada", "network_flow", "dhcp", "dns", "unknown"], "unknown"),
    "event_category": (["authentication", "network", "file", "process", "registry", "account", "cloud", "other"], None),
    "asset_criticality": (["critical", "high", "medium", "low", "unknown"], "unknown"),
    "user_type": (["human", "service", "system"], None),
    "auth_result": (["success", "failure", "unknown"], None),
    "direction": (["inbound", "outbound", "lateral"], None),
    "file_action": (["read", "write", "create", "delete", "rename"], None),
    "detection_source": (["sigma", "onnx", "ueba", "ioc", "threshold"], "sigma"),
    "status": (["open", "acknowledged", "in_progress", "resolved", "false_positive", "suppressed"], "open"),
}
