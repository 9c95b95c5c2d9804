"""Log normalisation: the lines are built from known columns, so parsing must give those back."""

from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.operators import normalize as nz
from quillwatch.plans import views as v
from quillwatch.plans.registry import query
from quillwatch.schema import DEFAULTS, ENUMS

txt = lambda x: (c(x) if isinstance(x, str) else x).cast("string")
SAN = "lower(replace(replace(product, ' ', '_'), '-', '_'))"
MS_TS = "make_timestamp(epoch_ms * 1000)"
SEC_TS = "date_trunc('second', ts)"
SEV_CEF = "CASE sev_rank WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"
FMT = "CASE WHEN source_type = 'linux_ebpf' THEN 'agent' WHEN fmt IN (0, 9) THEN 'cef' WHEN fmt = 1 THEN 'leef' WHEN fmt = 2 THEN 'json' ELSE 'collector_parsed' END"


def lines(spark, d, *fmts):
    return v.sec_events(spark, d).filter(c("fmt").isin(*fmts)).select("event_id", "tenant_id", "source_type", "raw", "ts_received")


def joined_keys(m):
    return F.array_join(F.array_sort(F.map_keys(m)), ",")


@query("norm_detect_format", f"SELECT event_id, {FMT} AS format FROM sec_events")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", nz.detect_format().alias("format"))


@query("norm_cef_header", """SELECT event_id, 'CEF:0' AS version, 'Acme' AS vendor, product, '6.0' AS device_version, event_type || ':' || (event_id % 7) AS class_id, 'Event seen' AS name,
 CASE sev_rank WHEN 0 THEN 'Unknown' WHEN 1 THEN '2' WHEN 2 THEN 'medium' WHEN 3 THEN '7' ELSE '10' END AS cef_severity FROM sec_events WHERE fmt = 0""")
def _(spark, d):
    p = lines(spark, d, 0, 9).select("event_id", nz.cef_parts("raw").alias("p")).filter(F.size("p") >= 7)
    return p.select("event_id", *[x.alias(n) for n, x in nz.cef_header("p").items()])


@query("norm_cef_extension", """SELECT event_id, src_ip AS src, 'free text here' AS cs1, CAST(k AS VARCHAR) AS k, message AS msg, coalesce(hostname, '-') AS shost, 'TCP' AS proto FROM sec_events WHERE fmt = 0""")
def _(spark, d):
    x = lines(spark, d, 0).select("event_id", nz.cef_extension(F.element_at(nz.cef_parts("raw"), 8)).alias("x"))
    at = lambda n: F.try_element_at("x", F.lit(n))
    return x.select("event_id", *[at(n).alias(n) for n in ("src", "cs1", "k", "msg", "proto")], F.coalesce(at("shost"), F.lit("-")).alias("shost"))


@query("norm_cef_map", f"""SELECT event_id, src_ip, dst_ip, src_port, dst_port, 'tcp' AS protocol, bytes_out, hostname, user_name, process_name, event_id % 5000 AS process_pid, {MS_TS} AS event_ts,
 'cef_class_id,cef_name,cef_product,cef_vendor,cs1,k,message' AS field_names FROM sec_events WHERE fmt = 0""")
def _(spark, d):
    return nz.cef_columns(lines(spark, d, 0), v.NOW).select("event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out", "hostname", "user_name", "process_name", "process_pid", "event_ts", joined_keys("fields").alias("field_names"))


@query("norm_cef_event_type", f"SELECT event_id, {SAN} || '_' || event_type || '_' || (event_id % 7) AS event_type FROM sec_events WHERE fmt = 0")
def _(spark, d):
    return nz.cef_columns(lines(spark, d, 0), v.NOW).select("event_id", "event_type")


@query("norm_cef_severity", f"SELECT event_id, {SEV_CEF} AS severity FROM sec_events WHERE fmt = 0")
def _(spark, d):
    return nz.cef_columns(lines(spark, d, 0), v.NOW).select("event_id", "severity")




def _cat_text(col, words):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (c(col) % len(words) + 1).cast("int"))


CAT_WORDS = ["auth failure", "LOGON ok", "netFLOW", "disk io", "Exec", "user_mgmt x", "AWS trail", "misc", "fs event"]
CAT_SQL = "SELECT event_id, (['{0}'])[event_id % 9 + 1] AS category FROM sec_events"


def _cat_query(name, fn, expected):
    @query(name, CAT_SQL.format("','".join(expected)))
    def run(spark, d):
        return v.sec_events(spark, d).select("event_id", fn(_cat_text("event_id", CAT_WORDS)).alias("category"))


_cat_query("norm_cef_category", nz.cef_category, ["authentication", "authentication", "network", "file", "process", "account", "other", "other", "other"])
_cat_query("norm_leef_category", nz.leef_category, ["authentication", "other", "other", "other", "other", "other", "other", "other", "other"])
_cat_query("norm_json_category", nz.json_category, ["authentication", "authentication", "other", "other", "process", "account", "cloud", "other", "file"])


@query("norm_leef_header", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2.0' ELSE '1.0' END AS version, 'Initech' AS vendor, product AS product_name, event_type AS leef_event_id FROM sec_events WHERE fmt = 1")
def _(spark, d):
    return nz.leef_columns(lines(spark, d, 1), v.NOW).select("event_id", "version", "vendor", "product_name", "leef_event_id")


@query("norm_leef2_delimiter", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '^' ELSE chr(9) END AS delimiter, CASE event_id % 4 WHEN 0 THEN ';' WHEN 1 THEN chr(9) WHEN 2 THEN '#' ELSE chr(9) END AS other FROM sec_events WHERE fmt = 1")
def _(spark, d):
    other = F.element_at(F.array(F.lit("x3B|a=1"), F.lit("|a=1"), F.lit("#|a=1"), F.lit("xZZ|a=1")), (c("event_id") % 4 + 1).cast("int"))
    return nz.leef_columns(lines(spark, d, 1), v.NOW).select("event_id", "delimiter", nz.leef_delimiter(F.lit("2.0"), other).alias("other"))


@query("norm_leef_attributes", "SELECT event_id, src_ip AS src, 'p' || k AS policy, message AS msg, 11 + CASE WHEN hostname IS NULL THEN 0 ELSE 1 END AS n FROM sec_events WHERE fmt = 1")
def _(spark, d):
    p = lines(spark, d, 1).select("event_id", nz.leef_parts("raw").alias("p"))
    ver, attrs = F.regexp_replace(F.element_at("p", 1), "^LEEF:", ""), F.element_at("p", 6)
    x = p.select("event_id", nz.leef_attributes(nz.leef_body(ver, attrs), nz.leef_delimiter(ver, attrs)).alias("x"))
    at = lambda n: F.try_element_at("x", F.lit(n)).alias(n)
    return x.select("event_id", at("src"), at("policy"), at("msg"), F.size("x").alias("n"))


@query("norm_leef_map", f"""SELECT event_id, src_ip, dst_ip, src_port, dst_port, 'tcp' AS protocol, hostname, user_name, {SAN} || '_leef_' || event_type AS event_type, {SEC_TS} AS event_ts, event_category,
 'leef_event_id,leef_product,leef_vendor,message,policy' AS field_names FROM sec_events WHERE fmt = 1""")
def _(spark, d):
    return nz.leef_columns(lines(spark, d, 1), v.NOW).select("event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "hostname", "user_name", "event_type", "event_ts", "event_category", joined_keys("fields").alias("field_names"))


@query("norm_leef_severity", "SELECT event_id, CASE sev_rank WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM sec_events WHERE fmt = 1")
def _(spark, d):
    return nz.leef_columns(lines(spark, d, 1), v.NOW).select("event_id", "severity")


@query("norm_json_map", f"""SELECT event_id, src_ip, dst_ip, src_port, dst_port, 'tcp' AS protocol, bytes_out, hostname, user_name, event_type, process_cmdline, event_id % 5000 AS process_pid, {SEC_TS} AS event_ts,
 'k,message,none,ok' AS field_names, CAST(k AS VARCHAR) || ',' || 'true' || ',' AS field_values FROM sec_events WHERE fmt = 2""")
def _(spark, d):
    j = nz.json_columns(lines(spark, d, 2), v.NOW)
    at = lambda n: c("fields")[n]
    return j.select("event_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out", "hostname", "user_name", "event_type", "process_cmdline", "process_pid", "event_ts",
                    joined_keys("fields").alias("field_names"), F.concat_ws(",", at("k"), at("ok"), at("none")).alias("field_values"))


@query("norm_json_severity", "SELECT event_id, CASE sev_rank WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM sec_events WHERE fmt = 2")
def _(spark, d):
    return nz.json_columns(lines(spark, d, 2), v.NOW).select("event_id", "severity")


@query("norm_alias_order", f"""SELECT event_id, CASE fmt WHEN 0 THEN '10.9.9.9' WHEN 2 THEN src_ip END AS src_ip, CASE WHEN fmt <> 0 THEN src_port END AS src_port,
 CASE WHEN fmt = 2 THEN 'first' ELSE user_name END AS user_name, CASE WHEN fmt = 2 THEN 3 WHEN fmt = 0 THEN event_id % 5000 END AS process_pid,
 CASE WHEN fmt = 0 THEN {MS_TS} ELSE {SEC_TS} END AS event_ts, CASE WHEN fmt = 0 THEN 'second' END AS second_user, CASE WHEN fmt = 0 THEN 'Other' END AS vendor
 FROM sec_events WHERE fmt IN (0, 1, 2)""")
def _(spark, d):
    """Lines in which a second alias of a field follows, some with values that cannot be read."""
    e = v.sec_events(spark, d).filter(c("fmt").isin(0, 1, 2))
    more = {0: F.concat("raw", F.lit(" sourceAddress=10.9.9.9 end=soon destinationUserName=second spt=http cef_vendor=Other")),
            1: F.concat("raw", F.translate(F.lit("~identUsername=second~eventTime=soon~src=bad"), "~", "\t")),
            2: F.concat(F.expr("left(raw, length(raw) - 1)"), F.lit(',"src":"10.9.9.9","actor":"first","ts":"soon","process_pid":4294967299,"process_cmdline":5}'))}
    more[1] = F.when(c("event_id") % 2 == 0, F.translate(more[1], "\t", "^")).otherwise(more[1])
    ask = ["event_id", "tenant_id", "source_type", "raw", "ts_received"]
    builds = {0: nz.cef_columns, 1: nz.leef_columns, 2: nz.json_columns}

    def columns(fmt):
        out = builds[fmt](e.filter(c("fmt") == fmt).withColumn("raw", more[fmt]).select(*ask), v.NOW)
        pid = c("process_pid") if fmt != 1 else F.lit(None).cast("bigint")
        field = lambda n: F.try_element_at("fields", F.lit(n))
        return out.select("event_id", "src_ip", "src_port", "user_name", pid.alias("process_pid"), "event_ts",
                          F.coalesce(field("destinationUserName"), field("identUsername")).alias("second_user"), field("cef_vendor").alias("vendor"))
    return columns(0).unionByName(columns(1)).unionByName(columns(2))


SYS = "FROM sec_events WHERE fmt IN (3, 4)"


@query("norm_syslog_priority", f"SELECT event_id, 32 + CASE sev_rank WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE 2 END AS priority {SYS}")
def _(spark, d):
    return nz.syslog_columns(lines(spark, d, 3, 4)).select("event_id", "priority")


@query("norm_syslog_5424", f"SELECT event_id, hostname, process_name, message, {SEC_TS} AS event_ts FROM sec_events WHERE fmt = 3")
def _(spark, d):
    return nz.syslog_columns(lines(spark, d, 3)).select("event_id", "hostname", "process_name", "message", "event_ts")


@query("norm_syslog_3164", f"SELECT event_id, coalesce(hostname, '-') AS hostname, {SEC_TS} AS event_ts FROM sec_events WHERE fmt = 4")
def _(spark, d):
    return nz.syslog_columns(lines(spark, d, 4)).select("event_id", "hostname", "event_ts")


@query("norm_syslog_tag", "SELECT event_id, coalesce(process_name, 'cron') AS process_name, (event_id % 5000) || ']:' || message AS message FROM sec_events WHERE fmt = 4")
def _(spark, d):
    return nz.syslog_columns(lines(spark, d, 4)).select("event_id", "process_name", "message")


@query("norm_syslog_severity", f"SELECT event_id, severity {SYS}")
def _(spark, d):
    return nz.syslog_columns(lines(spark, d, 3, 4)).select("event_id", "severity")


STAMPS = [("strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30')", "date_trunc('second', ts) - INTERVAL 330 MINUTE", "yyyy-MM-dd'T'HH:mm:ss", "+05:30"),
          ("strftime(ts, '%a, %d %b %Y %H:%M:%S +0200')", "date_trunc('second', ts) - INTERVAL 2 HOUR", "EEE, dd MMM yyyy HH:mm:ss", " +0200"),
          ("strftime(ts, '%Y-%m-%d %H:%M:%S')", "date_trunc('second', ts)", "yyyy-MM-dd HH:mm:ss", ""),
          ("strftime(ts, '%Y%m%dT%H%M%S')", "date_trunc('second', ts)", "yyyyMMdd'T'HHmmss", ""),
          ("strftime(ts, '%b %d %Y %H:%M:%S')", "date_trunc('second', ts)", "MMM dd yyyy HH:mm:ss", ""),
          ("strftime(ts, '%d/%b/%Y:%H:%M:%S')", "date_trunc('second', ts)", "dd/MMM/yyyy:HH:mm:ss", ""),
          ("strftime(ts, '%m/%d/%Y %I:%M:%S %p')", "date_trunc('second', ts)", "MM/dd/yyyy hh:mm:ss a", ""),
          ("strftime(ts, '%m/%d/%Y %H:%M:%S')", "date_trunc('second', ts)", "MM/dd/yyyy HH:mm:ss", ""),
          ("strftime(ts, '%Y-%m-%d')", "CAST(CAST(ts AS DATE) AS TIMESTAMP)", "yyyy-MM-dd", ""),
          ("'garbage ' || event_id", "NULL", "'garbage'", ""),
          ("strftime(ts, '%b %d %H:%M:%S')", "date_trunc('second', ts)", "MMM dd HH:mm:ss", ""),
          ("strftime(ts, '%Y-%m-%d %H:%M:%S.%f')", "ts", "yyyy-MM-dd HH:mm:ss.SSSSSS", "")]


@query("norm_timestamp", "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN {s[1]}" for i, s in enumerate(STAMPS)) + " END AS parsed FROM sec_events")
def _(spark, d):
    text = F.array(*[F.concat(F.date_format("ts", s[2]), F.lit(s[3])) for s in STAMPS])
    e = v.sec_events(spark, d).select("event_id", F.element_at(text, (c("event_id") % 12 + 1).cast("int")).alias("text"))
    return e.select("event_id", nz.parse_timestamp("text", v.NOW).alias("parsed"))


@query("norm_epoch", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN make_timestamp(epoch_ms * 1000) WHEN 1 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) + INTERVAL 500 MILLISECOND END AS parsed FROM sec_events")
def _(spark, d):
    sec = F.floor(c("epoch_ms") / 1000)
    text = F.when(c("event_id") % 3 == 0, txt("epoch_ms")).when(c("event_id") % 3 == 1, F.concat(txt(sec), F.lit("Z"))).otherwise(F.concat(txt(sec), F.lit(".5")))
    return v.sec_events(spark, d).select("event_id", nz.epoch(text).alias("parsed"))


@query("norm_bsd_year", "SELECT event_id, CASE WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-15' + INTERVAL 24 HOUR THEN date_trunc('second', ts) - INTERVAL 365 DAY ELSE date_trunc('second', ts) END AS parsed FROM sec_events")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", nz.bsd(c("bsd"), "2024-01-15 00:00:00").alias("parsed"))


@query("norm_ingest_lag", "SELECT event_id, CAST(greatest(0, least(CAST(floor((epoch_us(ts_received) - epoch_us(ts)) / 1000) AS BIGINT) * CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END, 4294967295)) AS BIGINT) AS lag FROM sec_events")
def _(spark, d):
    e = v.sec_events(spark, d)
    swap = c("event_id") % 7 == 0
    return e.select("event_id", F.when(swap, nz.ingest_lag_ms("ts_received", "ts")).otherwise(nz.ingest_lag_ms()).alias("lag"))


FP_SQL = "md5(tenant_id || chr(0) || coalesce(hostname, '') || chr(0) || event_type || chr(0) || coalesce(src_ip, '') || chr(0) || coalesce(dst_ip, '') || chr(0) || coalesce(process_name, '') || chr(0) || raw)"


@query("norm_fingerprint", f"SELECT event_id, CASE WHEN octet_length(encode(raw)) <= 256 THEN {FP_SQL} ELSE {FP_SQL.replace('|| raw)', '|| raw[:256])')} END AS fp FROM sec_events")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", F.md5(nz.fingerprint_text()).alias("fp"))


@query("norm_dedup_events", """SELECT tenant_id, user_name, event_type, event_id, ts_received FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_name, event_type ORDER BY ts_received DESC, event_id DESC) AS rn FROM sec_events) WHERE rn = 1""")
def _(spark, d):
    e = v.sec_events(spark, d).select("tenant_id", "user_name", "event_type", "event_id", "ts_received")
    return nz.newest_per_key(e, ["tenant_id", "user_name", "event_type"])


@query("norm_defaults", """SELECT event_id, 'unknown' AS collector_id, coalesce(hostname, '') AS raw, 0 AS severity_score, 1 AS schema_version,
 CASE WHEN event_id % 6 = 0 THEN CASE WHEN event_id % 10 = 0 THEN 'missing source_type,event_type' ELSE 'missing event_type' END WHEN event_id % 10 = 0 THEN 'missing source_type' END AS reject_reason FROM sec_events""")
def _(spark, d):
    e = v.sec_events(spark, d)
    e = e.select("event_id", "tenant_id", "ts", F.when(c("event_id") % 6 != 0, c("event_type")).alias("event_type"), F.when(c("event_id") % 10 != 0, c("source_type")).alias("source_type"), c("hostname").alias("raw"))
    return nz.apply_defaults(e, DEFAULTS, ["tenant_id", "source_type", "event_type", "ts"]).select("event_id", "collector_id", "raw", "severity_score", "schema_version", "reject_reason")


@query("norm_enum_validate", """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'info' ELSE severity END AS severity, CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE asset_criticality END AS criticality FROM sec_events""")
def _(spark, d):
    e = v.sec_events(spark, d)
    odd = lambda n, x: F.when(c("event_id") % n == 0, "bogus").otherwise(F.upper(x))
    return e.select("event_id", nz.enum_or_default(odd(8, "severity"), *ENUMS["severity"]).alias("severity"), nz.enum_or_default(odd(9, "asset_criticality"), *ENUMS["asset_criticality"]).alias("criticality"))


# Stated here once more, so that the SQL does not read the engine's own lists.
_SETS = """severity=info,low,medium,high,critical;info
source_type=linux_ebpf,windows_etw,syslog,cloudtrail,azure_activity_log,gcp_audit_log,http_intake,ot_scada,network_flow,dhcp,dns,unknown;unknown
event_category=authentication,network,file,process,registry,account,cloud,other;
asset_criticality=critical,high,medium,low,unknown;unknown
user_type=human,service,system;
auth_result=success,failure,unknown;
direction=inbound,outbound,lateral;
file_action=read,write,create,delete,rename;
detection_source=sigma,onnx,ueba,ioc,threshold;sigma
status=open,acknowledged,in_progress,resolved,false_positive,suppressed;open"""
_SET_ROWS = [(line.split("=")[0], line.split("=")[1].split(";")[0].split(","), line.split(";")[1]) for line in _SETS.splitlines()]


def _set_sql(name, words, default):
    listed = ",".join(f"'{w}'" for w in words)
    return f"CASE WHEN event_id % {len(words) + 2} < {len(words)} THEN ([{listed}])[event_id % {len(words) + 2} + 1] ELSE {repr(default) if default else 'NULL'} END AS {name}"


@query("norm_enum_sets", "SELECT event_id, " + ", ".join(_set_sql(*x) for x in _SET_ROWS) + " FROM sec_events")
def _(spark, d):
    """Every word of the ten sets, an unknown word and NULL; odd rows in capitals."""
    def spelt(words):
        word = F.get(F.array(*[F.lit(w) for w in words], F.lit("bogus"), F.lit(None).cast("string")), (c("event_id") % (len(words) + 2)).cast("int"))
        return F.when(c("event_id") % 2 == 0, word).otherwise(F.upper(word))
    e = v.sec_events(spark, d).select("event_id", *[spelt(words).alias(n) for n, words, _ in _SET_ROWS])
    return nz.read_enums(e, ENUMS)


@query("norm_severity_pretriage", """SELECT event_id, CASE WHEN auth_result = 'failure' THEN 'medium' WHEN event_category IN ('authentication', 'process') THEN 'low' ELSE 'info' END AS severity FROM sec_events""")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", nz.pretriage_severity().alias("severity"))


@query("norm_pipeline", f"""SELECT event_id, CASE WHEN source_type = 'linux_ebpf' THEN 'agent' WHEN fmt IN (0, 9) THEN 'cef' WHEN fmt = 1 THEN 'leef' WHEN fmt = 2 THEN 'json' ELSE 'collector_parsed' END AS format,
 n.event_type, n.event_category, n.hostname, n.user_name, n.src_ip, n.dst_ip, n.src_port, n.dst_port, n.protocol, n.bytes_out, n.process_name, n.process_pid, n.process_cmdline, n.file_hash,
 CAST(n.k AS VARCHAR) AS k, n.f_url AS url, n.ts FROM norm_events n JOIN (SELECT event_id, fmt FROM sec_events) USING (event_id)""")
def _(spark, d):
    at = lambda x: F.try_element_at("fields", F.lit(x)).alias(x)
    return v.normalized(spark, d).select("event_id", "format", "event_type", "event_category", "hostname", "user_name", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_out",
                                         "process_name", "process_pid", "process_cmdline", "file_hash", at("k"), at("url"), "ts")
