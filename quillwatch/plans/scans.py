"""Sources and sinks."""

from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.operators import filters as flt
from quillwatch.operators import ioc
from quillwatch.plans import views as v
from quillwatch.plans.registry import query
from quillwatch.sources import archive, events, intake, rule_files
from quillwatch.sources.event_store import EventStore
from quillwatch.sources.shared import new_folder
from quillwatch.sources.tables import spread, table

txt = lambda x: (c(x) if isinstance(x, str) else x).cast("string")


@query("src_raw_lines", """SELECT event_id, CASE WHEN event_id % 37 = 0 THEN '' ELSE raw END AS raw, CASE WHEN event_id % 37 = 0 THEN 'empty' END AS reject_reason FROM sec_events""")
def _(spark, d):
    e = v.sec_events(spark, d).select("event_id", F.when(c("event_id") % 37 == 0, "\r\n").otherwise(F.concat("raw", F.lit("\r\n"))).alias("value"))
    return intake.raw_lines(e).select("event_id", "raw", "reject_reason")


@query("src_text_files", """SELECT CASE WHEN event_id % 37 = 0 THEN '' WHEN event_id % 41 = 0 THEN chr(65533) || raw ELSE raw END AS raw,
 CASE WHEN event_id % 37 = 0 THEN 'empty' WHEN event_id % 41 = 0 THEN 'not utf-8' END AS reject_reason, count(*) AS n FROM sec_events GROUP BY 1, 2""")
def _(spark, d):
    """The lines as text files with CRLF ends, some empty, some with a byte that is no text; read back as a source."""
    broken = F.concat(F.unhex(F.lit("FF")), c("raw").cast("binary")).cast("string")
    body = F.when(c("event_id") % 37 == 0, "").when(c("event_id") % 41 == 0, broken).otherwise(c("raw"))
    path = new_folder(spark, "lines")
    v.sec_events(spark, d).select(F.concat(body, F.lit("\r")).alias("value")).write.mode("append").text(path)
    return intake.text_lines(spark.read, path).groupBy("raw", "reject_reason").agg(F.count("*").alias("n"))


@query("src_json_intake", """SELECT user_id % 3 AS auth, count(*) FILTER (event_id % 19 <> 0 AND event_id % 23 <> 0) AS n_accepted, count(*) FILTER (event_id % 29 <> 1 AND (event_id % 19 = 0 OR event_id % 23 = 0)) AS n_rejected,
 count(DISTINCT event_id) FILTER (event_id % 23 <> 0) AS fresh_ids FROM events WHERE event_id % 29 <> 1 GROUP BY 1""")
def _(spark, d):
    e = v.sec_events(spark, d)
    body = F.concat(F.lit("["), F.to_json(F.struct(F.lit("someone-else").alias("tenant_id"), F.when(c("event_id") % 19 != 0, c("event_type")).alias("event_type"), c("iso").alias("ts"), c("hostname"))), F.lit("]"))
    # Some bodies hold no item, some are cut off.
    body = F.when(c("event_id") % 29 == 1, "[]").when(c("event_id") % 23 == 0, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body)
    bodies = e.select(c("event_id").alias("batch_id"), (c("user_id") % 3).alias("auth"), body.alias("body"))
    rows = intake.json_arrays(bodies, "tenant_id string, event_type string, ts string, hostname string", F.concat(F.lit("tenant-"), txt("auth")))
    return intake.acceptance(rows.withColumn("auth", F.substring("tenant_id", 8, 9).cast("bigint")), "auth").join(
        rows.groupBy(F.substring("tenant_id", 8, 9).cast("bigint").alias("auth")).agg(F.countDistinct(F.when(c("pos").isNotNull(), c("event_id"))).alias("fresh_ids")), "auth")


@query("src_agent_events", """SELECT event_id, date_trunc('second', ts) AS ts, event_type, event_category,
 CASE event_type WHEN 'process_create' THEN 'execve' WHEN 'network_connect' THEN 'connect' ELSE CASE WHEN event_id % 4 IN (1, 2, 3) THEN 'write' ELSE 'read' END END AS event_action,
 CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type = 'process_create' AND event_id % 3 <> 0 THEN user_name END AS user_name, coalesce(process_name, 'sh') AS process_name,
 CASE WHEN event_type = 'process_create' THEN 'run --id ' || event_id END AS process_cmdline, CASE WHEN event_type = 'network_connect' THEN CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'unknown' END END AS protocol,
 CASE WHEN event_type = 'file_access' THEN 'f' || k || '.txt' END AS file_name, CASE WHEN event_type = 'file_access' THEN CASE WHEN event_id % 4 = 0 THEN 'read' ELSE 'write' END END AS file_action
 FROM sec_events WHERE event_type IN ('process_create', 'network_connect', 'file_access')""")
def _(spark, d):
    boot = 1_700_000_000_000_000_000
    e = v.sec_events(spark, d).filter(c("event_type").isin("process_create", "network_connect", "file_access"))
    rec = e.select("event_id", F.when(c("event_type") == "process_create", "process").when(c("event_type") == "network_connect", "network").otherwise("file").alias("kind"),
                   (F.unix_seconds(c("ts").cast("timestamp")) * 1_000_000_000 - boot).alias("ktime_ns"), c("user_id").alias("uid"), F.coalesce("process_name", F.lit("sh")).alias("comm"),
                   F.array(F.lit("run"), F.lit(""), F.lit("--id"), txt("event_id")).alias("argv"), F.lit("/bin/run").alias("exe_path"),
                   F.when(c("event_id") % 3 == 0, "").otherwise(c("user_name")).alias("username"), F.when(c("event_id") % 3 == 0, 6).when(c("event_id") % 3 == 1, 17).otherwise(1).alias("proto"),
                   F.concat(F.lit("/data/u/f"), txt("k"), F.lit(".txt")).alias("path"), (c("event_id") % 4).cast("int").alias("flags"))
    return intake.endpoint_events(rec, boot).select("event_id", "ts", "event_type", "event_category", "event_action", "user_id", "user_name", "process_name", "process_cmdline", "protocol", "file_name", "file_action")


@query("src_event_batches", """SELECT agent_id, sequence, count(*) FILTER (a.k IS NOT NULL) AS n_accepted, count(*) FILTER (a.k IS NULL) AS n_rejected FROM agent_batches
 LEFT JOIN (SELECT DISTINCT s_suppkey % 40 AS k FROM supplier WHERE s_suppkey % 40 < 35) a ON a.k = agent_id GROUP BY agent_id, sequence""")
def _(spark, d):
    reg = table(spark, d, "supplier").select((c("s_suppkey") % 40).alias("agent_id")).filter("agent_id < 35")
    return intake.acceptance(intake.split_known(v.agent_batches(spark, d), reg), "agent_id", "sequence")


@query("sink_dead_letter", "SELECT raw, 'raw' AS source_topic, 'short header' AS reason, 3 AS retries, event_id AS original_id FROM sec_events WHERE fmt = 9 AND source_type <> 'linux_ebpf'")
def _(spark, d):
    return intake.dead_letters(v.normalized(spark, d), "raw").select("raw", "headers.*")


@query("scan_events", "SELECT event_id, tenant_id, ts, source_type, event_type, hostname, user_name, src_ip, dst_ip, severity, raw FROM sec_events WHERE tenant_id = 'tenant-2'")
def _(spark, d):
    return flt.for_tenant(v.sec_events(spark, d), "tenant-2").select("event_id", "tenant_id", "ts", "source_type", "event_type", "hostname", "user_name", "src_ip", "dst_ip", "severity", "raw")


COLD = ["event_id", "tenant_id", "ts", "event_type", "severity"]


@query("sink_events", """SELECT 'stored' AS outcome, tenant_id, count(*) AS n FROM sec_events WHERE tenant_id = 'tenant-0' GROUP BY tenant_id
 UNION ALL SELECT 'refused', 'tenant-1', count(*) FILTER (tenant_id <> 'tenant-1') FROM sec_events WHERE tenant_id <> 'tenant-0'""")
def _(spark, d):
    e = v.sec_events(spark, d).select(COLD)
    store = EventStore(spark, new_folder(spark, "store"), e.schema)
    store.append(flt.for_tenant(e, "tenant-0"), "tenant-0")
    try:
        store.append(e.filter("tenant_id <> 'tenant-0'"), "tenant-1")
        refused = "none"
    except PermissionError as problem:
        refused = str(problem)
    stored = store.read().groupBy("tenant_id").agg(F.count("*").alias("n")).select(F.lit("stored").alias("outcome"), "tenant_id", "n")
    said = spark.range(1).select(F.lit("refused").alias("outcome"), F.lit("tenant-1").alias("tenant_id"), F.regexp_extract(F.lit(refused), r"holds (\d+) rows", 1).try_cast("bigint").alias("n"))
    return stored.unionByName(said)




def _archived(spark, d):
    e = v.sec_events(spark, d).select(COLD)
    path = new_folder(spark, "archive")
    archive.archive(e, path, v.NOW, 10)
    return e, path


@query("sink_archive_parquet", """SELECT CASE WHEN ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY THEN 'cold' ELSE 'hot' END AS tier, tenant_id, CAST(ts AS DATE) AS day, count(*) AS n FROM sec_events GROUP BY ALL""")
def _(spark, d):
    e = v.sec_events(spark, d).select(COLD)
    store = EventStore(spark, new_folder(spark, "store"), e.schema)
    store.append(e)
    store.move_expired(v.NOW, 10)
    store.move_expired(v.NOW, 10)  # a rerun finds nothing to move
    tier = lambda x: store.read(tier=x).groupBy("tenant_id", c("event_day").alias("day")).agg(F.count("*").alias("n")).select(F.lit(x).alias("tier"), "tenant_id", "day", "n")
    return tier("hot").unionByName(tier("cold"))


@query("src_archive_replay", "SELECT event_id, tenant_id, ts, event_type, severity FROM sec_events WHERE ts >= '2024-01-12'")
def _(spark, d):
    e, path = _archived(spark, d)
    return archive.replay(spark, path, e.schema, archive.still_hot(e, v.NOW, 10), start="2024-01-12")


@query("set_hot_cold", "SELECT tenant_id, count(*) AS n, count(DISTINCT event_id) AS ids FROM sec_events GROUP BY 1")
def _(spark, d):
    e, path = _archived(spark, d)
    return archive.replay(spark, path, e.schema, archive.still_hot(e, v.NOW, 10)).groupBy("tenant_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("src_feed_text", """SELECT value, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS value FROM documents) WHERE value <> '' AND value NOT LIKE '#%' GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return ioc.text_feed_rows(lines, "domain", "feed").groupBy("value").agg(F.count("*").alias("n"))


@query("src_feed_csv", "SELECT page_id, url AS value FROM pages WHERE page_id % 20 <> 3 AND page_id <> 0")
def _(spark, d):
    p = c("page_id")
    line = F.when(p == 0, "id,date,url,tags").when(p % 20 == 3, F.concat(F.lit("# "), c("url"))).otherwise(F.concat(txt("page_id"), F.lit(',2024-01-01, "'), c("url"), F.lit('",a,b,c')))
    lines = table(spark, d, "pages").select("page_id", line.alias("value"))
    return ioc.csv_feed_rows(lines, "url", "feed", 2, header="id,date,url,tags", keep=["page_id"]).select("page_id", "value")


@query("src_feed_misp", """SELECT value, severity, count(*) AS n FROM (SELECT c_name AS value, c_mktsegment AS severity FROM customer UNION ALL SELECT 'x' || c_custkey, NULL FROM customer) GROUP BY ALL""")
def _(spark, d):
    items = F.array(F.struct(F.concat(F.lit(" "), c("c_name")).alias("value"), c("c_mktsegment").alias("category")), F.struct(F.concat(F.lit("x"), txt("c_custkey")).alias("value"), F.lit(None).cast("string").alias("category")),
                    F.struct(F.lit("  ").alias("value"), F.lit("none").alias("category")))
    bodies = table(spark, d, "customer").select(F.when(c("c_custkey") % 2 == 0, F.to_json(F.struct(items.alias("Attribute")))).otherwise(F.to_json(items)).alias("body"))
    return ioc.misp_feed_rows(bodies, "domain", "feed").groupBy("value", "severity").agg(F.count("*").alias("n"))


@query("src_feed_abusech", """SELECT CASE c_custkey % 3 WHEN 0 THEN 'hash' WHEN 1 THEN 'url' ELSE 'ip' END || c_custkey AS value, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'tagged' END AS severity FROM customer""")
def _(spark, d):
    k = c("c_custkey")
    f = lambda m, name, alias: F.when(k % 3 == m, F.concat(F.lit(name), txt("c_custkey"))).alias(alias)
    item = F.struct(f(0, "hash", "sha256_hash"), f(1, "url", "url"), f(2, "ip", "ip_address"), F.when(k % 2 == 0, c("c_mktsegment")).alias("threat_type"), F.lit("tagged").alias("tags"))
    bodies = table(spark, d, "customer").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("body"))
    return ioc.json_feed_rows(bodies, "sha256", "feed").select("value", "severity")


def _rule_folder(spark, d):
    """Rule files written from ``part``: several documents per file, some broken, in nested folders."""
    p = table(spark, d, "part")
    k = c("p_partkey")
    doc = F.when(k % 31 == 0, "title: [unclosed").otherwise(F.concat(
        F.lit("title: "), c("p_name"), F.lit("\nid: rule-"), txt("p_partkey"), F.when(k % 3 == 0, "\nstatus: stable").otherwise(""), F.when(k % 4 == 0, "\nlevel: high").otherwise(""),
        F.lit("\ntags:\n  - attack.t"), txt(1000 + c("p_size")), F.lit("\ndetection:\n  sel:\n    k: 1\n  condition: sel")))
    path = new_folder(spark, "rules")
    p.select("p_brand", F.concat(doc, F.lit("\n---")).alias("value")).write.partitionBy("p_brand").text(path)
    return path


@query("src_rules_dir", "SELECT 'p_brand=' || p_brand AS folder, true AS has_content FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, d):
    f = rule_files.rule_files(spark, _rule_folder(spark, d), "*.txt")
    folder = F.url_decode(F.element_at(F.split("path", "/"), -2))
    return f.groupBy(folder.alias("folder")).agg((F.sum("length") > 0).alias("has_content"))


@query("rule_catalog", """SELECT CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 31 = 0 THEN 'none' ELSE 'rule-' || p_partkey END AS rule_id,
 CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 3 = 0 THEN 'stable' ELSE 'experimental' END AS status, CASE WHEN p_partkey % 31 <> 0 AND p_partkey % 4 = 0 THEN 'high' ELSE 'info' END AS level,
 CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE 'T' || (1000 + p_size) END AS technique, p_partkey % 31 = 0 AS failed FROM part""")
def _(spark, d):
    from quillwatch.functions import mitre
    f = rule_files.rule_files(spark, _rule_folder(spark, d), "*.txt").withColumn("text", F.concat(c("content").cast("string"), F.lit("\n")))
    docs = rule_files.documents(f, c("text"), "path").filter(c("doc") != "---").withColumn("doc", F.regexp_replace("doc", "\n---$", ""))
    cat = rule_files.catalog(docs, "path", "idx")
    out = rule_files.with_rule_defaults(cat, F.concat("path", txt("idx")))
    tag = F.try_element_at(mitre.parse_tags("tags"), F.lit(1))["technique_id"]
    return out.select("title", F.when(c("error").isNull(), c("rule_id")).otherwise("none").alias("rule_id"), "status", "level", tag.alias("technique"), c("error").isNotNull().alias("failed"))


@query("src_rules_import", """SELECT p_partkey, idx, CASE idx WHEN 0 THEN p_name WHEN 1 THEN 'Unnamed Rule' END AS title, CASE idx WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS level, idx = 2 AS failed
 FROM part CROSS JOIN (VALUES (0), (1), (2)) t(idx)""")
def _(spark, d):
    body = F.concat(F.lit("title: "), c("p_name"), F.lit("\nlevel: high\n---\ndescription: untitled\n---\nbad: [unclosed\n---\n   \n"))
    docs = rule_files.documents(spread(table(spark, d, "part").select("p_partkey", "p_name")), body, "p_partkey")
    cat = rule_files.with_import_defaults(rule_files.catalog(docs, "p_partkey", "idx"))
    ok = c("error").isNull()
    return cat.select("p_partkey", "idx", F.when(ok, c("title")).alias("title"), F.when(ok, c("level")).alias("level"), (~ok).alias("failed"))


_LANES = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


def _digest_sql(kind, ts, line, rows):
    return f"""SELECT '{kind}' AS kind, day, n, sha256(n || ':' || total) AS digest FROM (SELECT CAST({ts} AS DATE) AS day, count(*) AS n, {_LANES} AS total
 FROM (SELECT {ts}, sha256({line}) AS h FROM {rows}) GROUP BY 1)"""


@query("sink_evidence_export", " UNION ALL ".join([
    _digest_sql("audit", "ts", """'{"event_id":' || event_id || ',"actor_id":"' || actor_id || '","action":"' || action || '"}'""", "audit_log"),
    _digest_sql("events", "ts", """'{"event_id":' || event_id || ',"tenant_id":"' || tenant_id || '","event_type":"' || event_type || '","src_ip":"' || src_ip || '"}'""", "sec_events"),
    _digest_sql("alerts", "month", """'{"alert_id":' || alert_id || ',"tenant_id":"' || tenant_id || '","severity":"' || severity || '","status":"' || status || '"}'""", "(SELECT *, date_trunc('month', created_at) AS month FROM alerts_life)")]))
def _(spark, d):
    """The package: audit rows, events by day and alerts by month as JSON lines, and the manifest read from what was written."""
    e = v.sec_events(spark, d)
    parts = {"audit": e.select("event_id", c("user_name").alias("actor_id"), c("event_type").alias("action"), F.to_date("ts").alias("day")),
             "events": e.select("event_id", "tenant_id", "event_type", "src_ip", F.to_date("ts").alias("day")),
             "alerts": v.alerts_life(spark, d).select("alert_id", "tenant_id", "severity", "status", F.trunc("created_at", "month").alias("day"))}
    return archive.evidence_package(spark, parts, new_folder(spark, "evidence"))


@query("scan_tail", "SELECT event_id, ts FROM sec_events WHERE ts > '2024-01-20 12:00:00' ORDER BY ts, event_id LIMIT 100")
def _(spark, d):
    return flt.newer_than(v.sec_events(spark, d), "2024-01-20 12:00:00").select("event_id", "ts")
