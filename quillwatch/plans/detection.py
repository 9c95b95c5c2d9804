"""Rules, indicators, risk and alerts."""

from pyspark.sql import functions as F

from quillwatch.functions import mitre
from quillwatch.functions.scalars import c, severity_from_score
from quillwatch.operators import alerts, correlate, ioc, risk, rule_index, rules, split
from quillwatch.operators import filters as flt
from quillwatch.operators.analytics import side_by_side
from quillwatch.plans import views as v
from quillwatch.plans.registry import query
from quillwatch.plans.rule_set import BY_ID, RULES, SQL_PREDICATES
from quillwatch.plans.view_sql import SEV_OF
from quillwatch.sources import rule_files
from quillwatch.sources.shared import materialize, new_folder
from quillwatch.sources.tables import table

# ---- one query per rule feature: (detection, SQL predicate) ----------------
FEATURES = {
    "rule_exact": ({"sel": {"event_type": "Auth_FAILURE", "dst_port": "22"}, "bad": {"k": 7}, "condition": "sel and not bad"}, "event_type = 'auth_failure' AND dst_port = 22"),
    "rule_wildcard": ({"sel": {"CommandLine": ["*-ENC *7", "proc? --id ??"]}, "condition": "sel"},
                      "coalesce(regexp_full_match(lower(process_cmdline), '.*-enc .*7') OR regexp_full_match(process_cmdline, 'proc. --id ..'), false)"),
    "rule_null": ({"sel": {"ProcessName": None, "Image": None}, "condition": "sel"}, "process_name IS NULL"),
    "rule_contains": ({"sel": {"CommandLine|contains": ["SHELL", "c3 --"]}, "condition": "sel"}, "process_cmdline ILIKE '%shell%' OR process_cmdline LIKE '%c3 --%'"),
    "rule_contains_all": ({"sel": {"CommandLine|contains|all": ["proc", "--ID 1"]}, "condition": "sel"}, "process_cmdline LIKE '%proc%' AND process_cmdline LIKE '%--id 1%'"),
    "rule_all": (BY_ID["r12"]["detection"], SQL_PREDICATES["r12"]),
    "rule_startswith": ({"sel": {"User|startswith": "USER1"}, "condition": "sel"}, "user_name LIKE 'user1%'"),
    "rule_endswith": ({"sel": {"DestinationIp|endswith": [".7", ".19"]}, "condition": "sel"}, "dst_ip LIKE '%.7' OR dst_ip LIKE '%.19'"),
    "rule_regex": ({"sel": {"CommandLine|re": "id [0-9]+5$"}, "bad": {"User|re": "(unclosed"}, "up": {"User|re": "^USER"}, "condition": "sel or bad or up"},
                   "coalesce(regexp_matches(process_cmdline, 'id [0-9]+5$'), false)"),
    "rule_cidr": ({"sel": {"src_ip|cidr": ["10.2.0.0/15", "10.0.0.0/33", "nonsense/8"], "dst_ip|cidr": "198.51.100.0/28"}, "condition": "sel"},
                  "CAST(split_part(src_ip, '.', 2) AS INT) >= 2 AND dst_ip LIKE '198.51.100.%' AND CAST(split_part(dst_ip, '.', 4) AS INT) < 16"),
    "rule_numeric": ({"a": {"k|gte": 50, "k|lt": 60}, "b": {"src_port|gt": 8000, "dst_port|lte": 443}, "bad": {"k|gt": 1.5}, "condition": "a and b or bad"},
                     "k >= 50 AND k < 60 AND src_port > 8000 AND dst_port <= 443"),
    "rule_keywords": (BY_ID["r08"]["detection"], SQL_PREDICATES["r08"]),
    "rule_field_alias": ({"sel": {"Computer": "host-7", "k": ["1", "2", "3"]}, "un": {"NoSuchField": "x"}, "condition": "sel and not un"}, "hostname = 'host-7' AND k IN (1, 2, 3)"),
    "rule_group": (BY_ID["r10"]["detection"], SQL_PREDICATES["r10"]),
    "rule_condition": (BY_ID["r11"]["detection"], SQL_PREDICATES["r11"]),
    "rule_one_of": (BY_ID["r07"]["detection"], SQL_PREDICATES["r07"]),
    "rule_all_of": (BY_ID["r06"]["detection"], SQL_PREDICATES["r06"]),
}


def _feature(name, detection, predicate):
    @query(name, f"SELECT event_id, tenant_id, ts FROM sec_events WHERE {predicate}")
    def run(spark, d):
        rule = {"title": name, "id": name, "detection": detection}
        return rules.matching(v.sec_events(spark, d), rule).select("event_id", "tenant_id", "ts")


for _name, (_det, _pred) in FEATURES.items():
    _feature(_name, _det, _pred)


def _ids(matches="rule_matches"):
    return F.array_join(c(matches)["rule_id"], ",").alias("rule_ids")


@query("join_rule_match", "SELECT event_id, string_agg(rule_id, ',' ORDER BY pos) AS rule_ids FROM rule_hits GROUP BY event_id")
def _(spark, d):
    return rules.match_all(v.sec_events(spark, d), RULES).filter(F.size("rule_matches") > 0).select("event_id", _ids())


def _rule_folder(spark, d):
    """Rule files of three kinds, one document per row of ``part``; some cannot be read."""
    k = c("p_partkey")
    num = lambda x: x.cast("string")
    port = F.when(k % 3 == 0, "22").when(k % 3 == 1, "443").otherwise("8080")
    by_user = F.concat(F.lit("  sel:\n    User: USER"), num(k % 150), F.lit("\n  port:\n    DestinationPort:\n      - "), port, F.lit("\n  condition: sel and port"))
    by_host = F.concat(F.lit("  sel:\n    Computer: host-"), num(k % 40), F.lit("\n    CommandLine|contains: 'ID "), num(k % 10),
                       F.lit("'\n  skip:\n    event_type:\n      - file_access\n      - auth_*\n  condition: sel and not 1 of sk*"))
    by_text = F.concat(F.lit("  sel:\n    CommandLine|endswith: '"), num(k % 100), F.lit("'\n  num:\n    src_port|gte: 40000\n  condition: sel and not num"))
    body = F.when(k % 97 == 5, by_text).when(k % 2 == 0, by_user).otherwise(by_host)
    doc = F.when(k % 31 == 0, "title: [unclosed").otherwise(F.concat(F.lit("title: "), c("p_name"), F.lit("\nid: rule-"), num(k), F.lit("\nstatus: stable\ndetection:\n"), body))
    path = new_folder(spark, "rule-files")
    table(spark, d, "part").select((k % 20).alias("folder"), F.concat(doc, F.lit("\n---")).alias("value")).write.partitionBy("folder").text(path)
    return path


@query("join_rule_match_files", """SELECT event_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids FROM (SELECT e.event_id, 'rule-' || p_partkey AS rule_id FROM sec_events e JOIN part ON p_partkey % 31 <> 0 AND coalesce(
 CASE WHEN p_partkey % 97 = 5 THEN process_cmdline LIKE '%' || (p_partkey % 100) AND src_port < 40000
  WHEN p_partkey % 2 = 0 THEN user_name = 'user' || (p_partkey % 150) AND dst_port = CASE p_partkey % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 8080 END
  ELSE hostname = 'host-' || (p_partkey % 40) AND process_cmdline LIKE '%id ' || (p_partkey % 10) || '%' AND event_type <> 'file_access' AND event_type NOT LIKE 'auth%' END, false)) GROUP BY event_id""")
def _(spark, d):
    files = rule_files.rule_files(spark, _rule_folder(spark, d), "*.txt").withColumn("text", F.concat(c("content").cast("string"), F.lit("\n")))
    docs = rule_files.documents(files, c("text"), "path").withColumn("doc", F.regexp_replace("doc", "\n?---$", "")).filter("doc <> ''")
    cat = materialize(rule_files.catalog(docs, "path", "idx").filter("status = 'stable'"), "catalogue")
    e = v.sec_events(spark, d)
    index, numbered = rule_index.catalog_index(cat, e.columns)
    hits = materialize(rule_index.match_bodies(e, index).select("event_id", "_bodies"), "rule-hits")
    heads = cat.join(numbered, "detection").select("body", c("rule_id").alias("head"))
    return rule_index.with_heads(hits, heads, lambda held: F.array_join(held, ",")).select("event_id", c("_heads").alias("rule_ids"))


def _count_sql(width, by, cond, measure, test):
    return f"""SELECT tenant_id, {by}, ws AS window_start, ws + INTERVAL {width} AS window_end, n FROM (
 SELECT tenant_id, {by}, time_bucket(INTERVAL {width}, ts, TIMESTAMP '1970-01-01') AS ws, {measure} AS n FROM sec_events WHERE {cond} GROUP BY ALL) WHERE n {test}"""


@query("rule_count", _count_sql("6 HOUR", "hostname", "event_type = 'auth_failure'", "count(*)", "> 2"))
def _(spark, d):
    rule = {"title": "t", "id": "t", "detection": {"sel": {"event_type": "auth_failure"}, "timeframe": "6h", "condition": "sel | count() by Computer > 2"}}
    return rules.count_rule(v.sec_events(spark, d), rule)


@query("rule_threshold", _count_sql("12 HOUR", "user_name", "true", "CAST(sum(bytes_out) AS BIGINT)", ">= 12000000"))
def _(spark, d):
    return rules.threshold(v.sec_events(spark, d), ["tenant_id", "user_name"], F.sum("bytes_out"), ">=", 12000000, 12 * 3600)


@query("rule_velocity", _count_sql("1 MINUTE", "hostname", "true", "count(*)", "> 1"))
def _(spark, d):
    return rules.threshold(v.sec_events(spark, d), ["tenant_id", "hostname"], F.count("*"), ">", 1, 60)


SEQ_SQL = """SELECT b.event_id, b.hostname, max(a.ts) AS a_ts FROM sec_events b JOIN sec_events a ON a.hostname = b.hostname AND a.tenant_id = b.tenant_id
 AND a.event_type = '{0}' AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL {2} WHERE b.event_type = '{1}' GROUP BY ALL"""


@query("rule_near", SEQ_SQL.format("auth_failure", "auth_success", "30 MINUTE"))
def _(spark, d):
    rule = {"title": "t", "id": "t", "detection": {"a": {"event_type": "auth_failure"}, "b": {"event_type": "auth_success"}, "timeframe": "30m", "condition": "a | near b by Computer"}}
    return correlate.stepped(v.sec_events(spark, d), rule).select("event_id", "hostname", c("started").alias("a_ts"))


_SLIDING = """SELECT e.event_id, e.ts, {1} AS n FROM sec_events e JOIN sec_events o ON o.tenant_id = e.tenant_id AND o.{0} = e.{0} AND o.ts <= e.ts AND o.ts >= e.ts - INTERVAL {2}
 WHERE {3} AND {4} GROUP BY e.event_id, e.ts HAVING {1} > {5}"""


@query("rule_count_sliding", _SLIDING.format("hostname", "count(*)", "6 HOUR", "e.event_type = 'auth_failure'", "o.event_type = 'auth_failure'", 2))
def _(spark, d):
    rule = {"title": "t", "id": "t", "detection": {"sel": {"event_type": "auth_failure"}, "timeframe": "6h", "condition": "sel | count() by Computer > 2"}}
    return correlate.counted(v.sec_events(spark, d), rule, 12 * split.HOUR).select("event_id", "ts", "n")


@query("rule_count_distinct", _SLIDING.format("user_name", "count(DISTINCT o.dst_ip)", "12 HOUR", "e.dst_port = 443", "o.dst_port = 443", 1))
def _(spark, d):
    rule = {"title": "t", "id": "t", "detection": {"sel": {"dst_port": 443}, "timeframe": "12h", "condition": "sel | count(dst_ip) by User > 1"}}
    return correlate.counted(v.sec_events(spark, d), rule, split.DAY).select("event_id", "ts", "n")


_THREE = {"title": "Guess, login, read", "id": "q3", "level": "high", "detection": {
    "guess": {"event_type": "auth_failure"}, "login": {"event_type": "auth_success"}, "read": {"event_type": "file_access"}, "port": {"dst_port": 8080},
    "timeframe": "1d", "condition": "guess then login then read and not port by User"}}


@query("rule_sequence", """WITH g AS (SELECT * FROM sec_events WHERE event_type = 'auth_failure'), l AS (SELECT * FROM sec_events WHERE event_type = 'auth_success'),
 r AS (SELECT * FROM sec_events WHERE event_type = 'file_access' AND NOT coalesce(dst_port = 8080, false))
 SELECT r.event_id, r.user_name, max(g.ts) AS started FROM r JOIN l ON l.user_name = r.user_name AND l.tenant_id = r.tenant_id AND l.ts < r.ts
  JOIN g ON g.user_name = r.user_name AND g.tenant_id = r.tenant_id AND g.ts < l.ts AND g.ts >= r.ts - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(spark, d):
    return correlate.stepped(v.sec_events(spark, d), _THREE, 6 * split.HOUR).select("event_id", "user_name", "started")


def _rule_rows(spark, d):
    """Rule catalogue rows derived from ``part``: several versions per rule."""
    pick = lambda col, words: F.element_at(F.array(*[F.lit(w) for w in words]), (c(col) % len(words) + 1).cast("int"))
    return table(spark, d, "part").select(
        F.concat(F.lit("rule-"), (c("p_partkey") % 300).cast("string")).alias("rule_id"), c("p_partkey").alias("change_id"),
        c("p_name").alias("name"), pick("p_size", rules.STATUSES + ["deleted"]).alias("status"),
        pick("p_partkey", ["critical", "high", "medium", "low", "info", "odd"]).alias("level"),
        (c("p_size") % 3).alias("n_falsepositives"), (c("p_partkey") * 7 % 1000).alias("updated_at"))


RULE_ROWS = """(SELECT 'rule-' || (p_partkey % 300) AS rule_id, p_partkey AS change_id, p_name AS name,
 (['stable','test','experimental','deprecated','unsupported','deleted'])[p_size % 6 + 1] AS status,
 (['critical','high','medium','low','info','odd'])[p_partkey % 6 + 1] AS level, p_size % 3 AS n_falsepositives, p_partkey * 7 % 1000 AS updated_at FROM part)"""


@query("rule_status_filter", f"SELECT change_id, rule_id FROM {RULE_ROWS} WHERE status = 'stable'")
def _(spark, d):
    return _rule_rows(spark, d).filter(c("status") == "stable").select("change_id", "rule_id")


@query("rule_fp_class", f"""SELECT change_id, CASE WHEN status <> 'stable' THEN 'experimental' WHEN level IN ('critical','high') THEN 'production'
 WHEN level = 'medium' AND n_falsepositives = 0 THEN 'production' ELSE 'review' END AS fp_class FROM {RULE_ROWS}""")
def _(spark, d):
    return _rule_rows(spark, d).select("change_id", rules.fp_class().alias("fp_class"))


@query("rule_upsert", f"""SELECT rule_id, change_id, status, level FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY updated_at DESC, change_id DESC) AS rn
 FROM {RULE_ROWS}) WHERE rn = 1 AND status <> 'deleted'""")
def _(spark, d):
    return rules.latest_rules(_rule_rows(spark, d)).select("rule_id", "change_id", "status", "level")


@query("rule_validate", f"""SELECT change_id, CASE WHEN change_id % 50 = 0 OR change_id % 40 = 1 THEN 'name must be 1-200 characters' WHEN level = 'odd' THEN 'unknown severity' END AS error FROM {RULE_ROWS}""")
def _(spark, d):
    r = _rule_rows(spark, d).withColumn("name", F.when(c("change_id") % 50 == 0, "").when(c("change_id") % 40 == 1, F.repeat("name", 40 + 20)).otherwise(c("name")))
    return r.select("change_id", rules.validation("name", "level").alias("error"))


@query("rule_logsource", f"SELECT event_id FROM sec_events WHERE source_type IN ('linux_ebpf', 'syslog') AND ({SQL_PREDICATES['r02']})")
def _(spark, d):
    rule = dict(BY_ID["r02"], logsource={"product": "linux", "category": "unheard_of"})
    return rules.match_all(v.sec_events(spark, d), [rule], logsource=True).filter(F.size("rule_matches") > 0).select("event_id")


_LAST_DAY = "ts > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR"
_RATE = "SELECT rule_id, coalesce(matches, 0) AS matches, t.total, round(coalesce(matches, 0) / greatest(t.total, 1), 6) AS match_rate"


@query("rule_fp_rate", f"""SELECT *, CASE WHEN match_rate < 0.02 THEN 'production' WHEN match_rate <= 0.10 THEN 'review' ELSE 'experimental' END AS fp_class FROM (
 {_RATE} FROM (VALUES {", ".join(f"('{r['id']}')" for r in RULES if r['status'] == 'stable')}) x(rule_id)
 LEFT JOIN (SELECT rule_id, count(*) AS matches FROM rule_hits JOIN sec_events USING (event_id) WHERE {_LAST_DAY} GROUP BY 1) m USING (rule_id)
 CROSS JOIN (SELECT count(*) AS total FROM sec_events WHERE {_LAST_DAY}) t)""")
def _(spark, d):
    e = flt.after(v.sec_events(spark, d), F.lit(v.NOW).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS"), inclusive=False)
    return rules.match_rates(e, rules.stable(RULES))


@query("rule_backtest", f"""SELECT count(*) AS matches, round(count(*) / 48.0, 6) AS per_hour, string_agg(event_id, ',' ORDER BY event_id) FILTER (rn <= 5) AS sample
 FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM sec_events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR AND ({SQL_PREDICATES['r01']}))""")
def _(spark, d):
    hit = rules.matching(flt.since(v.sec_events(spark, d), "2d", v.NOW), BY_ID["r01"])
    total = hit.agg(F.count("*").alias("matches")).withColumn("per_hour", F.round(c("matches") / 48.0, 6))
    sample = hit.select("event_id").orderBy("event_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("sample"))
    return side_by_side(total, sample)


@query("rule_match_stats", """SELECT rule_id, count(*) AS total, max(ts) AS last_match, count(DISTINCT CAST(ts AS DATE)) AS days,
 round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS avg_per_day FROM rule_hits JOIN sec_events USING (event_id) GROUP BY rule_id""")
def _(spark, d):
    return rules.match_stats(rules.match_all(v.sec_events(spark, d), RULES))


# ---- indicators ---------------------------------------------------------------
NORM_SQL = """lower(regexp_extract({0}, '^([^:]*://[^/]*)', 1)) || regexp_replace({0}, '^[^:]*://[^/]*', '')"""


def _addresses():
    """The same page as an address: long and short IPv6 text, IPv4, no address, a mapped IPv4 address."""
    number, last = F.hex(1 + c("page_id") % 60000), (c("page_id") % 250).cast("string")
    return F.array(F.concat(F.lit("2001:0DB8:0000:0:0:0:0:"), F.lpad(number, 4, "0")), F.concat(F.lit("2001:DB8:0:01::"), number, F.lit(":0000")), F.concat(F.lit("10.0.0."), last),
                   F.concat(F.lit("Not:An:Address "), c("page_id").cast("string")), F.concat(F.lit("0:0::FFFF:10.1.2."), last))


@query("ioc_normalize", f"""SELECT page_id, {NORM_SQL.format("u")} AS url_norm, lower(html) = lower(upper(html)) AS same, lower('SHA' || page_id) AS hash_norm,
 rtrim(lower('Host' || page_id || '.Example.ORG..'), '.') AS domain_norm, lower('no-scheme/' || page_id || '/PATH') AS bare,
 CASE page_id % 5 WHEN 0 THEN '2001:db8::' || lower(to_hex(1 + page_id % 60000)) WHEN 1 THEN '2001:db8:0:1::' || lower(to_hex(1 + page_id % 60000)) || ':0'
 WHEN 2 THEN '10.0.0.' || (page_id % 250) WHEN 3 THEN 'Not:An:Address ' || page_id ELSE '::ffff:10.1.2.' || (page_id % 250) END AS ip_norm FROM (SELECT *, regexp_replace(url, '^(https?)://([^/]*)', upper(regexp_extract(url, '^https?://[^/]*'))) AS u FROM pages)""")
def _(spark, d):
    p = table(spark, d, "pages")
    head = F.regexp_extract("url", r"^https?://[^/]*", 0)
    t = lambda a, b: F.concat(F.lit(a), c("page_id").cast("string"), F.lit(b))
    n = lambda kind, x: ioc.normal_value(F.lit(kind), x)
    shouted = F.concat(F.upper(head), F.substring("url", F.length(head) + 1, F.length("url")))
    return p.select("page_id", n("url", shouted).alias("url_norm"), (F.lower("html") == F.lower(F.upper("html"))).alias("same"),
                    n("sha256", t("SHA", "")).alias("hash_norm"), n("domain", t("Host", ".Example.ORG..")).alias("domain_norm"), n("url", t("no-scheme/", "/PATH")).alias("bare"),
                    n("ip", F.get(_addresses(), (c("page_id") % 5).cast("int"))).alias("ip_norm"))


@query("ioc_namespace", """SELECT ioc_type, count(*) AS n FROM (SELECT DISTINCT ioc_type, value_norm FROM (
  SELECT 'domain' AS ioc_type, value_norm FROM ioc_set UNION ALL SELECT ioc_type, value_norm FROM ioc_set)) GROUP BY 1""")
def _(spark, d):
    s = v.ioc_set(spark, d)
    both = s.unionByName(s.withColumn("ioc_type", F.lit("domain")))
    return both.select("ioc_type", "value_norm").distinct().groupBy("ioc_type").agg(F.count("*").alias("n"))


@query("ioc_union_feeds", "SELECT ioc_type, value_norm, source, severity FROM ioc_set")
def _(spark, d):
    return v.ioc_set(spark, d)


@query("ioc_add_remove", """SELECT ioc_type, value_norm, CAST(least(n, 15) AS BIGINT) AS n FROM (SELECT ioc_type, value_norm, sum(delta) AS n FROM (
 SELECT ioc_type, value_norm, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS delta FROM ioc_cand WHERE pos > 0) GROUP BY ALL) WHERE n > 0""")
def _(spark, d):
    log = ioc.candidates(v.sec_events(spark, d)).filter("pos > 0").withColumn("delta", F.when(c("event_id") % 3 == 0, -1).otherwise(1))
    return ioc.present_after(log)


@query("ioc_hits", "SELECT event_id, pos, ioc_type, value_norm, source, severity FROM ioc_hit_rows")
def _(spark, d):
    return ioc.hits(v.sec_events(spark, d), v.ioc_set(spark, d)).select("event_id", "pos", "ioc_type", "value_norm", "source", "severity")


@query("ioc_hit_stats", "SELECT source, ioc_type, count(*) AS hits, count(DISTINCT event_id) AS events FROM ioc_hit_rows GROUP BY ALL")
def _(spark, d):
    return ioc.hit_stats(ioc.hits(v.sec_events(spark, d), v.ioc_set(spark, d)))


@query("join_ioc", "SELECT event_id, arg_min(ioc_type, pos) AS ioc_type, arg_min(value_norm, pos) AS ioc_value, arg_min(source, pos) AS ioc_feed FROM ioc_hit_rows GROUP BY event_id")
def _(spark, d):
    return ioc.first_hits(v.sec_events(spark, d), v.ioc_set(spark, d))


@query("join_ioc_semi", "SELECT event_id, true AS hit FROM (SELECT DISTINCT event_id FROM ioc_hit_rows) UNION ALL SELECT event_id, false FROM sec_events WHERE event_id NOT IN (SELECT event_id FROM ioc_hit_rows)")
def _(spark, d):
    e = v.sec_events(spark, d).select("event_id", "src_ip", "dst_ip", "file_hash", "fields")
    return ioc.flag(e, v.ioc_lookup(spark, d)).select("event_id", c("ioc_hit").alias("hit"))


@query("score_rule_severity", "SELECT event_id, base FROM scored")
def _(spark, d):
    return rules.match_all(v.sec_events(spark, d), RULES).select("event_id", risk.base_score().alias("base"))


@query("score_risk", "SELECT event_id, risk_score FROM scored")
def _(spark, d):
    return v.detected(spark, d).select("event_id", "risk_score")


@query("score_criticality", """SELECT asset_criticality, count(*) AS events, max(CASE asset_criticality WHEN 'critical' THEN 2.0 WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.7 ELSE 0.5 END)::DOUBLE AS factor
 FROM sec_events GROUP BY 1""")
def _(spark, d):
    factor = risk.word_map("asset_criticality", risk.CRITICALITY_TENTHS, 5) / 10
    return v.sec_events(spark, d).groupBy("asset_criticality").agg(F.count("*").alias("events"), F.max(factor).alias("factor"))


@query("score_severity", f"SELECT event_id, {SEV_OF.format('k')} AS score_severity FROM sec_events")
def _(spark, d):
    return v.sec_events(spark, d).select("event_id", severity_from_score("k").alias("score_severity"))


@query("score_candidate", "SELECT event_id, risk_score, risk_severity, ioc_hit, rule_ids FROM (SELECT *, coalesce(rule_ids, '') AS r FROM cand) x".replace("rule_ids FROM (", "r AS rule_ids FROM ("))
def _(spark, d):
    return v.candidates(spark, d).select("event_id", "risk_score", "risk_severity", "ioc_hit", _ids())


TAG_SQL = "(SELECT p_partkey, (['attack.t' || (1000 + p_size) || '.00' || (p_size % 9), 'ATTACK.T' || (1000 + p_size), 'attack.' || replace(p_name, ' ', '_'), 'attack.command_and_control', 'other.' || p_size])[p_partkey % 5 + 1] AS tag FROM part)"


@query("mitre_extract", f"""SELECT p_partkey, CASE WHEN low LIKE 'attack.%' AND NOT regexp_matches(low, '^attack.t[0-9]') THEN CASE WHEN low = 'attack.command_and_control' THEN 'Command and Control'
  ELSE list_aggregate(list_transform(string_split(substr(low, 8), '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END END AS tactic,
 CASE WHEN regexp_matches(low, '^attack.t[0-9]') THEN 'T' || regexp_extract(low, '^attack.t([^.]*)', 1) END AS technique_id,
 CASE WHEN regexp_matches(low, '^attack.t[0-9]+[.]') THEN regexp_extract(low, '^attack.t[0-9]+[.](.*)$', 1) END AS sub_technique_id
 FROM (SELECT *, lower(tag) AS low FROM {TAG_SQL})""")
def _(spark, d):
    s = lambda x: x.cast("string")
    size = c("p_size")
    tags = F.array(F.concat(F.lit("attack.t"), s(1000 + size), F.lit(".00"), s(size % 9)), F.concat(F.lit("ATTACK.T"), s(1000 + size)),
                   F.concat(F.lit("attack."), F.replace(c("p_name"), F.lit(" "), F.lit("_"))), F.lit("attack.command_and_control"), F.concat(F.lit("other."), s(size)))
    tag = F.element_at(tags, (c("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", mitre.parse_tag(tag).alias("t")).select("p_partkey", "t.tactic", "t.technique_id", "t.sub_technique_id")


# ---- alerts -----------------------------------------------------------------------

@query("alert_key", "SELECT event_id, tenant_id, rule_key AS rule_id, entity FROM cand")
def _(spark, d):
    return v.candidates(spark, d).select("event_id", "tenant_id", "rule_id", "entity")


@query("alert_windows", "SELECT tenant_id, rule_id, entity, window_start, event_count, first_seen, last_seen, max_risk FROM alert_win")
def _(spark, d):
    return alerts.windows(v.alert_evidence(spark, d)).drop("first")


@query("join_alert_evidence", "SELECT tenant_id, rule_key AS rule_id, entity, opening AS window_start, event_id, ts FROM ev_win")
def _(spark, d):
    return v.alert_evidence(spark, d).select("tenant_id", "rule_id", "entity", "window_start", "event_id", "ts")


@query("alert_source", "SELECT event_id, CASE WHEN n_rules > 0 THEN 'sigma' WHEN ioc_hit THEN 'ioc' ELSE 'onnx' END AS detection_source FROM scored")
def _(spark, d):
    return v.detected(spark, d).select("event_id", alerts.source("rule_matches", "ioc_hit").alias("detection_source"))


@query("alert_affected", "SELECT event_id, coalesce(hostname, '') AS hosts, user_name AS users, src_ip || ',' || dst_ip AS ips FROM cand")
def _(spark, d):
    j = lambda x: F.array_join(x, ",")
    return v.candidates(spark, d).select("event_id", j(alerts.listed("hostname")).alias("hosts"), j(alerts.listed("user_name")).alias("users"),
                                         j(alerts.affected_ips("src_ip", "dst_ip")).alias("ips"))


@query("alert_compliance_tags", "SELECT event_id, CASE WHEN risk_score >= 60 THEN 'Malicious Code / Attack' END AS cert_in_category, exfil AS dpdp_applicable FROM cand")
def _(spark, d):
    return v.candidates(spark, d).select("event_id", alerts.incident_class("risk_severity").alias("cert_in_category"),
                                         alerts.privacy_applies(F.flatten("rule_matches.tactics")).alias("dpdp_applicable"))


KEYCOLS = "tenant_id, rule_id, entity, window_start"
CAP = "upper(f.risk_severity[1]) || f.risk_severity[2:]"
TECH = "split_part(f.technique, '.', 1)"
IST = "strftime(first_seen + INTERVAL 330 MINUTE, '%H:%M IST')"
EN_SQL = f"""{CAP} || ' security alert: ' || coalesce(f.rule_name, 'Unknown') || ' detected on host ' || coalesce(f.hostname, 'unknown') || ' at ' || {IST} || '. ' || event_count || ' event(s) in the last 15 minutes. Severity: ' || {CAP} || '.' ||
 CASE WHEN f.technique IS NULL THEN '' WHEN f.tactic IS NULL THEN ' MITRE ATT&CK: ' || {TECH} || '.' ELSE ' MITRE ATT&CK: ' || {TECH} || ' (' || f.tactic || ').' END"""
HI_SQL = f"""(CASE f.risk_severity WHEN 'critical' THEN 'गंभीर' WHEN 'high' THEN 'उच्च' WHEN 'medium' THEN 'मध्यम' WHEN 'low' THEN 'निम्न' ELSE 'सूचनात्मक' END) || ' सुरक्षा अलर्ट: ' || coalesce(f.hostname, 'अज्ञात होस्ट')
 || ' पर ' || {IST} || ' पर ' || coalesce(f.rule_name, 'Unknown') || ' का पता चला। पिछले 15 मिनटों में ' || event_count || ' घटनाएँ।'"""
ALERT_KEY = ["tenant_id", "rule_id", "entity", "window_start"]


@query("alert_narrative_en", f"SELECT {KEYCOLS}, {EN_SQL} AS narrative_en FROM alert_win")
def _(spark, d):
    return v.alert_rows(spark, d).select(*ALERT_KEY, "narrative_en")


@query("alert_narrative_hi", f"SELECT {KEYCOLS}, {HI_SQL} AS narrative_hi FROM alert_win")
def _(spark, d):
    return v.alert_rows(spark, d).select(*ALERT_KEY, "narrative_hi")


@query("alert_assemble", f"""SELECT {KEYCOLS}, event_count, first_seen, last_seen, max_risk AS risk_score, {SEV_OF.format('max_risk')} AS severity, coalesce(f.rule_name, 'Unknown') AS rule_name,
 CASE WHEN f.rule_name IS NOT NULL THEN '1' END AS rule_version, CASE WHEN f.n_rules > 0 THEN 'sigma' WHEN f.ioc_hit THEN 'ioc' ELSE 'onnx' END AS detection_source, CAST(f.anomaly_score AS DOUBLE) AS confidence,
 f.tactic AS mitre_tactic, {TECH} AS mitre_technique, nullif(split_part(f.technique, '.', 2), '') AS mitre_sub_tech, 'open' AS status, 1 AS schema_version,
 CASE WHEN f.risk_severity IN ('high', 'critical') THEN 'Malicious Code / Attack' END AS cert_in_category, f.exfil AS dpdp_applicable,
 md5(tenant_id || '|' || rule_id || '|' || entity || '|' || epoch_us(window_start)) AS alert_id FROM alert_win""")
def _(spark, d):
    return v.alert_rows(spark, d).drop("narrative_en", "narrative_hi", "affected_assets", "affected_users", "affected_ips")


@query("flagship_alert_counts", f"SELECT {SEV_OF.format('max_risk')} AS severity, count(*) AS alerts, CAST(sum(event_count) AS BIGINT) AS events, max(max_risk) AS top_risk FROM alert_win GROUP BY 1")
def _(spark, d):
    w = alerts.windows(alerts.evidence(v.find_candidates(spark, d)))
    return w.groupBy(severity_from_score("max_risk").alias("severity")).agg(
        F.count("*").alias("alerts"), F.sum("event_count").alias("events"), F.max("max_risk").alias("top_risk"))


@query("pipeline_raw_to_alerts", f"SELECT {SEV_OF.format('max_risk')} AS severity, count(*) AS alerts, CAST(sum(event_count) AS BIGINT) AS events, max(max_risk) AS top_risk FROM norm_alert_win GROUP BY 1")
def _(spark, d):
    w = alerts.windows(alerts.evidence(v.raw_candidates(spark, d)))
    return w.groupBy(severity_from_score("max_risk").alias("severity")).agg(
        F.count("*").alias("alerts"), F.sum("event_count").alias("events"), F.max("max_risk").alias("top_risk"))


@query("alert_list", "SELECT alert_id, tenant_id, created_at, severity FROM alerts_life WHERE tenant_id = 'tenant-1' ORDER BY created_at DESC, alert_id DESC LIMIT 1000 OFFSET 20")
def _(spark, d):
    return flt.page(flt.for_tenant(v.alerts_life(spark, d), "tenant-1"), 5000, 20, "created_at", "alert_id", flt.MAX_ALERT_LIMIT).select("alert_id", "tenant_id", "created_at", "severity")


@query("alert_get", "SELECT alert_id, tenant_id, status FROM alerts_life WHERE tenant_id = 'tenant-2' AND alert_id = (SELECT max(alert_id) FROM alerts_life WHERE tenant_id = 'tenant-2')")
def _(spark, d):
    a = flt.for_tenant(v.alerts_life(spark, d), "tenant-2")
    return a.agg(F.max_by(F.struct("alert_id", "tenant_id", "status"), "alert_id").alias("x")).select("x.*")


@query("event_get", "SELECT event_id, tenant_id, ts FROM sec_events WHERE tenant_id = 'tenant-0' AND event_id IN (SELECT CAST(doc_id AS BIGINT) FROM labels)")
def _(spark, d):
    wanted = table(spark, d, "labels").select(c("doc_id").alias("event_id")).distinct()
    return flt.for_tenant(v.sec_events(spark, d), "tenant-0").join(wanted, "event_id", "left_semi").select("event_id", "tenant_id", "ts")


CHANGES_SQL = """(SELECT l_orderkey AS alert_id, l_orderkey * 10 + l_linenumber AS change_id, l_shipdate AS at_time, 'user' || (l_suppkey % 9) AS actor,
 (['In-Progress', 'RESOLVED', NULL, 'false-positive', 'bogus', 'open'])[l_partkey % 6 + 1] AS status, CASE WHEN l_linenumber % 3 = 0 THEN 'note ' || l_linenumber END AS notes,
 CASE WHEN l_linenumber % 2 = 0 THEN 'user' || (l_suppkey % 5) END AS assignee, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS dup FROM lineitem)"""


def _changes(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in ("In-Progress", "RESOLVED", None, "false-positive", "bogus", "open")]), (c("l_partkey") % 6 + 1).cast("int"))
    u = lambda n: F.concat(F.lit("user"), (c("l_suppkey") % n).cast("string"))
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("alert_id"), F.struct(c("l_orderkey") * 10 + c("l_linenumber"), c("l_partkey"), c("l_suppkey")).alias("change_id"), c("l_shipdate").alias("at_time"), u(9).alias("actor"), word.alias("status"),
        F.when(c("l_linenumber") % 3 == 0, F.concat(F.lit("note "), c("l_linenumber").cast("string"))).alias("notes"), F.when(c("l_linenumber") % 2 == 0, u(5)).alias("assignee"))


_CH = """(SELECT *, CASE lower(status) WHEN 'in-progress' THEN 'in_progress' WHEN 'resolved' THEN 'resolved' WHEN 'false-positive' THEN 'false_positive' WHEN 'open' THEN 'open' END AS word,
 (at_time, change_id, l_partkey, l_suppkey) AS o FROM (SELECT *, l_partkey, l_suppkey FROM """ + CHANGES_SQL.replace("l_linenumber, row_number", "l_partkey, l_suppkey, row_number").replace("PARTITION BY l_orderkey, l_linenumber", "PARTITION BY l_orderkey") + """) WHERE status IS DISTINCT FROM 'bogus')"""
_CH = _CH.replace("SELECT *, l_partkey, l_suppkey FROM ", "SELECT * FROM ")


@query("alert_update", f"""SELECT a.alert_id, coalesce(m.w, a.status) AS status, m.notes AS resolution_notes, m.assignee AS assigned_to, coalesce(m.rat, a.resolved_at) AS resolved_at, m.rby AS resolved_by
 FROM alerts_life a LEFT JOIN (SELECT alert_id, arg_max(word, o) FILTER (word IS NOT NULL) AS w, arg_max(notes, o) FILTER (notes IS NOT NULL) AS notes, arg_max(assignee, o) FILTER (assignee IS NOT NULL) AS assignee,
 arg_max(at_time, o) FILTER (word = 'resolved') AS rat, arg_max(actor, o) FILTER (word = 'resolved') AS rby FROM {_CH} GROUP BY alert_id) m USING (alert_id)""")
def _(spark, d):
    return alerts.apply_changes(v.alerts_life(spark, d), _changes(spark, d)).select("alert_id", "status", "resolution_notes", "assigned_to", "resolved_at", "resolved_by")


@query("alert_ack", f"""SELECT a.alert_id, CASE WHEN a.status = 'open' AND m.who IS NOT NULL THEN 'acknowledged' ELSE a.status END AS status, CASE WHEN a.status = 'open' THEN m.who END AS assigned_to
 FROM alerts_life a LEFT JOIN (SELECT l_orderkey AS alert_id, arg_min('user' || (l_suppkey % 9), (l_shipdate, 'user' || (l_suppkey % 9))) AS who FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) m USING (alert_id)""")
def _(spark, d):
    acks = table(spark, d, "lineitem").filter("l_linenumber = 2").select(c("l_orderkey").alias("alert_id"), c("l_shipdate").alias("at_time"), F.concat(F.lit("user"), (c("l_suppkey") % 9).cast("string")).alias("actor"))
    return alerts.acknowledge(v.alerts_life(spark, d), acks).select("alert_id", "status", "assigned_to")


@query("alert_mttx", """SELECT tenant_id, round(avg(detect_min), 6) AS mttd_min, round(avg(ack_min), 6) AS mtta_min, round(avg(resolve_min), 6) AS mttr_min, count(*) AS alerts FROM alerts_life GROUP BY 1""")
def _(spark, d):
    return alerts.response_times(v.alerts_life(spark, d), "tenant_id")


@query("alert_cases", """SELECT case_id, at_time, kind, detail FROM (SELECT case_id, created_at AS at_time, 'alert' AS kind, CAST(alert_id AS VARCHAR) AS detail FROM alerts_life WHERE case_id IS NOT NULL
 UNION ALL SELECT conv_id, TIMESTAMP '2024-01-01' + to_minutes(turn), role, text FROM conversations)""")
def _(spark, d):
    notes = table(spark, d, "conversations").select(c("conv_id").alias("case_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), c("turn").cast("int"))).alias("at_time"),
                                                    c("role").alias("kind"), c("text").alias("detail"))
    return alerts.timeline(v.alerts_life(spark, d), notes)


@query("alert_case_summary", """SELECT tenant_id, case_id, count(*) AS alerts, min(created_at) AS opened, max(created_at) AS last_alert,
 (['info','low','medium','high','critical'])[max(CASE severity WHEN 'info' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END)] AS severity,
 count(*) FILTER (status = 'open') AS open_alerts FROM alerts_life WHERE case_id IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    return alerts.case_summary(v.alerts_life(spark, d))


@query("alert_needs_notify", "SELECT alert_id, severity IN ('critical', 'high') AS urgent FROM alerts_life")
def _(spark, d):
    return v.alerts_life(spark, d).select("alert_id", alerts.is_urgent("severity").alias("urgent"))


# The alert creation dates are whole days, so the limit is exercised over the event stream instead.
@query("alert_notify_rate", """WITH req AS (SELECT tenant_id, event_id AS alert_id, ts AS created_at, severity, CASE event_id % 2 WHEN 0 THEN 'sms' ELSE 'email' END AS channel FROM sec_events),
 plain AS (SELECT * FROM req WHERE severity NOT IN ('critical', 'high')),
 hours AS (SELECT tenant_id, channel, min(created_at) AS h FROM plain GROUP BY ALL UNION ALL
  SELECT x.tenant_id, x.channel, min(p.created_at) FROM hours x JOIN plain p ON p.tenant_id = x.tenant_id AND p.channel = x.channel AND p.created_at >= x.h + INTERVAL 1 HOUR GROUP BY ALL)
 SELECT alert_id, channel, nth <= 10 AS allowed FROM (SELECT p.*, row_number() OVER (PARTITION BY p.tenant_id, p.channel, h.h ORDER BY p.created_at, p.alert_id) AS nth
  FROM plain p JOIN hours h ON p.tenant_id = h.tenant_id AND p.channel = h.channel AND p.created_at >= h.h AND p.created_at < h.h + INTERVAL 1 HOUR)
 UNION ALL SELECT alert_id, channel, true FROM req WHERE severity IN ('critical', 'high')""".replace("GROUP BY ALL UNION ALL", "GROUP BY tenant_id, channel UNION ALL"))
def _(spark, d):
    req = v.sec_events(spark, d).select("tenant_id", c("event_id").alias("alert_id"), c("ts").alias("created_at"), "severity",
                                        F.when(c("event_id") % 2 == 0, "sms").otherwise("email").alias("channel"))
    return alerts.rate_limited(req).select("alert_id", "channel", "allowed")


@query("alert_notify_plan", """SELECT alert_id, wa AS whatsapp_sent, CASE WHEN urgent OR NOT wa THEN sms ELSE false END AS sms_sent,
 CASE WHEN urgent OR NOT (wa OR sms) THEN em ELSE false END AS email_sent FROM (SELECT alert_id, severity IN ('critical', 'high') AS urgent,
  alert_id % 3 <> 0 AND alert_id % 11 <> 0 AS wa, alert_id % 5 <> 0 AND alert_id % 13 <> 0 AS sms, alert_id % 7 <> 0 AND alert_id % 17 <> 0 AS em FROM alerts_life)""")
def _(spark, d):
    m = lambda n: c("alert_id") % n != 0
    a = v.alerts_life(spark, d).withColumns({"whatsapp_ok": m(3), "whatsapp_allowed": m(11), "sms_ok": m(5), "sms_allowed": m(13), "email_ok": m(7), "email_allowed": m(17)})
    return alerts.notify_plan(a).select("alert_id", "whatsapp_sent", "sms_sent", "email_sent")


@query("alert_digest", """SELECT tenant_id, date_trunc('day', created_at) AS period, severity, count(*) AS alerts, count(DISTINCT rule_id) AS rules, max(risk_score) AS top_risk
 FROM alerts_life WHERE severity NOT IN ('critical', 'high') GROUP BY 1, 2, 3""")
def _(spark, d):
    return alerts.digest(v.alerts_life(spark, d), "day")


@query("alert_fp_rate", """SELECT rule_id, count(*) AS alerts, count(*) FILTER (status = 'false_positive') AS false_positives,
 round(avg(CASE WHEN status IN ('resolved', 'false_positive') THEN CASE WHEN status = 'false_positive' THEN 1 ELSE 0 END END), 6) AS fp_rate FROM alerts_life GROUP BY 1""")
def _(spark, d):
    return alerts.fp_rate(v.alerts_life(spark, d))
