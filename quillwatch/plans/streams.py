"""Streaming queries: each feeds the event store in time order, runs to the end and returns what was written."""

import datetime as dt

from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, from_micros
from quillwatch.operators import ioc
from quillwatch.plans import views as v
from quillwatch.plans.registry import SQL, query
from quillwatch.plans.rule_set import RULES
from quillwatch.sources.shared import new_folder
from quillwatch.streaming import jobs, ordered

_FEEDS: dict = {}
DELAY = "11 days"
#: Seconds of a slice of waiting rows.
SLICE = 86400


def deliveries(df):
    """The rows in three parts by thirds of the days they span, oldest first, each with the day that ends it; the outer parts are open and rows without a time come last."""
    day = lambda agg: F.to_date(agg("ts"))
    lo, hi = df.select(day(F.min).alias("lo"), day(F.max).alias("hi")).first()  # two dates
    if lo is None:
        return [(df, None)]
    cuts = [lo + dt.timedelta(days=((hi - lo).days + 1) * i // 3) for i in (1, 2)]
    at = lambda x: F.lit(f"{x} 00:00:00").cast("timestamp_ntz")
    first, second = (F.coalesce(c("ts") < at(x), F.lit(False)) for x in cuts)
    return [(df.filter(first), cuts[0]), (df.filter(~first & second), cuts[1]), (df.filter(~second), hi + dt.timedelta(days=1))]


def feed(spark, d, name, df):
    """A stream over a folder that received the rows in three deliveries, oldest first."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _FEEDS:
        path = new_folder(spark, "feed-" + name.replace("*", "all"))
        for part, _ in deliveries(df):
            part.write.mode("append").parquet(path)
        _FEEDS[key] = (path, df.schema)
    path, schema = _FEEDS[key]
    return jobs.read_folder(spark, path, schema, 8)


def event_feed(spark, d, *columns):
    """A feed of the events with the columns that the job reads."""
    return feed(spark, d, "-".join(("events", *columns)), v.sec_events(spark, d).select(*columns))


def appended(spark, df):
    out = new_folder(spark, "stream-out")
    jobs.run_available(df, out, new_folder(spark, "stream-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


def upserted(spark, df, keys):
    out = new_folder(spark, "stream-out")
    jobs.run_batches(df, jobs.upsert_log(out), new_folder(spark, "stream-checkpoint"))
    return jobs.latest_of(spark, out, keys)


def delivered(spark, name, parts, job, files=4):
    """One run of a job with state and timers per delivery, each of several triggers of `files` files; the state survives between runs in the checkpoint."""
    path, out, checkpoint = (new_folder(spark, f"{kind}-{name}") for kind in ("feed", "stream-out", "stream-checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(path)
        df = job(jobs.read_folder(spark, path, part.schema, files))
        jobs.run_timed(df, out, checkpoint)
    return spark.read.schema(df.schema).parquet(out)


def to_the_end(df, **marker):
    """The rows in three deliveries, and as the last one a single row (other columns null) whose time pushes the watermark past every deadline."""
    end = df.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"))
    last = end.select(*[c("ts") if f.name == "ts" else F.lit(marker.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return [part for part, _ in deliveries(df)] + [last]


def batched(spark, df, make):
    """Run a foreachBatch job writing below one folder and read the folder back."""
    out = new_folder(spark, "stream-out")
    jobs.run_batches(df, make(out), new_folder(spark, "stream-checkpoint"), "append")
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


@query("src_topics", "SELECT event_id, tenant_id, raw FROM sec_events")
def _(spark, d):
    return appended(spark, event_feed(spark, d, "event_id", "tenant_id", "raw", "ts").select("event_id", "tenant_id", "raw"))


@query("st_normalize", """SELECT event_id, CASE WHEN source_type = 'linux_ebpf' THEN 'agent' WHEN fmt IN (0, 9) THEN 'cef' WHEN fmt = 1 THEN 'leef' WHEN fmt = 2 THEN 'json' ELSE 'collector_parsed' END AS format,
 CASE WHEN source_type <> 'linux_ebpf' AND fmt = 9 THEN 'short header' END AS parse_error FROM sec_events""")
def _(spark, d):
    lines = event_feed(spark, d, "event_id", "tenant_id", "source_type", "raw", "ts_received", "ts").drop("ts")
    dead = new_folder(spark, "dead")
    return batched(spark, lines, lambda out: jobs.normalize_batches(out, dead, v.NOW)).select("event_id", "format", "parse_error")


@query("st_detect", "SELECT event_id, string_agg(rule_id, ',' ORDER BY pos) AS rule_ids FROM rule_hits GROUP BY event_id")
def _(spark, d):
    return appended(spark, jobs.detect(event_feed(spark, d, "*"), RULES).select("event_id", F.array_join("rule_matches.rule_id", ",").alias("rule_ids")).filter("rule_ids <> ''"))


@query("st_detect_risk", "SELECT event_id, risk_score, ioc_hit, coalesce(rule_ids, '') AS rule_ids FROM cand")
def _(spark, d):
    """Indicators, rules, risk and threshold as one streaming job."""
    indicators, e = v.ioc_lookup(spark, d), v.model_scores(event_feed(spark, d, "*"))
    found = batched(spark, e, lambda out: jobs.detect_batches(out, RULES, lambda number: indicators))
    return found.select("event_id", "risk_score", "ioc_hit", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("ioc_refresh", "SELECT event_id, risk_score, ioc_hit FROM scored")
def _(spark, d):
    """The list is rebuilt before every delivery; each event gets its hit and its risk, candidates and others."""
    e = v.model_scores(v.sec_events(spark, d))
    path, out, checkpoint = (new_folder(spark, f"{kind}-refresh") for kind in ("feed", "stream-out", "stream-checkpoint"))
    for part, _ in deliveries(e):
        part.write.mode("append").parquet(path)
        fresh = ioc.Lookup(v.ioc_set(spark, d))
        jobs.run_batches(jobs.read_folder(spark, path, part.schema), jobs.score_batches(out, RULES, lambda number, fresh=fresh: fresh), checkpoint, "append")
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


@query("st_push_filtered", "SELECT event_id, severity FROM sec_events WHERE sev_rank >= 3")
def _(spark, d):
    return appended(spark, jobs.push(event_feed(spark, d, "event_id", "severity", "ts"), "high").select("event_id", "severity"))


@query("st_dedup", "SELECT event_id, tenant_id FROM sec_events")
def _(spark, d):
    """Some events come twice, the second time in the same or a later delivery; each comes out once."""
    e = v.sec_events(spark, d).select("event_id", "tenant_id", "hostname", "event_type", "src_ip", "dst_ip", "process_name", "raw", "ts")
    twice = feed(spark, d, "twice", e.unionByName(e.filter("event_id % 3 = 0")))
    return appended(spark, jobs.dedup(twice, DELAY).select("event_id", "tenant_id"))


@query("st_tumbling_volume", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, tenant_id, count(*) AS n FROM sec_events GROUP BY 1, 2")
def _(spark, d):
    return upserted(spark, jobs.volume(event_feed(spark, d, "tenant_id", "ts"), DELAY, "1 hour"), ["window_start", "tenant_id"])


@query("st_sliding_threshold", """SELECT window_start, tenant_id, total FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * o) AS window_start, tenant_id, CAST(sum(bytes_out) AS BIGINT) AS total
 FROM sec_events CROSS JOIN (VALUES (0), (1), (2), (3)) t(o) GROUP BY 1, 2) WHERE total >= 600000000""")
def _(spark, d):
    return upserted(spark, jobs.sliding(event_feed(spark, d, "tenant_id", "ts", "bytes_out"), DELAY, "tenant_id", "24 hours", "6 hours", 600_000_000), ["window_start", "tenant_id"])


@query("st_session", """WITH g AS (SELECT tenant_id, user_name, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM sec_events WINDOW w AS (PARTITION BY tenant_id, user_name ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, user_name ORDER BY ts) AS sid FROM g)
 SELECT tenant_id, user_name, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM s GROUP BY tenant_id, user_name, sid""")
def _(spark, d):
    """A last row, far later, closes every session, those of the last days included."""
    e = v.sec_events(spark, d).select("tenant_id", "user_name", "ts")
    path, out, checkpoint = (new_folder(spark, f"{kind}-sessions") for kind in ("feed", "stream-out", "stream-checkpoint"))
    for part in to_the_end(e, user_name="the end"):
        part.write.mode("append").parquet(path)
        df = jobs.user_sessions(jobs.read_folder(spark, path, part.schema), DELAY, "8 hours")
        jobs.run_available(df, out, checkpoint)
    return spark.read.schema(df.schema).parquet(out).filter("user_name <> 'the end'")


@query("st_stream_join", """SELECT a.event_id AS a_id, b.event_id AS b_id, b.tenant_id, b.hostname, a.ts AS a_ts, b.ts AS b_ts
 FROM sec_events b JOIN sec_events a ON a.hostname = b.hostname AND a.tenant_id = b.tenant_id AND a.ts < b.ts AND b.ts <= a.ts + INTERVAL 3 HOUR
 WHERE a.event_type = 'auth_failure' AND b.event_type = 'auth_success'""")
def _(spark, d):
    """Every pair, as the second of its events arrives."""
    e = v.sec_events(spark, d).filter("hostname IS NOT NULL AND event_type IN ('auth_failure', 'auth_success')").select("event_id", "tenant_id", "hostname", "ts", "event_type")
    side = lambda kind: feed(spark, d, "logins", e).filter(c("event_type") == kind)
    df, out = jobs.pairs(side("auth_failure"), side("auth_success"), DELAY, "3 HOURS"), new_folder(spark, "stream-out")
    jobs.run_joined(df, out, new_folder(spark, "stream-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


@query("st_late_data", """SELECT event_id, event_id % 200 = 0 AND ts >= (SELECT CAST(min(ts) AS DATE) + CAST((CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1) * 2 // 3 AS INTEGER) FROM sec_events) AS late FROM sec_events""")
def _(spark, d):
    parts = [part for part, _ in deliveries(v.sec_events(spark, d).select("event_id", "ts"))]
    # The last delivery brings some rows that are 60 days old. What is late, the stream's own watermark says.
    old = parts[-1].withColumn("ts", F.when(c("event_id") % 200 == 0, c("ts") - F.expr("INTERVAL 60 DAYS")).otherwise(c("ts")))
    return delivered(spark, "late", [*parts[:-1], old], lambda s: ordered.lateness(s, DELAY, 32), 1000).select("event_id", "late")


@query("alert_windows_stream", """WITH f AS (SELECT event_id, tenant_id, coalesce(hostname, src_ip) AS entity, ts, sev_rank FROM sec_events WHERE event_type = 'auth_failure'),
 o AS (SELECT tenant_id, entity, min(ts) AS w FROM f GROUP BY 1, 2 UNION ALL
  SELECT o.tenant_id, o.entity, min(f.ts) FROM o JOIN f ON f.tenant_id = o.tenant_id AND f.entity = o.entity AND f.ts >= o.w + INTERVAL 48 HOUR GROUP BY 1, 2)
 SELECT o.tenant_id, o.entity, o.w AS first_seen, arg_min(f.event_id, (f.ts, f.event_id)) AS opened_by, max(f.ts) AS last_seen, count(*) AS event_count, max(f.sev_rank) AS risk_score
 FROM o JOIN f ON f.tenant_id = o.tenant_id AND f.entity = o.entity AND f.ts >= o.w AND f.ts < o.w + INTERVAL 48 HOUR GROUP BY 1, 2, 3""")
def _(spark, d):
    e = v.sec_events(spark, d).filter("event_type = 'auth_failure'").select("event_id", "tenant_id", F.lit("r").alias("rule_id"), F.coalesce("hostname", "src_ip").alias("entity"), "ts", c("sev_rank").alias("risk_score"))
    w = delivered(spark, "alerts", to_the_end(e, event_id=0, risk_score=0), lambda s: ordered.alert_windows(s, DELAY, 48 * 3600 * ordered.US, SLICE))
    return w.select("tenant_id", "entity", from_micros("first_us").alias("first_seen"), c("event_id").alias("opened_by"), from_micros("last_us").alias("last_seen"), "event_count", "risk_score")


@query("st_brute_force_stream", """WITH a AS MATERIALIZED (SELECT event_id, tenant_id, user_name, ts, event_type = 'auth_failure' AS f, row_number() OVER (PARTITION BY tenant_id, user_name ORDER BY ts, event_id) AS rn FROM sec_events
  WHERE event_type IN ('auth_failure', 'auth_success')),
 r AS (SELECT tenant_id, user_name, rn, event_id, ts, f, CASE WHEN f THEN 1 ELSE 0 END AS n FROM a WHERE rn = 1
  UNION ALL SELECT a.tenant_id, a.user_name, a.rn, a.event_id, a.ts, a.f, CASE WHEN NOT a.f THEN 0 WHEN r.n >= 3 AND a.ts >= r.ts + INTERVAL 36 HOUR THEN 1 WHEN r.n > 0 AND r.n < 3 AND a.ts >= r.ts + INTERVAL 5 DAY THEN 1 ELSE r.n + 1 END
  FROM r JOIN a ON a.tenant_id = r.tenant_id AND a.user_name = r.user_name AND a.rn = r.rn + 1)
 SELECT tenant_id, user_name, event_id, ts, CAST(n AS BIGINT) AS failures, CASE WHEN n >= 3 THEN ts + INTERVAL 36 HOUR END AS locked_until FROM r WHERE f""")
def _(spark, d):
    e = v.sec_events(spark, d).filter("event_type IN ('auth_failure', 'auth_success')").select("event_id", "tenant_id", "user_name", "ts", "event_type")
    locks = delivered(spark, "auth", to_the_end(e, event_id=0, event_type="auth_success"), lambda s: ordered.lockouts(s, DELAY, 3, 36 * 3600, 5 * 86400, SLICE))
    return locks.select("tenant_id", "user_name", "event_id", from_micros("us").alias("ts"), "failures", from_micros("locked_until_us").alias("locked_until"))


SQL["st_rate_limit_stream"] = SQL["st_rate_limit"]


@query("st_rate_limit_stream")
def _(spark, d):
    b = v.agent_batches(spark, d).select("agent_id", "batch_id", "ts", "n_events")
    took = delivered(spark, "limit", to_the_end(b, batch_id=0, n_events=0), lambda s: ordered.limit_batches(s, DELAY, "n_events", 15, 12 * 3600 * ordered.US, SLICE))
    return took.select("agent_id", from_micros("window_us").alias("window_start"), "batch_id", "accepted")


@query("st_agent_dark_stream", """WITH b AS (SELECT agent_id, ts, lead(ts) OVER (PARTITION BY agent_id ORDER BY ts) AS nx FROM heartbeats)
 SELECT agent_id, 'dark' AS kind, ts + INTERVAL 4 HOUR AS at_time FROM b WHERE nx IS NULL OR nx > ts + INTERVAL 4 HOUR
 UNION ALL SELECT agent_id, 'revived', nx FROM b WHERE nx > ts + INTERVAL 4 HOUR AND nx < ts + INTERVAL 12 HOUR
 UNION ALL SELECT agent_id, 'gone', ts + INTERVAL 12 HOUR FROM b WHERE nx IS NULL OR nx >= ts + INTERVAL 12 HOUR""")
def _(spark, d):
    said = delivered(spark, "beats", to_the_end(v.heartbeats(spark, d)), lambda s: ordered.agents(s, DELAY, 4 * 3600, 12 * 3600, SLICE))
    return said.filter("agent_id IS NOT NULL").select("agent_id", "kind", from_micros("us").alias("at_time"))
