"""Literal cases: parsers, timestamps, rules, scoring, windows, lockouts, reports."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quillwatch.functions import mitre
from quillwatch.functions.scalars import duration_text, in_cidr, ipv6, severity_from_score
from quillwatch.operators import alerts, anchored, audit, compliance, enrich, filters, ioc, risk, rules, sessions, split
from quillwatch.operators import normalize as nz
from quillwatch.sources import events as store
from quillwatch.sources import intake, rule_files
from quillwatch.sources.shared import new_folder

NOW = "2026-03-23 00:00:00"
T0 = dt.datetime(2024, 1, 1)


def lines(spark, *raw):
    rows = [(i, "t", "syslog", r, T0) for i, r in enumerate(raw)]
    return spark.createDataFrame(rows, "event_id bigint, tenant_id string, source_type string, raw string, ts_received timestamp_ntz")


def one(df):
    return df.collect()[0]


def test_cef(spark):
    r = one(nz.cef_columns(lines(spark, "<13>Jan 15 10:30:45 host CEF:0|ArcSight|Logger|6.0|auth:1|User Login|5|suser=alice sproc=sshd spid=1234 in=512 out=256 shost=a sourceHostName=b x=1 x=2"), NOW))
    assert (r.event_type, r.severity, r.user_name, r.process_name, r.process_pid, r.bytes_in, r.bytes_out) == ("logger_auth_1", "medium", "alice", "sshd", 1234, 512, 256)
    assert r.hostname == "a" and r.fields["sourceHostName"] == "b" and r.fields["x"] == "2" and r.fields["cef_vendor"] == "ArcSight"


def test_cef_short_header_is_an_error(spark):
    assert one(nz.cef_columns(lines(spark, "CEF:0|a|b"), NOW)).parse_error == "short header"


def test_leef(spark):
    a, b = nz.leef_columns(lines(spark, "LEEF:1.0|IBM|QRadar|7.2.8|Login|\tsrc=10.0.0.1\tsrcPort=22\tusrName=alice", "LEEF:2.0|IBM|QRadar|7.2.8|Login|^|src=10.0.0.1^sev=Informational"), NOW).orderBy("event_id").collect()
    assert (a.src_ip, a.src_port, a.user_name, a.event_type, a.severity) == ("10.0.0.1", 22, "alice", "qradar_leef_login", "info")
    assert (b.src_ip, b.delimiter, b.severity) == ("10.0.0.1", "^", "medium")


def test_json(spark):
    r = one(nz.json_columns(lines(spark, '{"src_ip":"10.0.0.1","dst_ip":"8.8.8.8","src_port":1234,"protocol":"TCP","hostname":5,"odd":{"a":1},"sev":"WARN"}'), NOW))
    assert (r.src_ip, r.dst_ip, r.src_port, r.protocol, r.hostname, r.severity) == ("10.0.0.1", "8.8.8.8", 1234, "tcp", None, "medium")
    assert r.fields["odd"] == '{"a":1}'
    assert one(nz.json_columns(lines(spark, "{broken"), NOW)).parse_error


def test_pairs_count_in_text_order(spark):
    head = "CEF:0|A|B|1|c|n|5|"
    rows = nz.cef_columns(lines(spark, head + "sourceAddress=10.0.0.1 src=10.0.0.2 duser=first suser=second rt=2024-01-01 end=soon start=2024-01-03 end=never",
                                head + "src=10.0.0.1 sourceAddress=bad rt=soon end=later dhost=a dst_hostname=b cef_name=own msg=x message=y"), NOW).orderBy("event_id").collect()
    a, b = rows
    assert (a.src_ip, a.user_name, a.fields["suser"], a.event_ts) == ("10.0.0.2", "first", "second", dt.datetime(2024, 1, 3))
    assert (b.src_ip, b.event_ts, b.fields["dst_hostname"], b.fields["cef_name"], b.fields["message"]) == (None, None, "b", "own", "y")
    r = one(nz.leef_columns(lines(spark, "LEEF:1.0|A|B|1|c|\tidentUsername=first\tusrName=second\tidentSrc=h1\tsrcHost=h2\tsev=1\tseverity=9\teventTime=soon\tdevTime=2024-01-02"), NOW))
    assert (r.user_name, r.hostname, r.fields["srcHost"], r.severity, r.event_ts) == ("first", "h1", "h2", "critical", dt.datetime(2024, 1, 2))
    assert "usrName" not in r.fields
    r = one(nz.json_columns(lines(spark, '{"user":"u","actor":"a","src_ip":5,"src":"10.0.0.1","ts":"soon","timestamp":"2024-01-02","pid":1,"process_pid":4294967299,"type":"t","event_type":7,"x":1.5,"y":null,"z":[1,{"b":2}]}'), NOW))
    assert (r.user_name, r.src_ip, r.event_ts, r.process_pid, r.event_type) == ("a", None, dt.datetime(2024, 1, 2), 3, "t")
    assert (r.fields["x"], r.fields["y"], r.fields["z"]) == ("1.5", "", '[1,{"b":2}]')


def test_ipv6_is_canonical(spark):
    rng = random.Random(5)
    texts = ["::", "::1", "1::", "::ffff:10.1.2.3", "0:0:0:0:0:FFFF:0a01:0203", "64:ff9b::10.1.2.3", "1:2:3:4:5:6:7::", "1:0:0:2:0:0:0:3", "1:0:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "fe80::1:0:0:1",
             ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::", "::1.2.3", "::1.2.3.256", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "", "10.0.0.1"]
    texts += [":".join(rng.choice(["0", "0", "00", "AB", "0c", "ffff"]) for _ in range(8)) for _ in range(200)]
    texts += [":".join(rng.choice(["0", "1", "0a"]) for _ in range(rng.randint(1, 4))) + "::" + ":".join(rng.choice(["0", "2"]) for _ in range(rng.randint(0, 3))) for _ in range(100)]

    def want(text):
        try:
            a = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        return f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped else a.compressed
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ipv6("t").alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [(t, want(t)) for t in texts]


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\xfftwo\n\n" + "drei \ufffd ü\n".encode())
    got = {(r.raw, r.reject_reason) for r in intake.text_lines(spark.read, str(tmp_path)).collect()}
    assert got == {("one", None), ("\ufffdtwo", "not utf-8"), ("", "empty"), ("drei \ufffd ü", None)}


def test_syslog(spark):
    a, b = nz.syslog_columns(lines(spark, "<34>1 2026-03-22T10:00:00Z webserver sshd 1234 - - Failed password", "<13>Mar 22 10:00:00 myhost sshd[123]: Invalid user")).orderBy("event_id").collect()
    assert (a.hostname, a.process_name, a.message, a.severity, a.event_ts) == ("webserver", "sshd", "Failed password", "critical", dt.datetime(2026, 3, 22, 10))
    assert (b.hostname, b.process_name, b.severity) == ("myhost", "sshd", "low")


@pytest.mark.parametrize("text, want", [
    ("2026-03-22T10:30:00Z", dt.datetime(2026, 3, 22, 10, 30)), ("2026-03-22T16:00:00+05:30", dt.datetime(2026, 3, 22, 10, 30)),
    ("Sun, 22 Mar 2026 10:30:00 +0000", dt.datetime(2026, 3, 22, 10, 30)), ("1774175400", dt.datetime(2026, 3, 22, 10, 30)),
    ("1774175400000", dt.datetime(2026, 3, 22, 10, 30)), ("2026-03-22 10:30:00.123", dt.datetime(2026, 3, 22, 10, 30, 0, 123000)),
    ("20260322T103000", dt.datetime(2026, 3, 22, 10, 30)), ("Mar 22 2026 10:30:00", dt.datetime(2026, 3, 22, 10, 30)),
    ("22/Mar/2026:10:30:00", dt.datetime(2026, 3, 22, 10, 30)), ("03/22/2026 10:30:00 AM", dt.datetime(2026, 3, 22, 10, 30)),
    ("Mar 22 10:30:00", dt.datetime(2026, 3, 22, 10, 30)), ("Dec 31 23:00:00", dt.datetime(2025, 12, 31, 23)), ("not a time", None), ("", None)])
def test_timestamps(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "t string").select(nz.parse_timestamp("t", NOW).alias("x"))).x == want


def event_rows(spark):
    rows = [(1, "powershell -enc AAAA", "10.1.2.3", 8080, {"k": "5"}, "raw One"), (2, None, "192.168.1.9", 22, {}, "raw two"), (3, "cmd /c dir", "bad", 443, {"k": "12"}, "")]
    return spark.createDataFrame(rows, "event_id int, process_cmdline string, src_ip string, dst_port int, fields map<string,string>, raw string")


@pytest.mark.parametrize("detection, want", [
    ({"s": {"CommandLine|contains": "ENC"}, "condition": "not s"}, {2, 3}),
    ({"s": {"CommandLine": None}, "condition": "s"}, {2}),
    ({"s": {"src_ip|cidr": "10.0.0.0/8"}, "condition": "s"}, {1}), ({"s": {"src_ip|cidr": "10.0.0.0/0"}, "condition": "s"}, {1, 2}),
    ({"s": {"src_ip|cidr": "10.0.0.0/33"}, "condition": "s"}, set()), ({"s": {"src_ip|cidr": "192.168.1.9"}, "condition": "s"}, {2}),
    ({"s": {"k|gt": 5}, "condition": "s"}, {3}), ({"s": {"dst_port": "22"}, "condition": "s"}, {2}), ({"s": {"k": 5}, "condition": "s"}, set()),
    ({"sel1": {"dst_port": 22}, "sel2": {"dst_port": 443}, "condition": "1 of sel*"}, {2, 3}), ({"sel1": {"dst_port": 22}, "sel2": {"dst_port|gt": 1}, "condition": "all of sel*"}, {2}),
    ({"a": {"dst_port": 22}, "b": {"dst_port": 443}, "cc": {"CommandLine|startswith": "CMD"}, "condition": "a and cc or b"}, {3}),
    ({"a": {"dst_port": 22}, "condition": "all of zzz*"}, set()), ({"kw": ["RAW"], "condition": "kw"}, {1, 2}), ({"kw": [], "condition": "kw"}, set()),
    ({"s": {"CommandLine|re": "(unclosed"}, "condition": "s"}, set())])
def test_rules(spark, detection, want):
    got = rules.matching(event_rows(spark), {"title": "t", "id": "x", "detection": detection})
    assert {r.event_id for r in got.collect()} == want


def test_condition_text_cannot_smuggle_expressions():
    with pytest.raises(rules.RuleError):
        rules.condition_sql("a; drop", ["a"], "_")


def test_risk(spark):
    d = spark.createDataFrame([(90, True, 0.8, 0.9, "critical", 100), (50, False, None, None, "low", 35), (90, False, None, None, "low", 63), (0, True, None, None, "medium", 20), (0, True, None, None, "critical", 40)],
                              "base int, hit boolean, an double, ue double, crit string, want int")
    for r in d.select("want", risk.risk(F.col("base"), "hit", "an", "ue", "crit").alias("got"), severity_from_score("want").alias("s")).collect():
        assert r.got == r.want


def test_tags(spark):
    r = one(spark.createDataFrame([(["attack.t1059.001", "ATTACK.lateral_movement", "attack.command_and_control", "other"],)], "t array<string>").select(mitre.parse_tags("t").alias("x"))).x
    assert [(x.tactic, x.technique_id, x.sub_technique_id) for x in r] == [(None, "T1059", "001"), ("Lateral Movement", None, None), ("Command and Control", None, None)]


def brute_windows(data, width):
    out, cur = set(), {}
    for k, t in sorted(data):
        if k not in cur or t - cur[k] >= width:
            cur[k] = t
            out.add((k, t))
    return out


@pytest.mark.parametrize("limit", [200_000, 50, 0])
def test_anchored_windows_match_a_walk(spark, limit):
    """``limit`` 0 sends every run through pointer doubling, as a hot key would go."""
    rng, width, data = random.Random(5), dt.timedelta(minutes=15), []
    for k, (n, pace) in enumerate([(60, 0.5), (800, 0.02), (200, 0.3), (5, 3), (1, 1)]):
        t = T0
        for _ in range(n):
            t += dt.timedelta(microseconds=int(rng.expovariate(1) * pace * 9e8))
            data.append((f"k{k}", t))
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz")
    got = {(r.k, r.t) for r in anchored.anchors(df, ["k"], "ts", 15 * split.MINUTE, limit).selectExpr("k", "cast(timestamp_micros(anchor) as timestamp_ntz) t").collect()}
    assert got == brute_windows(data, width)


def test_hundred_events_make_one_alert_and_the_next_window_opens_at_its_end(spark):
    data = [(i, T0 + dt.timedelta(seconds=i)) for i in range(100)] + [(100, T0 + dt.timedelta(minutes=15))]
    c = spark.createDataFrame([("t", "r", "h", i, t, 50) for i, t in data], "tenant_id string, rule_id string, entity string, event_id int, ts timestamp_ntz, risk_score int")
    assert sorted(r.event_count for r in alerts.windows(alerts.evidence(c)).collect()) == [1, 100]


def test_lockout(spark):
    kinds = "ffffsfffff"
    d = spark.createDataFrame([("u", i, T0 + dt.timedelta(seconds=i), k) for i, k in enumerate(kinds)], "user string, event_id int, ts timestamp_ntz, k string")
    got = sessions.lockouts(d, ["user"], F.col("k") == "f", F.col("k") == "s").filter("locked_until is not null").collect()
    assert [(r.event_id, r.locked_until) for r in got] == [(9, T0 + dt.timedelta(seconds=9, minutes=15))]


def test_expired_lock_resets_the_count(spark):
    times = [0, 1, 2, 3, 4, 2000, 2001]
    d = spark.createDataFrame([("u", i, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "user string, event_id int, ts timestamp_ntz")
    got = sessions.lockouts_expiring(d, ["user"], F.lit(True), F.lit(False)).orderBy("event_id").collect()
    assert [r.failures for r in got] == [1, 2, 3, 4, 5, 1, 2]


def test_sliced_windows_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(3)}", T0 + dt.timedelta(seconds=rng.randrange(20000)), i, rng.randrange(6)) for i in range(400)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int, v int")
    d.createOrReplaceTempView("d_rows")
    want = {r.id: r for r in spark.sql("""SELECT id, sum(v) OVER w AS s, lag(v) OVER (PARTITION BY k ORDER BY ts, id) AS p,
      max(v) OVER (PARTITION BY k ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
      size(collect_set(v) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW)) AS u
      FROM d_rows WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""").collect()}
    got = split.running(d, ["k"], "ts", ["ts", "id"], {"s": F.col("v")})
    got = split.previous(got, ["k"], "ts", ["ts", "id"], {"p": F.col("v")})
    got = split.running_max(got, ["k"], "ts", ["ts", "id"], {"m": F.col("v")})
    got = split.range_distinct(got, ["k"], "ts", "v", 5 * split.MINUTE, "u")
    for r in got.collect():
        w = want[r.id]
        assert (r.s, r.p, r.m, r.u) == (w.s, w.p, w.m, w.u)


def test_sequence_needs_order_and_distance(spark):
    d = spark.createDataFrame([(1, "t", "h", T0, "a"), (2, "t", "h", T0, "b"), (3, "t", "h", T0 + dt.timedelta(seconds=10), "b"), (4, "t", "h", T0 + dt.timedelta(seconds=99), "b")],
                              "event_id int, tenant_id string, hostname string, ts timestamp_ntz, k string")
    assert [r.event_id for r in enrich.sequence(d, ["tenant_id", "hostname"], F.col("k") == "a", F.col("k") == "b", 60).collect()] == [3]


def test_indicator_forms(spark):
    d = spark.createDataFrame([("url", "HTTPS://EVIL.Example/Path"), ("domain", "Evil.COM.."), ("url", "NoScheme/X"), ("sha256", "AB")], "k string, v string")
    assert [r.x for r in d.select(ioc.normal_value("k", "v").alias("x")).collect()] == ["https://evil.example/Path", "evil.com", "noscheme/x", "ab"]


def test_feeds(spark):
    text = spark.createDataFrame([(x,) for x in ["# Comment line", "", "1.2.3.4", "10.0.0.1"]], "value string")
    assert [r.value for r in ioc.text_feed_rows(text, "ip", "f").collect()] == ["1.2.3.4", "10.0.0.1"]
    csv = spark.createDataFrame([(x,) for x in ["id,date,url,tags", "1,2024-01-01,http://evil.com/malware.exe,malware", '2,2024-01-02,"http://bad.net/payload",a,b']], "value string")
    assert [r.value for r in ioc.csv_feed_rows(csv, "url", "f", 2, header="id,date,url,tags").collect()] == ["http://evil.com/malware.exe", "http://bad.net/payload"]


def test_deadline(spark):
    d = spark.createDataFrame([("2024-01-01T14:00:00Z",), ("2023-12-29T16:00:00Z",), ("soon",)], "t string")
    got = [tuple(r.x) for r in d.select(compliance.deadline("t", "2024-01-02 00:00:00").alias("x")).collect()]
    assert got == [(False, 62), (True, -8), (False, 72)]


def test_incident_category(spark):
    d = spark.createDataFrame([("Ransomware found",), ("port SCAN of malware",), ("nothing",)], "t string")
    assert [r.x for r in d.select(compliance.incident_category("t").alias("x")).collect()] == [5, 1, None]
    with pytest.raises(ValueError):
        compliance.category_counts(d.withColumn("ts", F.lit(T0)), "2024-02-01", "2024-01-01", text="t")


def test_durations(spark):
    d = spark.createDataFrame([(3720,), (184,), (5,), (None,)], "s bigint")
    assert [r.x for r in d.select(duration_text(F.col("s")).alias("x")).collect()] == ["1h 2m", "3m 4s", "5s", "N/A"]


def test_foreign_batch_is_refused_whole(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int")
    with pytest.raises(PermissionError):
        store.append_events(d, new_folder(spark, "x"), tenant="a")


def test_filters_refuse_unknown_columns(spark):
    d = spark.createDataFrame([("a",)], "hostname string")
    with pytest.raises(ValueError):
        filters.equals(d, password="x")
    with pytest.raises(ValueError):
        filters.parse_duration("5x")
    assert filters.page_size(0) == 100 and filters.page_size(99999) == 10000


def test_permissions(spark):
    m = {(r.role, r.action, r.resource) for r in audit.permission_matrix(spark).collect()}
    assert ("admin", "delete", "users") not in m and ("admin", "write", "rules") in m and ("analyst", "execute", "playbooks") in m and ("api_key", "read", "rules") not in m
    assert sum(r == "super_admin" for r, _, _ in m) == 50


def test_chain_continues_from_the_tip(spark):
    log = spark.createDataFrame([("t", i, f"a{i}", "u", T0) for i in range(1, 7)], "tenant_id string, chain_seq bigint, action string, actor_id string, ts timestamp_ntz")
    whole = {r.chain_seq: r.row_hash for r in audit.build_chain(log).collect()}
    tips = spark.createDataFrame([("t", whole[3])], "tenant_id string, tip_hash string")
    assert {r.chain_seq: r.row_hash for r in audit.build_chain(log.filter("chain_seq > 3"), tips).collect()} == {k: h for k, h in whole.items() if k > 3}
    assert audit.verify_chain(audit.build_chain(log)).count() == 0


def test_bad_rule_document_keeps_its_error(spark):
    docs = spark.createDataFrame([(1, "title: ok\nlevel: high"), (2, "a: [")], "id int, doc string")
    got = {r.id: r for r in rule_files.with_rule_defaults(rule_files.catalog(docs, "id"), F.col("id").cast("string")).collect()}
    assert got[1].title == "ok" and got[1].status == "experimental" and got[1].error is None and got[2].error


def test_cidr_bounds(spark):
    d = spark.createDataFrame([("10.255.255.255",), ("11.0.0.0",), ("010.0.0.1",), (None,)], "ip string")
    assert [r.x for r in d.select(in_cidr("ip", "10.0.0.0/8").alias("x")).collect()] == [True, False, False, False]


def test_wide_numbers_and_columns_of_the_line(spark):
    r = one(nz.normalize(lines(spark, "CEF:0|A|B|1|x|y|5|src=10.0.0.1 in=9223372036854775807 out=0000000000000000000512 spid=7 proto=TCP fname=a.txt z=1"), NOW))
    assert (r.bytes_in, r.bytes_out, r.process_pid, r.protocol, r.file_name, r.fields["z"]) == (9223372036854775807, 512, 7, "tcp", "a.txt", "1")
    assert one(nz.normalize(lines(spark, "CEF:0|A|B|1|x|y|5|in=18446744073709551616"), NOW)).bytes_in is None


def test_agent_rows_keep_their_columns_and_set_hosts_stay(spark):
    base = lines(spark, "CEF:0|A|B|1|x|y|5|shost=parsed suser=bob", "anything").withColumn("source_type", F.when(F.col("event_id") == 1, "linux_ebpf").otherwise("syslog"))
    d = base.withColumns({"hostname": F.lit("given"), "user_name": F.lit(""), "event_type": F.when(F.col("event_id") == 1, "process_create"), "process_cmdline": F.lit("run")})
    a, b = nz.normalize(d, NOW).orderBy("event_id").collect()
    assert (a.hostname, a.user_name, a.event_type, a.process_cmdline) == ("given", "bob", "b_x", "run")
    assert (b.format, b.hostname, b.event_type, b.process_cmdline, b.parse_error) == ("agent", "given", "process_create", "run", None)


@pytest.mark.parametrize("condition", ["s t", "s and", "(s", "s or or t", "s; t", "s | count() > 1"])
def test_malformed_conditions_are_errors_and_stop_nothing(spark, condition):
    rule = lambda key, text: {"id": key, "title": key, "status": "stable", "level": "low", "detection": {"s": {"event_type": "x"}, "t": {"event_type": "y"}, "condition": text}}
    d = spark.createDataFrame([("x", "r", {"a": "b"})], "event_type string, raw string, fields map<string,string>")
    both = [rule("bad", condition), {"id": "empty", "title": "e", "status": "stable"}, rule("good", "s and not t")]
    assert [x["rule_id"] for x in one(rules.match_all(d, both)).rule_matches] == ["good"]
    good, bad = rules.usable(both, d.columns)
    assert [r["id"] for r in good] == ["good"] and [i for i, _ in bad] == ["bad", "empty"] and all(reason for _, reason in bad)


def test_every_address_of_an_event_is_looked_up(spark):
    ind = ioc.indicator_set(spark.createDataFrame([("url", "http://b.example/x", "u", None), ("domain", "C.example.", "d", None), ("ip", "9.9.9.9", "i", None)], "ioc_type string, value string, source string, severity string"))
    rows = [(1, None, {"p": "http://a.example/", "q": "http://B.example/x"}), (2, None, {"p": "http://a.example/", "q": "https://c.example:8/z"}), (3, "9.9.9.9", {"q": "http://b.example/x"}),
            (4, None, {}), (5, None, None), (6, None, {"q": "http://b.example/x"})]
    d = spark.createDataFrame(rows, "event_id bigint, src_ip string, fields map<string,string>").withColumns({"dst_ip": F.lit(None).cast("string"), "file_hash": F.lit(None).cast("string")})
    got = {r.event_id: (r.ioc_hit, r.ioc_type, r.ioc_feed) for r in ioc.flag(d, ind, with_domain=True).collect()}
    assert got == {1: (True, "url", "u"), 2: (True, "domain", "d"), 3: (True, "ip", "i"), 4: (False, None, None), 5: (False, None, None), 6: (True, "url", "u")}
    assert {r.event_id for r in ioc.keep_hit(d, ind).collect()} == {1, 3, 6}


def test_assets_and_logins_of_another_tenant_do_not_match(spark):
    e = spark.createDataFrame([(1, "a", "H1", "bob"), (2, "b", "h1", "bob"), (3, "c", "h1", None)], "event_id int, tenant_id string, hostname string, user_name string").withColumn("asset_tags", F.array().cast("array<string>"))
    assets = spark.createDataFrame([("a", "h1", "x1", ["t"], "high"), ("a", "H1", "x2", ["u"], "low"), ("b", "h1", "x3", ["v"], "low")], "tenant_id string, hostname string, asset_id string, tags array<string>, criticality string")
    assert [(r.event_id, r.asset_id) for r in enrich.with_assets(e, assets).orderBy("event_id").collect()] == [(1, "x1"), (2, "x3"), (3, None)]
    users = spark.createDataFrame([("a", "BOB", "Robert")], "tenant_id string, login string, canonical_user string")
    assert [r.canonical_user for r in enrich.with_identity(e, users).orderBy("event_id").collect()] == ["Robert", "bob", None]


def test_archive_run_again_replaces_itself(spark):
    from quillwatch.sources import archive
    d = spark.createDataFrame([(i, "t", T0 + dt.timedelta(days=i)) for i in range(5)], "event_id int, tenant_id string, ts timestamp_ntz")
    path = new_folder(spark, "cold")
    for now in ("2024-01-12 00:00:00", "2024-01-12 00:00:00"):
        archive.archive(d, path, now, 8)
    assert sorted(r.event_id for r in archive.replay(spark, path, d.schema, archive.still_hot(d, "2024-01-12 00:00:00", 8)).collect()) == [0, 1, 2, 3, 4]


def test_linear_model_scores(spark):
    from quillwatch.operators import models
    d = spark.createDataFrame([([0.5, 0.25],), ([9.0, 9.0],), ([1.0],)], "x array<double>")
    assert [r[0] for r in d.select(models.score([1.0, 1.0], "x")).collect()] == [0.75, 1.0, None]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_large_indicator_lists_give_exact_hits(spark, broadcast):
    from quillwatch.operators import ioc
    n = 20_000
    ind = spark.range(n).select(F.lit("ip").alias("ioc_type"), F.concat(F.lit("10.0."), F.col("id").cast("string")).alias("value_norm"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("source"), F.lit(None).cast("string").alias("severity"))
    ind = ind.unionByName(spark.createDataFrame([("url", "http://bad/x", "u", None), ("domain", "evil", "d", None), ("ip", "10.0.7", "a", None)], ind.schema))
    e = spark.range(6000).select(F.col("id").alias("event_id"), F.concat(F.lit("10.0."), (F.col("id") * 7).cast("string")).alias("src_ip"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.0."), F.col("id").cast("string"))).alias("dst_ip"),
                                 F.lit(None).cast("string").alias("file_hash"), F.lit("own").alias("_row"),
                                 F.when(F.col("id") == 5001, F.create_map(F.lit("a"), F.lit("http://ok/1"), F.lit("b"), F.lit("HTTP://bad/x"), F.lit("c"), F.lit("http://evil:80/q"))).alias("fields"))
    e = e.unionByName(e.filter("event_id = 3")).drop("_row")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        look = ioc.Lookup(ind)
        got = ioc.flag(e, look, with_domain=True)
        assert got.columns == [*e.columns, "ioc_type", "ioc_value", "ioc_feed", "ioc_hit"]
        rows = got.collect()
        passed = e.filter(look.maybe("ip", F.col("src_ip"))).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 6001
    for r in rows:
        i = r.event_id
        want = f"f{i * 7}" if i * 7 < n else f"f{i}" if i % 2 == 0 else None
        want = "a" if i == 1 else "d" if i == 5001 else want
        assert (r.ioc_feed, r.ioc_hit) == (want, want is not None), r
    assert 0 <= passed - sum(1 for r in rows if r.event_id * 7 < n) < 40
    assert not [r for r in ioc.flag(e, ind.limit(0)).collect() if r.ioc_hit]
