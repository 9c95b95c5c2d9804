"""Rules as data against rules as columns, and rules over several events against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import correlate, rule_index, rules
from quillwatch.plans import views
from quillwatch.plans.detection import FEATURES
from quillwatch.plans.rule_set import RULES

T0 = dt.datetime(2024, 1, 1)


def ids(df):
    return {r["event_id"]: r["ids"] for r in df.select("event_id", F.col("rule_matches.rule_id").alias("ids")).collect()}


def test_indexed_rules_equal_columns(spark, root):
    odd = [{"User|contains": ["USER1", None, 3, True]}, {"DestinationPort": ["22", 443, "x", None]}, {"DestinationPort|all": [22]}, {"none_such": None}, {"k|gt": 50, "src_port|lte": 5000},
           {"src_ip|cidr": ["10.1.0.0/16", "bad", "10.2.3.4"]}, {"CommandLine|re": ["^proc[3-5]", "(unclosed"]}, {"User": []}, {"User|all": []}, {}, {"User": ["ÜSER", "user12?"]},
           {"Hostname|unheard": "host-1"}, {"process_cmdline": "x"}]
    extra = [{"id": f"x{i:02}", "title": "t", "detection": {"sel": body, "condition": "sel"}} for i, body in enumerate(odd)]
    extra += [{"id": f"n{i:02}", "title": "t", "detection": {"sel": body, "any": {"event_type": "auth_failure"}, "condition": "not sel and any"}} for i, body in enumerate(odd)]
    extra += [{"id": name, "title": name, "detection": detection} for name, (detection, _) in FEATURES.items()]
    bad = [{"id": "b1", "title": "t", "detection": {"sel": {"User": "x"}, "condition": "sel sel"}}, {"id": "b2", "title": "t", "detection": {"condition": "sel | count() > 1"}}, {"id": "b3", "title": "t"},
           {"id": "b4", "title": "t", "detection": {**{f"s{i}": {"k": 1} for i in range(11)}, "condition": "1 of s*"}}]
    every = [*RULES, *extra]
    e = views.sec_events(spark, root)
    index = rule_index.Index([*every, *bad], e.columns)
    assert [x for x, _ in index.rejected] == ["b1", "b2", "b3", "b4"] and all(reason for _, reason in index.rejected)
    assert index.filed and index.always
    got = rule_index.match_indexed(e, index)
    assert got.columns == [*e.columns, "rule_matches"]
    assert ids(got) == ids(rules.match_all(e, every, stable_only=False))


def test_plan_does_not_grow_with_rules(spark, root):
    e = views.sec_events(spark, root)
    rule = lambda i: {"id": f"r{i}", "title": "t", "detection": {"sel": {"User": f"user{i}", "dst_port": i % 3}, "text": {"CommandLine|contains": str(i)}, "condition": "sel and not text"}}
    text = lambda n: rule_index.match_indexed(e, rule_index.Index([rule(i) for i in range(n)], e.columns))._jdf.queryExecution().executedPlan().toString()
    assert text(2000).count("\n") == text(20).count("\n")
    assert rule_index.match_indexed(e, rule_index.Index([], e.columns)).filter("size(rule_matches) > 0").isEmpty()


def rows(spark, data):
    return spark.createDataFrame(data, "event_id bigint, tenant_id string, user_name string, ts timestamp_ntz, event_type string, dst_ip string")


@pytest.mark.parametrize("width", [60_000_000, 3600_000_000])
def test_steps_equal_a_walk(spark, width):
    rng = random.Random(5)
    data = [(i, "t", rng.choice("uvv") if i % 50 else None, T0 + dt.timedelta(seconds=rng.randrange(0, 4000) // 3 * 3) if i % 70 else None, rng.choice("abcdx"), "d") for i in range(600)]
    rule = {"id": "s", "title": "s", "detection": {**{x: {"event_type": x} for x in "abcd"}, "timeframe": "5m", "condition": "a then b or c then c then d by User"}}
    got = {r["event_id"]: r["started"] for r in correlate.stepped(rows(spark, data), rule, width).collect()}
    want = {}
    known = sorted((r for r in data if r[2] and r[3]), key=lambda r: r[3])
    for user in "uv":
        best, pending, at = [None] * 3, [], None  # latest start per step, of rows strictly before
        for r in [x for x in known if x[2] == user]:
            if r[3] != at:
                for i, start in pending:
                    best[i] = max(filter(None, (best[i], start)))
                pending, at = [], r[3]
            for i, kinds in enumerate(("a", "bc", "c", "d")):
                if r[4] in kinds:
                    start = r[3] if i == 0 else best[i - 1]
                    if start and i < 3:
                        pending.append((i, start))
                    elif start and r[3] - start <= dt.timedelta(minutes=5):
                        want[r[0]] = start
    assert got == want and len(got) > 20


def test_counts_slide_over_borders(spark):
    data = [(i, "t", "u", T0 + dt.timedelta(minutes=58, seconds=40 * i), "a", f"d{i % 2}") for i in range(6)] + [(90, "t", "w", T0, "a", None), (91, "t", None, T0, "a", "d")]
    rule = lambda text: {"id": "c", "title": "c", "detection": {"sel": {"event_type": "a"}, "timeframe": "2m", "condition": text}}
    found = lambda text: {r["event_id"]: r["n"] for r in correlate.counted(rows(spark, data), rule(text)).collect()}
    assert found("sel | count() by User > 3") == {3: 4, 4: 4, 5: 4}
    assert found("sel | count(DestinationIp) by User >= 2") == {i: 2 for i in range(1, 6)}
    assert found("sel | count(DestinationIp) by User = 0") == {90: 0}
    out = correlate.correlate(rows(spark, data), [dict(rule("sel | count() by User > 3")), dict(rule("sel | near sel by User"), id="n")]).collect()
    assert {r["rule_id"] for r in out} == {"c", "n"} and all((r["n"] is None) != (r["started"] is None) for r in out)
    with pytest.raises(rules.RuleError):
        correlate.stepped(rows(spark, data), rule("sel then "))
