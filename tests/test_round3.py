"""Cases of the third review: each failed before its fix."""

import os

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import rule_index, rules
from quillwatch.plans import load_all, views
from quillwatch.plans.registry import QUERIES
from quillwatch.plans.rule_set import RULES
from quillwatch.streaming import jobs

load_all()

from quillwatch.plans import streams  # noqa: E402


@pytest.fixture()
def copied(root, tmp_path):
    """The small tables as links, of which a test may put others in place."""
    for name in os.listdir(root):
        os.symlink(f"{root}/{name}", tmp_path / name)
    return tmp_path


def replaced(folder, name, df):
    os.unlink(folder / f"{name}.parquet")
    df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_csv_feed_keeps_the_page_of_a_repeated_url(spark, root, copied):
    pages = spark.read.parquet(f"{root}/pages.parquet")
    d = replaced(copied, "pages", pages.unionByName(pages.withColumn("page_id", pages.page_id + 10_000)))
    got = sorted(r.page_id for r in QUERIES["src_feed_csv"](spark, d).collect())
    ids = [r.page_id + n for r in pages.collect() for n in (0, 10_000)]
    assert got == sorted(x for x in ids if x % 20 != 3 and x != 0)


def test_rules_are_read_by_several_tasks(spark, root):
    assert QUERIES["src_rules_import"](spark, root).rdd.getNumPartitions() >= 4


def test_store_moves_source_columns_only(spark, root):
    plan = views.derive_events(spark, root, by_day=True)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan.split("RepartitionByExpression")[1]
    assert "powershell" in plan and "powershell" not in moved


def test_volume_feed_holds_what_the_job_reads(spark, root):
    assert streams.event_feed(spark, root, "tenant_id", "ts").columns == ["tenant_id", "ts"]


def test_rules_that_test_the_same_are_tried_once(spark, root):
    e = views.sec_events(spark, root)
    rule = lambda i: {"id": f"r{i}", "title": f"t{i}", "detection": {"sel": {"User": f"user{i % 3}"}, "condition": "sel"}}
    index = rule_index.Index([rule(i) for i in range(120_000)], e.columns)
    assert sum(len(rows) for rows in index.filed["column:user_name"].values()) == 3 and len(index.heads) == 120_000
    few = rule_index.match_indexed(e, rule_index.Index([rule(i) for i in range(9)], e.columns)).filter("user_name = 'user1'").select("rule_matches.rule_id").distinct().collect()
    assert [r.rule_id for r in few] == [["r1", "r4", "r7"]]


def test_every_event_gets_hit_and_risk_in_a_stream_batch(spark, root, tmp_path):
    e = views.model_scores(views.sec_events(spark, root))
    jobs.score_batches(str(tmp_path), RULES, lambda number: views.ioc_lookup(spark, root))(e, 0)
    got = spark.read.parquet(f"{tmp_path}/batch=0")
    assert got.columns == ["event_id", "risk_score", "ioc_hit"] and got.count() == e.count()
    assert not got.filter("ioc_hit").isEmpty() and not got.filter("risk_score < 40").isEmpty()


def test_stream_join_gives_every_pair(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00"), (3, "2024-01-01 04:00:00"), (4, "2024-01-01 01:00:00")], "event_id bigint, t string")
    rows = rows.selectExpr("event_id", "'t' AS tenant_id", "'h' AS hostname", "cast(t AS timestamp_ntz) AS ts")
    got = jobs.pairs(rows.filter("event_id < 3"), rows.filter("event_id >= 3"), "1 day", "3 HOURS").collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(1, 4), (2, 3)]
    got = jobs.pairs(rows.filter("event_id < 3"), rows.filter("event_id >= 3"), "1 day", "5 HOURS").collect()
    assert sorted((r.a_id, r.b_id) for r in got) == [(1, 3), (1, 4), (2, 3)]


def test_heads_are_put_together_once_for_a_set_of_bodies(spark):
    heads = spark.createDataFrame([(b, f"h{b}{k}") for b in range(3) for k in range(3 - b)] + [(1, "h00")], "body int, head string")
    hits = spark.createDataFrame([(1, [0, 2]), (1, [0, 2]), (2, [2, 0]), (3, []), (4, [9]), (5, [9, 1, 0]), (None, [1])], "event_id long, _bodies array<int>")
    got = rule_index.with_heads(hits, heads)
    both = ["h00", "h01", "h02", "h20"]
    assert got.columns == ["event_id", "_heads"]
    assert sorted(((r.event_id or 0), r._heads) for r in got.collect()) == [(0, ["h00", "h10", "h11"]), (1, both), (1, both), (2, both), (5, ["h00", "h01", "h02", "h10", "h11"])]
    assert [x.event_id for x in rule_index.with_heads(hits, heads, F.size).filter("_heads = 4").collect()].count(1) == 2
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1:]
    assert below and not any("event_id" in x.split("]")[0] for x in below)


def test_starts_and_ends_of_values_are_looked_up(spark, root):
    e = views.sec_events(spark, root)
    texts = ["7", "ID 9", "E", "", "powershell.exe -enc 14", "proc3", "PROC", "--id 990", "ü", "x" * 40]
    rule = lambda name, selection, condition="sel": {"id": name, "title": name, "detection": {"sel": selection, "num": {"src_port|gte": 1500}, "condition": condition}}
    every = [rule(f"{way}{i}", {f"CommandLine|{way}": text}, condition) for i, text in enumerate(texts) for way in ("startswith", "endswith") for condition in ("sel and not num",)]
    every += [rule("list", {"CommandLine|endswith": texts[:3]}), rule("both", {"CommandLine|endswith": "1", "CommandLine|startswith": "p"}), rule("exact", {"CommandLine|endswith": "1", "User": "user3"}), rule("not", {"CommandLine|endswith": "1"}, "num and not sel"),
              rule("some", [{"CommandLine|endswith": "12"}, {"User": "user5"}]), rule("free", {"k|endswith": "1"})]
    index = rule_index.Index(every, e.columns)
    assert {x for x in index.filed if x.startswith(("starts", "ends"))} >= {"ends1:process_cmdline", "ends4:process_cmdline", "starts16:process_cmdline", "starts4:process_cmdline"}
    assert sorted(h["rule_id"] for n, h in index.heads if n in {b["body"] for b in index.always}) == ["endswith3", "free", "not", "startswith3"]
    got = {r.event_id: r.ids for r in rule_index.match_indexed(e, index).selectExpr("event_id", "rule_matches.rule_id AS ids").collect()}
    want = {r.event_id: r.ids for r in rules.match_all(e, every, stable_only=False).selectExpr("event_id", "rule_matches.rule_id AS ids").collect()}
    assert got == want and {"endswith0", "endswith1", "startswith5", "list", "both", "some"} <= {x for ids in want.values() for x in ids}


def test_stream_join_looks_at_its_own_time_only(spark):
    # Two first events and a second one in every three hours, before and after 1970: pairs lie on both sides of every border of a step.
    rows = spark.range(60).selectExpr("id AS event_id", "'t' AS tenant_id", "'h' AS hostname", "timestamp_ntz'1969-12-30 18:00:00' + make_dt_interval(0, id, 0, 0) AS ts")
    firsts, seconds = rows.filter("event_id % 3 <> 1"), rows.filter("event_id % 3 = 1")
    joined = jobs.pairs(firsts.unionByName(firsts), seconds, "1 day", "3 HOURS")
    got = sorted((r.a_id, r.b_id) for r in joined.collect())
    assert got == sorted((a, b) for b in range(1, 60, 3) for a in range(max(0, b - 3), b) if a % 3 != 1 for _ in range(2))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_a_step" in plan.split("Join Inner")[1].split("\n")[0]
    nothing = rows.selectExpr("event_id", "tenant_id", "hostname", "CAST(NULL AS timestamp_ntz) AS ts")
    assert jobs.pairs(nothing, seconds, "1 day", "3 HOURS").isEmpty() and jobs.pairs(firsts, nothing, "1 day", "3 HOURS").isEmpty() and jobs.pairs(firsts, seconds, "1 day", "0 HOURS").isEmpty()


def test_joined_streams_keep_settings_and_pairs_of_several_runs(spark, tmp_path):
    rows = spark.range(12).selectExpr("id AS event_id", "'t' AS tenant_id", "'h' AS hostname", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id, 0, 0) AS ts")
    name = "spark.sql.streaming.join.stateFormatVersion"
    before = spark.conf.get(name, None)
    for k in range(3):  # the state goes from run to run
        rows.filter(f"event_id div 4 = {k}").write.mode("append").parquet(f"{tmp_path}/in")
        side = lambda n: jobs.read_folder(spark, f"{tmp_path}/in", rows.schema).filter(f"event_id % 2 = {n}")  # noqa: B023, E731
        df = jobs.pairs(side(0), side(1), "1 day", "3 HOURS")
        jobs.run_joined(df, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert spark.conf.get(name, None) == before
    got = sorted((r.a_id, r.b_id) for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect())
    assert got == sorted((a, b) for b in range(1, 12, 2) for a in (b - 3, b - 1) if a >= 0)
    assert (tmp_path / "checkpoint" / "state" / "0" / "0").is_dir() and not (tmp_path / "checkpoint" / "state" / "0" / "0" / "left-keyToNumValues").exists()


def test_dense_runs_of_few_openings_are_folded(spark, monkeypatch):
    from quillwatch.operators import anchored
    # Key 0: 400 instants within 40 widths, key 1: 400 within 160.
    rows = spark.createDataFrame([(k, (1 + 3 * k) * 100_000 * n + n * n % 977) for k in range(2) for n in range(400)], "k long, us long").selectExpr("k", "timestamp_micros(us) AS ts")
    run = lambda most: sorted(map(tuple, anchored.anchors(rows, ["k"], "ts", 1_000_000, most).collect()))
    want = []
    for k in range(2):
        last = None
        for t in sorted((1 + 3 * k) * 100_000 * n + n * n % 977 for n in range(400)):
            if last is None or t >= last + 1_000_000:
                last = t
                want.append((k, t))
    doubled, double = [], anchored._double
    monkeypatch.setattr(anchored, "_double", lambda ticks, *rest: doubled.append({r["k"] for r in ticks.select("k").distinct().collect()}) or double(ticks, *rest))
    assert run(50) == want and doubled == [{1}]
    assert run(10) == want and doubled[1:] == [{0, 1}]
    assert run(200) == want and len(doubled) == 2
