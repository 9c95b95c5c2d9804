"""Streams with timers: the same rows for any cut into triggers and any order within them, equal to a plain walk; idle keys leave the state."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillwatch.sources.shared import new_folder
from quillwatch.streaming import jobs, ordered

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, tenant_id string, user_name string, hostname string, agent_id bigint, ts timestamp_ntz, event_type string, risk_score bigint, batch_id bigint, n bigint"


def data():
    rng = random.Random(3)
    out = []
    for i in range(900):
        at = T0 + dt.timedelta(seconds=rng.choice([1, 1, 1, 3]) * rng.randrange(0, 6000))
        out.append((i, "t", rng.choice("uvw"), rng.choice("hk"), i % 2, at, rng.choice(["auth_failure", "auth_failure", "auth_success"]), i % 9, i, 1 + i % 7))
    return out


def us(t):
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)


def walk(fold, rows, keys, columns):
    """The fold over whole keys in order, run to its end."""
    out = []
    for key in {tuple(r[k] for k in keys) for r in rows}:
        held = None
        for row in sorted(tuple(r[c] for c in columns) for r in rows if tuple(r[k] for k in keys) == key):
            while held is not None and fold.deadline(held) <= row[0] and type(fold).__name__ in ("Beats",):
                held, said = fold.idle(held)
                out += [(*key, *x) for x in said]
            held, said = fold.step(held, row)
            out += [(*key, *x) for x in said]
        while held is not None:
            held, said = fold.idle(held)
            out += [(*key, *x) for x in said]
    return sorted(out, key=repr)


JOBS = {
    "windows": (lambda s: ordered.folded(s, ["tenant_id", "user_name"], ordered.Windows(600 * ordered.US), "6 hours", 900), ordered.Windows(600 * ordered.US), ["tenant_id", "user_name"], ["us", "event_id", "risk_score"]),
    "locks": (lambda s: ordered.lockouts(s, "6 hours", 3, 300, 1200, 900), ordered.Locks(3, 300 * ordered.US, 1200 * ordered.US), ["tenant_id", "user_name"], ["us", "event_id", "failed"]),
    "limits": (lambda s: ordered.limit_batches(s, "6 hours", "n", 20, 300 * ordered.US, 900), ordered.Limits(20, 300 * ordered.US), ["agent_id"], ["us", "batch_id", "n"]),
    "beats": (lambda s: ordered.agents(s, "6 hours", 60, 240, 900), ordered.Beats(60 * ordered.US, 240 * ordered.US), ["agent_id"], ["us"]),
    "follow": (lambda s: ordered.follow(s, F.col("event_type") == "auth_failure", F.col("event_type") == "auth_success", "6 hours", 60, 900), ordered.Latest(60 * ordered.US), ["tenant_id", "hostname"], ["us", "kind", "event_id"]),
}


@pytest.mark.parametrize("name", list(JOBS))
def test_triggers_do_not_matter(spark, name):
    job, fold, keys, columns = JOBS[name]
    rows = data()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    end = spark.createDataFrame([(-1, "end", "end", "end", -1, T0 + dt.timedelta(days=9), "auth_success", 0, -1, 0), (-2, None, None, None, None, None, None, None, None, None)], SCHEMA)
    plain = [dict(zip(names, r), us=us(r[5]), failed=int(r[6] == "auth_failure"), kind=int(r[6] == "auth_failure")) for r in rows]
    want = walk(fold, plain, keys, columns)
    cuts = {"one": [rows], "many": [rows[k::4] for k in range(4)]}  # the second: triggers that overlap in time
    for cut in cuts.values():
        path, out, checkpoint = (new_folder(spark, x) for x in ("rows", "out", "checkpoint"))
        for part in [*[spark.createDataFrame(p, SCHEMA).coalesce(1) for p in cut], end.coalesce(1)]:
            part.write.mode("append").parquet(path)
            df = job(jobs.read_folder(spark, path, part.schema, 1))
            jobs.run_timed(df, out, checkpoint)
        done = spark.read.schema(df.schema).parquet(out)
        if name == "follow":
            done = done.select("tenant_id", "hostname", "a_id", "b_id", F.unix_micros(F.col("a_ts").cast("timestamp")).alias("a"), F.unix_micros(F.col("b_ts").cast("timestamp")).alias("b"))
        got = sorted((tuple(r) for r in done.collect() if r[0] not in ("end", -1)), key=repr)
        assert got == want and len(got) > 20
    held = spark.read.format("statestore").load(checkpoint, stateVarName="held").select("value").collect()
    assert len(held) <= 1  # the marker's own key at most
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").count("RocksDB") == 0


def test_watermark_of_the_engine_tells_late_rows(spark):
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(48)]
    old = [(100 + i, T0 + dt.timedelta(hours=6 * i)) for i in range(8)] + [(200, None)]
    path, out, checkpoint = (new_folder(spark, x) for x in ("rows", "out", "checkpoint"))
    for part in (rows, old):
        spark.createDataFrame(part, "event_id bigint, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        df = ordered.lateness(jobs.read_folder(spark, path, "event_id bigint, ts timestamp_ntz"), "24 hours", 3)
        jobs.run_timed(df, out, checkpoint)
    got = {r["event_id"]: r["late"] for r in spark.read.schema(df.schema).parquet(out).collect()}
    assert got == {**{i: False for i in range(48)}, **{100 + i: 6 * i < 23 for i in range(8)}, 200: False}


def test_state_grows_with_buckets_not_with_keys(spark):
    schema = "event_id bigint, user_name string, ts timestamp_ntz, risk_score bigint"
    rows = [(i, f"u{i % 400}", T0 + dt.timedelta(minutes=i % 30), 1) for i in range(1200)] + [(9999, None, T0, 1)]
    path, out, checkpoint = (new_folder(spark, x) for x in ("rows", "out", "checkpoint"))
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    df = ordered.folded(jobs.read_folder(spark, path, schema), ["user_name"], ordered.Windows(ordered.US), "6 hours", 900, spread=4)
    jobs.run_timed(df, out, checkpoint)
    assert 0 < spark.read.format("statestore").load(checkpoint, stateVarName="sizes").count() <= 8  # four buckets, two slices
