"""Versions of the event store: whole batches, pruned days, hot to cold in one step."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillwatch.sources.event_store import EventStore
from quillwatch.sources.shared import new_folder

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "event_id int, tenant_id string, ts timestamp_ntz, note string"


def batch(spark, ids, tenant="a"):
    return spark.createDataFrame([(i, tenant, T0 + dt.timedelta(days=i % 10), "x") for i in ids], SCHEMA)


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_store_versions(spark):
    store = EventStore(spark, new_folder(spark, "store"), batch(spark, [1]).schema)
    assert store.listed() == (0, []) and ids(store.read()) == [] and store.move_expired("2024-02-01 00:00:00", 1) == 0
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for x in batches:
            seen.add(len(x))
            yield x
    assert store.append(batch(spark, range(20)).mapInPandas(touch, SCHEMA), "a") == 20 and seen.value == 20
    mixed = batch(spark, range(20, 30)).unionByName(batch(spark, [90], "b")).unionByName(batch(spark, [91], None))
    with pytest.raises(PermissionError, match="holds 2 rows"):
        store.append(mixed, "a")
    assert ids(store.read()) == list(range(20)) and store.orphans().count() == 12
    assert store.append(mixed) == 12 and store.append(batch(spark, [])) == 0
    assert ids(store.read()) == [*range(30), 90, 91] and ids(store.read(tenant="b")) == [90]
    assert ids(store.read(start="2024-01-09", end="2024-01-09 10:00:00")) == [8, 18, 28]
    assert store.read().columns == ["event_id", "tenant_id", "ts", "note", "event_day"]
    assert "PartitionFilters: [isnotnull(tenant_id" in store.read(tenant="b")._sc._jvm.PythonSQLUtils.explainString(store.read(tenant="b")._jdf.queryExecution(), "formatted")


def test_days_move_once(spark):
    store = EventStore(spark, new_folder(spark, "store"), batch(spark, [1]).schema)
    store.append(batch(spark, range(30)).unionByName(batch(spark, [50, 51], "odd tenant")).unionByName(spark.createDataFrame([(70, "a", None, None)], SCHEMA)))
    number, before = store.listed()
    assert store.move_expired("2024-01-10 12:00:00", 5) == 12  # days before the 5th
    after, _ = store.listed()
    assert after == number + 1 and store.move_expired("2024-01-10 12:00:00", 5) == 0 and store.listed()[0] == after
    cold = ids(store.read(tier="cold"))
    assert cold == [i for i in range(30) if i % 10 < 4] and ids(store.read()) == [*range(30), 50, 51, 70]
    assert set(ids(store.read(tier="hot"))) == {*range(30), 50, 51, 70} - set(cold)
    assert ids(store.read(tier="hot").filter(F.col("event_day").isNull())) == [70]
    assert store.move_expired("2024-01-11 12:00:00", 5) == 3
    with pytest.raises(Exception, match="(?i)exist"):  # a writer that started from an older version
        store._commit(number, before)
