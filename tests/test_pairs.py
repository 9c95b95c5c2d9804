"""Pairs of a line: the last duplicate stands, and a line is cut into pairs once, not once for every pair."""

from pyspark.sql import functions as F

from quillwatch.operators import normalize as nz


def test_last_duplicate_stands(spark):
    rows = spark.createDataFrame([("a=1 b=2  a=3 c= a=4 5",), ("b=1 c=2",), ("no pairs",), (None,)], "x string")
    got = [r["m"] for r in rows.select(nz.cef_extension("x").alias("m")).collect()]
    assert got == [{"a": "4 5", "b": "2", "c": ""}, {"b": "1", "c": "2"}, {}, {}]


def test_a_line_is_cut_once(spark):
    rows = spark.createDataFrame([("a=1 a=2",)], "x string").select(nz.cef_extension("x").alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_whole_numbers_up_to_a_limit(spark):
    texts = ["0080", "+7", "65536", "9223372036854775807", "9223372036854775808", "00000000000000000000000000012", "-1", "", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [tuple(r) for r in rows.select(nz.unsigned(F.col("x"), nz.PORT), nz.unsigned(F.col("x"), nz.U64)).collect()]
    assert got == [(80, 80), (7, 7), (None, 65536), (None, 9223372036854775807), (None, None), (12, 12), (None, None), (None, None), (None, None), (None, None)]


def test_a_struct_of_a_dialect_is_only_made_for_its_lines(spark):
    rows = spark.createDataFrame([(1, "t", "syslog", None)], "event_id bigint, tenant_id string, source_type string, raw string").withColumn("ts_received", F.current_timestamp().cast("timestamp_ntz"))
    plan = nz.normalize(rows, "2024-01-31 00:00:00")._jdf.queryExecution().analyzed().toString()
    assert all(f"CASE WHEN (format#" in line for line in plan.split("\n") if any(f" AS _{n}#" in line for n in ("cef", "leef", "json", "collector_parsed")))
    assert all(f"= {n}) THEN struct(" in plan for n in ("cef", "leef", "json", "collector_parsed"))
