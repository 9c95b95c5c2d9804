"""Hot and cold storage of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwatch.functions.scalars import c

# Days a row stays hot; what a tenant id may look like.
KEEP_DAYS = 180
TENANT_PATTERN = r"^[A-Za-z0-9_-]+$"


def expired(df: DataFrame, now: str, days: int = KEEP_DAYS) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter((c("ts") < cutoff) & c("tenant_id").rlike(TENANT_PATTERN))


def still_hot(df: DataFrame, now: str, days: int = KEEP_DAYS) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter((c("ts") >= cutoff) | ~c("tenant_id").rlike(TENANT_PATTERN))


def archive(df: DataFrame, path: str, now: str, days: int = KEEP_DAYS) -> None:
    """Old rows to parquet by (run, tenant, day). Rows are spread over (tenant, day, hour), so a tenant
    holding most of a day is still written by many tasks. A run repeated with the same ``now`` replaces itself."""
    old = expired(df, now, days).withColumns({"run": F.regexp_replace(F.lit(now), "[^0-9]", "-"), "day": F.to_date("ts")})
    (old.repartition("tenant_id", "day", F.hour("ts")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run", "tenant_id", "day").parquet(path))


def replay(spark: SparkSession, path: str, schema, hot: DataFrame | None = None, start=None, end=None) -> DataFrame:
    """Archived days again, pruned by partition, with the hot rows if given."""
    cold = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("day", T.DateType())])).parquet(path)
    if start:
        cold = cold.filter(c("day") >= F.lit(start).cast("date"))
    if end:
        cold = cold.filter(c("day") <= F.lit(end).cast("date"))
    cold = cold.drop("run", "day")
    return cold if hot is None else cold.unionByName(hot)


def evidence_manifest(df: DataFrame, kind: str, day="day") -> DataFrame:
    """Per day: rows and a digest that does not depend on row order or partitioning.

    Each row's JSON (without the day) is digested, the digests are added up in eight lanes of 32 bits, and the sums
    are digested: no file has to pass through one task to be checked."""
    line = F.to_json(F.struct(*[c(x) for x in df.columns if x != day]))
    lanes = [f"_lane{i}" for i in range(8)]
    part = {x: F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i, x in enumerate(lanes)}
    text = F.concat_ws(":", c("n").cast("string"), *[c(x).cast("decimal(38,0)").cast("string") for x in lanes])
    return (df.withColumn("_digest", F.sha2(line, 256)).withColumns(part).groupBy(c(day).alias("day")).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in lanes])
            .select(F.lit(kind).alias("kind"), "day", "n", F.sha2(text, 256).alias("digest")))


def export_evidence(df: DataFrame, path: str, day="day") -> None:
    """JSON lines by day, few files a day: rows are gathered by day, and a large day is split again."""
    df.hint("rebalance", day).write.mode("append").partitionBy(day).json(path)


def evidence_package(spark: SparkSession, parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Each kind of rows below its own folder, and one manifest over what the files hold."""
    manifests = []
    for kind, rows in parts.items():
        export_evidence(rows, f"{path}/{kind}")
        manifests.append(evidence_manifest(spark.read.schema(rows.schema).json(f"{path}/{kind}"), kind))
    return reduce(DataFrame.unionByName, manifests)
