"""The event store: tenant-partitioned parquet, written once and read with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwatch.functions.scalars import c
from quillwatch.sources.shared import new_folder


def foreign_rows(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of a batch that do not belong to the writing tenant."""
    return df.filter(~c("tenant_id").eqNullSafe(tenant))


def append_events(df: DataFrame, path: str, tenant: str | None = None, partitions=("tenant_id",)) -> None:
    """Append a batch. With ``tenant`` given the whole batch is refused if any row is foreign."""
    if tenant is not None and not foreign_rows(df, tenant).isEmpty():
        raise PermissionError(f"batch holds rows of another tenant than {tenant}")
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def read_events(spark: SparkSession, path: str, schema, tenant: str | None = None) -> DataFrame:
    """Scan with a fixed schema; the tenant predicate prunes partitions."""
    df = spark.read.schema(schema).parquet(path)
    return df if tenant is None else df.filter(c("tenant_id") == tenant)


def stored(df: DataFrame, name: str, partitions=("tenant_id",)) -> DataFrame:
    """Write a derived table to the shared folder and return its scan."""
    path = new_folder(df.sparkSession, name)
    append_events(df, path, partitions=partitions)
    return read_events(df.sparkSession, path, df.schema)
