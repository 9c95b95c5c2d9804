"""The event store: segments by (tenant, day) and a list of versions that says which of them count.

A write stages a segment, a folder of its own partitioned by tenant and day, and counts the batch in the same pass; only when the batch is in order is a
new version written that lists the segment's folders. Readers take the newest version, so they see a batch whole or not at all, and what a failed writer left behind is
listed nowhere. Days move from hot to cold by one version that drops the hot folders and names the cold ones.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwatch.functions.scalars import c
from quillwatch.sources.archive import KEEP_DAYS, TENANT_PATTERN

KEYS = ("tenant_id", "event_day")


class EventStore:
    """schema: of the events, with tenant_id and ts."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.fields = T.StructType([f for f in schema.fields if f.name != "event_day"])

    # ---- versions

    def listed(self) -> tuple[int, list[tuple[str, str]]]:
        """Number of the newest version, and its (folder, tier) entries. One entry per segment, tenant and day, so the list grows with days, not with rows."""
        try:
            rows = self.spark.read.schema("folder string, tier string, version int").json(f"{self.path}/versions")
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
                raise
            return 0, []
        newest = rows.agg(F.max("version")).first()[0]
        if newest is None:
            return 0, []
        return newest, [(r["folder"], r["tier"]) for r in rows.filter(c("version") == newest).collect() if r["folder"]]

    def _commit(self, base: int, entries: list[tuple[str, str]]) -> None:
        """The next version, in one file. It is an error if another writer has made that version."""
        rows = self.spark.createDataFrame([*sorted(entries), ("", "")], "folder string, tier string").coalesce(1)
        rows.write.mode("errorifexists").json(f"{self.path}/versions/version={base + 1}")

    # ---- writing

    def _stage(self, df: DataFrame, tier: str, tenant: str | None = None) -> tuple[list[tuple[str, str]], dict]:
        """A segment, unlisted, its entries, and its rows and foreign rows, counted while it was written."""
        segment = f"{self.path}/segments/segment={uuid.uuid4().hex}"
        seen = Observation()
        own = F.lit(True) if tenant is None else c("tenant_id").eqNullSafe(tenant)
        counted = df.withColumn("event_day", F.to_date("ts")).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~own).alias("foreign"))
        # Spread within the day, so a tenant that holds most of it is still written by many tasks.
        counted.repartition(*KEYS, F.hour("ts")).write.partitionBy(*KEYS).parquet(segment)
        try:
            files = self.spark.read.schema(self._stored()).parquet(segment).inputFiles()
        except AnalysisException:
            files = []
        folders = {os.path.dirname(f)[os.path.dirname(f).index("segments/segment="):] for f in files if "event_day=" in f}
        # Nothing is counted where the optimiser knows that there are no rows.
        return [(unquote(x), tier) for x in folders], seen.get if folders else {"rows": 0, "foreign": 0}

    def _stored(self) -> T.StructType:
        return T.StructType([*[f for f in self.fields.fields if f.name != "tenant_id"], T.StructField("tenant_id", T.StringType()), T.StructField("event_day", T.DateType())])

    def append(self, df: DataFrame, tenant: str | None = None) -> int:
        """Rows written. With ``tenant``, a batch that holds any other tenant's row is refused whole; the batch is evaluated once either way."""
        entries, counted = self._stage(df, "hot", tenant)
        if counted["foreign"]:
            raise PermissionError(f"batch holds {counted['foreign']} rows of another tenant than {tenant}")
        base, old = self.listed()
        self._commit(base, old + entries)
        return counted["rows"]

    # ---- reading

    def read(self, tenant: str | None = None, start: str | None = None, end: str | None = None, tier: str | None = None) -> DataFrame:
        """Events of the newest version with ``event_day``. Tenant and days choose folders; times in ``start`` and ``end`` are left to the caller's filter."""
        _, entries = self.listed()
        return self._scan([f for f, t in entries if tier in (None, t)], tenant, start, end)

    def _scan(self, folders: list[str], tenant=None, start=None, end=None) -> DataFrame:
        day = lambda f: f.rsplit("event_day=", 1)[1][:10]
        wanted = [f for f in folders if (start is None or day(f) >= start[:10]) and (end is None or day(f) <= end[:10])]
        if not wanted:
            out = self.spark.createDataFrame([], self._stored())
        else:
            out = self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/{f}" for f in wanted]).drop("segment")
        out = out if tenant is None else out.filter(c("tenant_id") == tenant)
        return out.select(*self.fields.names, "event_day")

    # ---- hot to cold

    def move_expired(self, now: str, days: int = KEEP_DAYS) -> int:
        """Whole days that ended ``days`` before ``now`` go to cold folders, in one version. Rows moved; 0 when there is nothing left to move."""
        cutoff = self.spark.sql(f"SELECT date_format(to_date(timestamp_ntz '{now}' - make_dt_interval({int(days)})), 'yyyy-MM-dd') AS d").first()[0]
        base, entries = self.listed()
        old = [f for f, t in entries if t == "hot" and f.rsplit("event_day=", 1)[1] < cutoff and self._tenant_ok(f)]
        if not old:
            return 0
        cold, counted = self._stage(self._scan(old).drop("event_day"), "cold")
        self._commit(base, [e for e in entries if e[0] not in set(old)] + cold)
        return counted["rows"]

    @staticmethod
    def _tenant_ok(folder: str) -> bool:
        return re.fullmatch(TENANT_PATTERN.strip("^$"), folder.split("tenant_id=", 1)[1].split("/", 1)[0]) is not None

    def orphans(self) -> DataFrame:
        """Folders of segments that the newest version does not list: left by refused or failed writes and by moves."""
        _, entries = self.listed()
        held = self.spark.createDataFrame([(f,) for f, _ in entries], "folder string")
        try:
            files = self.spark.read.schema(self._stored()).parquet(f"{self.path}/segments").inputFiles()
        except AnalysisException:
            files = []
        every = sorted({unquote(os.path.dirname(f)[os.path.dirname(f).index("segments/segment="):]) for f in files})
        return self.spark.createDataFrame([(f,) for f in every], "folder string").join(held, "folder", "left_anti")
