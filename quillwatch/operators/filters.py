"""Row filters over the event and alert tables. Each one is a predicate Catalyst can push to the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import SEVERITIES, all_of, c, seconds

# Columns a caller may test for equality.
EQUALITY_COLUMNS = ["source_type", "event_type", "hostname", "user_name", "src_ip", "dst_ip", "process_name"]
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def for_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(c("tenant_id") == tenant)


def time_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Both ends inclusive, either may be open. Where the table is stored by day, the days are chosen as folders."""
    conds = [c("ts") >= F.lit(start).cast("timestamp_ntz")] if start else []
    conds += [c("ts") <= F.lit(end).cast("timestamp_ntz")] if end else []
    if "event_day" in df.columns:
        conds += [c("event_day") >= F.lit(start).cast("timestamp_ntz").cast("date")] if start else []
        conds += [c("event_day") <= F.lit(end).cast("timestamp_ntz").cast("date")] if end else []
    return df.filter(all_of(conds)) if conds else df


def after(df: DataFrame, limit, inclusive: bool = True) -> DataFrame:
    """Rows from a time on, which may be a constant expression; days as in ``time_range``."""
    d = df.filter(c("ts") >= limit if inclusive else c("ts") > limit)
    return d.filter(c("event_day") >= limit.cast("date")) if "event_day" in df.columns else d


def equals(df: DataFrame, **wanted) -> DataFrame:
    unknown = set(wanted) - set(EQUALITY_COLUMNS)
    if unknown:
        raise ValueError(f"not filterable: {sorted(unknown)}")
    conds = [c(k) == v for k, v in wanted.items() if v is not None]
    return df.filter(all_of(conds)) if conds else df


def ioc_only(df: DataFrame) -> DataFrame:
    return df.filter(c("ioc_hit"))


def min_severity(df: DataFrame, floor: str) -> DataFrame:
    return df.filter(c("severity").isin(SEVERITIES[SEVERITIES.index(floor):]))


def parse_duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smhd])", text)
    if not m:
        raise ValueError(f"bad duration {text!r}")
    return int(m[1]) * UNIT_SECONDS[m[2]]


def since(df: DataFrame, text: str, now: str) -> DataFrame:
    """``30s`` / ``5m`` / ``2h`` / ``7d`` before ``now``, or an absolute time."""
    ref = F.lit(now).cast("timestamp_ntz")
    start = ref - seconds(parse_duration(text)) if re.fullmatch(r"\d+[smhd]", text) else F.lit(text).cast("timestamp").cast("timestamp_ntz")
    return after(df, start)


def where_allowed(df: DataFrame, column: str, op: str, value, allowed=tuple(EQUALITY_COLUMNS) + ("severity", "dst_port", "bytes_out")) -> DataFrame:
    """One caller-supplied comparison behind a column and operator allow-list."""
    if column not in allowed:
        raise ValueError(f"column {column!r} is not filterable")
    tests = {"=": lambda a: a == value, "<>": lambda a: a != value, "<": lambda a: a < value, "<=": lambda a: a <= value,
             ">": lambda a: a > value, ">=": lambda a: a >= value, "in": lambda a: a.isin(value)}
    return df.filter(tests[op](c(column)))


def alert_status(df: DataFrame, status=None, severity=None) -> DataFrame:
    conds = [c(k) == v for k, v in (("status", status), ("severity", severity)) if v]
    return df.filter(all_of(conds)) if conds else df


def asset_attrs(df: DataFrame, os_name=None, criticality=None, agent_active=None) -> DataFrame:
    pairs = (("os_name", os_name), ("criticality", criticality), ("agent_active", agent_active))
    conds = [c(k) == v for k, v in pairs if v is not None]
    return df.filter(all_of(conds)) if conds else df


# ---- ordering and paging --------------------------------------------------

DEFAULT_LIMIT, MAX_LIMIT, MAX_ALERT_LIMIT = 100, 10_000, 1_000


def page_size(limit: int | None, top: int = MAX_LIMIT) -> int:
    return min(limit, top) if limit else DEFAULT_LIMIT


def latest(df: DataFrame, limit: int | None = None, ts="ts", tie="event_id") -> DataFrame:
    """Newest first; the tie-break makes the page stable."""
    return df.orderBy(c(ts).desc(), c(tie).desc()).limit(page_size(limit))


def page(df: DataFrame, limit: int | None, offset: int, ts="ts", tie="event_id", top: int = MAX_LIMIT) -> DataFrame:
    return df.orderBy(c(ts).desc(), c(tie).desc()).offset(offset).limit(page_size(limit, top))


def newer_than(df: DataFrame, cursor: str, limit: int = 100) -> DataFrame:
    """Live tail: rows strictly newer than the cursor, oldest first."""
    return after(df, F.lit(cursor).cast("timestamp_ntz"), inclusive=False).orderBy("ts", "event_id").limit(limit)
