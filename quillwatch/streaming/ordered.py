"""Per-key state machines over streams, with rows released by the watermark in order of time.

Rows of a bucket of keys wait in the state store, packed by time slice, until the watermark has passed the slice; a timer per slice then hands them to the fold of
their key in order of time. So neither the cut of the input into triggers nor the order within one changes a result, and a task holds one slice of one bucket at a
time, not its rows of a trigger. Folds keep a few numbers per key and name the time at which they can be forgotten; a bucket has a timer for the earliest: idle keys leave the state.

Rows later than the watermark are dropped by the engine (`lateness` separates them instead); rows without a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillwatch.functions.scalars import c, from_micros

US = 1_000_000
#: Rows given out as one frame.
FRAME = 50_000
#: Hash buckets of keys.
SPREAD = 512


@contextmanager
def state_store(spark: SparkSession, **more: str):
    """Keyed state with timers needs the store that spills to disk; the session's own choice comes back after the start of the stream. ``more``: further settings for the start, by their names after `spark.sql.streaming.`"""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", **{f"spark.sql.streaming.{k}": v for k, v in more.items()}}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# ---- folds: columns (all bigint, the first is the time), state, out; step, deadline, idle ------------------

class Windows:
    """Windows anchored at their first row: the time of the opening row, its id, the last time, count and highest score."""
    columns = ("us", "event_id", "risk_score")
    state = "first_us bigint, event_id bigint, last_us bigint, event_count bigint, risk_score bigint"
    out = state

    def __init__(self, width_us: int):
        self.width_us = width_us

    def step(self, held, row):
        us, event_id, score = row
        if held is None or us >= held[0] + self.width_us:
            return (us, event_id, us, 1, score), [held] if held else ()
        return (held[0], held[1], us, held[3] + 1, max(held[4], score)), ()

    def deadline(self, held):
        return held[0] + self.width_us

    def idle(self, held):
        return None, [held]


class Locks:
    """Failures since the last success. From the limit on each failure renews a lock; an expired lock clears the count, and so does a silence of forget_us."""
    columns = ("us", "event_id", "failed")
    state = "failures bigint, last_us bigint"
    out = "us bigint, event_id bigint, failures bigint, locked_until_us bigint"

    def __init__(self, limit: int, lock_us: int, forget_us: int):
        self.limit, self.lock_us, self.forget_us = limit, lock_us, forget_us

    def step(self, held, row):
        us, event_id, failed = row
        if not failed:
            return None, ()
        n = 1 if held is None or us >= self.deadline(held) else held[0] + 1
        return (n, us), [(us, event_id, n, us + self.lock_us if n >= self.limit else None)]

    def deadline(self, held):
        return held[1] + (self.lock_us if held[0] >= self.limit else self.forget_us)

    def idle(self, held):
        return None, ()


class Limits:
    """Whole batches accepted while the sum of a window, which opens at a sender's first batch, stays within the limit."""
    columns = ("us", "batch_id", "n")
    state = "open_us bigint, used bigint"
    out = "window_us bigint, batch_id bigint, accepted boolean"

    def __init__(self, limit: int, width_us: int):
        self.limit, self.width_us = limit, width_us

    def step(self, held, row):
        us, batch_id, n = row
        opened, used = held if held and us < held[0] + self.width_us else (us, 0)
        fits = used + n <= self.limit
        return (opened, used + n if fits else used), [(opened, batch_id, fits)]

    def deadline(self, held):
        return held[0] + self.width_us

    def idle(self, held):
        return None, ()


class Beats:
    """An agent is dark when more than after_us pass without a heartbeat, revived by the next one, and gone, thus new again, after gone_us."""
    columns = ("us",)
    state = "last_us bigint, dark boolean"
    out = "kind string, us bigint"

    def __init__(self, after_us: int, gone_us: int):
        self.after_us, self.gone_us = after_us, gone_us

    def step(self, held, row):
        us, said = row[0], []
        while held and us >= self.deadline(held):
            held, more = self.idle(held)
            said += more
        if held and held[1]:
            said.append(("revived", us))
        return (us, False), said

    def deadline(self, held):
        return held[0] + (self.gone_us if held[1] else self.after_us + 1)

    def idle(self, held):
        return (None, [("gone", held[0] + self.gone_us)]) if held[1] else ((held[0], True), [("dark", held[0] + self.after_us)])


class Latest:
    """Each second row (kind 0) with the latest first row (kind 1) strictly before it and within the time; of first rows of one instant the largest id counts."""
    columns = ("us", "kind", "event_id")
    state = "a_us bigint, a_id bigint"
    out = "a_id bigint, b_id bigint, a_us bigint, b_us bigint"

    def __init__(self, within_us: int):
        self.within_us = within_us

    def step(self, held, row):
        us, kind, event_id = row
        if kind:
            return (us, event_id), ()
        return held, [(held[1], event_id, held[0], us)] if held and us <= held[0] + self.within_us else ()

    def deadline(self, held):
        return held[0] + self.within_us + 1

    def idle(self, held):
        return None, ()


class InOrder(StatefulProcessor):
    """The fold over the rows of a bucket of keys, key by key in order of all columns; a slice is the time whose rows wait and are taken together.

    State calls cost far more than rows, so they are made per bucket and slice, not per key: rows wait as packed parts, the folds of a bucket's keys as one text."""

    def __init__(self, fold, key_names: list[str], slice_ms: int):
        self.fold, self.key_names, self.slice_ms = fold, key_names, slice_ms
        self.names = [*key_names, *[x.split()[0] for x in fold.out.split(", ")]]

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice bigint, part bigint", "body binary")
        self.sizes = handle.getMapState("sizes", "slice bigint", "parts bigint")
        self.held = handle.getValueState("held", "body string")
        self.packed = pa.schema([*[(f"key{i}", pa.string()) for i in range(len(self.key_names))], *[(x, pa.int64()) for x in self.fold.columns]])
        self.done = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            batch = pa.RecordBatch.from_pandas(frame[self.packed.names], self.packed, preserve_index=False)
            places = frame["us"].to_numpy(dtype=np.int64) // (self.slice_ms * 1000)
            for place in np.unique(places).tolist():
                n = self.sizes.getValue((place,))[0] if self.sizes.containsKey((place,)) else 0
                if n == 0:
                    self.handle.registerTimer((place + 1) * self.slice_ms)
                body = pa.BufferOutputStream()
                with pa.ipc.new_stream(body, self.packed) as stream:
                    stream.write_batch(batch.filter(pa.array(places == place)))
                self.parts.updateValue((place, n), (body.getvalue().to_pybytes(),))
                self.sizes.updateValue((place,), (n + 1,))
        yield from ()

    def _slices(self, ready: list[int]) -> Iterator[tuple[list, list, list]]:
        """Per slice: the keys, and the number of its key and the cells of every row, in order."""
        for place in ready:
            n = self.sizes.getValue((place,))[0]
            table = pa.concat_tables([pa.ipc.open_stream(bytes(self.parts.getValue((place, k))[0])).read_all() for k in range(n)])
            for k in range(n):
                self.parts.removeKey((place, k))
            self.sizes.removeKey((place,))
            numbers: dict = {}
            owners = zip(*[table.column(i).to_pylist() for i in range(len(self.key_names))])
            codes = np.fromiter((numbers.setdefault(x, len(numbers)) for x in owners), np.int64, table.num_rows)
            cells = np.column_stack([table.column(x).to_numpy() for x in self.fold.columns])
            order = np.lexsort([*cells.T[::-1], codes])
            yield list(numbers), codes[order].tolist(), cells[order].tolist()

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names).astype(object).where(lambda x: x.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All slices that the watermark has passed: the first timer of a trigger does the work of all.
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == mark:
            return
        self.done[key] = mark
        grid = mark // self.slice_ms
        ready = sorted(place for (place,) in self.sizes.keys() if place < grid)
        width, said = len(self.key_names), []
        held = {tuple(x[:width]): tuple(x[width:]) for x in json.loads(self.held.get()[0])} if self.held.exists() else {}
        for owners, codes, cells in self._slices(ready):
            for code, row in zip(codes, cells):
                owner = owners[code]
                held[owner], more = self.fold.step(held.get(owner), row)
                for x in more:
                    said.append((*owner, *x))
                if len(said) >= FRAME:
                    yield self._frame(said)
                    said = []
        end = grid * self.slice_ms * 1000
        live = {}
        for owner, state in held.items():
            while state is not None and self.fold.deadline(state) <= end:
                state, more = self.fold.idle(state)
                said += [(*owner, *x) for x in more]
            if state is not None:
                live[owner] = state
            if len(said) >= FRAME:
                yield self._frame(said)
                said = []
        if live:
            self.held.update((json.dumps([[*owner, *state] for owner, state in live.items()]),))
            self.handle.registerTimer(-(-min(map(self.fold.deadline, live.values())) // (self.slice_ms * 1000)) * self.slice_ms)
        else:
            self.held.clear()
        if said:
            yield self._frame(said)


def folded(rows: DataFrame, keys: list[str], fold, delay: str, slice_s: int = 3600, spread: int = SPREAD) -> DataFrame:
    """rows: a stream with ts, the keys and the fold's other columns. One row per outcome: keys and the fold's out columns.

    ``spread`` is the number of hash buckets of keys. Any number gives the same rows, but a checkpoint keeps the number it was started with."""
    timed = rows.filter("ts IS NOT NULL").withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", delay)
    texts = [c(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(spread)).alias("bucket")
    kept = timed.select("ts", bucket, *texts, F.unix_micros("ts").alias("us"), *[c(x).cast("bigint").alias(x) for x in fold.columns[1:]])
    out = ", ".join([*[f"`{k}` string" for k in keys], fold.out])
    done = kept.groupBy("bucket").transformWithStateInPandas(InOrder(fold, keys, slice_s * 1000), out, "Append", "EventTime")
    return done.select(*[c(k).cast(rows.schema[k].dataType).alias(k) for k in keys], *[c(x) for x in done.columns[len(keys):]])


# ---- the jobs ---------------------------------------------------------------------------------------

def alert_windows(cands: DataFrame, delay: str, width_us: int, slice_s: int = 3600) -> DataFrame:
    """Anchored alert windows as they end, with the candidate that opened each."""
    return folded(cands, ["tenant_id", "rule_id", "entity"], Windows(width_us), delay, slice_s)


def lockouts(attempts: DataFrame, delay: str, limit: int, lock_s: int, forget_s: int, slice_s: int = 3600) -> DataFrame:
    """Every failure with the count it brings its user to and until when it locks."""
    rows = attempts.withColumn("failed", (c("event_type") == "auth_failure").cast("bigint"))
    return folded(rows, ["tenant_id", "user_name"], Locks(limit, lock_s * US, forget_s * US), delay, slice_s)


def limit_batches(batches: DataFrame, delay: str, size: str, limit: int, width_us: int, slice_s: int = 3600) -> DataFrame:
    return folded(batches.withColumn("n", c(size)), ["agent_id"], Limits(limit, width_us), delay, slice_s)


def agents(beats: DataFrame, delay: str, after_s: int, gone_s: int, slice_s: int = 3600) -> DataFrame:
    return folded(beats, ["agent_id"], Beats(after_s * US, gone_s * US), delay, slice_s)


def follow(events: DataFrame, first, second, delay: str, within_s: int, slice_s: int = 3600) -> DataFrame:
    """One row per `second` event with the latest `first` event of its tenant and host before it, within the time: one pending row per key, no pairs."""
    rows = events.filter(first | second).withColumn("kind", F.when(first, 1).otherwise(0))
    return folded(rows, ["tenant_id", "hostname"], Latest(within_s * US), delay, slice_s).withColumns({"a_ts": from_micros("a_us"), "b_ts": from_micros("b_us")}).drop("a_us", "b_us")


# ---- late rows ----------------------------------------------------------------------------------------

class Lateness(StatefulProcessor):
    """Rows with whether they are behind the engine's watermark. Keeps no state."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            yield frame[["event_id", "us"]].assign(late=(frame["us"] < limit).fillna(False).astype(bool))


def lateness(rows: DataFrame, delay: str, spread: int = 256) -> DataFrame:
    """event_id, us and late of every row of a stream, by the watermark that the engine itself holds in the trigger; rows without a time are not late.

    Only the plain number of microseconds goes on, so the engine does not drop the late rows. Keys are hash buckets: any spread gives the same rows.
    """
    timed = rows.withColumn("_mark", c("ts").cast("timestamp")).withWatermark("_mark", delay)
    plain = timed.select("event_id", F.unix_micros("_mark").alias("us"), F.pmod(F.xxhash64("event_id"), F.lit(spread)).alias("part"))
    return plain.groupBy("part").transformWithStateInPandas(Lateness(), "event_id bigint, us bigint, late boolean", "Append", "EventTime")
