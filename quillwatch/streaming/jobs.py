"""Streaming forms of the jobs. Every clock is event time; sources and sinks are folders or Kafka."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.operators import filters, ioc, normalize, risk, rules
from quillwatch.streaming.ordered import state_store


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, rows_per_trigger: int = 1_000_000) -> DataFrame:
    """Raw lines of a topic; the tenant is the message key."""
    k = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", rows_per_trigger).load()
    return k.select(c("key").cast("string").alias("tenant_id"), c("value").cast("string").alias("raw"), c("timestamp").cast("timestamp_ntz").alias("ts_received"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; offsets and state live in the checkpoint."""
    _available(df, out, checkpoint, mode).awaitTermination()


def run_timed(df: DataFrame, out: str, checkpoint: str) -> None:
    """The same for a job with timers."""
    with state_store(df.sparkSession):
        _available(df, out, checkpoint, "append").awaitTermination()


def run_joined(df: DataFrame, out: str, checkpoint: str) -> None:
    """The same for a join of streams. A partition's state is one store, not four, and a trigger writes what changed in it, not all of it: with many partitions the stores took most of the time."""
    with state_store(df.sparkSession, **{"join.stateFormatVersion": "3", "stateStore.rocksdb.changelogCheckpointing.enabled": "true"}):
        _available(df, out, checkpoint, "append").awaitTermination()


def _available(df: DataFrame, out: str, checkpoint: str, mode: str):
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def upsert_log(out: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer for updating aggregates: each batch's changed rows with the batch number.

    A batch writes its own folder in overwrite mode, so a replayed batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return write


def latest_of(spark: SparkSession, out: str, keys) -> DataFrame:
    """Current value of every key of an upsert log."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(out)
    rest = [x for x in log.columns if x not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*").drop("_batch")


# ---- stateless ---------------------------------------------------------------

def normalize_batches(enriched: str, dead: str, now: str) -> Callable[[DataFrame, int], None]:
    """Raw to enriched and dead letters, once per micro-batch: the enriched rows are written first and
    the failures are picked from what was written."""
    from quillwatch.sources.intake import dead_letters

    def each(batch: DataFrame, number: int) -> None:
        path = f"{enriched}/batch={number}"
        out = normalize.normalize(batch, now)
        out.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(out.schema).parquet(path)
        dead_letters(done, "raw").write.mode("overwrite").parquet(f"{dead}/batch={number}")
    return each


def detect(events: DataFrame, rule_list) -> DataFrame:
    """Enriched events to rule matches: stateless columns, the same as in batch."""
    return rules.match_all(events, rule_list)


def detect_batches(out: str, rule_list, indicators: Callable[[int], DataFrame | ioc.Lookup]) -> Callable[[DataFrame, int], None]:
    """Candidates per micro-batch: indicators, rules, risk and its threshold. ``indicators`` is called for every batch with its
    number, so a rebuilt list takes effect at the next one and old entries are gone."""
    def each(batch: DataFrame, number: int) -> None:
        e = ioc.flag(batch, indicators(number))
        risk.candidates(risk.score_events(rules.match_all(e, rule_list))).select(
            "event_id", "tenant_id", "ts", "hostname", "src_ip", "ioc_hit", "risk_score", c("rule_matches.rule_id").alias("rule_ids")
        ).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return each


def score_batches(out: str, rule_list, indicators: Callable[[int], DataFrame | ioc.Lookup]) -> Callable[[DataFrame, int], None]:
    """Every event with its risk and whether it hits the list as it is when its micro-batch is read."""
    def each(batch: DataFrame, number: int) -> None:
        scored = risk.score_events(rules.match_all(ioc.flag(batch, indicators(number)), rule_list))
        scored.select("event_id", "risk_score", "ioc_hit").write.mode("overwrite").parquet(f"{out}/batch={number}")
    return each


def push(events: DataFrame, floor: str) -> DataFrame:
    return filters.min_severity(events, floor)


# ---- windows -------------------------------------------------------------------

def marked(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Watermarks need an instant type; the stored event time has no zone and means UTC."""
    return df.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup(events: DataFrame, delay: str) -> DataFrame:
    return marked(events, delay).withColumn("dedup_hash", normalize.fingerprint()).dropDuplicatesWithinWatermark(["dedup_hash"])


def volume(events: DataFrame, delay: str, width: str = "1 minute") -> DataFrame:
    return (marked(events, delay).groupBy(F.window("ts", width).alias("w"), "tenant_id").agg(F.count("*").alias("n"))
            .select(c("w.start").cast("timestamp_ntz").alias("window_start"), "tenant_id", "n"))


def sliding(events: DataFrame, delay: str, key: str, width: str = "1 hour", step: str = "5 minutes", floor: int = 0) -> DataFrame:
    """Windows whose sum has reached the floor; a window appears as soon as it does and again when its sum grows."""
    return (marked(events, delay).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.sum("bytes_out").alias("total")).filter(c("total") >= floor)
            .select(c("w.start").cast("timestamp_ntz").alias("window_start"), key, "total"))


def pairs(first: DataFrame, second: DataFrame, delay: str, within: str) -> DataFrame:
    """Stream-stream join: every ``second`` event with every ``first`` event of its tenant and host before it, within the time.

    Time is part of the key, in steps as long as ``within``: an event looks at the events of two steps, not at all that its host has in the state. A first event waits under
    each step that its time reaches into, a second event is of one step, so a pair is met once."""
    step = F.greatest(F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {within}")), F.lit(1))
    of = lambda ts: F.floor(F.unix_micros(ts) / step)
    end = c("a_ts") + F.expr(f"INTERVAL {within}")
    a = marked(first, delay).select(c("tenant_id").alias("_tenant"), c("hostname").alias("_host"), c("ts").alias("a_ts"), c("event_id").alias("a_id"))
    a = a.withColumn("_a_step", F.explode(F.sequence(of(c("a_ts")), of(end))))
    b = marked(second, delay).select("tenant_id", "hostname", c("ts").alias("b_ts"), c("event_id").alias("b_id"))
    b = b.withColumn("_b_step", of(c("b_ts")))
    same = (c("_tenant") == c("tenant_id")) & (c("_host") == c("hostname")) & (c("_a_step") == c("_b_step"))
    met = a.join(b, same & (c("b_ts") > c("a_ts")) & (c("b_ts") <= end))
    return met.select("a_id", "b_id", "tenant_id", "hostname", *[c(x).cast("timestamp_ntz").alias(x) for x in ("a_ts", "b_ts")])


def user_sessions(events: DataFrame, delay: str, gap: str = "30 minutes") -> DataFrame:
    return (marked(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "tenant_id", "user_name").agg(F.count("*").alias("n"))
            .select(c("w.start").cast("timestamp_ntz").alias("session_start"), c("w.end").cast("timestamp_ntz").alias("session_end"), "tenant_id", "user_name", "n"))
