"""Intake shapes: text lines, JSON arrays, endpoint records, agent batches, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from quillwatch.functions.scalars import c


def raw_lines(lines: DataFrame, value="value") -> DataFrame:
    """Trailing line ends trimmed; empty or undecodable lines carry a reject reason. What cannot be decoded stands as U+FFFD."""
    line = F.regexp_replace(F.make_valid_utf8(c(value)), r"[\r\n]+$", "")
    reason = F.when(c(value).isNull() | ~F.is_valid_utf8(c(value)), "not utf-8").when(line == "", "empty")
    return lines.withColumn("raw", line).withColumn("reject_reason", reason)


def text_lines(source: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """Lines of text files, read at once (``spark.read``) or as they come (``spark.readStream``)."""
    return raw_lines(source.option("lineSep", "\n").text(path))


def json_arrays(bodies: DataFrame, item_schema: str, tenant, batch="batch_id", body="body") -> DataFrame:
    """JSON array bodies to rows. The tenant is the authenticated one, whatever the item says; event
    ids are fresh and reproducible; an item without the required fields is rejected, and so is a body that is
    no array, as one row without a position."""
    items = F.posexplode_outer(F.from_json(c(body), f"array<struct<{item_schema}>>"))
    empty = F.coalesce(F.size(F.from_json(c(body), f"array<struct<{item_schema}>>")) == 0, F.lit(False))
    rows = bodies.filter(~empty).select(c(batch), tenant.alias("_tenant"), items.alias("pos", "i")).select(batch, "pos", "_tenant", "i.*").drop("tenant_id")
    return (rows.withColumnRenamed("_tenant", "tenant_id").withColumn("event_id", F.md5(F.concat_ws("|", c(batch).cast("string"), c("pos").cast("string"))))
            .withColumn("accepted", c("event_type").isNotNull() & c("ts").isNotNull()))


def acceptance(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~c("accepted")).alias("n_rejected"))


# Protocol numbers and open-mode bits of endpoint records.
PROTOCOLS = {6: "tcp", 17: "udp"}
WRITE_BITS = 3


def endpoint_events(records: DataFrame, boot_ns) -> DataFrame:
    """Process, network and file records of endpoint agents as canonical rows.

    Input columns: kind, ktime_ns, uid, comm, argv, exe_path, username, proto, path, flags."""
    k = c("kind")
    when = lambda name, v: F.when(k == name, v)
    proto = F.when(c("proto") == 6, "tcp").when(c("proto") == 17, "udp").otherwise("unknown")
    argv = F.array_join(F.filter("argv", lambda x: x != ""), " ")
    action = F.when(c("flags").bitwiseAND(F.lit(WRITE_BITS)) != 0, "write").otherwise("read")
    us = F.floor((c("ktime_ns") + boot_ns) / 1000).cast("bigint")
    return records.select(
        "event_id", F.timestamp_micros(us).cast("timestamp_ntz").alias("ts"), F.lit("linux_ebpf").alias("source_type"),
        choose_type(k).alias("event_type"), F.when(k == "process", "process").when(k == "network", "network").otherwise("file").alias("event_category"),
        F.when(k == "process", "execve").when(k == "network", "connect").otherwise(action).alias("event_action"),
        c("uid").cast("string").alias("user_id"), F.when(k == "process", F.nullif(c("username"), F.lit(""))).alias("user_name"),
        c("comm").alias("process_name"), when("process", argv).alias("process_cmdline"), when("process", c("exe_path")).alias("process_path"),
        when("network", proto).alias("protocol"), when("network", F.lit("outbound")).alias("direction"),
        when("file", c("path")).alias("file_path"), when("file", F.element_at(F.split("path", "/"), -1)).alias("file_name"),
        when("file", action).alias("file_action"))


def choose_type(kind: Column) -> Column:
    return F.when(kind == "process", "process_create").when(kind == "network", "network_connect").otherwise("file_access")


def split_known(batches: DataFrame, registry: DataFrame, key="agent_id") -> DataFrame:
    """Batches with ``accepted``: the agent is registered."""
    known = registry.select(c(key)).distinct().withColumn("_known", F.lit(True))
    return batches.join(known, key, "left").withColumn("accepted", F.coalesce("_known", F.lit(False))).drop("_known")


MAX_TRIES = 3


def dead_letters(rows: DataFrame, topic: str, error="parse_error", message_id="event_id") -> DataFrame:
    """Failed rows with the four headers of the dead-letter stream."""
    return rows.filter(c(error).isNotNull()).select(
        "raw", F.struct(F.lit(topic).alias("source_topic"), c(error).alias("reason"), F.lit(MAX_TRIES).alias("retries"),
                        c(message_id).alias("original_id")).alias("headers"))
