"""Bounded, labelled samples for fitting, and settings shared by the operators that use Arrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.sources.shared import materialize


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows per Arrow batch and per batch of the Parquet reader; texts may be long and a batch is held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's decimal text modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until docs has no such column."""
    held, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """text, label of at most about `limit` labelled documents among the `allowed` ids, both classes in their natural share.

    Ids are drawn by hash, so the draw is repeatable. Labels other than 0 and 1 do not count; of contradicting labels 1 counts. The drawn
    ids are bounded by `limit`, so they are sent to all tasks and no text is shuffled but the sample's own.
    """
    known = labels.where(F.col(label).isin(0, 1) & allowed).groupBy("doc_id").agg(F.max(label).alias("label"))
    total = known.count()
    share = int(min(1.0, limit / total) * 1_000_000) if total else 0
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return materialize(rows.select("doc_id", "text", "label"), "sample")


def likely(rows: DataFrame, wanted: DataFrame, column: str, bits: int = 1 << 22) -> DataFrame:
    """rows whose `column` may be among the values of wanted: all that are, and few others while wanted is small against `bits`.

    A bitmap of hashes, of `bits` / 8 bytes whatever the data's size, goes to all tasks, so rows that a later join would drop need no shuffle.
    """
    return parted(rows, wanted, column, bits)[0]


def parted(rows: DataFrame, wanted: DataFrame, column: str, bits: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """The `likely` rows and all others, which are certainly not among the values of wanted."""
    own_block, own_place, own_map = unused(rows, "_block", "_place", "_map")

    def of(name: str) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(name), F.lit(bits))
        return F.floor(bit / 32768), bit % 32768

    block, place = of(column)
    maps = materialize(wanted.select(block.alias(own_block), place.alias(own_place)).groupBy(own_block).agg(F.bitmap_construct_agg(own_place).alias(own_map)), "bitmap")
    byte = F.conv(F.hex(F.expr(f"substring({own_map}, cast({own_place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), F.col(own_place) % 8)) % 2) == 1
    side = lambda how, keep: rows.withColumns({own_block: block, own_place: place}).join(F.broadcast(maps), own_block, how).where(keep).select(*[F.col(f"`{c}`") for c in rows.columns])
    return side("inner", hit), side("left", ~F.coalesce(hit, F.lit(False)))
