"""WARC archives written and read by Spark's text files.

Writing: one record a row, ended by the record terminator, which is the line separator of the writer. Payloads equal to one of a smaller
page_id become revisit records. Only (digest, page_id) is grouped; payloads are not.

Reading: `lineSep` is the version line that begins every record, so any task that reads a part of a file gets whole chunks between two
magics, wherever they stand. The chunks of a file are its partition, so their lengths, added up by file part and then inside
it, give every chunk's offset. Each chunk whose header parses is a candidate record and points to the offset at which it ends. A magic inside a
payload also makes a candidate, so which are records is decided from the start of the file: candidates that end exactly where the next
one begins form runs; pointer jumping over runs (doubling, the number of rounds is known from the largest count of runs in a file) keeps what is
reachable from offset 0. Chunks of a payload that holds a magic are put together again. Bodies travel only for those.

Defined cases: null html is an empty payload; a null url gives a record without target; a null page_id comes after all others and is
written as an empty id; rows repeated with their page_id are written each, and those that repeat the first are responses as it is; line breaks in a url are percent-encoded;
other columns are ignored; records cut short at the end of a file are not returned; an empty table gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwatch.sources.shared import materialize

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four letters."""
    def letters(k: Column, hex_: Column) -> Column:
        n = F.conv(hex_.substr(k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.lit(BASE32).substr(F.shiftright(n, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for j in range(4)])
    return F.element_at(F.transform(F.array(F.sha1(payload)), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: letters(k, h)), "")), 1)


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a response or revisit record for every row of pages (page_id, url, html). Payloads of under `min_bytes` are never revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.select("*", digest(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").alias("bytes"))
    firsts = materialize(rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("digest", "first"), "warc-firsts")
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", _name(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", _name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"))
    rows.select(F.concat(head, F.when(again, "").otherwise(F.col("payload"))).alias("value")).write.option("lineSep", END).text(path)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk between two magics, with its offset; `end` is the offset that its own header claims, null where there is none."""
    value = F.col("value")
    bytes_ = value.cast("binary")
    rows = _raw(spark, path).withColumn("head", F.substring_index("value", END, 1)).withColumn("n", F.octet_length("value").cast("long"))
    rows = rows.withColumn("hlen", (F.octet_length("head") + len(END)).cast("long")).withColumn("length", F.when(F.col("hlen") <= F.col("n"), _header(F.col("head"), "content-length")).try_cast("long"))
    rows = rows.withColumn("whole", F.coalesce((F.col("n") == F.col("hlen") + F.col("length") + len(END)) & value.endswith(END), F.lit(False)))
    names = {"type": "warc-type", "id": "warc-record-id", "target": "warc-target-uri", "refers": "warc-refers-to"}
    rows = rows.select("file", "block", "seq", "n", "hlen", "length", "whole", *[F.when(F.col("length").isNotNull(), _header(F.col("head"), h)).alias(c) for c, h in names.items()],
                       F.when(F.col("whole"), digest(F.expr("substring(cast(value as binary), cast(hlen + 1 as int), cast(length as int))"))).alias("digest"))
    rows = materialize(rows, "warc-chunks")
    step = F.col("n") + len(MAGIC)
    base = (rows.groupBy("file", "block").agg(F.sum(step).alias("total"))
            .select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(base, ["file", "block"]).withColumn("at", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")
    return placed.withColumn("end", F.when(F.col("at") >= 0, F.col("at") + len(MAGIC) + F.col("hlen") + F.col("length") + len(END)))


def reachable(chunks: DataFrame) -> DataFrame:
    """file, block, at of the candidates that the chain from offset 0 meets."""
    by_part = Window.partitionBy("file", "block").orderBy("at")
    cand = chunks.where(F.col("end").isNotNull()).select("file", "block", "at", "end", F.lead("at").over(by_part).alias("next"), F.lag("end").over(by_part).alias("before"))
    landed = cand.where(F.col("next").isNull() | (F.col("next") != F.col("end"))).select("file", F.col("end").alias("at"), F.lit(True).alias("landed")).distinct()
    first = F.col("before").isNull() | (F.col("before") != F.col("at")) | F.col("landed").isNotNull()
    runs = cand.join(landed, ["file", "at"], "left").withColumn("run", F.max(F.when(first, F.col("at"))).over(by_part))
    runs = materialize(runs.select("file", "block", "at", "end", "run"), "warc-runs")
    state = runs.groupBy("file", F.col("run").alias("head")).agg(F.max("end").alias("to")).withColumn("reached", F.col("head") == 0)
    longest = state.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for k in range(max(0, longest - 1).bit_length()):
        hit = state.where("reached").select("file", F.col("to").alias("head"), F.lit(True).alias("hit")).distinct()
        jump = state.select("file", F.col("head").alias("to"), F.col("to").alias("further"))
        state = materialize(state.join(jump, ["file", "to"], "left").join(hit, ["file", "head"], "left")
                            .select("file", "head", F.col("further").alias("to"), (F.col("reached") | F.col("hit").isNotNull()).alias("reached")), f"warc-jump-{k}")
    return runs.join(state.where("reached").select("file", F.col("head").alias("run")), ["file", "run"], "left_semi").select("file", "block", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, at, type, id, target, refers, length, digest (of the record's own payload) of every record."""
    chunks = candidates(spark, path)
    kept = materialize(chunks.join(reachable(chunks), ["file", "block", "at"], "left_semi"), "warc-kept")
    columns = ["file", "at", "type", "id", "target", "refers", "length"]
    simple = kept.where("whole").select(*columns, "digest")
    torn = kept.where(~F.col("whole"))
    if torn.isEmpty():
        return simple
    # Chunks of records that hold a magic: every chunk belongs to the last record before it.
    by_part = Window.partitionBy("file", "block").orderBy("at")
    starts = kept.select("file", "block", "at", F.col("at").alias("owner"))
    owned = chunks.join(starts, ["file", "block", "at"], "left").withColumn("owner", F.last("owner", True).over(by_part))
    carried = (starts.groupBy("file", "block").agg(F.max("owner").alias("last"))
               .join(chunks.select("file", "block").distinct(), ["file", "block"], "right")
               .withColumn("carry", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))))
    owned = owned.join(carried.select("file", "block", "carry"), ["file", "block"]).withColumn("owner", F.coalesce("owner", "carry"))
    wanted = owned.join(torn.select("file", F.col("at").alias("owner"), F.col("end").alias("until")), ["file", "owner"]).where(F.col("at") < F.col("until")).select("file", "block", "seq", "owner", "at", "n")
    wanted = materialize(wanted, "warc-wanted")
    asked = wanted.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"))
    put = (_raw(spark, path).join(wanted, ["file", "block", "seq"]).where(F.octet_length("value") == F.col("n")).groupBy("file", "owner")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value"), F.count(F.lit(1)).alias("got"), F.sum("n").alias("got_all")))
    # Files that Spark splits otherwise on this read than on the first must not pass for what was asked: that is an error, and the job can be run again.
    same = F.coalesce((F.col("got") == F.col("parts")) & (F.col("got_all") == F.col("all")), F.lit(False))
    put = asked.join(put, ["file", "owner"], "left").withColumn("value", F.when(same, F.col("value")).otherwise(F.raise_error(F.lit("archives were split differently on the second read"))))
    joined = torn.drop("digest").join(put.select("file", F.col("owner").alias("at"), "value"), ["file", "at"])
    ended = F.expr(f"substring(cast(value as binary), cast(hlen + length + 1 as int), {len(END)})") == F.lit(END).cast("binary")
    return simple.unionByName(joined.where(ended).select(*columns, digest(F.expr("substring(cast(value as binary), cast(hlen + 1 as int), cast(length as int))")).alias("digest")))


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes the payload of the record that it refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    own = records.where("type != 'revisit'").select(number("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                                                     F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    known = records.where("type != 'revisit'").groupBy(F.col("id").alias("refers")).agg(F.min(F.struct("length", "digest")).alias("known"))
    seen = (records.where("type = 'revisit'").join(known, "refers", "left")
            .select(number("id").alias("page_id"), F.col("known.length").alias("payload_bytes"), F.col("known.digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to")))
    return own.unionByName(seen)
