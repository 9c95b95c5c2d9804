"""Threat indicators: feed union, normal forms, lookups, hit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, ipv6
from quillwatch.sources.shared import materialize


def url_normal(value) -> Column:
    """Scheme and host in lower case, path kept; without a scheme all lower case."""
    v = c(value)
    at = F.locate("://", v)
    head = F.regexp_extract(v, r"^(.*?://[^/]*)", 1)
    return F.when(at > 0, F.concat(F.lower(head), F.substring(v, F.length(head) + 1, F.length(v)))).otherwise(F.lower(v))


def normal_value(kind, value) -> Column:
    k, v = c(kind), c(value)
    return (F.when(k == "ip", F.when(v.contains(":"), F.coalesce(ipv6(v), v)).otherwise(v)).when(k == "url", url_normal(v))
            .when(k == "domain", F.regexp_replace(F.lower(v), r"\.+$", ""))
            .otherwise(F.lower(v)))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), feeds)


def indicator_set(feed: DataFrame) -> DataFrame:
    """One row per (type, normal value): the type is part of the key."""
    return (feed.select("ioc_type", normal_value("ioc_type", "value").alias("value_norm"), "source", "severity")
            .groupBy("ioc_type", "value_norm").agg(F.min("source").alias("source"), F.min("severity").alias("severity")))


def urls_of() -> Column:
    """Addresses among the plain fields, in text order."""
    return F.array_sort(F.map_values(F.map_filter("fields", lambda _, v: v.startswith("http://") | v.startswith("https://"))))


def url_host(url) -> Column:
    return F.regexp_replace(F.regexp_extract(url_normal(url), r"://([^/:]*)", 1), r"\.+$", "")


#: The address columns hold dotted quads, whose text is canonical.
FIXED = [("ip", "src_ip"), ("ip", "dst_ip"), ("sha256", "file_hash")]


def fixed_value(kind: str, name: str) -> Column:
    return c(name) if kind == "ip" else normal_value(F.lit(kind), name)


ENTRY = "array<struct<pos:int,ioc_type:string,value_norm:string>>"


def entries(urls: Column, with_domain: bool = False) -> Column:
    """What an event has looked up, in order of precedence: its fixed columns, its addresses, then their hosts."""
    def entry(pos, kind, value):
        return F.struct(pos.alias("pos"), F.lit(kind).alias("ioc_type"), value.alias("value_norm"))
    parts = [F.array(*[entry(F.lit(i), kind, fixed_value(kind, x)) for i, (kind, x) in enumerate(FIXED)]),
             F.transform(urls, lambda u, i: entry(i + len(FIXED), "url", url_normal(u)))]
    if with_domain:
        parts.append(F.transform(urls, lambda u, i: entry(i + len(FIXED) + F.size(urls), "domain", url_host(u))))
    return F.filter(F.concat(*[F.coalesce(p, F.array().cast(ENTRY)) for p in parts]), lambda x: x["value_norm"].isNotNull())


def candidates(events: DataFrame, with_domain: bool = False) -> DataFrame:
    """Narrow rows (event_id, pos, type, value) to look up, in order of precedence."""
    return events.select("event_id", F.explode(entries(urls_of(), with_domain)).alias("x")).select("event_id", "x.*")


def hits(events: DataFrame, indicators: DataFrame, with_domain: bool = False) -> DataFrame:
    """Every match. A small set is broadcast by its statistics; a large one joins on (type, value),
    where adaptive execution splits a value that dominates the events."""
    return candidates(events, with_domain).join(indicators, ["ioc_type", "value_norm"])


def first_hits(events: DataFrame, indicators: DataFrame, with_domain: bool = False) -> DataFrame:
    first = F.min_by(F.struct("ioc_type", "value_norm", "source"), "pos").alias("h")
    return hits(events, indicators, with_domain).groupBy("event_id").agg(first).select(
        "event_id", c("h.ioc_type").alias("ioc_type"), c("h.value_norm").alias("ioc_value"), c("h.source").alias("ioc_feed"))


#: Bits per indicator, bits that each sets, words of a block, and blocks at most (32 MB).
BITS_EACH, SET_BITS, BLOCK_WORDS, MOST_BLOCKS = 20, 5, 64, 1 << 16


class Lookup:
    """Indicators written once, and a blocked Bloom filter over them.

    An indicator belongs to one block of 4 096 bits and sets `SET_BITS` bits in it. The filter is an array of words, at most `MOST_BLOCKS` blocks, which the plan takes
    in as a scalar subquery: tests are plain column arithmetic inside generated code. What it lets through wrongly (about one value in a thousand; more beyond
    13 million indicators) the exact join drops, so results do not depend on it."""

    def __init__(self, indicators: DataFrame):
        spark = indicators.sparkSession
        self.rows = materialize(indicators.select("ioc_type", "value_norm", "source", "severity"), "indicators")
        self.blocks = min(MOST_BLOCKS, max(1, -(-self.rows.count() * BITS_EACH // (64 * BLOCK_WORDS))))
        block, bits = self._places(c("ioc_type"), c("value_norm"))
        place = self.rows.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
        words = place.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        every = spark.range(self.blocks * BLOCK_WORDS).select(F.floor(c("id") / BLOCK_WORDS).alias("block"), (c("id") % BLOCK_WORDS).alias("word"))
        full = every.join(words, ["block", "word"], "left").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))).alias("held"))
        one = full.agg(F.sort_array(F.collect_list(F.struct("block", c("held")["mask"].alias("masks")))).alias("held")).select(F.flatten(c("held")["masks"]).alias("words"))
        self.words = materialize(one, "indicator-filter").select("words").scalar()

    def _places(self, kind: Column, value: Column) -> tuple[Column, list[Column]]:
        second = F.xxhash64(value, kind)
        return F.pmod(F.xxhash64(kind, value), F.lit(self.blocks)), [F.shiftrightunsigned(second, 12 * i).bitwiseAND(F.lit(4095)) for i in range(SET_BITS)]

    def maybe(self, kind: str, value: Column) -> Column:
        """False if the value is surely no indicator; false for no value."""
        block, bits = self._places(F.lit(kind), value)
        out = value.isNotNull()
        for bit in bits:
            word = F.get(self.words, (block * BLOCK_WORDS + F.shiftright(bit, 6)).cast("int"))
            out = out & (F.call_function("getbit", word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def flag(events: DataFrame, indicators: DataFrame | Lookup, with_domain: bool = False) -> DataFrame:
    """Events with ``ioc_hit`` and the winning indicator.

    Every event is tested against the filter by its own columns; those that fail it, nearly all without a hit, are done and are never moved. Only the rest
    (and events with several addresses) are joined with the indicators, as rows of their own, and brought together again by event."""
    look = indicators if isinstance(indicators, Lookup) else Lookup(indicators)
    d = events.withColumn("_urls", F.coalesce(urls_of(), F.array().cast("array<string>")))
    url = F.get("_urls", F.lit(0))
    keys = [(kind, fixed_value(kind, x)) for kind, x in FIXED] + [("url", url_normal(url))] + ([("domain", url_host(url))] if with_domain else [])
    maybe = F.size("_urls") > 1
    for kind, key in keys:
        maybe = maybe | look.maybe(kind, key)
    d = d.withColumn("_maybe", maybe)
    text = lambda x: F.lit(None).cast("string").alias(x)
    rest = d.filter("NOT _maybe").select(*events.columns, text("ioc_type"), text("ioc_value"), text("ioc_feed"))
    row = F.struct(*[c(f"`{x}`") for x in events.columns]).alias("_event")
    some = d.filter("_maybe").select(F.monotonically_increasing_id().alias("_row"), row, entries(c("_urls"), with_domain).alias("_looked_up"))
    some = some.select("_row", "_event", F.explode_outer("_looked_up").alias("_x")).select("_row", "_event", "_x.*")
    sides = look.rows.select(c("ioc_type").alias("_type"), c("value_norm").alias("_value"), "source")
    met = some.join(sides, (c("ioc_type") == c("_type")) & (c("value_norm") == c("_value")), "left")
    hit = F.when(c("_type").isNotNull(), F.struct("pos", c("source").alias("ioc_feed"), "ioc_type", c("value_norm").alias("ioc_value")))
    best = met.groupBy("_row").agg(F.first("_event").alias("_event"), F.min(hit).alias("_hit"))
    found = best.select("_event.*", "_hit.ioc_type", "_hit.ioc_value", "_hit.ioc_feed")
    return rest.unionByName(found).withColumn("ioc_hit", c("ioc_type").isNotNull())


def keep_hit(events: DataFrame, indicators: DataFrame | Lookup, negate: bool = False) -> DataFrame:
    return flag(events, indicators).filter(~c("ioc_hit") if negate else c("ioc_hit")).select(*events.columns)


def present_after(log: DataFrame, keys=("ioc_type", "value_norm"), top: int = 15) -> DataFrame:
    """Add/remove log: a value is present while adds exceed removes."""
    return log.groupBy(*keys).agg(F.sum("delta").alias("n")).filter("n > 0").withColumn("n", F.least("n", F.lit(top)))


def hit_stats(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.groupBy("source", "ioc_type").agg(F.count("*").alias("hits"), F.countDistinct("event_id").alias("events"))


def feed_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["ioc_type", "value_norm"]
    o, n = old.select(keys), new.select(keys)
    return (n.exceptAll(o).distinct().withColumn("change", F.lit("added"))
            .unionByName(o.exceptAll(n).distinct().withColumn("change", F.lit("removed"))))


def text_feed_rows(lines: DataFrame, kind: str, source: str) -> DataFrame:
    """Plain-text feed: one indicator per line, blank and ``#`` lines skipped."""
    v = strip(c("value"))
    return lines.select(F.lit(kind).alias("ioc_type"), v.alias("value"), F.lit(source).alias("source"),
                        F.lit(None).cast("string").alias("severity")).filter((c("value") != "") & ~c("value").startswith("#"))


def csv_feed_rows(lines: DataFrame, kind: str, source: str, column: int, header: str | None = None, keep=()) -> DataFrame:
    """Column ``column`` of a comma list; split limited so later commas stay in the tail; ``header``
    is the header line to drop (files may be split over tasks, so it is recognised by content). Columns of ``keep`` stay with their line."""
    t = strip(c("value"))
    cell = F.try_element_at(F.split(t, ",", column + 2), F.lit(column + 1))
    v = F.regexp_replace(strip(cell), '^"+|"+$', "")
    rows = lines.filter((t != "") & ~t.startswith("#"))
    if header is not None:
        rows = rows.filter(t != header)
    return rows.select(*keep, F.lit(kind).alias("ioc_type"), v.alias("value"), F.lit(source).alias("source"),
                       F.lit(None).cast("string").alias("severity")).filter(c("value") != "")


def misp_feed_rows(bodies: DataFrame, kind: str, source: str) -> DataFrame:
    """``{"Attribute":[{value,category}]}`` or a bare array of the same items."""
    item = "array<struct<value:string,category:string>>"
    items = F.coalesce(F.from_json("body", f"struct<Attribute:{item}>")["Attribute"], F.from_json("body", item))
    return (bodies.select(F.explode(items).alias("i"))
            .select(F.lit(kind).alias("ioc_type"), F.trim("i.value").alias("value"), F.lit(source).alias("source"), c("i.category").alias("severity"))
            .filter(c("value") != ""))


# Value fields of the JSON feed in order of preference.
JSON_FEED_FIELDS = ["sha256_hash", "url", "ioc", "hash", "domain", "ip_address"]


def json_feed_rows(bodies: DataFrame, kind: str, source: str) -> DataFrame:
    """``{"data":[...]}``; first present value field; severity from ``threat_type`` else ``tags``."""
    fields = ",".join(f"{f}:string" for f in JSON_FEED_FIELDS + ["threat_type", "tags"])
    items = F.from_json("body", f"struct<data:array<struct<{fields}>>>")["data"]
    i = lambda f: c(f"i.{f}")
    return (bodies.select(F.explode(items).alias("i"))
            .select(F.lit(kind).alias("ioc_type"), F.trim(F.coalesce(*[i(f) for f in JSON_FEED_FIELDS])).alias("value"),
                    F.lit(source).alias("source"), F.coalesce(i("threat_type"), i("tags")).alias("severity"))
            .filter(c("value") != ""))
