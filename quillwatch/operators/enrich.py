"""Joins that add context: assets, locations, identities, sequences, baselines, entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c, from_micros, ip_number, is_private_number, micros
from quillwatch.operators import split


def latest_by(df: DataFrame, keys, order) -> DataFrame:
    """Newest version per key, aggregated map-side before the shuffle."""
    rest = [x for x in df.columns if x not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def with_assets(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Case-insensitive host lookup within the tenant; tags appended once; a miss changes nothing.

    Hosts that differ in case only count once, the one of the smallest asset id."""
    a = (assets.groupBy(c("tenant_id").alias("_tenant"), F.lower("hostname").alias("_host"))
         .agg(F.min_by(F.struct("asset_id", c("tags").alias("_tags"), c("criticality").alias("asset_level")), "asset_id").alias("_a")).select("_tenant", "_host", "_a.*"))
    out = events.join(a, (F.lower(events["hostname"]) == a["_host"]) & (events["tenant_id"] == a["_tenant"]), "left").drop("_host", "_tenant")
    return out.withColumn("asset_tags", F.array_union(F.coalesce("asset_tags", F.array().cast("array<string>")),
                                                      F.coalesce("_tags", F.array().cast("array<string>")))).drop("_tags")


def with_assets_by_ip(events: DataFrame, assets: DataFrame, ip="src_ip") -> DataFrame:
    """``with_assets``, and for events whose host is not known the asset that has the event's address within the tenant."""
    found = with_assets(events, assets)
    a = (assets.filter("ip IS NOT NULL").groupBy(c("tenant_id").alias("_tenant"), c("ip").alias("_ip"))
         .agg(F.min_by(F.struct(c("asset_id").alias("_id"), c("tags").alias("_tags"), c("criticality").alias("_level")), "asset_id").alias("_a")).select("_tenant", "_ip", "_a.*"))
    out = found.withColumn("_by", F.when(c("asset_id").isNull(), c(ip))).join(a, (c("_by") == c("_ip")) & (found["tenant_id"] == c("_tenant")), "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"asset_id": F.coalesce("asset_id", "_id"), "asset_level": F.coalesce("asset_level", "_level"),
                            "asset_tags": F.array_union(F.coalesce("asset_tags", none), F.coalesce("_tags", none))}).drop("_tenant", "_ip", "_id", "_tags", "_level", "_by")


def with_locations(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Country and city of the source, country of the destination."""
    src = geo_lookup(events, "src_ip", ranges).withColumnsRenamed({"country": "src_country", "city": "src_city"})
    return geo_lookup(src, "dst_ip", ranges).withColumnRenamed("country", "dst_country").drop("city")


def with_criticality(events: DataFrame, assets: DataFrame) -> DataFrame:
    return with_assets(events, assets).withColumn("asset_criticality", F.coalesce("asset_level", F.lit("unknown")))


PREFIX = 1 << 16


def geo_lookup(ips: DataFrame, ip_col: str, ranges: DataFrame) -> DataFrame:
    """Country and city of each row's public address.

    Ranges are spread over the /16 blocks they touch, which turns the range condition into an
    equi-join on the block plus a check inside it; Spark broadcasts the range table only if its
    statistics allow. Private addresses and misses stay NULL.
    """
    blocks = ranges.withColumn("_blk", F.explode(F.sequence(F.floor(c("ip_from") / PREFIX), F.floor(c("ip_to") / PREFIX))))
    g = blocks.select("_blk", c("ip_from").alias("_from"), c("ip_to").alias("_to"), "country", "city")
    rows = ips.withColumn("_n", ip_number(ip_col)).withColumn("_ip", F.when(~is_private_number(c("_n")), c("_n"))).drop("_n").withColumn("_b", F.floor(c("_ip") / PREFIX))
    return (rows.join(g, (c("_b") == c("_blk")) & c("_ip").between(c("_from"), c("_to")), "left")
            .drop("_ip", "_b", "_blk", "_from", "_to"))


def with_identity(events: DataFrame, users: DataFrame) -> DataFrame:
    """Canonical user of a login within the tenant; of several the smallest."""
    u = users.groupBy(c("tenant_id").alias("_tenant"), F.lower("login").alias("_login")).agg(F.min("canonical_user").alias("canonical_user"))
    return events.join(u, (F.lower(events["user_name"]) == u["_login"]) & (events["tenant_id"] == u["_tenant"]), "left").drop("_login", "_tenant").withColumn(
        "canonical_user", F.coalesce("canonical_user", "user_name"))


def sequence(events: DataFrame, keys, first: Column, second: Column, within_s: int, width: int = split.HOUR) -> DataFrame:
    """Rows satisfying ``second`` that follow a ``first`` row of the same key within ``within_s``.

    Only the latest earlier ``first`` matters, so this is a running maximum, not a pair join:
    nothing multiplies however many rows share the key.
    """
    us = micros("ts")
    rows = events.filter((first | second) & F.concat(*[c(k) for k in keys]).isNotNull()).withColumn("_us", us)
    # Rows of one instant must not see each other: the maximum runs over strictly earlier instants.
    marks = rows.groupBy(*keys, "_us").agg(F.max(F.when(first, c("_us"))).alias("_a"))
    run = split.running_max(marks, keys, F.floor(c("_us") / width).cast("bigint"), ["_us"], {"a_us": c("_a")}, width)
    hit = run.filter(c("a_us") >= c("_us") - within_s * split.SECOND).select(*[c(k).alias(f"_k_{k}") for k in keys], c("_us").alias("_k_us"), "a_us")
    on = [rows[k] == hit[f"_k_{k}"] for k in keys] + [rows["_us"] == hit["_k_us"]]
    return rows.filter(second).join(hit, on).withColumn("a_ts", from_micros("a_us")).drop("_us", "_k_us", "a_us", *[f"_k_{k}" for k in keys])


def asof_daily(events: DataFrame, keys, daily: DataFrame, values) -> DataFrame:
    """Each event with the latest daily row strictly before its day.

    The daily table is extended with its predecessor per key (one row per key and day), so events
    find it by equality on (key, day). ``daily`` must have a row for every day on which a key is active.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("day")
    prior = daily.select(*[c(k).alias(f"_k_{k}") for k in keys], c("day").alias("_k_day"), F.lag("day").over(w).alias("baseline_day"),
                         *[F.lag(x).over(w).alias(x) for x in values])
    rows = events.withColumn("_day", F.to_date("ts"))
    on = [c(k) == c(f"_k_{k}") for k in keys] + [c("_day") == c("_k_day")]
    return rows.join(prior, on, "left").drop("_day", "_k_day", *[f"_k_{k}" for k in keys])


def coverage_gap(techniques: DataFrame, rules: DataFrame) -> DataFrame:
    return techniques.join(rules.select("technique").distinct(), "technique", "left_anti")


def zero_fill(catalog: DataFrame, counts: DataFrame, key: str, *measures) -> DataFrame:
    return catalog.join(counts, key, "left").fillna(0, subset=list(measures))


# ---- entity graph ----------------------------------------------------------------

def entity_nodes(events: DataFrame, risk="risk_score") -> DataFrame:
    """Users, hosts and addresses with last sighting and highest risk."""
    one = lambda kind, col: F.struct(F.lit(kind).alias("kind"), c(col).alias("id"))
    return (events.select("ts", c(risk).alias("risk"), F.explode(F.array(one("host", "hostname"), one("user", "user_name"), one("ip", "src_ip"))).alias("n"))
            .filter("n.id IS NOT NULL").groupBy("n.kind", "n.id").agg(F.max("ts").alias("last_seen"), F.max("risk").alias("max_risk")))


def entity_edges(events: DataFrame) -> DataFrame:
    """user → host and host → address, counted."""
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), c(a).alias("src"), c(b).alias("dst"))
    return (events.select("ts", F.explode(F.array(one("user_host", "user_name", "hostname"), one("host_ip", "hostname", "src_ip"))).alias("e"))
            .filter("e.src IS NOT NULL AND e.dst IS NOT NULL").groupBy("e.kind", "e.src", "e.dst")
            .agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")))


def lateral_movement(events: DataFrame, width: str, more_than: int) -> DataFrame:
    """Users reaching more than ``more_than`` hosts in a window."""
    return (events.filter("hostname IS NOT NULL").groupBy("tenant_id", "user_name", F.window("ts", width).alias("w"))
            .agg(F.countDistinct("hostname").alias("hosts")).filter(c("hosts") > more_than)
            .select("tenant_id", "user_name", c("w.start").alias("window_start"), "hosts"))
