"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every text becomes the set of its distinct shingles (hashes of `SHINGLE` words; fewer words are one shingle) and a signature of `COORDS` minima. Texts of
   equal sets are one class; everything below works on one representative of each class.
2. A representative is posted under each of its (coordinate, value) pairs. Documents that are similar enough agree on `need` coordinates or more (at a similarity of
   0.85 and 32 coordinates, fewer than 16 agreements happen to one pair in about three million; for other similarities the number has the same miss rate, `needed`). So, with pairs ordered by how many documents share them, two such documents
   meet within the rarest COORDS - need + 1 pairs of both: the longest lists (need - 1 of a document's) are skipped and only that prefix is joined. Pairs
   held by one document alone need no posting.
3. In each list, documents are first compared with a few centers of the list only; what links becomes components. Then documents outside the largest component of a list
   are compared with the documents of the list that are not in their own component, in blocks of `BLOCK` documents: first the `NEAREST` few of each block are confirmed, which
   connects most of what can be, then, with the new components, all of the lists where some had more than these. What is left out is connected already, so the components are those of
   comparing all pairs. A pair is looked at in the least list that both are in. Blocks return only pairs that pass the next step's first half.
4. Collisions are counted on longer signatures (`LONG` minima of a byte; at a similarity of 0.85 fewer than 399 agreements happen to four pairs in a million, and the same goes for others); what passes is
   confirmed on the full shingle sets. Both are made for documents with postings only.

Defined cases: null or empty texts and texts of white space have no shingle and link with nothing; repeated rows are one class; rows of one doc_id with different texts are told apart;
a null doc_id can be linked but names no component unless all of it is null; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, StructType

from quillwatch.llm.graph import components, joined
from quillwatch.llm.training import likely, parted, unused
from quillwatch.llm.words import SPACED, mix, raw
from quillwatch.sources.shared import materialize

SHINGLE, COORDS, LONG = 5, 32, 512
BLOCK, CENTERS, NEAREST = 1024, 2, 6
#: Agreements that are needed of so many coordinates at 85 %; they set the miss rate.
AT_85 = {COORDS: 16, LONG: 399}
_SALTS = mix(np.arange(1, 2 * LONG + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _fewer(n: int, coords: int, percent: int) -> int:
    """Chance of fewer than n agreements of `coords` at this similarity, times 100 ** coords."""
    return sum(comb(coords, k) * percent ** k * (100 - percent) ** (coords - k) for k in range(n))


def needed(percent: int, coords: int) -> int:
    """Most agreements that may be asked for at this similarity without missing more pairs than `AT_85` does at 85 %."""
    most = _fewer(AT_85[coords], coords, 85)
    n = 1
    while n < coords and _fewer(n + 1, coords, percent) <= most:
        n += 1
    return n


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after another, and their number in each row."""
    words, _, _, first = SPACED.words(*raw(column))
    rolled = words
    for k in range(1, SHINGLE):
        rolled = mix(rolled[:max(0, len(words) - k)] * _ROLL + words[k:])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a:b - SHINGLE + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * _ROLL + words[k:k + 1])
            sets.append(whole)
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.array([len(s) for s in sets], np.int64)


def signatures(sets: np.ndarray, size: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The least value of `coords` hashes over each set, as 32 bits; a row of zeros for an empty set."""
    out = np.zeros((len(size), coords), np.uint32)
    some = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[some]
    for lo in range(0, len(some), 256):  # rows at once, so that the sets stay near the processor
        hi = min(len(some), lo + 256)
        part = sets[at[lo]:at[hi] if hi < len(some) else len(sets)]
        for j in range(coords):
            v = (part ^ _SALTS[j]) * (_SALTS[LONG + j] | np.uint64(1))
            out[some[lo:hi], j] = (np.minimum.reduceat(v ^ (v >> np.uint64(32)), at[lo:hi] - at[lo]) >> np.uint64(32)).astype(np.uint32)
    return out


def _named() -> StructType:
    return StructType().add("n", LongType()).add("h1", LongType()).add("h2", LongType())


@arrow_udf(_named().add("sig", ArrayType(IntegerType())))
def sketch(texts: pa.Array) -> pa.Array:
    sets, size = shingle_sets(texts)
    sig = signatures(sets, size).view(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * COORDS), pa.array(sig.ravel()))
    return pa.StructArray.from_arrays([pa.array(size), *_sums(sets, size), lists], ["n", "h1", "h2", "sig"])


@arrow_udf(_named().add("set", ArrayType(LongType())).add("long", ArrayType(ByteType())))
def full_set(texts: pa.Array) -> pa.Array:
    sets, size = shingle_sets(texts)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(sets.view(np.int64)))
    low = mix(signatures(sets, size, LONG).astype(np.uint64)).astype(np.uint8).view(np.int8)
    return pa.StructArray.from_arrays([pa.array(size), *_sums(sets, size), lists, pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * LONG), pa.array(low.ravel()))], ["n", "h1", "h2", "set", "long"])


full_set = full_set.asNondeterministic()


def _sums(sets: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """Two sums over each set, which name it."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return [pa.array(np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[bounds]).view(np.int64)) for x in (sets, mix(sets))]


def _sized(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def postings(classes: DataFrame, percent: int = 85) -> DataFrame:
    """key, node, n: the prefix of every representative, rarest pairs first."""
    need = needed(percent, COORDS)
    posted = classes.select("node", "n", F.posexplode("sig").alias("coord", "value")).select("node", "n", (F.col("coord") * F.lit(1 << 32) + F.col("value").cast("long")).alias("key"))
    shared = posted.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("held > 1")  # moved once, not counted and then joined
    each = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "key"))).alias("pairs")).where(F.size("pairs") >= need)
    return each.select("node", "n", F.explode(F.slice("pairs", F.lit(1), F.size("pairs") - (need - 1))).alias("p")).select("p.key", "node", "n")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, counted: bool) -> DataFrame:
    """Pairs (a, b) with enough collisions whose full sets are similar enough. counted: collisions have been counted."""
    side = lambda c, v: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(v).alias(f"{v}{c}"))
    if not counted:
        agree = F.aggregate(F.zip_with("longa", "longb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        pairs = materialize(pairs.join(side("a", "long"), "a").join(side("b", "long"), "b").where(agree >= needed(percent, LONG)).select("a", "b"), "collisions")
    sets = likely(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), "node")  # only sets of these pairs are moved
    both = F.size(F.array_intersect("seta", "setb"))
    return materialize(pairs.join(side("a", "set"), "a").join(side("b", "set"), "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b"), "links")


def _compare(percent: int, nearest: int | None):
    """Within one task's cells: pairs of an asking and another document of a cell that collide often enough; the `nearest` of each asking one, or all. A row with a key only names a list where
    an asking document has more than that."""
    need = needed(percent, LONG)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("asks", "descending")])
        column = {c: table[c].to_numpy() for c in ("key", "i", "j", "asks", "node", "n", "part")}
        long = table["long"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, LONG)
        keys = table["keys"].combine_chunks()
        new = np.ones(table.num_rows + 1, bool)
        new[1:-1] = (column["key"][1:] != column["key"][:-1]) | (column["i"][1:] != column["i"][:-1]) | (column["j"][1:] != column["j"][:-1])
        found, cut = [], set()
        for a, b in zip(np.flatnonzero(new)[:-1].tolist(), np.flatnonzero(new)[1:].tolist(), strict=True):
            m = a + int(column["asks"][a:b].sum())
            n, part, others = column["n"][m:b], column["part"][m:b], long[m:b]
            for x in range(a, m):
                close = (np.minimum(n, column["n"][x]) * 100 >= np.maximum(n, column["n"][x]) * percent) & (part != column["part"][x])
                some = np.flatnonzero(close)
                agree = (others[some] == long[x]).sum(1)
                some, agree = some[agree >= need], agree[agree >= need]
                if nearest is not None and len(some) > nearest:
                    cut.add(int(column["key"][x]))
                    some = some[np.argsort(-agree, kind="stable")[:nearest]]
                own = set(keys[x].as_py()) if len(some) else set()
                for y in some.tolist():
                    if nearest is not None or min(own.intersection(keys[m + y].as_py())) == column["key"][x]:
                        found.append((min(column["node"][x], column["node"][m + y]), max(column["node"][x], column["node"][m + y])))
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        ends = [pa.concat_arrays([pa.array(pairs[:, side]), pa.nulls(len(cut), pa.int64())]) for side in (0, 1)]
        return pa.table([*ends, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(sorted(cut), pa.int64())])], names=["a", "b", "key"])
    return run


def links(docs: DataFrame, sketched: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node, root: components of class representatives, from links that connect what is connected."""
    lists = materialize(postings(classes, percent), "postings")
    wanted = lists.select("node").distinct()
    signed = classes.join(wanted, "node", "left_semi").select("node", "n", "h1", "h2")
    ids = materialize(sketched.join(wanted.select(F.col("node").alias("uid")), "uid", "left_semi").select("doc_id").distinct(), "wanted")
    read = likely(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "doc_id").join(ids.select(F.col("doc_id").alias("_id")), F.expr("doc_id <=> _id"), "left_semi")
    own = read.select(full_set("text").alias("s")).select("s.*")  # not deterministic for the optimiser, which would evaluate it twice
    sets = materialize(own.join(signed, ["n", "h1", "h2"]).dropDuplicates(["n", "h1", "h2"]).select("node", "n", "set", "long"), "sets")  # a class is a node; by the join's keys nothing moves twice

    stars = None
    for seed in range(CENTERS):
        center = lists.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(seed)), "node", "n")).alias("c")).select("key", F.col("c.node").alias("c"), F.col("c.n").alias("nc"))
        part = lists.join(center, "key").where(F.col("node") != F.col("c")).where(_sized(F.col("n"), F.col("nc"), percent)).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        stars = part if stars is None else stars.unionByName(part)
    tried = materialize(stars.distinct(), "stars")
    roots = components(_confirm(tried, sets, percent, counted=False))

    keys = lists.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most COORDS - need + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    for nearest in (NEAREST, None):
        parts = materialize(lists.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("part")), "parts")
        largest = parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "part")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("all"))
        open_lists = (largest.where("kinds > 1").select("key", F.col("top.part").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
                                                        F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("asking")))
        held = parts.join(open_lists, "key")
        asks = held.where("part != top").select("key", "node", "n", "part", of("asking").alias("i"), every("blocks").alias("j"), F.lit(1).alias("asks"))
        others = held.select("key", "node", "n", "part", every("asking").alias("i"), of("blocks").alias("j"), F.lit(0).alias("asks"))
        cells = materialize(asks.unionByName(others), "cells")
        tasks = max(1, -(-cells.count() // (4 * BLOCK)))
        full = cells.join(keys, "node").join(sets.select("node", "long"), "node").withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)))
        compared = materialize(full.groupBy("task").applyInArrow(_compare(percent, nearest), "a long, b long, key long").distinct(), "compared")
        pairs = materialize(compared.where("key IS NULL").select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        roots = joined(roots, _confirm(pairs, sets, percent, counted=True))
        cut = compared.where("key IS NOT NULL").select("key")
        if cut.isEmpty():
            break
        lists = lists.join(cut, "key", "left_semi")
    return roots


def cluster(docs: DataFrame, percent: int = 85) -> DataFrame:
    """uid, doc_id, text_key, n_shingles, component_id, keeper of every row. keeper: the row of its component that stays."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), sketch(text).alias("s"))
    sketched = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text_key", "s.n", "s.h1", "s.h2", "s.sig"), "sketches")
    same = ["n", "h1", "h2"]
    classes = materialize(sketched.where("n > 0").groupBy(*same).agg(F.min("uid").alias("node"), F.first("sig").alias("sig")), "classes")
    root = links(docs, sketched, classes, percent)
    of_class = materialize(classes.join(root, "node", "left").select(*same, F.coalesce("root", "node").alias("root")), "roots")
    placed = materialize(sketched.select("uid", "doc_id", "text_key", *same).join(of_class, same, "left").select("uid", "doc_id", "text_key", "n", F.coalesce("root", "uid").alias("root")), "placed")
    first = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("k"), F.count(F.lit(1)).alias("members"))
    several = materialize(first.where("members > 1").select("root", "component_id", F.col("k.uid").alias("keep")), "components")
    joined = placed.join(several, "root", "left")
    alone = F.col("keep").isNull()
    return joined.select("uid", "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                         (alone | (F.col("keep") == F.col("uid"))).alias("keeper"))


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id."""
    found = materialize(cluster(docs, percent).select("doc_id", "text_key", "keeper"), "clusters")
    gone = found.groupBy("doc_id", "text_key").agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("rows"))
    own_id, own_key, text_key, gone_row = unused(docs, "_id", "_key", "_text_key", "_gone")
    named = lambda rows: rows.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    lost = materialize(named(gone.where("NOT keeper")), "dropped")
    keyed = docs.withColumn(text_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    at = F.expr(f"doc_id <=> {own_id} AND {text_key} = {own_key}")
    maybe, sure = parted(keyed, lost.select(F.col(own_id).alias("doc_id")), "doc_id", 1 << 25)  # texts that certainly stay are not moved
    held = maybe.join(lost.withColumn(gone_row, F.lit(True)), at, "left").where(F.col(gone_row).isNull())  # an anti join would be pushed below the bitmap
    left = held.select(*[F.col(f"`{c}`") for c in keyed.columns]).unionByName(sure)
    if not gone.where("keeper AND rows > 1").isEmpty():  # whole rows repeated: keep one, but all of those without a shingle
        repeated = named(gone.where("keeper AND rows > 1"))
        once = left.join(repeated, at, "left_semi")
        some = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        left = left.join(repeated, at, "left_anti").unionByName(once.where(some).dropDuplicates(["doc_id", text_key])).unionByName(once.where(~F.coalesce(some, F.lit(False))))
    return left.drop(text_key)
