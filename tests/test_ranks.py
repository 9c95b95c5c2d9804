"""Medians, places and ranks against sorting; the plan never holds a key's rows."""

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from quillwatch.operators import ranks


def test_medians_equal_sorting(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in "abcdef" for v in [rng.choice([rng.randrange(-10**12, 10**12), rng.randrange(5), None]) for _ in range(rng.randrange(1, 400))]]
    rows += [("one", 7), ("two", -3), ("two", 4), (None, 5), (None, 6), (None, 9), ("none", None), ("wide", -2**61), ("wide", 2**61)] + [("hot", 11)] * 3000 + [("hot", 2**40)] * 2999
    table = spark.createDataFrame(rows, "k string, v bigint").repartition(7)
    want = defaultdict(list)
    for k, v in rows:
        if v is not None:
            want[k].append(v)
    got = {r["k"]: r["twice"] for r in ranks.doubled_medians(table, ["k"], "v").collect()}
    middle = lambda xs: sorted(xs)[(len(xs) - 1) // 2] + sorted(xs)[len(xs) // 2]
    assert got == {k: middle(xs) for k, xs in want.items()}
    assert got["a"] == 2 * statistics.median(want["a"])
    assert ranks.doubled_medians(table.limit(0), ["k"], "v").count() == 0


def test_places_and_ranks_equal_sorting(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(2000)] + [("hot", 1, i) for i in range(500)]
    table = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r["i"] if r["g"] != "hot" else -1 - r["i"]: r["n"] for r in ranks.numbered(table, ["g"], [F.col("v").desc_nulls_last(), F.col("i")], "n").collect()}
    dense = {(r["g"], r["v"]): r["rank"] for r in ranks.dense_ranks(table, ["g"], "v").collect()}
    for g in ("a", "b", None, "hot"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2] if g != "hot" else -1 - r[2]] for r in mine] == list(range(len(mine)))
        values = list(dict.fromkeys(r[1] for r in mine))
        assert [dense[g, x] for x in values] == list(range(1, len(values) + 1))
    assert ranks.dense_ranks(table.limit(0), ["g"], "v").count() == 0
