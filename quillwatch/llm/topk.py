"""Exact top-k inner products by dual-tree cover-tree search.

Rows are split into data blocks and queries into query blocks; every (query block, data block) is one task's group of bounded size. There, both sides get a cover tree: a node is a point and the radius
that covers its points; its children are a net of half that radius (of at most `FAN` points, where points beyond that go to the nearest one and the radius is measured). Pairs of
nodes are visited from the best bound on; the inner product of a pair's points is at most <p, q> + r_p |q| + r_q |p| + r_p r_q, and a pair is left out if that is less than
the worst k-th score of the query node. Equal bounds are visited, since ties are decided by id. Blocks return k rows for a query; Spark ranks them.

Products are sums of integers: exact in float64 below 2^53, else computed in int64.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; vectors are compared with those of their length only, empty
ones too; repeated rows are candidates each, and queries each; rows with the query's id are its own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF, FAN = 128, 24
NONE = np.iinfo(np.int64).min


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        self.center = points[rows[0]]
        self.norm = float(np.sqrt(self.center @ self.center))
        distance = np.sqrt(((points[rows] - self.center) ** 2).sum(1))
        self.radius = float(distance.max())
        self.rows, self.worst = rows, NONE
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius == 0:
            return
        reach, parts, left = self.radius / 2, [], rows
        centers = []
        while len(left) and len(parts) < FAN:
            d = distance if not parts else np.sqrt(((points[left] - points[left[0]]) ** 2).sum(1))
            centers.append(left[0])
            parts.append(left[d <= reach])
            left = left[d > reach]
        if len(left):
            c = points[centers]
            near = (((c ** 2).sum(1)) - 2 * points[left] @ c.T).argmin(1)
            parts = [np.concatenate([p, left[near == k]]) for k, p in enumerate(parts)]
        self.children = [Node(points, p) for p in parts]


def bound(q: Node, d: Node) -> float:
    value = float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
    return value + 1e-9 * abs(value) + 1e-6


class Search:
    def __init__(self, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.query_ids = ids, query_ids
        self.x, self.q = points.astype(np.float64), queries.astype(np.float64)
        largest = float(np.abs(self.x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(1, points.shape[1])
        self.exact = None if largest < 2 ** 53 else (points.astype(np.int64), queries.astype(np.int64))
        self.best = np.full((len(queries), k), NONE, np.int64)
        self.of = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.visit(Node(self.q, np.arange(len(queries))), Node(self.x, np.arange(len(points))))

    def leaves(self, q: Node, d: Node) -> None:
        if self.exact is None:
            score = np.rint(self.q[q.rows] @ self.x[d.rows].T).astype(np.int64)
        else:
            score = self.exact[1][q.rows] @ self.exact[0][d.rows].T
        ids = self.ids[d.rows]
        score = np.where(ids[None, :] == self.query_ids[q.rows][:, None], NONE, score)
        some = np.flatnonzero((score >= self.best[q.rows, -1:]).any(1))
        if len(some):
            rows = q.rows[some]
            score = np.concatenate([self.best[rows], score[some]], axis=1)
            of = np.concatenate([self.of[rows], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
            of = np.where(score == NONE, np.iinfo(np.int64).max, of)
            order = np.lexsort((of, ~score), axis=1)[:, :self.best.shape[1]]
            self.best[rows] = np.take_along_axis(score, order, 1)
            self.of[rows] = np.take_along_axis(of, order, 1)
        q.worst = int(self.best[q.rows, -1].min())

    def visit(self, q: Node, d: Node) -> None:
        stack = [(q, d, np.inf)]
        while stack:
            q, d, most = stack.pop()
            if most < q.worst:
                continue
            if not q.children and not d.children:
                self.leaves(q, d)
            elif d.children and (not q.children or d.radius >= q.radius):
                stack += sorted(((q, c, bound(q, c)) for c in d.children), key=lambda t: t[2])
            else:
                stack += [(c, d, bound(c, d)) for c in q.children]
                q.worst = min(c.worst for c in q.children)


def _cell(k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not data.num_rows or not queries.num_rows:
            return kind.empty_table()
        matrix = lambda t: t["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, t["dim"][0].as_py())
        found = Search(data["vec_id"].to_numpy(), matrix(data), queries["vec_id"].to_numpy(), matrix(queries), k)
        row, col = np.nonzero(found.best != NONE)
        return pa.table([pa.array(queries["vec_id"].to_numpy()[row]), pa.array(queries["query_key"].to_numpy()[row]), pa.array(found.of[row, col]), pa.array(found.best[row, col])], schema=kind)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every query. Components become floor(scale * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"), "is_query")
            .withColumn("row", F.monotonically_increasing_id()))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("m")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["m"] // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")  # noqa: E731  repeated rows are spread, too
    data = rows.select("vec_id", "q", F.size("q").alias("dim"), part(blocks).alias("block")).withColumn("query_block", every(query_blocks))
    asked = rows.where("is_query").select("vec_id", "q", F.col("row").alias("query_key"), F.size("q").alias("dim"), part(query_blocks).alias("query_block")).withColumn("block", every(blocks))
    keys = ["dim", "block", "query_block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_cell(k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
