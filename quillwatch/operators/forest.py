"""Tree ensembles for scoring events: fitted by Spark over all training rows, kept as a table of nodes, walked by column expressions.

The saved model is the model file: one row per node. Scoring reads it once, as a bounded number of nodes, into arrays that are part of the expression, so
events are scored in their own scan, without a join, a shuffle or Python.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c
from quillwatch.sources.shared import new_folder

TREES, DEPTH, SEED = 16, 5, 7
#: Nodes that a model may have to be sent along with an expression. More are an error.
MOST_NODES = 200_000


def fit(rows: DataFrame, features, label, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str | None:
    """Folder of a random forest fitted to rows (features: array of numbers, label: 0 or 1; rows with nulls do not count). None without both labels."""
    d = rows.select(array_to_vector(c(features).cast("array<double>")).alias("features"), c(label).cast("double").alias("label"), c(features).alias("_x"))
    d = d.filter(c("label").isin(0, 1) & c("_x").isNotNull() & ~F.exists("_x", lambda x: x.isNull() | F.isnan(x.cast("double")))).drop("_x")
    if d.select("label").distinct().count() < 2:
        return None
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, subsamplingRate=1.0, maxMemoryInMB=64).fit(d)
    path = new_folder(rows.sparkSession, "forest")
    model.write().save(path)
    return path


def nodes(spark: SparkSession, path: str) -> list[dict]:
    """Trees as flat lists: for node n its feature, threshold, children (-1 at a leaf) and the share of label 1 among its training rows."""
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "leftChild", "rightChild", "split.featureIndex", F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), "impurityStats")
    held = data.limit(MOST_NODES + 1).collect()
    if len(held) > MOST_NODES:
        raise ValueError(f"model has more than {MOST_NODES} nodes")
    trees: dict[int, list] = {}
    for r in sorted(held, key=lambda r: (r["treeID"], r["id"])):
        trees.setdefault(r["treeID"], []).append(r)
    return [{"feature": [r["featureIndex"] for r in t], "threshold": [0.0 if r["threshold"] is None else r["threshold"] for r in t], "left": [r["leftChild"] for r in t],
             "right": [r["rightChild"] for r in t], "share": [r["impurityStats"][1] / max(1e-300, sum(r["impurityStats"])) for r in t]} for t in trees.values()]


def score(model: list[dict] | None, features, depth: int = DEPTH) -> Column:
    """Mean share of label 1 in the leaves that the features reach, 0 to 1. NULL without a model, for null features, and where there are fewer than the model asks for."""
    if not model:
        return F.lit(None).cast("double")
    x = c(features)
    asked = 1 + max((f for t in model for f in t["feature"]), default=-1)
    numbers = lambda xs, kind: F.array(*[F.lit(v) for v in xs]).cast(f"array<{kind}>")

    def share(t: dict) -> Column:
        feature, threshold, left, right, leaf = (numbers(t[k], kind) for k, kind in (("feature", "int"), ("threshold", "double"), ("left", "int"), ("right", "int"), ("share", "double")))

        def step(n, _):
            down = F.when(F.get(x, F.get(feature, n)).cast("double") <= F.get(threshold, n), F.get(left, n)).otherwise(F.get(right, n))
            return F.when(F.get(left, n) < 0, n).otherwise(down)
        return F.get(leaf, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step))
    shares = [share(t) for t in model]
    total = shares[0]
    for s in shares[1:]:
        total = total + s
    usable = (F.size(x) >= asked) & ~F.exists(x, lambda v: v.isNull())
    return F.when(usable, total / len(model))
