"""The forest's column expression against the library's own probabilities, held-out anomalies, and defined cases."""

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillwatch.operators import forest
from quillwatch.plans import analysis


def test_scores_equal_the_fitted_model(spark, root):
    rows = analysis.behaviour(spark, root)
    path = forest.fit(rows.filter("NOT held_out"), "x", "label", trees=5, depth=4)
    model = forest.nodes(spark, path)
    own = RandomForestClassificationModel.load(path).transform(rows.withColumn("features", array_to_vector("x")))
    diff = own.withColumn("mine", forest.score(model, "x", 4)).select(F.max(F.abs(F.col("mine") - vector_to_array("probability")[1]))).first()[0]
    assert diff < 1e-9 and len(model) == 5
    odd = spark.createDataFrame([([1.0, None, 0.0, 1.0, 1.0, 1.0, 1.0],), ([1.0],), (None,)], "x array<double>")
    assert [r[0] for r in odd.select(forest.score(model, "x", 4)).collect()] == [None] * 3
    assert [r[0] for r in odd.select(forest.score(None, "x")).collect()] == [None] * 3
    assert forest.fit(rows.filter("label = 0"), "x", "label") is None and forest.fit(rows.limit(0), "x", "label") is None


def test_held_out_anomalies_are_found(spark):
    out = analysis.forest_scores(spark, "/root/testdata/sf0.01").filter("held_out").groupBy("label", "predicted").count().collect()
    n = {(r["label"], r["predicted"]): r["count"] for r in out}
    found, missed, wrong = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    assert found / (found + missed) > 0.8 and found / (found + wrong) > 0.9, n
