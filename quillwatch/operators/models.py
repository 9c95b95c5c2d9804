"""Batch scoring with an exported linear model, in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwatch.functions.scalars import c


def score(weights: Column | list[float] | None, features) -> Column:
    """Weighted sum of an array column, clamped to 0-1; NULL without a model or where the widths differ."""
    if weights is None:
        return F.lit(None).cast("double")
    w = F.array(*[F.lit(float(x)) for x in weights]) if isinstance(weights, list) else weights
    products = F.zip_with(c(features), w, lambda x, y: x.cast("double") * y)
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(c(features)) == F.size(w), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
