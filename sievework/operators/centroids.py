"""A small scoring model: similarity to the mean vector of each class."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import SMALL_TABLE_ROWS


def fit_centroids(vectors: DataFrame, label: str, features: str) -> dict[int, list[float]]:
    """Mean vector per class. Only the model comes to the driver, and only if it has few classes."""
    rows = vectors.select(label, array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    means = rows.groupBy(label).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("m"))
    found = means.select(label, F.transform("m", lambda x: F.round(x, 6)).alias("m")).limit(SMALL_TABLE_ROWS + 1).collect()
    if len(found) > SMALL_TABLE_ROWS:
        raise ValueError(f"more than {SMALL_TABLE_ROWS} classes")
    return {r[0]: list(r[1]) for r in sorted(found)}


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, x: total + x)


def centroid_scores(vectors: DataFrame, model: dict[int, list[float]], features: str, sharpness: float) -> DataFrame:
    """Add `probs`: one probability per class, in class order."""
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in model.values()])
    weighed = vectors.withColumn("_w", F.transform(centres, lambda c: F.exp(sharpness * _product(F.col(features), c))))
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    return weighed.withColumn("probs", F.transform("_w", lambda w: w / total)).drop("_w")
