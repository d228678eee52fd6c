"""Shortcut checks: what can be told from metadata, from features, from the source; PCA; a linear head.

Linear probes of all scopes and folds are fitted together (`regressions`); forests on metadata by `forests`, scope by scope.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.evaluate import class_report, class_weights
from sievework.operators.forests import fold_votes
from sievework.operators.ranks import hash_ranked
from sievework.operators.regressions import C, fit_many, held_out_predictions
from sievework.operators.splits import stratified_folds
from sievework.session import SMALL_TABLE_ROWS, cut_lineage, small_table

# The probes of the shortcut report.
METADATA = ["width", "height", "aspect", "brightness", "sharpness_256", "file_bytes"]
FOLDS = 5
TREES = 300
DEPTH = 30  # trees are grown until their leaves are pure or as deep as that


def label_dictionary(df: DataFrame, label: str) -> list[str]:
    """Class names in alphabetical order; the index of a name is its model label."""
    return list(StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df).labels)


def with_vectors(df: DataFrame, features: str, out: str = "vec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def principal_components(df: DataFrame, features: str, k: int):
    """(fitted model, rows with `components` ARRAY<DOUBLE>)."""
    rows = with_vectors(df, features)
    model = PCA(k=k, inputCol="vec", outputCol="_pc").fit(rows)
    return model, model.transform(rows).withColumn("components", vector_to_array("_pc")).drop("vec", "_pc")


def cross_validated_f1(df: DataFrame, label: str, id_col: str, make, folds: int = FOLDS, seed: int = 0) -> DataFrame:
    """One row with macro_f1, the mean over folds. `make(data, classes, folds)` gives (fold, y_true, y_pred) of rows (id, fold, y, …)."""
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(df)
    data = cut_lineage(stratified_folds(index.transform(df), folds, seed, label, id_col).withColumn("id", F.col(id_col)))
    report = class_report(make(data, len(index.labels), folds), by=["fold"])
    return report.groupBy("fold").agg(F.avg("f1").alias("f1")).agg(F.bround(F.avg("f1"), 3).alias("macro_f1"))


@dataclass(frozen=True)
class Probe:
    """Predict `label` within each value of `scope` that has several labels: by regressions on the features, or by `make`."""

    name: str
    scope: str
    label: str
    make: Callable[[DataFrame, int, int], DataFrame] | None = None


def probe_table(trees: int = TREES, depth: int = DEPTH) -> list[Probe]:
    return [Probe("class_by_metadata", "crop", "class_id", lambda data, classes, folds: fold_votes(data, METADATA, classes, folds, trees, depth)),
            Probe("class_by_features", "crop", "class_id"), Probe("source_by_features", "class_id", "dataset_id")]


def label_shares(rows: DataFrame, scope: str, label: str) -> DataFrame:
    """(scope, note) for scopes with two labels or more: 'label share' of each label, the most frequent first."""
    counts = rows.filter(F.col(scope).isNotNull() & F.col(label).isNotNull()).groupBy(scope, label).agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))))
    listed = counts.groupBy(scope).agg(F.sum("n").alias("total"), ordered.alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    shares = F.transform("all", lambda x: F.concat(x["label"], F.lit(" "), F.format_number(F.bround(-x["n"] / F.col("total"), 3), 3)))
    return listed.select(F.col(scope).alias("scope"), F.concat_ws(", ", shares).alias("note"))


def linear_f1(rows: DataFrame, linear: Sequence[Probe], id_col: str, features: str, folds: int = FOLDS, seed: int = 0,
              c: float = C) -> DataFrame:
    """(probe, scope, macro_f1) of all linear probes in all scopes: the mean over folds, all models fitted together."""
    named = [rows.filter(F.col(p.scope).isNotNull() & F.col(p.label).isNotNull()).select(
        F.concat_ws("\x1f", F.lit(p.name), p.scope).alias("group"), F.col(p.label).alias("label"), F.col(id_col).alias("id"),
        F.col(features).alias("x")) for p in linear]
    ranked = hash_ranked(cut_lineage(reduce(DataFrame.unionByName, named)), ["group", "label"], "id", seed)
    fitted, data = fit_many(ranked.withColumn("fold", (F.col("_rank") - 1) % folds), "group", "label", "x", "fold", c)
    report = class_report(held_out_predictions(fitted, data), by=["group", "fold"])
    mean = report.groupBy("group", "fold").agg(F.avg("f1").alias("f1")).groupBy("group").agg(F.bround(F.avg("f1"), 3).alias("macro_f1"))
    parts = F.split("group", "\x1f", 2)
    return mean.select(parts[0].alias("probe"), parts[1].alias("scope"), "macro_f1")


def shortcut_report(items: DataFrame, id_col: str = "image_id", features: str = "features", folds: int = FOLDS,
                    probes: Sequence[Probe] | None = None) -> DataFrame:
    """(probe, scope, macro_f1, note). `items` are usable rows with crop, class_id, dataset_id, METADATA, features.

    Scopes come from the taxonomy and are few (more than SMALL_TABLE_ROWS are refused); every model is trained on
    the cluster, and the linear ones all at once.
    """
    spark = items.sparkSession
    chosen = probe_table() if probes is None else probes
    rows = cut_lineage(items.na.fill(0.0, METADATA).select(id_col, "crop", "class_id", "dataset_id", features, *METADATA))
    results = []
    for probe in chosen:
        notes = label_shares(rows, probe.scope, probe.label).limit(SMALL_TABLE_ROWS + 1).collect()
        if len(notes) > SMALL_TABLE_ROWS:
            raise ValueError(f"too many scopes for {probe.name}")
        if probe.make is None:
            table = small_table(spark, [(probe.name, scope, note) for scope, note in map(tuple, notes)], "probe STRING, scope STRING, note STRING")
            results.append((probe.name, table))
            continue
        for scope, note in sorted(map(tuple, notes)):
            part = rows.filter((F.col(probe.scope) == scope) & F.col(probe.label).isNotNull())
            f1 = cross_validated_f1(part, probe.label, id_col, probe.make, folds)
            results.append((None, f1.select(F.lit(probe.name).alias("probe"), F.lit(scope).alias("scope"), "macro_f1", F.lit(note).alias("note"))))
    linear = [p for p in chosen if p.make is None]
    scores = cut_lineage(linear_f1(rows, linear, id_col, features, folds)) if linear else None
    done = [t if name is None else t.join(scores, ["probe", "scope"], "left").select("probe", "scope", "macro_f1", "note") for name, t in results]
    return reduce(DataFrame.unionByName, done, small_table(spark, [], "probe STRING, scope STRING, macro_f1 DOUBLE, note STRING"))


def train_head(feature_rows: DataFrame, features: str = "features", reg: float = 1e-4):
    """Class-weighted softmax without a hidden layer on the train rows of (features, split, class_id): (labels, fitted
    pipeline). `heads.train_head` trains the head proper."""
    labels = label_dictionary(feature_rows, "class_id")
    train = feature_rows.filter(F.col("split") == "train")
    weighted = train.join(class_weights(train).select("class_id", "weight"), "class_id")
    index = F.array_position(F.array(*[F.lit(l) for l in labels]), F.col("class_id"))
    data = cut_lineage(with_vectors(weighted, features).select("vec", "weight", (index - 1).cast("double").alias("y")))
    model = Pipeline(stages=[
        StandardScaler(withMean=True, inputCol="vec", outputCol="scaled"),
        LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", family="multinomial",
                           standardization=False, regParam=reg, maxIter=200, tol=1e-4)]).fit(data)
    return labels, model


def score_head(rows: DataFrame, labels: Sequence[str], model, features: str = "features") -> DataFrame:
    """Add probs (in label order) and y_pred."""
    scored = model.transform(with_vectors(rows, features))
    names = F.array(*[F.lit(l) for l in labels])
    return scored.withColumns({
        "probs": vector_to_array("probability"), "y_pred": F.element_at(names, F.col("prediction").cast("int") + 1)}).drop(
        "vec", "scaled", "rawPrediction", "probability", "prediction")
