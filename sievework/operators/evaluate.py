"""Classification metrics as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(train: DataFrame, label: str = "class_id") -> DataFrame:
    """Balanced weights n / (k · n_c), with n and k from the per-class counts."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    joined = counts.crossJoin(F.broadcast(totals))  # one row, put beside every class
    return joined.select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def confusion_counts(scored: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Counts of (truth, prediction) pairs; every metric below starts from this small table."""
    return scored.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(scored: DataFrame, labels: list, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Wide matrix over the given labels, zeros included: one row per true label. Another label stops the run."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(l,) for l in labels], scored.select(F.col(truth).alias("y_true")).schema)
    listed = [F.coalesce(F.col(c).isin(list(labels)), F.lit(False)) for c in ("y_true", "y_pred")]
    counts = confusion_counts(scored, truth, pred).groupBy("y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == l, F.col("n"))).alias(f"pred_{l}") for l in labels],
        F.min(F.when(~(listed[0] & listed[1]), F.concat_ws("/", "y_true", "y_pred"))).alias("_other"))
    stop = F.raise_error(F.concat(F.lit("label without a column: "), F.col("_other"))).cast("bigint")
    wide = grid.join(counts, "y_true", "full")
    return wide.select("y_true", *[F.when(F.col("_other").isNotNull(), stop).otherwise(F.coalesce(f"pred_{l}", F.lit(0))).alias(f"pred_{l}")
                                   for l in labels])


def class_report(scored: DataFrame, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 and support per label; 0 where the denominator is 0. `by` keeps runs apart."""
    pairs = scored.groupBy(*by, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    none = F.lit(0).cast("bigint")
    # each pair counts once for its true and once for its predicted label
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), none.alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")))
    sums = pairs.select(*by, F.explode(sides).alias("s")).select(*by, "s.*").groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hits = F.col("hits")
    return sums.select(
        *by, "label", ratio(hits, F.col("predicted")).alias("precision"), ratio(hits, F.col("support")).alias("recall"),
        ratio(2 * hits, F.col("predicted") + F.col("support")).alias("f1"), "support")


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.bround(F.avg("f1"), 4).alias("macro_f1"))


def per_source_accuracy(scored: DataFrame, truth: str = "y_true", pred: str = "y_pred", source: str = "dataset_id") -> DataFrame:
    """Accuracy per (class, source) for classes that come from two sources or more."""
    counts = scored.groupBy(F.col(truth).alias("class_id"), F.col(source).alias("dataset_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("hits"))
    several = counts.groupBy("class_id").agg(F.count("*").alias("sources")).filter(F.col("sources") >= 2)
    return counts.join(several, "class_id", "left_semi").select(
        "class_id", "dataset_id", "n", F.bround(F.col("hits") / F.col("n"), 3).alias("accuracy"))
