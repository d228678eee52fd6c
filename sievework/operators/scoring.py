"""From class probabilities to a short answer per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import SMALL_TABLE_ROWS

TOP_K = 3
MIN_CONFIDENCE = 0.35
# Accepted content types, size limit in bytes, and the texts of the answers.
CONTENT_TYPES = ["image/jpeg", "image/png", "image/webp"]
MAX_BYTES = 10 * 1024 * 1024
NOT_SURE_MESSAGE = "Not confident enough to name a disease. Try a clearer, closer photo."


NAMES = ("name_en", "name_hi", "crop")


class TaxonomyError(ValueError):
    pass


def argmax_index(probabilities: Column) -> Column:
    """Zero-based index of the largest value, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def top_k(scores: DataFrame, probs_col: str, k: int = TOP_K) -> DataFrame:
    """Add `top`: the k best (rank order, class_index, confidence to 4 decimals) within the row itself."""
    pairs = F.transform(F.col(probs_col), lambda p, i: F.struct(p.alias("p"), (-i).alias("i")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return scores.withColumn("top", F.transform(best, lambda x: F.struct(
        (-x["i"]).cast("int").alias("class_index"), F.bround(x["p"], 4).alias("confidence"))))


def missing_labels(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Model labels (class_index, class_id) that the taxonomy's model classes lack."""
    return labels.join(taxonomy.filter("in_model"), "class_id", "left_anti")


def name_alternatives(scored: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Add `named`: for each place of `top` its class, names, crop and confidence, looked up within the row."""
    unknown = missing_labels(labels, taxonomy)
    count = unknown.count()
    if count:
        some = ", ".join(r.class_id for r in unknown.limit(20).collect())
        raise TaxonomyError(f"{count} labels without a class (see missing_labels): {some}")
    info = labels.join(taxonomy.select("class_id", *NAMES), "class_id").limit(SMALL_TABLE_ROWS + 1).collect()
    if len(info) > SMALL_TABLE_ROWS:
        raise TaxonomyError(f"more than {SMALL_TABLE_ROWS} labels")
    entries = [x for r in info for x in (F.lit(r.class_index), F.struct(*[F.lit(r[c]).cast("string").alias(c) for c in ("class_id", *NAMES)]))]
    table = F.create_map(*entries)
    return scored.withColumn("named", F.transform("top", lambda t: F.struct(
        *[table[t["class_index"]][c].alias(c) for c in ("class_id", *NAMES)], t["confidence"].alias("confidence"))))


def gate(named: DataFrame, id_col: str, min_confidence: float = MIN_CONFIDENCE, message: str = NOT_SURE_MESSAGE) -> DataFrame:
    """One answer per item: status, top, alternatives, message."""
    sure = F.get("named", F.lit(0))["confidence"] >= min_confidence
    return named.select(
        id_col, F.when(sure, "ok").otherwise("not_sure").alias("status"), F.when(sure, F.get("named", F.lit(0))).alias("top"),
        F.when(sure, F.slice("named", F.lit(2), F.greatest(F.size("named"), F.lit(1)))).otherwise(F.col("named")).alias("alternatives"),
        F.when(~sure, F.lit(message)).alias("message"))


def input_error(content_type: Column, n_bytes: Column, readable: Column) -> Column:
    """415, 413 or 422, checked in this order; NULL for good input."""
    return (F.when(~F.coalesce(content_type.isin(CONTENT_TYPES), F.lit(False)), 415).when(n_bytes > MAX_BYTES, 413)
            .when(~readable, 422))
