"""Reading and writing the tables that pass between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.incremental import FIRST_VERSION, current_cache
from sievework.schema import FEATURES, HASH_CACHE, SPLITS, TAXONOMY, names


def read_table(spark: SparkSession, path: str, layout: str, fmt: str = "parquet") -> DataFrame:
    """A table with a known layout. Text files keep every value as written: only '' is a missing value."""
    reader = spark.read.schema(layout)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, layout: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Columns in the order of the layout; others are left out."""
    writer = df.select(*names(layout)).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_splits(splits: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The split table, in the order of data set, class and item."""
    write_table(splits.orderBy("dataset_id", "class_id", "image_id"), path, SPLITS, fmt)


def write_features(features: DataFrame, splits: DataFrame, path: str) -> None:
    """Features of the items that a split uses, with split, class and source; one row per item of `splits`."""
    rows = splits.filter("split <> 'unused'").join(features.select("image_id", "features"), "image_id")
    write_table(rows.withColumn("features", F.col("features").cast("array<float>")), path, FEATURES)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, FEATURES)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TAXONOMY, "csv")


def partial_path(path: str, partial: bool) -> str:
    """Runs over some datasets only never overwrite the whole table."""
    return path.rstrip("/") + ("_partial" if partial else "")


def append_cache(rows: DataFrame, path: str, version: str) -> None:
    """New hash results, stored by version so that a reader opens its own version only."""
    stamped = rows.withColumn("hash_version", F.lit(version).cast("string"))
    stamped.select(*names(HASH_CACHE)).write.mode("append").partitionBy("hash_version").parquet(path)


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    return current_cache(spark.read.schema(HASH_CACHE).parquet(path), version)


def adopt_unversioned_cache(rows: DataFrame, path: str) -> None:
    """Move a cache from before versioning to this layout, as version 1."""
    append_cache(rows, path, FIRST_VERSION)
