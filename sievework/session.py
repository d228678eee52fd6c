"""Session defaults for tests and benches, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Driver-side tables (rules, label maps, taxonomies) up to this many rows get a broadcast hint.
SMALL_TABLE_ROWS = 50_000
# The tables written in the current `scratch` scope.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
# Temporary folders of local runs that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app: str = "sievework", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and benches; on a cluster, use the session that is already there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local run leaves it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.applicationId in _LOCAL_FOLDERS:
        return _LOCAL_FOLDERS[spark.sparkContext.applicationId]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    _LOCAL_FOLDERS[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[spark.sparkContext.applicationId]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `cut_lineage` writes inside are deleted at the end. Results that read them must be written before."""
    written: list[str] = []
    mark = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(mark)
        for path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, prefix: str = "") -> str:
    """A new path in the shared folder, deleted at the end of the current `scratch` scope."""
    path = f"{shared_folder(spark)}/{prefix}{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def files_of(df: DataFrame, partition_by: Sequence[str] = ()) -> str:
    """Write `df` once to the shared folder, in folders by `partition_by`; its path."""
    path = shared_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The written table survives lost executors, is computed once however often it is used, and gives
    the planner its true size, so that later joins broadcast it only when it is small.
    """
    return df.sparkSession.read.schema(df.schema).parquet(files_of(df))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side configuration as a table; hinted for broadcast only when its known size is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= SMALL_TABLE_ROWS else df


def first_true(pairs: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    if not pairs:
        return otherwise if otherwise is not None else F.lit(None)
    case = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        case = case.when(cond, value)
    return case if otherwise is None else case.otherwise(otherwise)
