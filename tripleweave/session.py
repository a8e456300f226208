"""Session helpers: settings for large runs and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings for skewed, large graphs.  Values the session already carries are left alone.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the next operator wanted the join's own partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # rows of terms repeat kinds and datatypes and shrink some twenty times in a shuffle: a task of the default 64 MB would hold
    # more than a GB of them, and as many partitions as small data want would grow with large data; up to 200 partitions are
    # written without being sorted in memory first
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 << 20),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    # file contents travel to the Python parsers in batches of bounded size
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tripleweave-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Scratch folders of the work that is to clear them away, innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the scratch root."""
    path = f"{scratch_root(spark)}/tripleweave/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside when it ends: for work whose result does not read them any more.

    Checkpoints are Spark's own to clean (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield
    finally:
        _SCOPES.remove(mine)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a scratch table and read it back: short lineage, nothing is computed twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its partitions in their order; a table does not keep that."""
    context = df.sparkSession.sparkContext
    root = scratch_root(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return df.checkpoint()


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that carry file contents to Python, unless the session already does."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, TUNING[key])


def counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with its rows (``which``: those of them) counted while it is used; read the count with :func:`rows_seen` after the action."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")), seen


def rows_seen(seen: Observation, recount: DataFrame) -> int:
    """The observed count.  Spark may drop an observation together with a plan that it finds to be empty; then ``recount``,
    what was written or read, is counted, so that no other failure can pass for an empty result."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return recount.count()
