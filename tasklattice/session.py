"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def build_session(master: str | None = None, app: str = "tasklattice", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Adaptive execution does the sizing: it merges small shuffle partitions and
    splits skewed join partitions, so the same plan serves small and large tables.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh
    temporary folder, because there the driver's disk is the shared disk.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tasklattice-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for one run's files under the shared folder; unused so far."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result that is read more than once.

    Written as a table in the shared folder: it outlives lost executors, keeps
    column statistics, and lets later scans prune columns, which an RDD
    checkpoint does not.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder by way of Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` returned, once nothing reads them any more."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            delete_folder(table.sparkSession, path)
