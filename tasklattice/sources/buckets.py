"""A stored task table in buckets of ids, of which a change rewrites those it touches and no others.

The folders are ``buckets=<number>/bucket=<n>``; a task's bucket is a hash of its id, so buckets are
of like size whatever the families or dates. Written again, a change gives the same table: after a
broken run it is simply repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import normalise
from ..schema import TASK_SCHEMA
from ..session import delete_folder, materialise, release

BUCKETS = 64


def _placed(tasks: DataFrame, buckets: int) -> DataFrame:
    return tasks.select(*TASK_SCHEMA.names).withColumns({"buckets": F.lit(buckets), "bucket": _bucket("id", buckets)})


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def write_buckets(tasks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a table; the number of buckets stays."""
    _placed(normalise(tasks), buckets).repartition("bucket").write.partitionBy("buckets", "bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TASK_SCHEMA.fields)
    return spark.read.schema(f"{fields}, buckets int, bucket int").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).select(*TASK_SCHEMA.names)


def write_back(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None) -> list[int]:
    """Put new versions of tasks, and new tasks, in the stored table and take out the ids ``removed``; the buckets written.

    An id that is both is kept. Only the buckets of these ids are read and written; their numbers are all that the driver sees.
    """
    table = _stored(spark, path)
    number = table.select("buckets").first()
    if number is None:
        raise ValueError(f"{path} has no rows to tell its buckets by")
    fresh = materialise(_placed(normalise(changed), number.buckets))
    gone = fresh.select("id") if removed is None else fresh.select("id").unionByName(removed.select("id")).distinct()
    touched = sorted(r.bucket for r in gone.select(_bucket("id", number.buckets).alias("bucket")).distinct().collect())
    # Spark must not read the folders that it writes.
    kept = table.where(F.col("bucket").isin(touched)).join(gone, "id", "left_anti").select(*fresh.columns)
    after = materialise(kept.unionByName(fresh))
    after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)
    filled = {r.bucket for r in after.select("bucket").distinct().collect()}
    for bucket in touched:
        if bucket not in filled:
            delete_folder(spark, f"{path}/buckets={number.buckets}/bucket={bucket}")
    release(fresh, after)
    return touched
