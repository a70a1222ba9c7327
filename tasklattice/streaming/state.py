"""What streaming queries with a keyed state share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep the state of queries started from now on in RocksDB: on the executors' disks, with changes in the checkpoint."""
    spark.conf.set(PROVIDER_CONF, PROVIDER)


@contextmanager
def state_partitions(spark: SparkSession, count: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in so many partitions, by default one per core; the first start decides."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, count or spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, before)
