"""Reading task tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.maintenance import normalise
from ..schema import TASK_SCHEMA


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A task table with its fixed schema; nothing is inferred, unused columns are not read."""
    return normalise(spark.read.schema(TASK_SCHEMA).parquet(path))


def write_tasks(tasks: DataFrame, path: str, mode: str = "append") -> None:
    tasks.select(*TASK_SCHEMA.names).write.mode(mode).parquet(path)
