"""Replay of an arriving command log.

Every micro-batch is replayed with the batch operator, so a task or a tree of
tasks with a large share of the log spreads over the cluster in the same way.
A keyed state store would put each tree into a single task. What is kept
between batches is a table of changed states, one folder per batch, merged
every few batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.replay import replay
from ..session import materialise

CHANGES = "id string, state string, batch long"
VERDICTS = "seq long, id string, command string, from_state string, to_state string, verdict string"
MERGE_EVERY = 16


def _changes(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The last state of every task that changed before this batch."""
    merged_at = batch_id - batch_id % MERGE_EVERY
    folders = [f"{path}/changes/{n}" for n in range(merged_at, batch_id)]
    if merged_at:
        folders.append(f"{path}/merged/{merged_at}")
    if not folders:
        return spark.createDataFrame([], CHANGES)
    rows = spark.read.schema(CHANGES).parquet(*folders)
    return rows.groupBy("id").agg(F.max_by("state", "batch").alias("state"), F.max("batch").alias("batch"))


def _merge(spark: SparkSession, path: str, batch_id: int) -> None:
    """Fold the folders since the last merge into one table."""
    start = batch_id - MERGE_EVERY
    folders = [f"{path}/changes/{n}" for n in range(start, batch_id)]
    if start:
        folders.append(f"{path}/merged/{start}")
    rows = spark.read.schema(CHANGES).parquet(*folders)
    rows.groupBy("id").agg(F.max_by("state", "batch").alias("state"), F.max("batch").alias("batch")).write.mode(
        "overwrite"
    ).parquet(f"{path}/merged/{batch_id}")


def current_tasks(tasks: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The tasks as they stand before a batch."""
    changes = _changes(tasks.sparkSession, path, batch_id).select("id", F.col("state").alias("_state"))
    return (
        tasks.join(changes, "id", "left")
        .withColumn("state", F.coalesce("_state", "state"))
        .select(*tasks.columns)
    )


def replay_stream(log: DataFrame, tasks: DataFrame, path: str) -> DataStreamWriter:
    """Replay a feed (seq, id, command) in order of arrival, by ``seq`` within a batch.

    A batch that is run again starts from the same states and overwrites its own folders.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % MERGE_EVERY == 0:
            _merge(spark, path, batch_id)
        result = replay(current_tasks(tasks, path, batch_id), materialise(batch))
        result.history.write.mode("overwrite").parquet(f"{path}/verdicts/batch={batch_id}")
        accepted = result.history.where("verdict = 'ACCEPTED'")
        accepted.groupBy("id").agg(F.max_by("to_state", "seq").alias("state")).withColumn(
            "batch", F.lit(batch_id).cast("long")
        ).write.mode("overwrite").parquet(f"{path}/changes/{batch_id}")

    return log.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(step)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICTS + ", batch long").parquet(f"{path}/verdicts")
