"""Sort orders, and running numbers that never need one task per group.

Every order ends in ``id`` so that it is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def state_rank(state: str = "state") -> Column:
    return F.when(F.col(state) == "IN_PROGRESS", 0).when(F.col(state) == "NEW", 1).otherwise(2)


def priority_rank(priority: str = "priority") -> Column:
    """NULL for anything unknown, which sorts first."""
    col = F.col(priority)
    return F.when(col == "high", 0).when(col == "medium", 1).when(col == "low", 2)


def priority_text_rank(priority: str = "priority") -> Column:
    """The place of a priority when sorted by its letters, last to first."""
    col = F.col(priority)
    known = F.when(col == "medium", 0).when(col == "low", 1).when(col == "high", 2)
    return F.coalesce(known, F.lit(3))


def list_order() -> list[Column]:
    return [state_rank().asc(), priority_rank().asc(), F.desc("created"), F.asc("id")]


def newest_first() -> list[Column]:
    return [F.desc("created"), F.asc("id")]


def child_order(by: str = "text") -> list[Column]:
    """Subtask order. ``text`` sorts the priority by its letters (medium, low, high)."""
    if by == "text":
        return [F.desc("priority"), F.asc("created"), F.asc("id")]
    if by == "rank":
        return [priority_rank().asc(), F.asc("created"), F.asc("id")]
    raise ValueError(f"unknown child order: {by}")


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of a result that a limit has already cut short."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``row_number()`` over all rows, with one shuffle of them.

    Rows are range-partitioned and sorted, and each is written with its position
    in its partition. Partitions hold ascending ranges, so a row's number is its
    position plus the rows of all partitions before: a broadcast of one row per partition.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id holds the partition above 33 bits of position.
    placed = materialise(ranges.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + position + 1)
        .select(*df.columns, name)
    )


def running_number(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """``row_number()`` within ``keys``, with no group in one task. Keys are not null.

    Without keys see ``numbered``. With keys, rows are range-partitioned by keys and
    order and written with the number of their partition. Inside a partition they are numbered by a window; a group
    that began in an earlier partition goes on from the rows it has there. So a
    group that holds a third of all rows, or all of them, is spread by its order
    like any other, whatever its times and ids look like. Only counts per
    partition are summed across a group.
    """
    if not keys:
        return numbered(df, order, name)
    keys = list(keys)
    ranges = df.repartitionByRange(*(F.asc(key) for key in keys), *order)
    placed = materialise(ranges.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the groups that cross a border: at most one per partition.
    carried = materialise(
        placed.groupBy("_part", *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carried", F.sum("_n").over(earlier))
        .where(F.col("_carried") > 0)
        .select("_part", *keys, "_carried")
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(carried, ["_part", *keys], "left")
        .withColumn(name, F.col("_row") + F.coalesce("_carried", F.lit(0)))
        .select(*df.columns, name)
    )
