"""Counts over whole tables. Each is one pass with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import ACTIVE_STATES, CLOSED_STATES, KINDS, PRIORITIES, STATES
from .hierarchy import parents_of

DIMENSIONS = (("state", STATES), ("kind", KINDS), ("priority", PRIORITIES))


def _counted(tasks: DataFrame, active_only: bool) -> DataFrame:
    if not active_only:
        return tasks
    return tasks.where(~F.coalesce(F.col("state").isin(*CLOSED_STATES), F.lit(False)))


def summary_counts(tasks: DataFrame, active_only: bool = False) -> DataFrame:
    """(dimension, value, n) for states, kinds and priorities, zeros included."""
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("dimension"), F.lit(value).alias("value"))
                for name, values in DIMENSIONS
                for value in values
            )
        )
    ).alias("v")
    fixed = tasks.sparkSession.range(1).select(rows).select("v.*")
    names = [name for name, _ in DIMENSIONS]
    counts = (
        _counted(tasks, active_only)
        .groupingSets([[name] for name in names], *names)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set"))
    )
    # The grouping id has a bit for each column left out, the first column highest.
    full = (1 << len(names)) - 1
    ids = {full - (1 << (len(names) - 1 - i)): name for i, name in enumerate(names)}
    in_set = [(F.col("_set") == set_id, name) for set_id, name in ids.items()]
    counts = counts.select(
        C.cases(in_set).alias("dimension"),
        C.cases((condition, F.col(name)) for condition, name in in_set).alias("value"),
        "n",
    )
    return fixed.join(counts, ["dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summary_totals(tasks: DataFrame, active_only: bool = False) -> DataFrame:
    """One row: total, active, blocked, parents, subtasks.

    A task is a parent if any task names it, also one that is not counted itself.
    """
    parents = parents_of(tasks).withColumn("_parent", F.lit(True))
    return (
        _counted(tasks, active_only)
        .select("id", "state", "parent", "blocked_by")
        .join(parents, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("state").isin(*ACTIVE_STATES)).alias("active"),
            F.count_if(C.is_blocked()).alias("blocked"),
            F.count_if("_parent").alias("parents"),
            F.count_if(F.col("parent").isNotNull()).alias("subtasks"),
        )
    )


def tag_counts(tasks: DataFrame) -> DataFrame:
    """How many times each tag is set."""
    return tasks.select(F.explode(C.tag_list()).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
