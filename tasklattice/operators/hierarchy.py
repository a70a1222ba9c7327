"""Parent links, block links and the roll-ups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import CLOSED_STATES
from . import ordering as O
from .joins import left_lookup

# The order and wording of the state counts in a subtask summary.
BREAKDOWN = (
    ("DONE", "done"),
    ("IN_PROGRESS", "in progress"),
    ("NEW", "new"),
    ("CANCELLED", "cancelled"),
)


def subtasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("parent").isNotNull())


def parents_of(tasks: DataFrame) -> DataFrame:
    """The ids that some task names as its parent, once each."""
    return subtasks(tasks).select(F.col("parent").alias("id")).distinct()


def open_child() -> Column:
    """True for a subtask that keeps its parent from being done."""
    return ~F.coalesce(F.col("state").isin(*CLOSED_STATES), F.lit(False))


def progress(tasks: DataFrame) -> DataFrame:
    """Total and done subtasks per parent, combined before the shuffle."""
    return subtasks(tasks).groupBy("parent").agg(
        F.count(F.lit(1)).alias("subtasks_total"),
        F.count_if(F.col("state") == "DONE").alias("subtasks_done"),
    )


def child_breakdown(tasks: DataFrame) -> DataFrame:
    """Subtask counts per parent and state, with the summary line."""
    names = {state: f"n_{state.lower()}" for state, _ in BREAKDOWN}
    counts = subtasks(tasks).groupBy("parent").agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("state") == state).alias(names[state]) for state, _ in BREAKDOWN),
    )
    parts = [
        F.when(F.col(names[state]) > 0, F.concat(F.col(names[state]).cast("string"), F.lit(" " + label)))
        for state, label in BREAKDOWN
    ]
    line = F.concat(
        F.lit("Total: "), F.col("total").cast("string"), F.lit(" subtasks ("),
        F.concat_ws(", ", *parts), F.lit(")"),
    )
    return counts.withColumn("summary", line)


def children(tasks: DataFrame, ids: DataFrame | None = None, order: str = "text") -> DataFrame:
    """Subtasks with their position ``child_no`` under the parent.

    ``ids`` restricts the parents. Parents that do not exist have no row here.
    """
    wanted = (tasks if ids is None else ids).select(F.col("id").alias("parent"))
    rows = subtasks(tasks).join(wanted, "parent", "left_semi")
    return O.running_number(rows, O.child_order(order), ["parent"], "child_no")


def _attach(tasks: DataFrame, link: str, prefix: str) -> DataFrame:
    """Left-join the linked task's short id and title; a missing target leaves nulls."""
    target = tasks.select(
        F.col("id").alias(link),
        C.short_id().alias(f"{prefix}_short"),
        F.col("title").alias(f"{prefix}_title"),
    )
    return left_lookup(tasks, target, link, "id")


def with_parent(tasks: DataFrame) -> DataFrame:
    return _attach(tasks, "parent", "parent")


def with_blocker(tasks: DataFrame) -> DataFrame:
    return _attach(tasks, "blocked_by", "blocker")


def blocking_children(tasks: DataFrame) -> DataFrame:
    """Per parent with open subtasks: how many, and the first one in subtask order."""
    first = F.struct(
        O.priority_text_rank().alias("rank"), F.col("created"), F.col("id"), F.col("state")
    )
    return (
        subtasks(tasks)
        .where(open_child())
        .groupBy("parent")
        .agg(F.count(F.lit(1)).alias("open_children"), F.min(first).alias("first"))
        .select(
            F.col("parent").alias("id"),
            "open_children",
            F.col("first.id").alias("open_child"),
            F.col("first.state").alias("open_child_state"),
        )
    )


def completable(tasks: DataFrame) -> DataFrame:
    """Every task with whether its subtasks allow it to be done, and what stands in the way."""
    return tasks.join(blocking_children(tasks), "id", "left").withColumns(
        {
            "open_children": F.coalesce("open_children", F.lit(0)),
            "completable": F.col("open_child").isNull(),
        }
    )
