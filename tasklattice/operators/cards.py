"""Task cards: a task with its parent, its subtasks and their counts, as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..session import materialise
from .hierarchy import child_breakdown, children
from .matching import resolve


def cards(tasks: DataFrame, refs: DataFrame, order: str = "text") -> DataFrame:
    """One card per task that a ref names: lines (id, part, no, line).

    Sorted by (id, part, no) they read as the card: 1 the task, 2 its parent,
    3 the subtasks in order, 4 their counts. A card is rows rather than one
    value, so a task with any number of subtasks has its whole card.
    """
    ids = materialise(resolve(refs, tasks).where("status = 'OK'").select("id").distinct())
    shown = tasks.join(ids, "id", "left_semi")
    # Counted for all parents first: a join on the parent would gather each family in one task.
    counts = child_breakdown(tasks).withColumnRenamed("parent", "id").join(ids, "id", "left_semi")

    def part(rows: DataFrame, number: int, line, key: str = "id", no=F.lit(1)) -> DataFrame:
        return rows.select(
            F.col(key).alias("id"), F.lit(number).alias("part"), no.cast("long").alias("no"), line.alias("line")
        )

    head = shown.join(
        counts.select("id", F.col("n_done").alias("subtasks_done"), F.col("total").alias("subtasks_total")),
        "id",
        "left",
    )
    parent_line = F.concat(F.lit("Parent: "), C.short_id(), F.lit(" - "), F.col("title"))
    child_ids = shown.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.col("id").alias("child"))
    teaser = F.when(
        F.col("description") != "", F.concat(F.lit("\n      "), C.first_line())
    ).otherwise("")
    return (
        part(head, 1, X.logstyle())
        .unionByName(part(child_ids.join(tasks.select("id", "title"), "id"), 2, parent_line, key="child"))
        .unionByName(
            part(
                children(tasks, ids, order), 3, F.concat(F.lit("  "), X.subtask_line(), teaser),
                key="parent", no=F.col("child_no"),
            )
        )
        .unionByName(part(counts, 4, F.col("summary")))
    )
