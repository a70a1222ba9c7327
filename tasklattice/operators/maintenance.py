"""Keeping a task table sound: audit, upgrade, append, update, delete."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    DEFAULT_AUTHOR,
    DEFAULT_PRIORITY,
    DEFAULT_STATE,
    KINDS,
    MUTABLE_COLUMNS,
    PRIORITIES,
    STATES,
    TASK_SCHEMA,
)
from ..session import materialise
from .ingest import validation_error
from .joins import left_lookup
from .links import on_cycles, reached, single_links
from .lifecycle import moment

LINKS = ("parent", "blocked_by")


class Change(NamedTuple):
    """The table after a change, and the rows that were refused with the reason."""

    tasks: DataFrame
    refused: DataFrame


def normalise(tasks: DataFrame) -> DataFrame:
    """Texts that may be absent are empty, links that may be absent are NULL."""
    return tasks.withColumns(
        {name: F.coalesce(name, F.lit("")) for name in ("description", "source", "tags")}
    )


def upgrade_snapshot(old: DataFrame) -> DataFrame:
    """A table of an older layout in today's: same rows, same links, missing values filled.

    Priority, state and author get their defaults where the column or the value
    is missing. Times stay NULL if unknown. Running it on an upgraded table
    changes nothing.
    """
    filled = {"priority": DEFAULT_PRIORITY, "state": DEFAULT_STATE, "author": DEFAULT_AUTHOR}

    def column(field) -> Column:
        value = F.col(field.name) if field.name in old.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in filled:
            value = F.coalesce(value, F.lit(filled[field.name]))
        return value.alias(field.name)

    return normalise(old.select(*map(column, TASK_SCHEMA.fields)))


def _dangling(rows: DataFrame, link: str, ids: DataFrame) -> DataFrame:
    """Rows whose link names no task."""
    target = ids.select(F.col("id").alias(link))
    return rows.where(F.col(link).isNotNull()).join(target, link, "left_anti")


def audit(tasks: DataFrame) -> DataFrame:
    """Every broken table rule: (id, rule, value). One row per broken rule and task row.

    Every id on a cycle of parents, or of blockers, is reported once; an id on several
    rows is followed along its smallest link.
    """

    def missing(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.struct(F.lit(f"{name} is missing").alias("rule"), F.lit("").alias("value")))

    def outside(name: str, allowed: tuple[str, ...]) -> Column:
        # NULL passes, as in a CHECK constraint.
        return F.when(
            ~F.col(name).isin(*allowed),
            F.struct(F.lit(f"{name} is unknown").alias("rule"), F.col(name).alias("value")),
        )

    broken = F.array_compact(
        F.array(
            missing("id"), missing("kind"), missing("title"), missing("author"),
            outside("priority", PRIORITIES), outside("state", STATES), outside("kind", KINDS),
        )
    )
    by_row = tasks.select("id", F.explode(broken).alias("v")).select("id", "v.rule", "v.value")
    repeated = (
        tasks.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("id", F.lit("id is repeated").alias("rule"), F.col("n").cast("string").alias("value"))
    )
    found = by_row.unionByName(repeated)
    for link in LINKS:
        found = found.unionByName(
            _dangling(tasks.select("id", link), link, tasks).select(
                "id", F.lit(f"{link} does not exist").alias("rule"), F.col(link).alias("value")
            )
        )
        cycles = on_cycles(single_links(tasks, link))
        found = found.unionByName(cycles.select("id", F.lit(f"{link} forms a cycle").alias("rule"), F.col("to").alias("value")))
    return found


def _first_refusal(rows: DataFrame, ids: DataFrame, error: Column, spread: str) -> DataFrame:
    """Add ``reason``: the first failed validation, else the first link without a target."""
    for link in LINKS:
        target = ids.select(F.col("id").alias(link), F.lit(True).alias(f"_{link}_found"))
        rows = left_lookup(rows, target, link, spread)
    lost = [
        F.when(F.col(link).isNotNull() & F.col(f"_{link}_found").isNull(), f"{link} does not exist")
        for link in LINKS
    ]
    return rows.withColumn("reason", F.coalesce(error, *lost)).drop(*(f"_{link}_found" for link in LINKS))


def append_tasks(tasks: DataFrame, new: DataFrame, order: str) -> Change:
    """Add valid new rows one after the other by ``order``; the others come back with a reason.

    A link must lead to an existing task or to an accepted row of the batch that
    comes earlier; rows of one place in the order do not see each other. Of rows
    with one id the first accepted one is taken. A NULL id is refused. Links
    inside the batch are followed in rounds, one per step of the longest chain.
    """
    no_id = F.when(F.col("id").isNull(), "id is missing")
    checked = new.withColumns(
        {
            "_error": F.coalesce(no_id, validation_error()),
            # Tells rows apart that agree in id and order.
            "_row": F.monotonically_increasing_id(),
        }
    )
    for link in ("id", *LINKS):
        target = tasks.select(F.col("id").alias(link), F.lit(True).alias(f"_{link}_stored"))
        checked = left_lookup(checked, target, link, order)
    inside = [F.col(link).isNotNull() & F.col(f"_{link}_stored").isNull() for link in LINKS]
    checked = materialise(checked.withColumn("_inside", inside[0] | inside[1]))

    place = F.struct(F.col(order).alias("at"), F.col("_row").alias("row"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min(place).alias("_first"))

    def with_links(rows: DataFrame, accepted: DataFrame) -> DataFrame:
        """Add ``_lost``: the first link that leads nowhere, given the ids accepted so far."""
        for link in LINKS:
            target = accepted.select(F.col("id").alias(link), F.col("_first.at").alias(f"_{link}_at"))
            rows = left_lookup(rows, target, link, order)
        found = lambda link: F.col(f"_{link}_stored").isNotNull() | F.coalesce(F.col(f"_{link}_at") < F.col(order), F.lit(False))
        lost = [F.when(F.col(link).isNotNull() & ~found(link), f"{link} does not exist") for link in LINKS]
        return rows.withColumn("_lost", F.coalesce(*lost))

    open_rows = checked.where(F.col("_error").isNull() & F.col("_id_stored").isNull())
    free = first(open_rows.where(~F.col("_inside")))
    linked = open_rows.where("_inside").select("id", order, "_row", *LINKS, *(f"_{link}_stored" for link in LINKS))
    accepted = materialise(free)
    # A row is accepted in the round after its links are, so the set of ids and
    # their first places settle; an earlier twin may still take a later one's place.
    while True:
        reached = with_links(linked, accepted).where(F.col("_lost").isNull())
        settled = materialise(first(free.withColumns({order: F.col("_first.at"), "_row": F.col("_first.row")}).select("id", order, "_row").unionByName(reached.select("id", order, "_row"))))
        changed = settled.join(accepted, ["id", "_first"], "left_anti")
        if changed.isEmpty():
            break
        accepted = settled

    winners = accepted.select("id", F.col("_first.row").alias("_winner"))
    judged = left_lookup(with_links(checked, accepted), winners, "id", order)
    taken = F.col("_id_stored").isNotNull() | ~F.equal_null(F.col("_row"), F.col("_winner"))
    judged = materialise(
        judged.withColumn("reason", F.coalesce("_error", "_lost", F.when(taken, "id exists already")))
    )
    fresh = judged.where(F.col("reason").isNull()).select(*tasks.columns)
    return Change(tasks.unionByName(fresh), judged.where(F.col("reason").isNotNull()).select("id", order, "reason"))


def upsert_fields(tasks: DataFrame, changes: DataFrame, at: datetime | str, order: str) -> Change:
    """Replace all fields but `id` and `created` where the id matches.

    Unknown ids change nothing. Of valid changes to one task the last by ``order`` holds.
    """
    judged = materialise(_first_refusal(changes, tasks, validation_error(), order))
    valid = judged.where(F.col("reason").isNull())
    last = valid.groupBy("id").agg(
        F.max_by(F.struct(*MUTABLE_COLUMNS), order).alias("_new")
    )
    matched = F.col("_new").isNotNull()
    values = {name: F.when(matched, F.col(f"_new.{name}")).otherwise(F.col(name)) for name in MUTABLE_COLUMNS}
    values["updated"] = F.when(matched, moment(at)).otherwise(F.col("updated").cast("timestamp_ntz"))
    after = tasks.join(last, "id", "left").withColumns(values).select(*tasks.columns)
    return Change(after, judged.where(F.col("reason").isNotNull()).select("id", order, "reason"))


def delete_tasks(tasks: DataFrame, ids: DataFrame) -> Change:
    """Delete tasks that no remaining task names as parent or blocker.

    A refused row stays, and so keeps its own parent and blocker. Those links are
    followed among the rows asked for, one kind at a time and each to its end
    by doubling, until neither kind leads to a further row.
    """
    edges = tasks.select("id", *LINKS)
    asked = ids.select("id").distinct()
    doomed = materialise(edges.join(asked, "id", "left_semi"))
    staying = edges.join(asked, "id", "left_anti")
    named = staying.select(F.explode(F.array_compact(F.array(*LINKS))).alias("id")).distinct()
    kept = materialise(doomed.select("id").join(named, "id", "left_semi"))
    inside = {}
    for link in LINKS:
        target = doomed.select(F.col("id").alias("to"))
        inside[link] = materialise(single_links(doomed, link).join(target, "to", "left_semi").select("id", "to"))
    idle, turn = 0, 0
    while idle < len(LINKS):
        more, count = reached(kept, inside[LINKS[turn % len(LINKS)]])
        turn += 1
        if count:
            kept = materialise(kept.unionByName(more))
        # A kind that was followed to its end has nothing more to add by itself.
        idle = 1 if count else idle + 1
    doomed = doomed.join(kept, "id", "left_anti")
    after = tasks.join(doomed.select("id"), "id", "left_anti")
    return Change(after, kept.withColumn("reason", F.lit("still referenced")))
