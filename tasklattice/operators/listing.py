"""Filters, ranked listings and text search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import DEFAULT_LIMIT, KINDS, LISTABLE_STATES, PRIORITIES, STATES
from ..session import materialise
from . import ordering as O
from .hierarchy import progress
from .joins import left_lookup


def pick(value: str | None, allowed: tuple[str, ...], what: str) -> str | None:
    """Match a filter value to its canonical spelling, in any letter case."""
    if not value:
        return None
    for candidate in allowed:
        if value.replace("-", "_").lower() == candidate.lower():
            return candidate
    raise ValueError(f"invalid {what}: {value} (must be one of {', '.join(allowed)})")


@dataclass(frozen=True)
class ListOptions:
    """What to list. Unknown values are refused here, before any plan exists."""

    state: str | None = None
    priority: str | None = None
    kind: str | None = None
    tag: str | None = None
    tag_match: str = "substring"
    blocked: bool = False
    show_done: bool = False
    show_cancelled: bool = False
    all: bool = False
    limit: int = DEFAULT_LIMIT

    def __post_init__(self) -> None:
        object.__setattr__(self, "state", pick(self.state, LISTABLE_STATES, "state"))
        object.__setattr__(self, "priority", pick(self.priority, PRIORITIES, "priority"))
        object.__setattr__(self, "kind", pick(self.kind, KINDS, "kind"))
        if self.tag_match not in ("substring", "exact"):
            raise ValueError(f"invalid tag match: {self.tag_match}")


def visible_states(options: ListOptions) -> Column:
    """Which states a listing without a state filter shows."""
    hidden = [] if options.all else ["INBOX", "INVALID"]
    if not options.show_done:
        hidden.append("DONE")
    if not options.show_cancelled:
        hidden.append("CANCELLED")
    return ~F.col("state").isin(hidden) if hidden else F.lit(True)


def matching(tasks: DataFrame, options: ListOptions) -> DataFrame:
    """All rows a listing selects, unordered. Filters stay on raw columns so the scan takes them."""
    rows = tasks.where(F.col("state") == options.state if options.state else visible_states(options))
    if options.priority:
        rows = rows.where(F.col("priority") == options.priority)
    if options.kind:
        rows = rows.where(F.col("kind") == options.kind)
    if options.tag and options.tag_match == "exact":
        rows = rows.where(F.array_contains(C.tag_list(), options.tag))
    elif options.tag:
        rows = rows.where(F.col("tags").ilike(f"%{C.escape_like(options.tag)}%"))
    if options.blocked:
        rows = rows.where(C.is_blocked())
    return rows


def list_tasks(tasks: DataFrame, options: ListOptions = ListOptions()) -> DataFrame:
    """The ranked listing; with a limit it runs as a top-k, without a full sort."""
    rows = matching(tasks, options).orderBy(*O.list_order())
    return rows.limit(options.limit) if options.limit > 0 and not options.all else rows


def list_with_progress(tasks: DataFrame, options: ListOptions = ListOptions()) -> DataFrame:
    """The listing with done and total subtasks of its root tasks.

    A short listing first says which parents to count at all; it is written, so
    the top-k runs once. The order is put back after the join.
    """
    listed = list_tasks(tasks, options)
    counted = tasks
    if options.limit > 0 and not options.all:
        listed = materialise(listed)
        counted = tasks.join(listed.select(F.col("id").alias("parent")), "parent", "left_semi")
    counts = progress(counted).withColumnRenamed("parent", "id")
    is_root = F.col("parent").isNull()
    listed = listed.withColumn("_root", F.when(is_root, F.col("id")))
    return (
        left_lookup(listed, counts.withColumnRenamed("id", "_root"), "_root", "id")
        .drop("_root")
        .withColumns(
            {name: F.coalesce(name, F.lit(0)) for name in ("subtasks_total", "subtasks_done")}
        )
        .orderBy(*O.list_order())
    )


def list_by_state(tasks: DataFrame, state: str) -> DataFrame:
    """All tasks in one state, newest first."""
    return tasks.where(F.col("state") == pick(state, STATES, "state")).orderBy(*O.newest_first())


def list_done(tasks: DataFrame) -> DataFrame:
    return list_tasks(tasks, ListOptions(state="DONE", all=True))


def list_cancelled(tasks: DataFrame) -> DataFrame:
    return list_tasks(tasks, ListOptions(state="CANCELLED", all=True))


def inbox(tasks: DataFrame) -> DataFrame:
    """Tasks waiting for review."""
    return list_by_state(tasks, "INBOX")


def active_count(tasks: DataFrame) -> DataFrame:
    """How many tasks the default listing holds without its limit."""
    return matching(tasks, ListOptions()).agg(F.count(F.lit(1)).alias("n"))


def search(tasks: DataFrame, query: str) -> DataFrame:
    """Tasks of any state whose title or description holds the text, newest first.

    ``%`` and ``_`` in the query are wildcards; a backslash is an ordinary character.
    """
    pattern = "%" + query.lower().replace("\\", "\\\\") + "%"
    hit = F.lower("title").like(pattern) | F.lower("description").like(pattern)
    return tasks.where(hit).orderBy(*O.newest_first())
