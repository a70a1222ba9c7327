"""Replay of an arriving command log on a keyed state store.

A key is a bucket of tasks by their ids' hash, the value the state, parent and number of
open children of each. A call to the state store costs far more than a task does, so a
batch makes three per bucket and not some per task. The task table is read once, when the
stream begins for the first time; after that a batch touches the buckets it names and
nothing else.

Only `done` looks at other tasks, and only down: so tasks are dealt to stages by their
height above the leaves. A stage runs the commands of its own tasks and tells each
parent, as an event for the parent's key, when a child opened or closed; parents stand
in later stages of the same batch. Commands for higher tasks and finished verdicts pass
through. A chain of tasks deeper than ``most_stages`` is for ``replay_stream``, whose
batches replay any depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.hierarchy import open_child, subtasks
from ..schema import CLOSED_STATES, COMMAND_RULES, COMMANDS, GUARDED_COMMAND
from ..session import materialise, release
from .replay import VERDICTS
from .state import use_disk_state

MOST_STAGES = 16
# Keys of the state store at each height; a stream is restarted with as many as it began with.
BUCKETS = 4096
# What passes from stage to stage. ``delta`` is set in an event for a parent, ``verdict`` in a finished row.
EVENT = "id string, seq long, command string, delta int, from_state string, to_state string, verdict string, bucket int"
# The tasks of a bucket as JSON: a list of (id, parent) that stays, and one of (state, opened) that is written again.
LINKS, NOW = "links string", "now string"
Event = Row(*(part.split()[0] for part in EVENT.split(", ")))
TARGETS = {(command, source): target for command, source, target in COMMAND_RULES}


def judge(command: str, state: str, opened: int) -> tuple[str, str | None]:
    """The verdict on a command, and the state it leads to if it is accepted."""
    if command not in COMMANDS:
        return "UNKNOWN_COMMAND", None
    if command == GUARDED_COMMAND and opened:
        return "OPEN_CHILDREN", None
    target = TARGETS.get((command, state))
    return ("ACCEPTED", target) if target else ("REFUSED", None)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _packed(rows: Iterable) -> str:
    return json.dumps(list(rows), separators=(",", ":"))


class Stage(StatefulProcessor):
    """Runs the commands of the tasks it keeps, in order of ``seq``, and passes on all other rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getValueState("links", LINKS)
        self.now = handle.getValueState("now", NOW)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        tasks = {task.get("id"): task for task in json.loads(initialState.tasks)}.values()
        self.links.update((_packed((task.get("id"), task.get("parent")) for task in tasks),))
        self.now.update((_packed((task.get("state"), task["opened"]) for task in tasks),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = []
        for row in rows:
            if row.verdict is None:
                waiting.append(row)
            else:
                yield row
        held = self.links.get() if waiting else None
        if held is None:
            yield from waiting
            return
        places = {task: (place, parent) for place, (task, parent) in enumerate(json.loads(held[0]))}
        now = json.loads(self.now.get()[0])
        changed = False
        # The rows of one bucket in one batch; the source's trigger options bound a batch.
        for row in sorted(waiting, key=lambda r: r.seq):
            if row.id not in places:
                yield row
                continue
            place, parent = places[row.id]
            state, opened = now[place]
            if row.delta is not None:
                now[place] = (state, opened + row.delta)
                changed = True
                continue
            verdict, target = judge(row.command, state, opened)
            yield Event(row.id, row.seq, row.command, None, state, target, verdict, None)
            if target:
                flip = (target not in CLOSED_STATES) - (state not in CLOSED_STATES)
                now[place] = (target, opened)
                changed = True
                if flip and parent is not None:
                    yield Event(parent, row.seq, None, flip, None, None, None, None)
        if changed:
            self.now.update((_packed(now),))

    def close(self) -> None:
        pass


def heights(tasks: DataFrame, most: int = MOST_STAGES) -> list[DataFrame]:
    """Ids by their height above the leaves: one written table per height from 1 on. ValueError beyond ``most`` heights."""
    links = tasks.select("id", "parent")
    level, found = links, []
    while True:
        above = materialise(subtasks(level).select(F.col("parent").alias("id")).distinct().join(links, "id"))
        if above.isEmpty():
            release(above)
            return found
        found.append(above)
        if len(found) >= most:
            raise ValueError(f"a chain of {most} parents or a cycle: use replay_stream")
        level = above


class States(NamedTuple):
    """The tasks before the first batch, (id, state, parent, opened, height), written; the number of heights, and of buckets at each."""

    table: DataFrame
    stages: int
    buckets: int


def initial_states(tasks: DataFrame, most_stages: int = MOST_STAGES, buckets: int = BUCKETS) -> States:
    """What the stream begins with, from tasks (id, parent, state). A task of a batch holds a bucket of one height in memory."""
    levels = heights(tasks, most_stages)
    opened = subtasks(tasks).where(open_child()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("opened"))
    known = tasks.select("id", "state", "parent").join(opened, "id", "left").withColumn("opened", F.coalesce("opened", F.lit(0).cast("long")))
    # The highest table that names a task tells its height.
    rows = [level.select("id", F.lit(number).alias("height")) for number, level in enumerate(levels, 1)]
    if rows:
        height = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.max("height").alias("height"))
        known = known.join(height, "id", "left").withColumn("height", F.coalesce("height", F.lit(0)))
    else:
        known = known.withColumn("height", F.lit(0))
    table = materialise(known)
    release(*levels)
    return States(table, len(levels) + 1, buckets)


def keyed_replay(log: DataFrame, states: States) -> DataFrame:
    """The verdicts on a feed (seq, id, command): (seq, id, command, from_state, to_state, verdict).

    In order of arrival, and by ``seq`` within a batch. A command without ``seq`` is NO_SEQ, one for
    an unknown task NOT_FOUND. All rows of one bucket in a batch are one task's work.
    """
    use_disk_state(log.sparkSession)
    empty = F.lit(None).cast("string")
    command = F.coalesce("command", F.lit(""))
    events = log.select(
        "id", F.col("seq").cast("long").alias("seq"), command.alias("command"), F.lit(None).cast("int").alias("delta"),
        empty.alias("from_state"), empty.alias("to_state"), F.when(F.col("seq").isNull(), "NO_SEQ").alias("verdict"),
    )
    bucket = bucket_of(states.buckets)
    for number in range(states.stages):
        level = states.table.where(F.col("height") == number).withColumn("bucket", bucket)
        held = F.to_json(F.collect_list(F.struct("id", "state", "parent", "opened"))).alias("tasks")
        start = level.groupBy("bucket").agg(held).groupBy("bucket")
        events = events.withColumn("bucket", bucket).groupBy("bucket").transformWithState(Stage(), EVENT, "Append", "None", start)
    # An event for a parent that is in no table ends here.
    judged = events.where(F.col("delta").isNull()).withColumn("verdict", F.coalesce("verdict", F.lit("NOT_FOUND")))
    return judged.select(*(part.split()[0] for part in VERDICTS.split(", ")))


def keyed_replay_stream(log: DataFrame, states: States, path: str) -> DataStreamWriter:
    """Write the verdicts of ``keyed_replay``, each exactly once, also over restarts."""
    found = keyed_replay(log, states)
    return found.writeStream.outputMode("append").format("parquet").option("path", f"{path}/verdicts").option("checkpointLocation", f"{path}/checkpoint")


def keyed_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICTS).parquet(f"{path}/verdicts")
