"""Replay of an ordered command log over a whole table of tasks.

A command changes one task, and only `done` looks at others: it is refused
while a direct child is open *at that moment*. A child never looks at its
parent. So tasks are replayed in rounds: first all whose commands need no look
at children, then those whose children are settled, and so on upwards. The
number of rounds is the longest chain of parents that were told `done`; the
loop runs over rounds, never over rows.

Within a round every task is a state machine run over its commands in order.
A task with very many commands is cut into chunks of the log. A chunk acts on
the state as a function from states to states, functions compose, and
composing them in a tree of fixed fan-out gives the state at the start of
every chunk. All chunks then run side by side, so one task may hold any share
of the log.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import CLOSED_STATES, COMMAND_RULES, COMMANDS, GUARDED_COMMAND, STATES
from ..session import materialise, scratch_path
from .hierarchy import open_child, parents_of
from .joins import left_lookup
from .lifecycle import rule_target

# Tasks with more commands than this are replayed in chunks.
HOT_COMMANDS = 4096
# Chunks, and the groups that combine them, span 2**10 places of the level below.
CHUNK_BITS = 10
# Guard counts are summed per 2**20 log places before they are ordered per parent.
GUARD_BITS = 20
# The round of commands that find no task.
STRAY = -1

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("from_state", T.StringType()),
        T.StructField("to_state", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("parent_round", T.IntegerType()),
    ]
)


class Replay(NamedTuple):
    """Tasks with their final states, and one history row per command."""

    tasks: DataFrame
    history: DataFrame


def _state_index(state: str) -> Column:
    position = F.array_position(F.array(*map(F.lit, STATES)), F.col(state)) - 1
    return F.when(position >= 0, position).cast("int")


def _state_name(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATES)), index)


def _step(command: str = "command", allowed: str = "children_ok") -> Column:
    """What a command does, as an array that maps state numbers to state numbers."""
    branches = []
    for name in COMMANDS:
        target_of = {source: target for rule, source, target in COMMAND_RULES if rule == name}
        moves = [STATES.index(target_of.get(state, state)) for state in STATES]
        applies = F.col(command) == name
        if name == GUARDED_COMMAND:
            applies = applies & F.col(allowed)
        branches.append((applies, F.array(*map(F.lit, moves))))
    return C.cases(branches, _identity())


def _identity() -> Column:
    return F.array(*(F.lit(i) for i in range(len(STATES))))


def _composed(items: str) -> Column:
    """The steps of an ordered array, one after the other, as a single step."""
    return F.aggregate(
        items, _identity(), lambda done, item: F.transform(done, lambda at: F.get(item["step"], at))
    )


def _running_states(items: str, start: str) -> Column:
    """The state before each item of an ordered array."""
    empty = F.array().cast("array<int>")
    return F.aggregate(
        items,
        F.struct(F.col(start).alias("now"), empty.alias("seen")),
        lambda acc, item: F.struct(
            F.get(item["step"], acc["now"]).alias("now"),
            F.concat(acc["seen"], F.array(acc["now"])).alias("seen"),
        ),
        lambda acc: acc["seen"],
    )


def _chunk_starts(rows: DataFrame, span: int) -> DataFrame:
    """The state number at the start of every chunk of the hot tasks: (id, chunk, start).

    Up: combine runs of chunks into ever larger ones until each task is one
    piece. Down: hand the start state back through the same pieces.
    """
    level = (
        rows.groupBy("id", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "step"))).alias("items"))
        .select("id", "chunk", _composed("items").alias("step"))
    )
    levels = []
    while span > 1:
        span = (span >> CHUNK_BITS) + 1
        level = materialise(
            level.groupBy("id", F.shiftright("chunk", CHUNK_BITS).alias("above"))
            .agg(F.sort_array(F.collect_list(F.struct("chunk", "step"))).alias("items"))
            .withColumn("step", _composed("items"))
        )
        levels.append(level)
        level = level.select("id", F.col("above").alias("chunk"), "step")
    starts = rows.select("id", F.lit(0).cast("long").alias("chunk"), F.col("first_state").alias("start")).distinct()
    for level in reversed(levels):
        opened = level.withColumnRenamed("above", "chunk").join(starts, ["id", "chunk"])
        starts = opened.select(
            "id",
            F.explode(F.arrays_zip("items", _running_states("items", "start").alias("states"))).alias("item"),
        ).select("id", F.col("item.items.chunk").alias("chunk"), F.col("item.states").alias("start"))
    return starts


def _run(rows: DataFrame, hot_span: int) -> DataFrame:
    """Run the commands of each task in order.

    ``chunk`` is -1 for tasks that run in one piece. ``hot_span`` is the number
    of chunks in the log, 0 when no task needs any.
    """
    rows = rows.withColumn("step", _step())
    start = F.first("first_state")
    if hot_span:
        rows = materialise(rows)
        starts = _chunk_starts(rows.where("chunk >= 0"), hot_span)
        rows = rows.join(starts, ["id", "chunk"], "left")
        start = F.coalesce(F.first("start"), start)
    runs = rows.groupBy("id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("seq", "command", "children_ok", "step"))).alias("items"),
        start.alias("run_start"),
        F.first("parent").alias("parent"),
        F.first("parent_round").alias("parent_round"),
    )
    states = _running_states("items", "run_start").alias("states")
    return runs.select(
        "id", "parent", "parent_round", F.explode(F.arrays_zip("items", states)).alias("item")
    ).select(
        F.col("item.items.seq").alias("seq"),
        "id",
        F.col("item.items.command").alias("command"),
        F.col("item.items.children_ok").alias("children_ok"),
        _state_name(F.col("item.states")).alias("from_state"),
        "parent",
        "parent_round",
    )


def _judged(history: DataFrame) -> DataFrame:
    target = rule_target("command", "from_state")
    verdict = (
        F.when(F.col("from_state").isNull(), "NOT_FOUND")
        .when(~F.coalesce(F.col("command").isin(*COMMANDS), F.lit(False)), "UNKNOWN_COMMAND")
        .when((F.col("command") == GUARDED_COMMAND) & ~F.col("children_ok"), "OPEN_CHILDREN")
        .when(target.isNull(), "REFUSED")
        .otherwise("ACCEPTED")
    )
    return history.withColumn("verdict", verdict).withColumn(
        "to_state", F.when(F.col("verdict") == "ACCEPTED", target)
    )


def _rounds(tasks: DataFrame, log: DataFrame) -> tuple[DataFrame | None, int]:
    """(id, round) of the tasks that must wait for their children, and the number of rounds.

    Only parents with a `done` in the log wait, so the loop handles those alone.
    """
    told = log.where(F.col("command") == GUARDED_COMMAND).select("id").distinct()
    waiting = materialise(
        tasks.select("id", "parent").join(told, "id", "left_semi").join(parents_of(tasks), "id", "left_semi")
    )
    spark, path, count = tasks.sparkSession, scratch_path(tasks.sparkSession, "replay-rounds"), 0
    while not waiting.isEmpty():
        held = waiting.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
        marked = materialise(waiting.join(held.withColumn("held", F.lit(True)), "id", "left"))
        ready = marked.where("held IS NULL").select("id", "parent")
        if ready.isEmpty():
            raise ValueError("parent links form a cycle")
        count += 1
        ready.select("id").write.parquet(f"{path}/round={count}")
        waiting = marked.where("held").select("id", "parent")
    return (spark.read.schema("id string, round int").parquet(path) if count else None), count


def _open_at_start(nodes: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For all waiting parents at once, by their round: how many children are open from the start
    (id, n, round), and when others come to be (id, seq, delta, round)."""
    held = nodes.where(F.col("parent").isNotNull() & open_child()).select(F.col("parent").alias("id"), "born")
    path = scratch_path(nodes.sparkSession, "replay-open")
    first = held.where("born IS NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(waiting, "id")
    first.write.partitionBy("round").parquet(f"{path}/first")
    later = held.where("born IS NOT NULL").join(waiting, "id")
    later.select("id", F.col("born").alias("seq"), F.lit(1).alias("delta"), "round").write.partitionBy("round").parquet(f"{path}/later")
    read = lambda name, schema: nodes.sparkSession.read.schema(f"{schema}, round int").parquet(f"{path}/{name}")
    return read("first", "id string, n long"), read("later", "id string, seq long, delta int")


def _with_guard(rows: DataFrame, flips: DataFrame, opened: DataFrame) -> DataFrame:
    """Attach whether all children are closed at each command of the waiting tasks.

    ``flips`` (id, seq, delta) says when a child of ``id`` opened or closed,
    ``opened`` (id, n) how many were open from the start. The running sum is taken per
    stretch of the log, on top of the sums of the stretches before it.
    """
    events = rows.withColumn("delta", F.lit(0)).unionByName(flips, allowMissingColumns=True)
    events = events.withColumn("stretch", F.shiftright("seq", GUARD_BITS))
    earlier = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        events.groupBy("id", "stretch")
        .agg(F.sum("delta").alias("n"))
        .select("id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried"))
        .join(opened, "id", "left")
        .select("id", "stretch", (F.col("carried") + F.coalesce("n", F.lit(0))).alias("carried"))
    )
    inside = Window.partitionBy("id", "stretch").orderBy("seq")
    return (
        events.withColumn("inside", F.sum("delta").over(inside))
        .join(before, ["id", "stretch"])
        .where(F.col("command").isNotNull())
        .withColumn("children_ok", F.col("inside") + F.col("carried") == 0)
        .select(*rows.columns, "children_ok")
    )


def replay(tasks: DataFrame, log: DataFrame, hot_commands: int = HOT_COMMANDS) -> Replay:
    """Apply a log (seq, id, command[, at]) to the tasks, refusing what the rules forbid.

    ``seq`` is a unique whole number and gives the order. A command without one
    has no place in the log: it changes nothing and its verdict is NO_SEQ. A task may carry
    ``born``, the place in the log where it came to be; before that it neither
    takes commands nor holds its parent open.
    """
    spark = tasks.sparkSession
    has_birth = "born" in tasks.columns
    born = F.col("born") if has_birth else F.lit(None).cast("long")
    nodes = tasks.select("id", "parent", "state", born.alias("born"))
    unplaced = log.where(F.col("seq").isNull())
    log = log.where(F.col("seq").isNotNull()).withColumn("command", F.coalesce("command", F.lit("")))

    hot = log.groupBy("id").count().where(F.col("count") > hot_commands).select("id", F.lit(True).alias("hot"))
    hot = materialise(hot)
    low = hot_span = 0
    if not hot.isEmpty():
        low, high = log.agg(F.min("seq"), F.max("seq")).first()
        hot_span = ((high - low) >> CHUNK_BITS) + 1

    waiting, last_round = _rounds(tasks, log)
    known = nodes.select("id", "parent", _state_index("state").alias("first_state"), "born")
    if waiting is None:
        known = known.withColumns({"round": F.lit(0), "parent_round": F.lit(-1)})
    else:
        above = waiting.select(F.col("id").alias("parent"), F.col("round").alias("parent_round"))
        known = (
            left_lookup(known.join(waiting, "id", "left"), above, "parent", "id")
            .withColumns(
                {"round": F.coalesce("round", F.lit(0)), "parent_round": F.coalesce("parent_round", F.lit(-1))}
            )
        )
    known = known.join(hot, "id", "left") if hot_span else known.withColumn("hot", F.lit(False))
    placed = left_lookup(log, known, "id", "seq")
    missing = F.col("first_state").isNull() | F.coalesce(F.col("seq") < F.col("born"), F.lit(False))
    chunk = F.when(F.col("hot"), F.shiftright(F.col("seq") - low, CHUNK_BITS)).otherwise(F.lit(-1))
    work = placed.select(
        "seq",
        "id",
        "command",
        "first_state",
        "parent",
        F.coalesce("parent_round", F.lit(-1)).alias("parent_round"),
        chunk.cast("long").alias("chunk"),
        F.when(missing, STRAY).otherwise(F.coalesce("round", F.lit(0))).alias("round"),
    )
    work_path = scratch_path(spark, "replay-work")
    work.write.partitionBy("round").parquet(work_path)
    work = spark.read.schema(work.schema).parquet(work_path)

    # One folder per round, split by the round in which the parent will read it.
    history_path = scratch_path(spark, "replay-history")

    def record(rows: DataFrame) -> None:
        _judged(rows).select(*HISTORY_SCHEMA.names).write.mode("append").partitionBy("round", "parent_round").parquet(
            history_path
        )

    def recorded() -> DataFrame:
        return spark.read.schema(HISTORY_SCHEMA).parquet(history_path)

    strays = work.where(F.col("round") == STRAY).withColumns(
        {"from_state": F.lit(None).cast("string"), "children_ok": F.lit(True)}
    )
    if last_round:
        opened, births = _open_at_start(nodes, waiting)
    for number in range(last_round + 1):
        rows = work.where(F.col("round") == number).drop("round")
        if number == 0:
            rows = rows.withColumn("children_ok", F.lit(True))
        else:
            mine = F.col("round") == number
            flips = _flips(recorded(), number).unionByName(births.where(mine).drop("round"))
            rows = _with_guard(rows, flips, opened.where(mine).drop("round"))
        finished = _run(rows, hot_span).withColumn("round", F.lit(number))
        record(finished if number else finished.unionByName(strays.select(*finished.columns)))

    history = recorded().select("seq", "id", "command", "from_state", "to_state", "verdict")
    absent = F.lit(None).cast("string")
    refused = unplaced.select(
        F.col("seq").cast("long").alias("seq"), "id", F.coalesce("command", F.lit("")).alias("command"),
        absent.alias("from_state"), absent.alias("to_state"), F.lit("NO_SEQ").alias("verdict"),
    )
    return Replay(_final_tasks(tasks, history, log), history.unionByName(refused))


def _flips(history: DataFrame, number: int) -> DataFrame:
    """When the children of this round's parents opened (+1) or closed (-1)."""
    was_open = ~F.col("from_state").isin(*CLOSED_STATES)
    is_open = ~F.col("to_state").isin(*CLOSED_STATES)
    delta = is_open.cast("int") - was_open.cast("int")
    return (
        history.where((F.col("parent_round") == number) & (F.col("verdict") == "ACCEPTED"))
        .select(F.col("parent").alias("id"), "seq", delta.alias("delta"))
        .where("delta != 0")
    )


def _final_tasks(tasks: DataFrame, history: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks after the log: the state, and the time of the last change where the log has times."""
    accepted = history.where("verdict = 'ACCEPTED'")
    last = accepted.groupBy("id").agg(
        F.max_by("to_state", "seq").alias("_state"), F.max("seq").alias("_seq")
    )
    if "at" in log.columns and "updated" in tasks.columns:
        times = log.select(F.col("seq").alias("_seq"), F.col("at").cast("timestamp_ntz").alias("_at"))
        last = last.join(times, "_seq", "left").select("id", "_state", "_at")
        after = tasks.join(last, "id", "left").withColumn(
            "updated", F.coalesce("_at", F.col("updated").cast("timestamp_ntz"))
        )
    else:
        after = tasks.join(last, "id", "left")
    return after.withColumn("state", F.coalesce("_state", "state")).select(*tasks.columns)
