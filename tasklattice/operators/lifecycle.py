"""State changes and block links: tables of requests judged on a snapshot of the tasks."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import COMMAND_RULES, COMMANDS, GUARDED_COMMAND
from ..session import materialise
from .hierarchy import blocking_children
from .joins import left_lookup
from .matching import resolve


class Outcome(NamedTuple):
    """The table after the requests, and one verdict per request."""

    tasks: DataFrame
    verdicts: DataFrame


def moment(at: datetime | str | Column) -> Column:
    return (at if isinstance(at, Column) else F.lit(at)).cast("timestamp_ntz")


def rule_target(command: Column | str, state: Column | str) -> Column:
    """The state a command leads to from a state; NULL where no rule allows it."""
    command, state = C.as_col(command), C.as_col(state)
    return C.cases(
        ((command == name) & (state == source), target) for name, source, target in COMMAND_RULES
    )


def allowed_next(state: Column | str = "state") -> Column:
    """The moves open to a state, as ``NEW (accept), INVALID (reject)``."""
    moves: dict[str, list[str]] = {}
    for command, source, target in COMMAND_RULES:
        moves.setdefault(source, []).append(f"{target} ({command})")
    return C.lookup(state, {s: ", ".join(m) for s, m in moves.items()}, F.lit(""))


def next_states(tasks: DataFrame) -> DataFrame:
    return tasks.select("id", "state", allowed_next().alias("allowed"))


def _message() -> Column:
    """Why a request was refused, or what it did."""
    command = F.col("command")
    refused = F.concat(
        C.short_id(), F.lit(": "), command, F.lit(" does not apply to "), F.col("state"),
        F.lit("; open moves: "), F.coalesce(F.nullif(allowed_next(), F.lit("")), F.lit("none")),
    )
    guarded = F.concat(
        C.short_id(), F.lit(": child "), F.col("open_child"), F.lit(" is still "), F.col("open_child_state")
    )
    accepted = F.concat(F.lit("Task "), C.short_id(), F.lit(" marked as "), C.state_verb("to_state"))
    verdict = F.col("verdict")
    return (
        F.when(verdict == "ACCEPTED", accepted)
        .when(verdict == "OPEN_CHILDREN", guarded)
        .when(verdict == "REFUSED", refused)
        .when(verdict == "CONFLICT", "more than one request for this task; replay the log instead")
        .when(verdict == "UNKNOWN_COMMAND", F.concat(F.lit("no such command: "), command))
        .when(verdict == "AMBIGUOUS", F.concat(F.lit("several tasks fit: "), F.col("ref")))
        .otherwise(F.concat(F.lit("no task fits: "), F.col("ref")))
    )


def _targeted(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests with the id and status of the task they name."""
    return materialise(left_lookup(requests, materialise(resolve(requests, tasks)), "ref", "seq"))


def judge_transitions(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """A verdict per request (seq, ref, command), all on the same snapshot.

    Requests of a task are judged up to the first that is accepted; a refused one
    changes nothing. Those after it would depend on it, which a snapshot cannot
    show, so each is a CONFLICT.
    """
    targeted = _targeted(requests, tasks)
    known = F.col("command").isin(*COMMANDS)
    # All that is known of a task, in one row, so that the requests join once.
    asked = targeted.where("status = 'OK'").select("id").distinct()
    facts = materialise(
        tasks.select("id", "state").join(asked, "id", "left_semi").join(blocking_children(tasks), "id", "left")
    )
    target = rule_target("command", "state")
    alone = (
        F.when(F.coalesce("status", F.lit("NOT_FOUND")) != "OK", F.coalesce("status", F.lit("NOT_FOUND")))
        .when(~F.coalesce(known, F.lit(False)), "UNKNOWN_COMMAND")
        .when((F.col("command") == GUARDED_COMMAND) & F.col("open_child").isNotNull(), "OPEN_CHILDREN")
        .when(target.isNull(), "REFUSED")
        .otherwise("ACCEPTED")
    )
    judged = materialise(left_lookup(targeted, facts, "id", "seq").withColumn("verdict", alone))
    accepted = judged.where("verdict = 'ACCEPTED'").groupBy("id").agg(F.min("seq").alias("first_seq"))
    late = F.col("verdict").isin("ACCEPTED", "REFUSED", "OPEN_CHILDREN") & (F.col("seq") > F.col("first_seq"))
    return (
        left_lookup(judged, materialise(accepted), "id", "seq")
        .withColumn("verdict", F.when(late, "CONFLICT").otherwise(F.col("verdict")))
        .withColumn("to_state", F.when(F.col("verdict") == "ACCEPTED", target))
        .withColumn("message", _message())
        .select(
            "seq", "ref", "command", "id", F.col("state").alias("from_state"), "to_state", "verdict", "message"
        )
    )


def apply_transitions(tasks: DataFrame, requests: DataFrame, at: datetime | str) -> Outcome:
    """Judge the requests and write the accepted states back; `updated` moves with them."""
    verdicts = judge_transitions(tasks, requests)
    accepted = verdicts.where("verdict = 'ACCEPTED'").select("id", "to_state")
    changed = F.col("to_state").isNotNull()
    after = (
        tasks.join(accepted, "id", "left")
        .withColumns(
            {
                "state": F.coalesce("to_state", "state"),
                "updated": F.when(changed, moment(at)).otherwise(F.col("updated").cast("timestamp_ntz")),
            }
        )
        .select(*tasks.columns)
    )
    return Outcome(after, verdicts)


def _write_blocker(tasks: DataFrame, changes: DataFrame, at: datetime | str) -> DataFrame:
    """Set `blocked_by` from changes (id, new_blocker), one row per task."""
    marked = changes.withColumn("_changed", F.lit(True))
    changed = F.col("_changed").isNotNull()
    return (
        tasks.join(marked, "id", "left")
        .withColumns(
            {
                "blocked_by": F.when(changed, F.col("new_blocker")).otherwise(F.col("blocked_by")),
                "updated": F.when(changed, moment(at)).otherwise(F.col("updated").cast("timestamp_ntz")),
            }
        )
        .select(*tasks.columns)
    )


def apply_blocks(tasks: DataFrame, requests: DataFrame, at: datetime | str) -> Outcome:
    """Block tasks: requests (seq, ref, by_ref). The last accepted request of a task holds."""
    found = materialise(
        resolve(requests.select("ref").unionByName(requests.select(F.col("by_ref").alias("ref"))), tasks)
    )
    blocker = found.select(
        F.col("ref").alias("by_ref"), F.col("id").alias("by_id"), F.col("status").alias("by_status")
    )
    verdicts = (
        left_lookup(left_lookup(requests, found, "ref", "seq"), blocker, "by_ref", "seq")
        .withColumn(
            "verdict",
            F.when(F.col("id").isNull(), F.coalesce("status", F.lit("NOT_FOUND")))
            .when(
                F.col("by_id").isNull(),
                F.concat(F.lit("BLOCKER_"), F.coalesce("by_status", F.lit("NOT_FOUND"))),
            )
            .when(F.col("id") == F.col("by_id"), "SELF")
            .otherwise("BLOCKED"),
        )
        .select("seq", "ref", "by_ref", "id", "by_id", "verdict")
    )
    latest = (
        verdicts.where("verdict = 'BLOCKED'").groupBy("id").agg(F.max_by("by_id", "seq").alias("new_blocker"))
    )
    return Outcome(_write_blocker(tasks, latest, at), verdicts)


def apply_unblocks(tasks: DataFrame, requests: DataFrame, at: datetime | str) -> Outcome:
    """Clear block links: requests (seq, ref). Only the first request of a task finds it blocked."""
    targeted = _targeted(requests, tasks)
    first = targeted.where("status = 'OK'").groupBy("id").agg(F.min("seq").alias("first_seq"))
    facts = materialise(tasks.select("id", "blocked_by").join(first, "id"))
    verdicts = (
        left_lookup(targeted, facts, "id", "seq")
        .withColumn(
            "verdict",
            F.when(F.col("id").isNull(), F.coalesce("status", F.lit("NOT_FOUND")))
            .when(C.is_blocked() & (F.col("seq") == F.col("first_seq")), "UNBLOCKED")
            .otherwise("WAS_NOT_BLOCKED"),
        )
        .select("seq", "ref", "id", "verdict")
    )
    cleared = first.select("id", F.lit(None).cast("string").alias("new_blocker"))
    return Outcome(_write_blocker(tasks, cleared, at), verdicts)
