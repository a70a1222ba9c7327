"""Replay and snapshot judgements against a model that runs one command at a time."""

import random
from datetime import timedelta

import pytest
from conftest import START, sha, task

from tasklattice.operators import lifecycle, replay as replay_module
from tasklattice.operators.replay import replay
from tasklattice.schema import COMMAND_RULES, COMMANDS
from tasklattice.streaming.replay import replay_stream, verdicts

RULES = {(c, s): t for c, s, t in COMMAND_RULES}


def model(tasks, log):
    """tasks: {id: (parent, state, born)}; log: [(seq, id, command)]."""
    state = {i: s for i, (_, s, _) in tasks.items()}
    children = {}
    for i, (parent, _, _) in tasks.items():
        children.setdefault(parent, []).append(i)
    history = {}
    for seq, i, command in sorted(log, key=lambda r: r[0]):
        alive = lambda t: tasks[t][2] is None or tasks[t][2] <= seq
        if i not in tasks or not alive(i):
            history[seq] = (i, command, None, None, "NOT_FOUND")
            continue
        before, target = state[i], RULES.get((command, state[i]))
        held = any(alive(k) and state[k] not in ("DONE", "CANCELLED") for k in children.get(i, []))
        if command not in COMMANDS:
            verdict = "UNKNOWN_COMMAND"
        elif command == "done" and held:
            verdict = "OPEN_CHILDREN"
        else:
            verdict = "ACCEPTED" if target else "REFUSED"
        if verdict == "ACCEPTED":
            state[i] = target
        history[seq] = (i, command, before, target if verdict == "ACCEPTED" else None, verdict)
    return state, history


def make_case(seed, n_tasks, n_commands, hot_share=0.0, births=False):
    rng = random.Random(seed)
    ids = [sha(f"{seed}-{i}") for i in range(n_tasks)]
    states = ["INBOX", "NEW", "IN_PROGRESS", "DONE", "CANCELLED", "INVALID"]
    tasks = {}
    for n, i in enumerate(ids):
        parent = ids[rng.randrange(n)] if n and rng.random() < 0.8 else None
        born = rng.randrange(n_commands * 3) if births and rng.random() < 0.4 else None
        tasks[i] = (parent, rng.choice(states), born)
    seqs = rng.sample(range(1000, 1000 + n_commands * 3), n_commands)
    taken = {b for _, _, b in tasks.values()}
    commands = list(COMMANDS) + ["done", "done", "in-progress", "close"]
    log = [
        (seq, ids[0] if rng.random() < hot_share else rng.choice(ids + ["unknown", None]), rng.choice(commands))
        for seq in seqs
        if seq not in taken
    ]
    if births:
        tasks = {i: (p, s, None if b is None else b + 1000) for i, (p, s, b) in tasks.items()}
        taken = {b for _, _, b in tasks.values()}
        log = [row for row in log if row[0] not in taken]
    return tasks, log


def run(spark, tasks, log, births=False, **options):
    columns = "id string, parent string, state string" + (", born long" if births else "")
    rows = [(i, p, s, b) if births else (i, p, s) for i, (p, s, b) in tasks.items()]
    table = spark.createDataFrame(rows, columns)
    commands = spark.createDataFrame(log, "seq long, id string, command string")
    result = replay(table, commands, **options)
    history = result.history.collect()
    got = {r.seq: (r.id, r.command, r.from_state, r.to_state, r.verdict) for r in history}
    assert len(got) == len(history)
    return {r.id: r.state for r in result.tasks.collect()}, got


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_the_model(spark, seed):
    tasks, log = make_case(seed, n_tasks=12, n_commands=400)
    state, history = run(spark, tasks, log)
    assert (state, history) == model(tasks, log)
    assert {"OPEN_CHILDREN", "ACCEPTED", "REFUSED", "NOT_FOUND", "UNKNOWN_COMMAND"} == {h[4] for h in history.values()}


def test_one_task_with_most_of_the_log(spark, monkeypatch):
    """Small chunks make a tree of several levels, also for guarded tasks."""
    monkeypatch.setattr(replay_module, "CHUNK_BITS", 3)
    monkeypatch.setattr(replay_module, "GUARD_BITS", 4)
    tasks, log = make_case(5, n_tasks=8, n_commands=500, hot_share=0.6)
    assert run(spark, tasks, log, hot_commands=20) == model(tasks, log)


def test_tasks_born_in_the_middle(spark):
    tasks, log = make_case(9, n_tasks=12, n_commands=300, births=True)
    assert run(spark, tasks, log, births=True) == model(tasks, log)


def test_empty_log_and_cycles(spark):
    state, history = run(spark, {"a": (None, "NEW", None)}, [])
    assert state == {"a": "NEW"} and history == {}
    with pytest.raises(ValueError, match="cycle"):
        run(spark, {"a": ("b", "NEW", None), "b": ("a", "NEW", None)}, [(1, "a", "done"), (2, "b", "done")])


def test_times_follow_the_last_change(spark, make_tasks):
    tasks = make_tasks(task("a"), task("b"))
    at = lambda n: START + timedelta(days=n)
    log = spark.createDataFrame(
        [(1, sha("a"), "accept", at(1)), (2, sha("a"), "done", at(2)), (3, sha("a"), "done", at(3))],
        "seq long, id string, command string, at timestamp_ntz",
    )
    rows = {r.title: r for r in replay(tasks, log).tasks.collect()}
    assert (rows["a"].state, rows["a"].updated) == ("DONE", at(2))
    assert (rows["b"].state, rows["b"].updated) == ("INBOX", START)


def test_stream_equals_the_model(spark, tmp_path, monkeypatch):
    """Several batches, with a merge of the kept states on the way."""
    from tasklattice.streaming import replay as stream_module

    monkeypatch.setattr(stream_module, "MERGE_EVERY", 2)
    tasks, log = make_case(11, n_tasks=8, n_commands=120)
    log.sort(key=lambda row: row[0])
    source = tmp_path / "log"
    schema = "seq long, id string, command string"
    for n in range(3):
        spark.createDataFrame(log[n * 30 : (n + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(source))
    table = spark.createDataFrame([(i, p, s) for i, (p, s, _) in tasks.items()], "id string, parent string, state string")

    def feed():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        replay_stream(stream, table, str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return {r.seq: (r.id, r.command, r.from_state, r.to_state, r.verdict) for r in verdicts(spark, str(tmp_path / "out")).collect()}

    assert feed() == model(tasks, log[:90])[1]
    spark.createDataFrame(log[90:], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert feed() == model(tasks, log)[1]


TRANSITIONS = [
    # (from, to, child state, allowed)
    ("INBOX", "NEW", None, True), ("INBOX", "INVALID", None, True), ("INBOX", "IN_PROGRESS", None, False), ("INBOX", "DONE", None, False),
    ("NEW", "IN_PROGRESS", None, True), ("NEW", "DONE", None, True), ("NEW", "CANCELLED", None, True),
    ("IN_PROGRESS", "DONE", None, True), ("IN_PROGRESS", "CANCELLED", None, True), ("IN_PROGRESS", "NEW", None, False),
    ("DONE", "IN_PROGRESS", None, True), ("DONE", "NEW", None, False), ("CANCELLED", "NEW", None, True),
    ("CANCELLED", "IN_PROGRESS", None, True), ("INVALID", "NEW", None, False),
    ("IN_PROGRESS", "DONE", "NEW", False), ("IN_PROGRESS", "DONE", "DONE", True), ("IN_PROGRESS", "DONE", "CANCELLED", True),
    ("IN_PROGRESS", "CANCELLED", "NEW", True), ("IN_PROGRESS", "DONE", "INBOX", False),
]
COMMAND_FOR = {"NEW": "accept", "INVALID": "reject", "IN_PROGRESS": "in-progress", "DONE": "done", "CANCELLED": "cancel"}


def test_transition_table(spark, make_tasks):
    rows, requests = [], []
    for n, (before, after, child, _) in enumerate(TRANSITIONS):
        rows.append(task(f"p{n}", state=before))
        if child:
            rows.append(task(f"c{n}", state=child, parent=f"p{n}"))
        command = "reopen" if before == "CANCELLED" and after == "NEW" else COMMAND_FOR[after]
        requests.append((n, sha(f"p{n}")[:12], command))
    tasks = make_tasks(*rows)
    asked = spark.createDataFrame(requests, "seq long, ref string, command string")
    after, judged = lifecycle.apply_transitions(tasks, asked, "2024-02-01 00:00:00")
    got = {r.seq: r for r in judged.collect()}
    state = {r.title: (r.state, r.updated > START) for r in after.collect()}
    for n, (before, to, child, allowed) in enumerate(TRANSITIONS):
        assert (got[n].verdict == "ACCEPTED") == allowed
        assert state[f"p{n}"] == ((to, True) if allowed else (before, False))
    assert got[15].message == f"{sha('p15')[:7]}: child {sha('c15')} is still NEW"
    assert got[2].message == f"{sha('p2')[:7]}: in-progress does not apply to INBOX; open moves: NEW (accept), INVALID (reject)"


def test_commands_with_rules_of_their_own(spark, make_tasks):
    tasks = make_tasks(task("c", state="CANCELLED"), task("d", state="DONE"), task("n", state="NEW"), task("x", state="NEW"))
    asked = [
        (1, sha("c"), "accept"), (2, sha("d"), "reject"), (3, sha("n"), "reopen"),
        (4, sha("x"), "cancel"), (5, sha("x"), "done"), (6, "nope", "done"), (7, sha("d"), "fly"),
        (8, sha("n"), "done"), (9, sha("n"), "fly"), (10, sha("n"), "reopen"),
    ]
    _, judged = lifecycle.apply_transitions(tasks, spark.createDataFrame(asked, "seq long, ref string, command string"), START)
    got = {r.seq: (r.verdict, r.message) for r in judged.collect()}
    assert got[1] == ("REFUSED", f"{sha('c')[:7]}: accept does not apply to CANCELLED; open moves: IN_PROGRESS (in-progress), NEW (reopen)")
    assert got[2] == ("REFUSED", f"{sha('d')[:7]}: reject does not apply to DONE; open moves: IN_PROGRESS (in-progress)")
    assert got[3][0] == "REFUSED"
    assert [got[n][0] for n in (4, 5, 6, 7)] == ["ACCEPTED", "CONFLICT", "NOT_FOUND", "UNKNOWN_COMMAND"]
    assert [got[n][0] for n in (8, 9, 10)] == ["ACCEPTED", "UNKNOWN_COMMAND", "CONFLICT"]  # judged on, as 3 changed nothing


def test_blocks(spark, make_tasks):
    tasks = make_tasks(task("a"), task("b"), task("c", blocked_by="a"))
    asked = [(1, sha("a")[:9], sha("b")), (2, sha("a"), sha("c")), (3, sha("b"), sha("b")[:10]), (4, sha("b"), "none"), (5, "none", sha("a")), (6, sha("c"), "none2")]
    after, judged = lifecycle.apply_blocks(tasks, spark.createDataFrame(asked, "seq long, ref string, by_ref string"), "2024-02-01 00:00:00")
    assert {r.seq: r.verdict for r in judged.collect()} == {
        1: "BLOCKED", 2: "BLOCKED", 3: "SELF", 4: "BLOCKER_NOT_FOUND", 5: "NOT_FOUND", 6: "BLOCKER_NOT_FOUND"
    }
    rows = {r.title: r for r in after.collect()}
    assert rows["a"].blocked_by == sha("c") and rows["a"].updated > START
    assert rows["b"].blocked_by is None and rows["b"].updated == START
    assert rows["c"].blocked_by == sha("a")
    after, judged = lifecycle.apply_unblocks(after, spark.createDataFrame([(1, sha("c")), (2, sha("c")), (3, sha("b")), (4, "none")], "seq long, ref string"), START)
    assert {r.seq: r.verdict for r in judged.collect()} == {1: "UNBLOCKED", 2: "WAS_NOT_BLOCKED", 3: "WAS_NOT_BLOCKED", 4: "NOT_FOUND"}
    assert {r.title: r.blocked_by for r in after.collect()} == {"a": sha("c"), "b": None, "c": None}


def test_next_states(make_tasks):
    rows = {r.state: r.allowed for r in lifecycle.next_states(make_tasks(task("a"), task("b", state="INVALID"))).collect()}
    assert rows == {"INBOX": "NEW (accept), INVALID (reject)", "INVALID": ""}
