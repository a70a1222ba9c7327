"""Streams of several batches: keyed replay, and messages that come again or late."""

from __future__ import annotations

import json
import os
from datetime import timedelta
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from conftest import START
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_replay import make_case, model

from tasklattice.plans import fixture as fx
from tasklattice.streaming import keyed_replay as kr
from tasklattice.streaming.capture import arrivals, capture_stream, captured_tasks, quarantine
from tasklattice.streaming.state import state_partitions

LOG = "seq long, id string, command string"
TREE = "id string, parent string, state string"


def send(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, writer):
    with state_partitions(spark, 2):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_keyed_replay_equals_the_model(spark, tmp_path):
    """Batches and a restart; the tasks are read before the first batch only."""
    tasks, log = make_case(11, n_tasks=8, n_commands=120)
    log.sort(key=lambda row: row[0])
    table = spark.createDataFrame([(i, p, s) for i, (p, s, _) in tasks.items()], TREE)
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    states = kr.initial_states(table)
    feed = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    send(spark, log[:40], LOG, source)
    send(spark, log[40:80], LOG, source)
    run(spark, kr.keyed_replay_stream(feed(), states, out))
    # Other states in the table change nothing any more.
    other = kr.initial_states(table.withColumn("state", F.lit("INVALID")))
    known = next(iter(tasks))
    send(spark, [*log[80:], (None, known, "done"), (10_000, "nobody", "done"), (10_001, known, None)], LOG, source)
    run(spark, kr.keyed_replay_stream(feed(), other, out))
    rows = kr.keyed_verdicts(spark, out).collect()
    got = {r.seq: (r.id, r.command, r.from_state, r.to_state, r.verdict) for r in rows}
    assert len(rows) == len(log) + 3
    assert got.pop(None)[4] == "NO_SEQ"
    assert got.pop(10_000)[4] == "NOT_FOUND"
    assert got.pop(10_001)[4] == "UNKNOWN_COMMAND"
    assert got == model(tasks, log)[1]


class Counted:
    """A state value that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_calls_to_the_state_store_do_not_grow_with_tasks():
    """A bucket of many tasks with many commands: two calls to begin with, three in a batch, none for rows that only pass."""
    calls = []
    for size in (3, 300):
        stage, kept = kr.Stage(), {}
        stage.init(SimpleNamespace(getValueState=lambda name, schema: kept.setdefault(name, Counted())))
        stage.handleInitialState((7,), Row(bucket=7, tasks=json.dumps([{"id": f"t{k}", "state": "NEW", "parent": "p", "opened": 1} for k in range(size)])), None)
        rows = [kr.Event(f"t{k % size}", k, ("done", "in-progress", "cancel")[k // size], None, None, None, None, 7) for k in reversed(range(3 * size))]
        got = list(stage.handleInputRows((7,), iter([*rows, kr.Event("other", 0, "done", None, None, None, None, 7)]), None))
        verdicts = [(r.verdict, r.to_state) for r in got if r.verdict]
        assert verdicts == [("OPEN_CHILDREN", None)] * size + [("ACCEPTED", "IN_PROGRESS")] * size + [("ACCEPTED", "CANCELLED")] * size
        assert sum(r.delta or 0 for r in got) == -size and [r.id for r in got if not r.verdict and r.delta is None] == ["other"]
        before = sum(v.calls for v in kept.values())
        assert list(stage.handleInputRows((7,), iter(got[:1]), None)) == got[:1]
        calls.append((before, sum(v.calls for v in kept.values())))
    assert calls == [(5, 5)] * 2


@pytest.mark.parametrize("buckets", [1, 3])
def test_few_buckets_hold_many_tasks(spark, tmp_path, buckets):
    tasks, log = make_case(5, n_tasks=12, n_commands=90)
    log.sort(key=lambda row: row[0])
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    send(spark, log[:50], LOG, source)
    send(spark, log[50:], LOG, source)
    states = kr.initial_states(spark.createDataFrame([(i, p, s) for i, (p, s, _) in tasks.items()], TREE), buckets=buckets)
    run(spark, kr.keyed_replay_stream(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source), states, out))
    got = {r.seq: (r.id, r.command, r.from_state, r.to_state, r.verdict) for r in kr.keyed_verdicts(spark, out).collect()}
    assert got == model(tasks, log)[1]


def test_heights_and_deep_chains(spark):
    chain = [(f"t{k}", f"t{k - 1}" if k else None, "NEW") for k in range(5)] + [("lone", None, "NEW"), ("u", "t0", "DONE")]
    table = spark.createDataFrame(chain, TREE)
    states = kr.initial_states(table)
    got = {r.id: (r.height, r.opened) for r in states.table.collect()}
    assert got == {"t0": (4, 1), "t1": (3, 1), "t2": (2, 1), "t3": (1, 1), "t4": (0, 0), "lone": (0, 0), "u": (0, 0)}
    assert states.stages == 5
    with pytest.raises(ValueError, match="replay_stream"):
        kr.initial_states(table, most_stages=3)
    with pytest.raises(ValueError, match="cycle"):
        kr.initial_states(spark.createDataFrame([("a", "b", "NEW"), ("b", "a", "NEW")], TREE))


def test_first_repeated_and_late(spark, tmp_path):
    """Every row comes out once, with what became of it; times come out as they came in."""
    schema = "n long, text string, at timestamp"
    source, out = str(tmp_path / "feed"), str(tmp_path / "out")
    at = lambda minutes: START + timedelta(minutes=minutes, microseconds=123456)
    batches = [
        [(1, "a", at(0)), (2, "b", at(10)), (2, "b again", at(11)), (3, "c", at(30))],
        [(1, "a again", at(0)), (4, "d", at(200)), (5, "no time", None)],
        [(6, "late", at(20)), (2, "b late", at(10)), (4, "d again", at(200)), (7, "in time", at(150))],
    ]
    for rows in batches:
        send(spark, rows, schema, source)
        feed = spark.readStream.schema(schema).parquet(source)
        found = arrivals(feed, "n", "at", "1 hour")
        run(spark, found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint"))
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted((r.n, r.text, r.arrival) for r in rows) == [
        (1, "a", "first"), (1, "a again", "repeated"), (2, "b", "first"), (2, "b again", "repeated"), (2, "b late", "late"), (3, "c", "first"),
        (4, "d", "first"), (4, "d again", "repeated"), (5, "no time", "late"), (6, "late", "late"), (7, "in time", "first"),
    ]
    assert {r.text: r["at"] for r in rows} == {text: time for rows in batches for _, text, time in rows}


def test_late_messages_are_in_the_quarantine(spark, tmp_path):
    schema = "n long, text string, kind string, at timestamp"
    source, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for rows in ([(1, "A\n\nbody", "bug", START + timedelta(hours=5))], [(2, "B\n\nbody", "bug", START), (1, "A\n\nbody", "bug", START + timedelta(hours=5))]):
        send(spark, rows, schema, source)
        feed = spark.readStream.schema(schema).parquet(source)
        run(spark, capture_stream(feed, out, "n", event_time="at"))
    assert [r.title for r in captured_tasks(spark, out).collect()] == ["A"]
    assert [(r.n, r.error) for r in quarantine(spark, out).collect()] == [(2, "came later than the watermark")]


@pytest.mark.parametrize("parts", [1, 3])
def test_a_feed_of_a_file_and_of_a_folder(spark, tmp_path, parts):
    """A table is streamed whole in either layout, and no other table beside it."""
    table = str(tmp_path / "documents.parquet")
    spark.range(20).repartition(3).write.parquet(table)
    if parts == 1:
        single = spark.read.parquet(table).toArrow()
        table = str(tmp_path / "one" / "documents.parquet")
        (tmp_path / "one").mkdir()
        pq.write_table(single, table)
    folder = os.path.dirname(table)
    spark.range(7).write.parquet(f"{folder}/events.parquet")
    writer = fx.feed(spark, folder, "documents").writeStream.format("parquet").option("path", f"{folder}/out")
    run(spark, writer.option("checkpointLocation", f"{folder}/checkpoint"))
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(20))
