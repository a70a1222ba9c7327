import pytest
from conftest import START, sha, task
from pyspark.sql import functions as F

from tasklattice.operators import ingest, maintenance
from tasklattice.schema import TASK_COLUMNS, TASK_SCHEMA
from tasklattice.sources.tables import read_tasks, write_tasks
from tasklattice.streaming.capture import capture_stream, captured_tasks, quarantine

AT = "2024-02-01 00:00:00"


@pytest.mark.parametrize(
    "text, title, body",
    [
        ("T\n\nbody", "T", "body"),
        ("T\nbody", "T", "body"),
        ("  T  \n\n  one\n\ntwo  \n\n", "T", "one\n\ntwo"),
        ("T\r\n\r\none\r\ntwo\r\n", "T", "one\ntwo"),
        ("T", "T", ""),
        (" T　\nbody ", "T", "body"),
        ("\n", "", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_message_split(spark, text, title, body):
    row = ingest.parse_messages(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.title, row.description) == (title, body)
    assert row.parse_error == (None if title else "no title line")


def test_heredoc_tail_is_removed_once_and_only_on_request(spark):
    rows = spark.createDataFrame([("T\n\nbody\nEOF < /dev/null",), ("T\n\nDONE < /dev/null EOL < /dev/null\n",)], "text string")
    bodies = lambda **options: [r.description for r in ingest.parse_messages(rows, **options).collect()]
    assert bodies(heredoc=True) == ["body", "DONE < /dev/null"]
    assert bodies()[0] == "body\nEOF < /dev/null"


@pytest.mark.parametrize(
    "fields, error",
    [
        ({}, None),
        ({"title": " \t"}, "title is blank"),
        ({"title": "", "kind": "X"}, "title is blank"),
        ({"description": "\n"}, "description is blank"),
        ({"kind": "chore"}, "kind not allowed: chore"),
        ({"priority": "urgent"}, "priority not allowed: urgent"),
        ({"state": "OPEN"}, "state not allowed: OPEN"),
    ],
)
def test_validation_reports_the_first_rule(make_tasks, fields, error):
    assert ingest.validate_tasks(make_tasks(task("t", **fields))).first().error == error


def test_capture(spark):
    messages = spark.createDataFrame(
        [
            (1, "Leak\n\nIt leaks", "bug", "high", "main.c:1", "a,b", None),
            (2, "No body", "feature", None, None, None, None),
            (3, "\n\nbody", "feature", None, None, None, None),
            (4, "T\nbody", "feature", "urgent", None, None, None),
            (5, "T\nbody", "regression", None, None, None, "B <b@example.com>"),
        ],
        "n long, text string, kind string, priority string, source string, tags string, author string",
    )
    rows = {r.n: r for r in ingest.capture(messages, AT, "n").collect()}
    first = rows[1]
    assert (first.kind, first.priority, first.state, first.source, first.tags) == ("BUG", "high", "INBOX", "main.c:1", "a,b")
    assert (first.author, str(first.created), first.created) == ("Unknown <unknown@example.com>", AT, first.updated)
    assert first.id == sha(f"BUGLeakIt leaks{1706745600}1")
    assert (rows[5].author, rows[5].priority, rows[5].source) == ("B <b@example.com>", "medium", "")
    assert [rows[n].error for n in (1, 2, 3, 4, 5)] == [
        None, "description is blank", "no title line", "priority not allowed: urgent", None
    ]
    again = {r.n: r.id for r in ingest.capture(messages.repartition(3), AT, "n").collect()}
    assert again == {n: r.id for n, r in rows.items()}


def test_subtasks(spark, make_tasks):
    tasks = make_tasks(task("p", state="DONE"))
    messages = spark.createDataFrame(
        [(1, "T\nbody", sha("p")[:8], "bug"), (2, "T\nbody", "nope", "BUG"), (3, "T\nbody", sha("p"), "Bug"), (4, "\nbody", sha("p"), "FEATURE")],
        "n long, text string, parent_ref string, kind string",
    )
    rows = {r.n: r for r in ingest.capture_subtasks(messages, tasks, AT, "n").collect()}
    assert (rows[1].parent, rows[1].kind, rows[1].state, rows[1].error) == (sha("p"), "BUG", "INBOX", None)
    assert [rows[n].error for n in (2, 3, 4)] == ["parent_ref fits no single task", "kind not allowed: Bug", "no title line"]


def test_audit(spark, make_tasks):
    good = make_tasks(task("p"), task("c", parent="p", blocked_by="p", priority=None, state=None))
    assert maintenance.audit(good).count() == 0
    bad = make_tasks(
        task("same"), task("same"), task("k", kind="CHORE"), task("s", state="OPEN"), task("q", priority="urgent"),
        task("t", title=None), task("a", author=None), task("l", parent="gone"), task("b", blocked_by="gone"),
    )
    found = {(r.id, r.rule, r.value) for r in maintenance.audit(bad).collect()}
    assert found == {
        (sha("same"), "id is repeated", "2"), (sha("k"), "kind is unknown", "CHORE"), (sha("s"), "state is unknown", "OPEN"),
        (sha("q"), "priority is unknown", "urgent"), (sha("t"), "title is missing", ""), (sha("a"), "author is missing", ""),
        (sha("l"), "parent does not exist", sha("gone")), (sha("b"), "blocked_by does not exist", sha("gone")),
    }


def test_upgrade_keeps_rows_and_links_and_can_run_twice(make_tasks):
    old = make_tasks(task("p", state="DONE"), task("c", parent="p", blocked_by="p", description=None)).drop("source", "tags", "author")
    new = maintenance.upgrade_snapshot(old)
    assert new.columns == list(TASK_COLUMNS)
    rows = {r.title: r for r in new.collect()}
    assert (rows["c"].parent, rows["c"].blocked_by, rows["c"].source, rows["c"].description) == (sha("p"), sha("p"), "", "")
    assert sorted(map(tuple, maintenance.upgrade_snapshot(new).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_append(spark, make_tasks):
    tasks = make_tasks(task("a"))
    new = make_tasks(
        task("b", parent="a"), task("b", title="twin"), task("a", title="again"), task("c", parent="gone"), task("d", title=" "), task("e", parent="b")
    ).withColumn("n", F.when(F.col("title") == "twin", 2).otherwise(1))
    change = maintenance.append_tasks(tasks, new, "n")
    assert sorted(r.title for r in change.tasks.collect()) == ["a", "b"]
    assert sorted((r.id, r.reason) for r in change.refused.collect()) == sorted(
        [(sha("b"), "id exists already"), (sha("a"), "id exists already"), (sha("c"), "parent does not exist"),
         (sha("d"), "title is blank"), (sha("e"), "parent does not exist")]
    )


def test_append_links_inside_a_batch(make_tasks):
    """The rows are judged as if they were created one after the other."""
    tasks = make_tasks(task("a"))
    batch = [
        task("p", title="1"), task("c", title="2", parent="p", blocked_by="a"), task("g", title="3", parent="c"), task("early", title="4", parent="late"),
        task("late", title="5"), task("lost", title="6", parent="gone"), task("below", title="7", parent="lost"), task("below", title="8", parent="g"),
        task("self", title="9", parent="self"), task("twin", title="91", parent="early"), task("twin", title="92", blocked_by="below"),
    ]
    new = make_tasks(*batch).withColumn("n", F.col("title").cast("int"))
    change = maintenance.append_tasks(tasks, new, "n")
    assert sorted(r.title for r in change.tasks.collect()) == ["1", "2", "3", "5", "8", "92", "a"]
    assert {(r.n, r.reason) for r in change.refused.collect()} == {(n, "parent does not exist") for n in (4, 6, 7, 9, 91)}


def test_append_refuses_missing_ids_and_takes_one_of_two_equal_rows(make_tasks):
    new = make_tasks(task("b"), task("b"), task("x"), task("y"))
    new = new.withColumns({"n": F.lit(1), "id": F.when(~F.col("title").isin("x", "y"), F.col("id"))})
    change = maintenance.append_tasks(make_tasks(task("a")), new, "n")
    assert sorted(r.title for r in change.tasks.collect()) == ["a", "b"]
    assert sorted(r.reason for r in change.refused.collect()) == ["id exists already", "id is missing", "id is missing"]


def test_an_upgraded_table_passes_the_audit(make_tasks):
    old = make_tasks(task("p", priority=None, state=None), task("c", parent="p")).drop("source", "tags", "author")
    assert maintenance.audit(maintenance.upgrade_snapshot(old)).count() == 0


def test_upsert(make_tasks):
    tasks = make_tasks(task("a"), task("b"), task("c", parent="a"))
    changes = make_tasks(
        task("a", title="first"), task("a", title="last", state="DONE"), task("a", title="bad", kind="X"), task("z", title="new"), task("c", parent=None, tags="x")
    ).withColumn("n", F.monotonically_increasing_id())
    change = maintenance.upsert_fields(tasks, changes, AT, "n")
    rows = {r.id: r for r in change.tasks.collect()}
    assert len(rows) == 3
    assert (rows[sha("a")].title, rows[sha("a")].state, rows[sha("a")].created) == ("last", "DONE", START)
    assert rows[sha("a")].updated > START and rows[sha("b")].updated == START
    assert (rows[sha("c")].parent, rows[sha("c")].tags) == (None, "x")
    assert [(r.id, r.reason) for r in change.refused.collect()] == [(sha("a"), "kind not allowed: X")]


def test_delete_follows_links_of_refused_rows(spark, make_tasks):
    tasks = make_tasks(
        task("p"), task("c", parent="p"), task("g", parent="c"), task("x", blocked_by="y"), task("y"), task("z", blocked_by="w"), task("w", parent="v"), task("v"), task("u")
    )
    ids = spark.createDataFrame([(sha(n),) for n in ("p", "c", "g", "y", "v", "w", "u", "none")], "id string")
    change = maintenance.delete_tasks(tasks, ids)
    assert {r.title for r in change.tasks.collect()} == {"x", "y", "z", "w", "v"}
    assert {r.id for r in change.refused.collect()} == {sha("y"), sha("w"), sha("v")}
    nothing = maintenance.delete_tasks(tasks, ids.where("id = ''"))
    assert nothing.tasks.count() == 9 and nothing.refused.count() == 0


def test_round_trip(spark, make_tasks, tmp_path):
    write_tasks(make_tasks(task("a", source=None, tags=None)), str(tmp_path / "t"))
    read = read_tasks(spark, str(tmp_path / "t"))
    assert [f.dataType for f in read.schema.fields] == [f.dataType for f in TASK_SCHEMA.fields]
    row = read.first()
    assert (row.source, row.tags, row.parent) == ("", "", None)


def test_stream_capture_restarts_without_loss_or_doubles(spark, tmp_path):
    schema = "n long, text string, kind string, at timestamp_ntz"
    out = str(tmp_path / "out")

    def send(*rows):
        typed = [(n, text, kind, START) for n, text, kind in rows]
        spark.createDataFrame(typed, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))

    def drain():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
        feed = feed.withColumn("at", F.col("at").cast("timestamp"))
        capture_stream(feed, out, "n", event_time="at").trigger(availableNow=True).start().awaitTermination()

    send((1, "A\nbody", "bug"), (2, "B\nbody", "feature"))
    send((2, "B\nbody", "feature"), (3, "no body", "bug"))
    drain()
    assert sorted(r.title for r in captured_tasks(spark, out).collect()) == ["A", "B"]
    assert [r.n for r in quarantine(spark, out).collect()] == [3]
    send((4, "C\nbody", "regression"))
    drain()
    rows = captured_tasks(spark, out).collect()
    assert sorted(r.title for r in rows) == ["A", "B", "C"] and {r.created for r in rows} == {START}


def test_capture_family(spark, make_tasks):
    """A chain of 500 rows, each below the one before; refusals go down, cycles and lost keys are named."""
    rows = [(f"k{n}", f"T{n}\nbody", "bug", f"k{n - 1}" if n else None, None) for n in range(500)]
    rows += [("bad", "no body", "bug", None, None), ("b1", "B\nbody", "bug", "bad", None), ("b2", "B\nbody", "Bug", "b1", None), ("b3", "B\nbody", "bug", "b1", None)]
    rows += [("x", "X\nbody", "bug", "y", None), ("y", "Y\nbody", "bug", "x", None), ("z", "Z\nbody", "bug", "y", None)]
    rows += [("lost", "L\nbody", "bug", "nobody", None), ("old", "O\nbody", "feature", None, sha("p")), ("none", "N\nbody", "bug", None, "zzzz"), ("root", "R\nbody", "Bug", None, None)]
    messages = spark.createDataFrame(rows, "n string, text string, kind string, parent_key string, parent_ref string")
    got = {r.n: r for r in ingest.capture_family(messages, make_tasks(task("p")), AT, "n").collect()}
    assert len(got) == len(rows)
    assert all(got[f"k{n}"].error is None and got[f"k{n}"].parent == (got[f"k{n - 1}"].id if n else None) for n in range(500))
    assert {n: got[n].error for n in ("bad", "b1", "b2", "b3", "x", "y", "z", "lost", "none")} == {
        "bad": "description is blank", "b1": "the parent was refused", "b2": "kind not allowed: Bug", "b3": "the parent was refused",
        "x": "its parents form a cycle", "y": "its parents form a cycle", "z": "the parent was refused", "lost": "parent_key names no row",
        "none": "parent_ref fits no single task",
    }
    assert (got["old"].parent, got["old"].error, got["root"].error, got["root"].kind) == (sha("p"), None, None, "BUG")
    assert ingest.capture_family(messages.limit(0), make_tasks(task("p")), AT, "n").count() == 0
