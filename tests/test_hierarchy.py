import pytest
from conftest import names, sha, task
from pyspark.sql import functions as F

from tasklattice.functions import columns as C
from tasklattice.operators import cards, hierarchy, summary


@pytest.fixture(scope="module")
def family(make_tasks):
    return make_tasks(
        task("parent", kind="FEATURE", state="IN_PROGRESS", priority="high", source="app.py:1", tags="a,b", blocked_by="other", description="First\nSecond"),
        task("c1", parent="parent", state="DONE", priority="high", created=3),
        task("c2", parent="parent", state="INBOX", priority="medium", created=2, description="Line one\nLine two"),
        task("c3", parent="parent", state="CANCELLED", priority="low", created=1),
        task("c4", parent="parent", state="NEW", priority="medium", created=1, blocked_by="other"),
        task("other", state="NEW"),
        task("closed", state="NEW"),
        task("k1", parent="closed", state="DONE"),
        task("k2", parent="closed", state="CANCELLED"),
        task("lost", parent="nowhere"),
    )


def test_children_come_by_priority_text_then_age(family):
    rows = hierarchy.children(family).where(F.col("parent") == sha("parent")).orderBy("child_no").collect()
    assert [(r.child_no, r.title) for r in rows] == [(1, "c4"), (2, "c2"), (3, "c3"), (4, "c1")]
    ranked = hierarchy.children(family, order="rank").where(F.col("parent") == sha("parent")).orderBy("child_no")
    assert names(ranked) == ["c1", "c4", "c2", "c3"]
    only = hierarchy.children(family, family.where("title = 'closed'").select("id"))
    assert sorted(names(only)) == ["k1", "k2"]


def test_progress_and_breakdown(family):
    progress = {r.parent: (r.subtasks_total, r.subtasks_done) for r in hierarchy.progress(family).collect()}
    assert progress[sha("parent")] == (4, 1)
    assert progress[sha("closed")] == (2, 1)
    lines = {r.parent: r.summary for r in hierarchy.child_breakdown(family).collect()}
    assert lines[sha("parent")] == "Total: 4 subtasks (1 done, 1 new, 1 cancelled)"
    assert lines[sha("nowhere")] == "Total: 1 subtasks ()"


def test_links(family):
    parents = {r.title: (r.parent_short, r.parent_title) for r in hierarchy.with_parent(family).collect()}
    assert parents["c1"] == (sha("parent")[:7], "parent")
    assert parents["lost"] == (None, None)
    assert parents["other"] == (None, None)
    blockers = {r.title: r.blocker_title for r in hierarchy.with_blocker(family).collect()}
    assert blockers["parent"] == "other" and blockers["other"] is None


def test_completable_names_the_first_open_child(family):
    rows = {r.title: r for r in hierarchy.completable(family).collect()}
    assert not rows["parent"].completable
    assert (rows["parent"].open_children, rows["parent"].open_child) == (2, sha("c4"))
    assert rows["parent"].open_child_state == "NEW"
    assert rows["closed"].completable and rows["other"].completable


def test_card(spark, family):
    refs = spark.createDataFrame([(sha("parent")[:8],), (sha("c2"),), ("zzzz",)], "ref string")
    lines = cards.cards(family, refs).orderBy("id", "part", "no").collect()
    of = lambda name: [r.line for r in lines if r.id == sha(name)]
    parent = of("parent")
    assert parent[0].startswith(f"task {sha('parent')}\nAuthor: A <a@example.com>\nDate:   Mon, 15 Jan 2024 10:30:00 +0000\n")
    assert "  ▶ feature(high): parent [1/4]\n    First\n    Second\n" in parent[0]
    assert parent[0].endswith(f"\n    Source: app.py:1\n    Blocked-by: {sha('other')[:7]}\n    Tags: a,b\n")
    assert [line.split(" - ")[1].split()[0] for line in parent[1:5]] == ["c4", "c2", "c3", "c1"]
    assert parent[2].endswith("| bug, medium\n      Line one")
    assert parent[5] == "Total: 4 subtasks (1 done, 1 new, 1 cancelled)"
    child = of("c2")
    assert child[1] == f"Parent: {sha('parent')[:7]} - parent"
    assert len(child) == 2
    assert len(lines) == 8


@pytest.fixture(scope="module")
def fourteen(make_tasks):
    plain = [
        ("BUG", "INBOX", "high"), ("FEATURE", "INBOX", "medium"),
        ("BUG", "NEW", "high"), ("BUG", "NEW", "medium"), ("FEATURE", "NEW", "high"),
        ("BUG", "IN_PROGRESS", "high"), ("FEATURE", "IN_PROGRESS", "medium"), ("REGRESSION", "IN_PROGRESS", "high"),
        ("BUG", "DONE", "low"), ("FEATURE", "DONE", "medium"), ("REGRESSION", "DONE", "high"),
        ("BUG", "CANCELLED", "low"),
    ]
    rows = [task(f"t{i}", kind=k, state=s, priority=p, blocked_by="t0" if i in (3, 6) else None) for i, (k, s, p) in enumerate(plain)]
    rows.append(task("parent", kind="FEATURE", state="NEW", priority="medium"))
    rows.append(task("child", state="IN_PROGRESS", priority="medium", parent="parent"))
    return make_tasks(*rows)


def test_summary(fourteen):
    counts = {(r.dimension, r.value): r.n for r in summary.summary_counts(fourteen).collect()}
    assert len(counts) == 12
    by = lambda d, *values: [counts[d, v] for v in values]
    assert by("state", "INBOX", "NEW", "IN_PROGRESS", "DONE", "CANCELLED", "INVALID") == [2, 4, 4, 3, 1, 0]
    assert by("kind", "BUG", "FEATURE", "REGRESSION") == [7, 5, 2]
    assert by("priority", "high", "medium", "low") == [6, 6, 2]
    assert summary.summary_totals(fourteen).first().asDict() == dict(total=14, active=8, blocked=2, parents=1, subtasks=1)


def test_active_summary(make_tasks, fourteen):
    totals = summary.summary_totals(fourteen, active_only=True).first()
    assert (totals.total, totals.active) == (10, 8)
    counts = {(r.dimension, r.value): r.n for r in summary.summary_counts(fourteen, active_only=True).collect()}
    assert counts["state", "DONE"] == 0 and counts["state", "INBOX"] == 2
    # A parent counts also when its only child is closed.
    tasks = make_tasks(task("p", state="NEW"), task("c", state="DONE", parent="p"))
    assert summary.summary_totals(tasks, active_only=True).first().parents == 1
    empty = summary.summary_totals(tasks.where("false")).first()
    assert empty.total == 0 and empty.parents == 0


def test_tags(make_tasks):
    tasks = make_tasks(task("a", tags="ui, api"), task("b", tags="guide,,docs"), task("c", tags=""), task("d", tags=" ,ui"))
    lists = {r.title: r.tags for r in tasks.select("title", C.tag_list().alias("tags")).collect()}
    assert lists == {"a": ["ui", "api"], "b": ["guide", "docs"], "c": [], "d": ["ui"]}
    assert {r.tag: r.n for r in summary.tag_counts(tasks).collect()} == {"ui": 2, "api": 1, "guide": 1, "docs": 1}
    marks = {r.title: r.m for r in tasks.select("title", C.tag_marks().alias("m")).collect()}
    assert marks == {"a": "#ui #api", "b": "#guide # #docs", "c": "", "d": "# #ui"}
