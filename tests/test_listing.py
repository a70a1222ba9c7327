import pytest
from conftest import names, sha, task
from pyspark.sql import Window
from pyspark.sql import functions as F

from tasklattice.operators import listing, ordering
from tasklattice.operators.listing import ListOptions


@pytest.fixture(scope="module")
def mixed(make_tasks):
    return make_tasks(
        task("bug one", state="NEW", priority="high", tags="backend,urgent", created=1),
        task("feature one", kind="FEATURE", state="IN_PROGRESS", tags="frontend, ui", created=2),
        task("regression one", kind="REGRESSION", state="DONE", priority="low", tags="build", created=3),
        task("bug two", state="CANCELLED", source="src/main.c:7", created=4),
        task("bug three", state="INBOX", created=5),
        task("bug four", state="INVALID", created=6),
        task("feature two", kind="FEATURE", state="NEW", priority="high", blocked_by="bug one", created=7),
        task("old style", state="NEW", priority=None, created=8),
    )


def listed(tasks, **options):
    return names(listing.list_tasks(tasks, ListOptions(**options)))


def test_default_hides_closed_and_unaccepted(mixed):
    # In progress first, then an unknown priority before the known ones, then the newest.
    assert listed(mixed) == ["feature one", "old style", "feature two", "bug one"]


def test_all_variants(mixed):
    assert len(listed(mixed, all=True)) == 6
    assert len(listed(mixed, all=True, show_done=True, show_cancelled=True)) == 8
    assert set(listed(mixed, show_done=True)) == set(listed(mixed)) | {"regression one"}


def test_state_filter_overrides_visibility(mixed):
    assert listed(mixed, state="DONE") == ["regression one"]
    assert listed(mixed, state="cancelled") == ["bug two"]
    assert listed(mixed, state="in-progress") == ["feature one"]
    assert names(listing.list_done(mixed)) == ["regression one"]
    assert names(listing.list_cancelled(mixed)) == ["bug two"]
    assert names(listing.list_by_state(mixed, "invalid")) == ["bug four"]
    assert names(listing.inbox(mixed)) == ["bug three"]


def test_filters_and_limit(mixed):
    assert listed(mixed, priority="HIGH") == ["feature two", "bug one"]
    assert listed(mixed, kind="feature") == ["feature one", "feature two"]
    assert listed(mixed, blocked=True) == ["feature two"]
    assert listed(mixed, limit=2) == ["feature one", "old style"]
    assert listed(mixed, limit=0) == listed(mixed)
    assert listing.active_count(mixed).first().n == 4


def test_tag_is_a_substring_unless_exact(mixed):
    everything = dict(all=True, show_done=True, show_cancelled=True)
    assert set(listed(mixed, tag="UI", **everything)) == {"feature one", "regression one"}
    assert listed(mixed, tag="ui", tag_match="exact", **everything) == ["feature one"]
    assert listed(mixed, tag="%", **everything) == []
    assert listed(mixed, tag="_", **everything) == []


@pytest.mark.parametrize(
    "options", [dict(state="OPEN"), dict(state="INBOX"), dict(priority="urgent"), dict(kind="chore"), dict(tag_match="x")]
)
def test_unknown_values_are_refused(options):
    with pytest.raises(ValueError):
        ListOptions(**options)


def test_order_is_total(make_tasks):
    tasks = make_tasks(*(task(i, state="NEW", priority="low") for i in range(20)))
    assert names(listing.list_tasks(tasks), "id") == sorted(sha(i) for i in range(20))


def test_search(make_tasks):
    tasks = make_tasks(
        task("Fix memory leak", description="Parser keeps nodes", created=1),
        task("Add login", description="Uses less MEMORY", state="DONE", created=2),
        task("Crash 100% of the time", description="a\\b", created=3),
        task("Crash 1000 times", description="nothing", created=4),
    )
    found = lambda q: names(listing.search(tasks, q))
    assert found("memory") == ["Add login", "Fix memory leak"]
    assert found("memory leak") == ["Fix memory leak"]
    assert found("crash") == ["Crash 1000 times", "Crash 100% of the time"]
    assert found("100% of") == ["Crash 100% of the time"]
    assert found("f_x%leak") == ["Fix memory leak"]
    assert found("a\\b") == ["Crash 100% of the time"]
    assert found("b\\") == []
    assert found("nonexistent") == []
    assert len(found("%")) == 4


def test_progress_of_root_tasks_only(make_tasks):
    tasks = make_tasks(
        task("root", state="NEW", created=1),
        task("kid", state="IN_PROGRESS", parent="root", created=2),
        task("kid done", state="DONE", parent="root", created=3),
        task("grandkid", state="DONE", parent="kid", created=4),
    )
    for options in (ListOptions(), ListOptions(all=True, show_done=True)):
        rows = {r.title: (r.subtasks_total, r.subtasks_done) for r in listing.list_with_progress(tasks, options).collect()}
        assert rows["root"] == (2, 1)
        assert rows["kid"] == (0, 0)


def test_running_number_equals_row_number(make_tasks):
    """One group holds most rows, and all of them share three times."""
    rows = [
        task(i, parent="hot" if i % 4 else f"p{i % 3}", priority=["high", "medium", "low", None][i % 4], state=["NEW", "DONE", "IN_PROGRESS"][i % 3], created=i % 3)
        for i in range(300)
    ]
    tasks = make_tasks(*rows)
    for order, keys in (
        (ordering.list_order(), []),
        (ordering.newest_first(), []),
        (ordering.child_order(), ["parent"]),
        (ordering.child_order("rank"), ["parent"]),
    ):
        plain = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
        expected = {r.id: r.n for r in tasks.select("id", plain.alias("n")).collect()}
        got = {r.id: r["rank"] for r in ordering.running_number(tasks, order, keys).collect()}
        assert got == expected
