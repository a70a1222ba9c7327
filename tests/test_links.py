"""Links followed by doubling: cycles, closures, and how many rounds they take."""

import random

import pytest
from conftest import sha, task
from pyspark.sql import functions as F

from tasklattice.operators import links, maintenance

PAIRS = "id string, link string"


def walk(start, to):
    """All that a start leads to, in order, until a link ends or comes back."""
    seen, at = [], to.get(start)
    while at is not None and at not in seen:
        seen.append(at)
        at = to.get(at)
    return seen


@pytest.fixture
def passes(monkeypatch):
    """Counts the tables that following links writes."""
    count = []
    plain = links.materialise
    monkeypatch.setattr(links, "materialise", lambda df: count.append(1) or plain(df))
    return count


@pytest.mark.parametrize("seed", range(4))
def test_cycles_and_closures_of_random_links(spark, seed):
    rng = random.Random(seed)
    to = {f"n{i}": rng.choice([None, f"n{rng.randrange(40)}", f"n{max(0, i - 1)}"]) for i in range(40)}
    rows = spark.createDataFrame([*to.items(), (None, "n1"), ("n41", "gone")], PAIRS)
    table = links.single_links(rows, "link")
    assert {(r.id, r.to) for r in links.on_cycles(table).collect()} == {(i, to[i]) for i in to if i in walk(i, to)}
    seeds = rng.sample(sorted(to), 5)
    found, count = links.reached(spark.createDataFrame([(s,) for s in seeds], "id string"), table)
    wanted = {i for s in seeds for i in walk(s, to)} - set(seeds)
    got = [r.id for r in found.collect()]
    assert sorted(got) == sorted(wanted) and count == len(got)


def test_rounds_move_hashes_unless_two_ids_share_one(spark, monkeypatch):
    """Rounds write longs in place of ids; with a hash of few values they write the ids, and find the same."""
    table = links.single_links(spark.createDataFrame([(f"n{i}", f"n{max(i - 1, i // 10 * 10) if i % 10 else i + 9}") for i in range(40)], PAIRS), "link")
    plain, kinds = links.materialise, []
    monkeypatch.setattr(links, "materialise", lambda df: kinds.append(dict(df.dtypes)["to"]) or plain(df))
    found = [sorted(map(tuple, links.on_cycles(table).collect()))]
    assert len(found[0]) == 40 and set(kinds) == {"bigint"}
    kinds.clear()
    monkeypatch.setattr(links, "HASH", lambda column: F.crc32(F.col(column) if isinstance(column, str) else column) % 7)
    found.append(sorted(map(tuple, links.on_cycles(table).collect())))
    assert found[0] == found[1] and set(kinds) == {"string"}


def test_an_id_on_several_rows_has_its_smallest_link(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "a"), ("b", "a")], PAIRS)
    assert [tuple(r) for r in links.on_cycles(links.single_links(rows, "link")).collect()] == [("a", "a")]
    assert links.on_cycles(links.single_links(rows.limit(0), "link")).count() == 0


def test_audit_reports_cycles_in_few_passes(make_tasks, passes):
    """Cycles of 1, 2 and 500 steps, chains into them and beside them."""
    rows = [task(f"r{k}", parent=f"r{(k + 1) % 500}") for k in range(500)]
    rows += [task("own", parent="own"), task("two", parent="other"), task("other", parent="two")]
    rows += [task(f"t{k}", parent=f"t{k - 1}" if k else "two") for k in range(100)]
    rows += [task(f"c{k}", parent=f"c{k - 1}" if k else None, blocked_by="own") for k in range(200)]
    found = {(r.id, r.rule) for r in maintenance.audit(make_tasks(*rows)).collect()}
    assert found == {(sha(name), "parent forms a cycle") for name in (*(f"r{k}" for k in range(500)), "own", "two", "other")}
    assert len(passes) < 15


def test_deleting_a_long_chain_in_few_passes(spark, make_tasks, passes):
    """A task that stays holds 500 others, half by parents, half by blockers."""
    rows = [task(f"p{k}", parent=f"p{k + 1}") for k in range(250)] + [task("p250", blocked_by="b0")]
    rows += [task(f"b{k}", blocked_by=f"b{k + 1}") for k in range(250)] + [task("b250"), task("free", parent="freed"), task("freed")]
    tasks = make_tasks(*rows)
    ids = tasks.where("title <> 'p0'").select("id")
    change = maintenance.delete_tasks(tasks, ids)
    assert {r.title for r in change.tasks.collect()} == {r["title"] for r in rows} - {"free", "freed"}
    assert change.refused.count() == 501
    # Two tables per round.
    assert len(passes) < 2 * 2 * 15
