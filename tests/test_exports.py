import csv
import glob
import io
import json

import pytest
from conftest import sha, task

from tasklattice.functions import text as X
from tasklattice.functions import columns as C
from tasklattice.sources import exports


@pytest.fixture(scope="module")
def three(make_tasks):
    return make_tasks(
        task("bug", priority="high", state="NEW", tags="a,b", title='Say "hi", twice', source=" padded ", created=1),
        task("feature", kind="FEATURE", state="IN_PROGRESS", blocked_by="bug", description="One\nTwo", created=2),
        task("regression", kind="REGRESSION", state="DONE", priority="low", parent="bug", description="", created=3),
    )


def files(path):
    return [open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*"))]


def written(tasks, tmp_path, fmt, **options):
    path = str(tmp_path / "out")
    exports.export_tasks(tasks, fmt, path, **options)
    return files(path)


def test_json(three, tmp_path):
    rows = {r["id"]: r for text in written(three, tmp_path, "JSON") for r in map(json.loads, text.splitlines())}
    assert len(rows) == 3
    assert rows[sha("feature")] == {
        "id": sha("feature"), "kind": "FEATURE", "state": "IN_PROGRESS", "priority": "medium", "title": "feature",
        "description": "One\nTwo", "tags": "", "source": "", "blocked_by": sha("bug"),
        "created_at": "2024-01-15 10:30:02", "updated_at": "2024-01-15 10:30:00",
    }
    assert rows[sha("regression")]["parent"] == sha("bug")


def test_csv(three, tmp_path):
    rows = [r for text in written(three, tmp_path, "csv") for r in csv.DictReader(io.StringIO(text))]
    assert list(rows[0]) == ["ID", "Type", "State", "Priority", "Title", "Tags", "Source", "Parent", "BlockedBy", "Created", "Updated"]
    bug = next(r for r in rows if r["ID"] == sha("bug"))
    assert (bug["Title"], bug["Tags"], bug["Source"], bug["Parent"]) == ('Say "hi", twice', "a,b", " padded ", "")


def test_markdown(three, tmp_path):
    text = "".join(written(three, tmp_path, "markdown"))
    short = sha("bug")[:7]
    assert text.startswith(
        "# Tasks Export\n\nTotal tasks: 3\n\n| ID | Type | State | Priority | Title | Tags | Source | Parent | Blocked By |\n|---|---|---|---|---|---|---|---|---|\n"
        f"| 1 | FEATURE | IN_PROGRESS | medium | feature | - | - | - | #{short} |\n"
        '| 2 | BUG | NEW | high | Say "hi", twice | a,b |  padded  | - | - |\n'
        f"| 3 | REGRESSION | DONE | low | regression | - | - | #{short} | - |\n"
        f"\n## Task Details\n\n### #{sha('feature')}: feature\n\nOne\nTwo\n\n- **Type:** Feature\n- **State:** IN_PROGRESS ▶\n- **Priority:** medium =\n"
        f"- **Blocked by:** #{sha('bug')}\n- **Created:** 2024-01-15 10:30:02\n- **Updated:** 2024-01-15 10:30:00\n\n### #"
    )
    assert text.endswith(f"- **Parent:** #{sha('bug')}\n- **Created:** 2024-01-15 10:30:03\n- **Updated:** 2024-01-15 10:30:00\n\n")


def test_filters(three, tmp_path):
    assert len("".join(written(three, tmp_path, "oneline", active=True)).splitlines()) == 2
    for n, (options, count) in enumerate([({"state": "in-progress"}, 1), ({"kind": "Bug"}, 1), ({"priority": "LOW"}, 1), ({"tag": "b"}, 1), ({}, 3)]):
        exports.export_tasks(three, "json", str(tmp_path / f"f{n}"), **options)
        assert len("".join(files(str(tmp_path / f"f{n}"))).splitlines()) == count
    for options in ({"state": "inbox"}, {"priority": "x"}):
        with pytest.raises(ValueError):
            exports.export_tasks(three, "json", str(tmp_path / "bad"), **options)
    with pytest.raises(ValueError, match="unsupported format"):
        exports.export_tasks(three, "xml", str(tmp_path / "bad"))


def test_text_in_list_order(three, tmp_path):
    lines = "".join(written(three, tmp_path, "oneline")).splitlines()
    assert lines == [
        f"{sha('feature')[:7]} ▶ feature(medium): feature [BLOCKED]",
        f"{sha('bug')[:7]} ◆ bug(high): Say \"hi\", twice",
        f"{sha('regression')[:7]} ✓ regression(low): regression",
    ]


def test_standard_is_the_default(three, tmp_path):
    text = "".join(written(three, tmp_path, ""))
    assert text.startswith(f"task {sha('feature')}\nAuthor: A <a@example.com>\nDate:   Mon, 15 Jan 2024 10:30:02 +0000\n\n  ▶ feature(medium): feature\n    One\n    Two\n\n    Blocked-by:")


def test_icons_and_marks(make_tasks):
    states = ["INBOX", "NEW", "IN_PROGRESS", "DONE", "CANCELLED", "INVALID", "OTHER"]
    rows = make_tasks(*(task(s, state=s, priority="high") for s in states), task("low", priority="low"), task("none", priority=""))
    got = {r.title: r for r in rows.select("title", C.state_icon().alias("i"), C.export_icon().alias("e"), C.priority_mark().alias("p")).collect()}
    assert [got[s].i for s in states] == ["?", "◆", "▶", "✓", "✗", "⊘", "·"]
    assert [got[s].e for s in states] == ["?", "◆", "▶", "✓", "✗", "?", "?"]
    assert (got["NEW"].p, got["low"].p, got["none"].p) == ("!", "-", ".")


def test_subtask_line_pads_by_bytes(make_tasks):
    rows = make_tasks(task("a", state="NEW"), task("b", title="x" * 90, blocked_by="a"), task("é", state="INBOX"))
    lines = [r.line for r in rows.select(X.subtask_line().alias("line")).collect()]
    assert len(lines[0].encode()) == 79 and lines[0].endswith("  | bug, medium")
    assert lines[1].endswith("x  | bug, medium, blocked")
    assert len(lines[2].encode()) == 79


def test_compact_form(three):
    lines = {r.title: r.line for r in three.select("title", X.compact().alias("line")).collect()}
    assert lines["feature"] == f"{sha('feature')[:7]} ▶ feature(medium): feature ⊘"
    assert lines['Say "hi", twice'].endswith('twice #a #b')


def test_exports_keep_the_order_of_their_source(spark, make_tasks, tmp_path):
    tasks = make_tasks(*(task(f"t{n}", priority=("low", "high")[n % 2], state="INBOX", created=n) for n in range(6)))
    path = str(tmp_path / "newest")
    exports.export_rows(tasks, "Oneline", path, order="newest")
    lines = [r.value for r in exports.numbered_lines(spark, path).orderBy("no").collect()]
    assert [line.rsplit(" ", 1)[1] for line in lines] == ["t5", "t4", "t3", "t2", "t1", "t0"]
    with pytest.raises(ValueError):
        exports.export_rows(tasks, "oneline", str(tmp_path / "bad"), order="size")


def test_list_text_shows_progress_of_roots_only(make_tasks):
    tasks = make_tasks(
        task("root", state="NEW"),
        task("child", state="NEW", parent="root"),
        task("leaf", state="DONE", parent="child"),
        task("done", state="DONE", parent="root"),
    )
    lines = {r.id: r.line for r in exports.list_text(tasks).collect()}
    assert set(lines) == {sha("root"), sha("child")}
    assert "[1/2]" in lines[sha("root")] and "[" not in lines[sha("child")]
