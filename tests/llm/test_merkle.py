"""The Merkle manifest against hashlib, over small trees of several levels."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tasklattice.llm import merkle_manifest as mm
from tasklattice.llm.common import LOWER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    parts = (row[0], row[3], row[2], row[4], row[1])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def lowered(row):
    return (row[0], None if row[1] is None else row[1].encode().translate(LOWER).decode(), *row[2:])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over the nodes, and for each of them what stands left and right of it at every level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            paths[k].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        places = [at // 16 for at in places]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[source] = own, *climb([leaf_of(r) for r in own])
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for source, top in zip(order, tops):
        own, subroot, paths = trees[source]
        for row, path in zip(own, paths):
            path = path + top
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf_of(lowered(row) if changed else row)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def query(spark, tmp_path):
    def run(rows, extra=False):
        docs = spark.createDataFrame(rows, SCHEMA)
        if extra:
            docs = docs.withColumns({name: F.lit("x") for name in ("grp", "row", "leaf", "tree", "pos", "salt", "place", "slot_0", "_at", "_part", "path", "root")})
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        return mm.op12_merkle_manifest(spark, str(tmp_path))

    return run


def test_trees_of_several_levels(query):
    """A group of three levels, one that fills its runs, single leaves, a last run of one, nulls in every column."""
    rows = [(k, f"Text {k} ÄÖ\nLine", "en", "hot", k) for k in range(273)]
    rows += [(k, f"low {k}", "en", "full", 1) for k in range(16)]
    rows += [(k, f"Up {k}", None, f"s{k}", None) for k in range(20)]
    rows += [(k, None if k % 2 else "", "de", None, 0) for k in range(17)]
    rows += [(None, "No Id", "en", "hot", 1), (7, "Other text of a repeated id", "en", "hot", 1), (900, "X" * 200_000, "en", "é", 1)]
    assert found(query(rows, extra=True)) == brute(rows)


def test_repeated_rows_are_leaves(query):
    rows = [(1, "Same", "en", "a", 4)] * 40 + [(2, "Last", "en", "a", 4)]
    got = found(query(rows))
    assert len(got) == 41
    expected = brute(rows)
    for column in (0, 1, 2, 3, 5):
        assert sorted(r[column] for r in got) == sorted(r[column] for r in expected)
    assert sorted(r[4] for r in got) == sorted(r[4] for r in expected)


@pytest.mark.parametrize("rows", [[], [(5, "Only", "en", "a", 4)], [(None, None, None, None, None)]])
def test_smallest_tables(query, rows):
    assert found(query(rows)) == (brute(rows) if rows else [])


def test_manifest_tables_and_other_columns(spark):
    """The operator on its own: other id, group and columns, its levels, and a proof that fails for a changed row."""
    docs = spark.createDataFrame([(f"k{n:03}", n % 2, f"v{n}") for n in range(70)], "key string, part int, value string")
    made = mm.manifest(mm.leaves(docs, "key", "part", ["key", "value"], value=docs["value"]))
    assert [t.count() for t in made.groups] == [6, 2]
    assert [r["size"] for r in made.names.orderBy("tree").collect()] == [35, 35]
    proved = mm.proofs(made)
    again = mm.leaf_digest([F.col("id"), F.col("value")])
    assert proved.where(mm.fold(again, F.col("path")) == F.col("root")).count() == 70
    other = mm.leaf_digest([F.col("id"), F.concat("value", F.lit("!"))])
    assert proved.where(mm.fold(other, F.col("path")) == F.col("root")).count() == 0
    made.release()
