"""A table stored by buckets: changes rewrite the folders they touch."""

import os

import pytest
from conftest import sha, task
from pyspark.sql import functions as F

from tasklattice.sources import buckets


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def folders(names):
    return {os.path.dirname(n) for n in names}


def test_a_change_rewrites_the_buckets_it_touches(spark, make_tasks, tmp_path):
    path = str(tmp_path / "table")
    rows = [task(n, title=f"title {n}") for n in range(400)]
    buckets.write_buckets(make_tasks(*rows), path, 32)
    before = files(path)
    assert len(folders(before)) == 32
    changed = make_tasks(*(task(n, title="new title", description=None) for n in (3, 50)), task("fresh", title="fresh"))
    removed = spark.createDataFrame([(sha(n),) for n in (7, 50, "unknown")], "id string")
    touched = buckets.write_back(spark, path, changed, removed)
    after = files(path)
    assert 3 <= len(touched) <= 5
    assert folders(before - after) | folders(after - before) <= {f"buckets=32/bucket={n}" for n in touched}
    got = {r.id: (r.title, r.description) for r in buckets.read_buckets(spark, path).collect()}
    expected = {sha(n): (f"title {n}", f"About {n}") for n in range(400) if n != 7}
    expected |= {sha(3): ("new title", ""), sha(50): ("new title", ""), sha("fresh"): ("fresh", "About fresh")}
    assert got == expected
    # Once more changes nothing.
    buckets.write_back(spark, path, changed, removed)
    assert {r.id: (r.title, r.description) for r in buckets.read_buckets(spark, path).collect()} == expected


def test_an_emptied_bucket_is_empty(spark, make_tasks, tmp_path):
    path = str(tmp_path / "table")
    tasks = make_tasks(*(task(n) for n in range(40)))
    buckets.write_buckets(tasks, path, 8)
    numbered = tasks.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    gone = numbered.where("bucket = 2")
    touched = buckets.write_back(spark, path, tasks.limit(0), gone)
    assert touched == [2]
    assert buckets.read_buckets(spark, path).count() == 40 - gone.count()
    assert not any("bucket=2/" in f for f in files(path))
    assert buckets.write_back(spark, path, tasks.limit(0)) == []


def test_a_table_without_rows_is_refused(spark, make_tasks, tmp_path):
    path = str(tmp_path / "table")
    os.makedirs(path)
    with pytest.raises(ValueError, match="buckets"):
        buckets.write_back(spark, path, make_tasks(task("a")))
