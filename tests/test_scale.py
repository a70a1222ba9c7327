"""Plans and skew: what must hold however large the tables are."""

from collections import Counter

import pytest
from conftest import sha, task
from pyspark.sql import functions as F

from tasklattice.operators import hierarchy, lifecycle, listing, ordering, summary
from tasklattice.operators.listing import ListOptions
from tasklattice.session import scratch_path
from tasklattice.sources.tables import read_tasks, write_tasks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, make_tasks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "tasks")
    write_tasks(make_tasks(*(task(i, state="NEW", parent=None if i % 3 else "0") for i in range(50))), path)
    return read_tasks(spark, path)


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(listing.list_tasks(stored, ListOptions(priority="high", kind="bug")))
    assert "EqualTo(priority,high)" in plan and "EqualTo(kind,BUG)" in plan and "Not(In(state" in plan
    for narrow in (hierarchy.progress(stored), summary.summary_counts(stored), summary.summary_totals(stored)):
        plan = plan_of(narrow)
        assert "description" not in plan and "title" not in plan


def test_a_limited_listing_is_a_top_k(stored):
    plan = plan_of(listing.list_tasks(stored, ListOptions()))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_counts_are_combined_before_the_shuffle(stored):
    for counts in (hierarchy.progress(stored), hierarchy.blocking_children(stored), summary.tag_counts(stored)):
        assert "partial_count" in plan_of(counts)


@pytest.fixture
def large_joins(spark):
    """Every join shuffles, and a partition of a few kilobytes counts as skewed."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def lopsided(make_tasks):
    rows = [task(i, state="NEW", parent="0" if i % 3 == 1 else f"{i % 97}" if i % 3 == 2 else None) for i in range(3000)]
    return make_tasks(*rows).repartition(6)


def test_a_hot_parent_is_split(spark, lopsided, large_joins):
    joined = hierarchy.with_parent(lopsided).select("id", "parent", "parent_title")
    assert "skew=true" in final_plan_of(joined)
    assert joined.where("parent_title = '0'").count() >= 1000
    assert joined.count() == 3000


def test_rows_without_a_link_do_not_meet_in_one_partition(lopsided, large_joins):
    roots = lopsided.where("parent IS NULL")
    sizes = hierarchy.with_parent(roots).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 500


def test_many_requests_for_one_task_are_split(spark, lopsided, large_joins):
    requests = spark.range(4000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, sha(0)).otherwise(F.sha1((F.col("id") % 3000).cast("string"))).alias("ref"),
        F.lit("in-progress").alias("command"),
    ).repartition(6)
    judged = lifecycle.judge_transitions(lopsided, requests)
    assert "skew=true" in final_plan_of(judged)
    assert judged.count() == 4000


@pytest.mark.parametrize("shape", ["one time", "many times of a day", "ids of one stem"])
def test_numbering_of_one_hot_group_uses_many_tasks(lopsided, large_joins, shape):
    hot = lopsided.where(F.col("parent").isNotNull()).withColumn("parent", F.lit("hot"))
    if shape == "many times of a day":
        hot = hot.withColumn("created", (F.col("created") + F.expr("make_dt_interval(0, 0, 0, rand(1))")).cast("timestamp_ntz"))
    if shape == "ids of one stem":
        hot = hot.withColumn("id", F.concat(F.lit("ABC-"), "title"))
    hot.write.mode("overwrite").parquet(path := scratch_path(hot.sparkSession, "hot"))
    hot = hot.sparkSession.read.parquet(path)
    numbered = ordering.running_number(hot, ordering.child_order(), ["parent"], "no")
    (window,) = [line for line in plan_of(numbered).splitlines() if "row_number()" in line]
    assert "_part" in window
    rows = numbered.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.no for r in rows) == list(range(1, hot.count() + 1))
    assert [r.id for r in sorted(rows, key=lambda r: r.no)] == [r.id for r in hot.orderBy(*ordering.child_order()).collect()]
    sizes = Counter(r.task for r in rows)
    assert len(sizes) > 2 and max(sizes.values()) < len(rows) * 0.7


def test_core_plans_need_no_python(stored):
    for result in (
        listing.list_with_progress(stored),
        listing.search(stored, "x"),
        hierarchy.children(stored),
        hierarchy.completable(stored),
        summary.summary_totals(stored),
    ):
        plan = plan_of(result)
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
