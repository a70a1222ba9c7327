"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import columns as C
from ..functions import text as X
from ..operators import cards as cards_
from ..operators import hierarchy, ingest, lifecycle, listing, maintenance, matching, ordering, summary, textindex
from ..operators.listing import ListOptions
from ..operators.replay import replay
from ..schema import TASK_COLUMNS, TASK_SCHEMA
from ..session import materialise, release, scratch_path
from ..sources import buckets, exports
from ..sources.tables import read_tasks, write_tasks
from ..streaming import keyed_replay
from ..streaming.capture import capture_stream, captured_rows
from ..streaming.replay import replay_stream, verdicts
from ..streaming.state import state_partitions
from . import fixture as fx

AT = "2024-01-15 10:30:00"
AUTHOR = "A. Writer <writer@example.com>"

Query = Callable[[SparkSession, str], DataFrame]


def _tasks(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    return fx.derive(spark, sf_dir, fx.TASKS, busy)


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """Task columns with times as text, so both engines print the same."""
    columns = names or [n for n in df.columns]
    return df.select(
        *(C.stamp(n).alias(n) if n in ("created", "updated") else F.col(n) for n in columns)
    )


def _ranked(df: DataFrame, order=ordering.list_order) -> DataFrame:
    """Number a result that its limit has bounded."""
    ranked = ordering.with_rank(df, order())
    return _shown(ranked.withColumn("rank", F.col("rank").cast("long")))


def _numbered(df: DataFrame, kind: str = "list") -> DataFrame:
    """Number a result of any size."""
    order = {"list": ordering.list_order, "newest": ordering.newest_first}[kind]
    return _shown(ordering.running_number(df, order()))


def _top(options: ListOptions) -> Query:
    return lambda spark, sf: _ranked(listing.list_tasks(_tasks(spark, sf), options))


def _all(options: ListOptions) -> Query:
    return lambda spark, sf: _numbered(listing.matching(_tasks(spark, sf), options))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most urgent active tasks with the progress of their subtasks."""
    listed = listing.list_with_progress(_tasks(spark, sf_dir), ListOptions())
    return _ranked(listed)


def _list_all_with_progress(spark: SparkSession, sf: str) -> DataFrame:
    options = ListOptions(all=True, show_done=True, show_cancelled=True)
    return _shown(
        listing.list_with_progress(_tasks(spark, sf), options), "id", "state", "subtasks_total", "subtasks_done"
    )


def _search_many(spark: SparkSession, sf: str) -> DataFrame:
    return matching.search_many(_tasks(spark, sf, busy=True), fx.derive(spark, sf, fx.SEARCHES))


def _with_refs(operator: Callable[[DataFrame, DataFrame], DataFrame], text: str) -> Query:
    return lambda spark, sf: operator(fx.derive(spark, sf, text), _tasks(spark, sf, busy=True))


def _over_tasks(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(_tasks(spark, sf))


def _line(expression: Callable) -> Query:
    return lambda spark, sf: _tasks(spark, sf).select("id", expression().alias("line"))


def _children(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.children(_tasks(spark, sf)).select("parent", "child_no", "id", "priority", "state", "title")


def _logstyle(spark: SparkSession, sf: str) -> DataFrame:
    tasks = _tasks(spark, sf, busy=True)
    listed = tasks.join(hierarchy.progress(tasks).withColumnRenamed("parent", "id"), "id", "left")
    return listed.select("id", X.logstyle().alias("line"))


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """The small scalar functions side by side."""
    return _tasks(spark, sf).select(
        "id",
        C.short_id().alias("short"),
        C.is_blocked().alias("blocked"),
        C.kind_label().alias("kind_label"),
        C.state_icon().alias("icon"),
        C.export_icon().alias("export_icon"),
        C.priority_mark().alias("mark"),
        C.state_verb().alias("verb"),
        C.tag_marks().alias("tag_marks"),
        C.tags_text(C.tag_list()).alias("tags_clean"),
        C.first_line().alias("teaser"),
        C.stamp("created").alias("stamp"),
        C.mail_date("created").alias("mail_date"),
        C.created_message().alias("message"),
        C.count_label(F.size(C.tag_list()), "tag").alias("tag_count"),
        X.compact().alias("compact"),
    )


def _next_states(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.next_states(_tasks(spark, sf))


def _parse_messages(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ingest.parse_messages(fx.table(spark, sf, "documents").select("doc_id", "text"))
    return parsed.select("doc_id", "title", "description", "parse_error")


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    messages = fx.derive(spark, sf, fx.MESSAGES)
    return ingest.parse_messages(messages.withColumn("kind", F.upper("kind")))


def _new_tasks(spark: SparkSession, sf: str) -> DataFrame:
    drafted = ingest.new_tasks(_drafts(spark, sf), AT, "doc_id", AUTHOR)
    return _shown(drafted, "doc_id", *TASK_COLUMNS)


def _validate_tasks(spark: SparkSession, sf: str) -> DataFrame:
    drafted = ingest.new_tasks(_drafts(spark, sf), AT, "doc_id", AUTHOR)
    return ingest.validate_tasks(drafted).select("doc_id", "error")


def _capture(spark: SparkSession, sf: str) -> DataFrame:
    captured = ingest.capture(fx.derive(spark, sf, fx.MESSAGES), AT, "doc_id", author=AUTHOR)
    return _shown(captured)


def _capture_subtasks(spark: SparkSession, sf: str) -> DataFrame:
    messages = fx.derive(spark, sf, fx.SUBTASK_MESSAGES)
    captured = ingest.capture_subtasks(messages, _tasks(spark, sf, busy=True), AT, "doc_id", author=AUTHOR)
    return _shown(captured, "doc_id", "id", "parent", "priority", "state", "kind", "source", "tags", "error")


def _capture_family(spark: SparkSession, sf: str) -> DataFrame:
    messages = fx.derive(spark, sf, fx.FAMILY_MESSAGES)
    captured = ingest.capture_family(messages, _tasks(spark, sf), AT, "doc_id", author=AUTHOR)
    return _shown(captured, "doc_id", "id", "parent", "priority", "state", "kind", "error")


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.audit(fx.derive(spark, sf, fx.DIRTY_TASKS))


def _upgrade(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(maintenance.upgrade_snapshot(fx.derive(spark, sf, fx.OLD_TASKS)))


def _append(spark: SparkSession, sf: str) -> DataFrame:
    new = fx.derive(spark, sf, fx.NEW_ROWS)
    change = maintenance.append_tasks(_tasks(spark, sf), new, "n")
    return _shown(change.tasks)


def _append_refused(spark: SparkSession, sf: str) -> DataFrame:
    new = fx.derive(spark, sf, fx.NEW_ROWS)
    return maintenance.append_tasks(_tasks(spark, sf), new, "n").refused


def _append_family(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of rows that link to each other."""
    new = fx.derive(spark, sf, fx.FAMILY_ROWS)
    stored = _tasks(spark, sf)
    change = maintenance.append_tasks(stored, new, "n")
    added = change.tasks.where("tags = 'imported'").select("id", F.lit(None).cast("long").alias("n"), F.lit("added").alias("outcome"))
    return added.unionByName(change.refused.select("id", F.col("n").cast("long").alias("n"), F.col("reason").alias("outcome")))


def _audit_upgraded(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules per table row that an upgrade leaves: none."""
    return maintenance.audit(maintenance.upgrade_snapshot(fx.derive(spark, sf, fx.OLD_TASKS)))


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    changes = fx.derive(spark, sf, fx.FIELD_CHANGES)
    return _shown(maintenance.upsert_fields(_tasks(spark, sf), changes, AT, "n").tasks)


def _stored_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of fields in a table stored by buckets, written back and read again."""
    path = scratch_path(spark, "buckets")
    buckets.write_buckets(_tasks(spark, sf), path)
    changes = fx.derive(spark, sf, fx.FIELD_CHANGES)
    after = maintenance.upsert_fields(buckets.read_buckets(spark, path), changes, AT, "n").tasks
    buckets.write_back(spark, path, after.join(changes.select("id").distinct(), "id", "left_semi"))
    return _shown(buckets.read_buckets(spark, path))


def _stored_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """Deletions from a table stored by buckets."""
    path = scratch_path(spark, "buckets")
    buckets.write_buckets(_tasks(spark, sf), path)
    stored = buckets.read_buckets(spark, path)
    change = maintenance.delete_tasks(stored, fx.derive(spark, sf, fx.DELETIONS))
    gone = stored.select("id").join(change.tasks.select("id"), "id", "left_anti")
    buckets.write_back(spark, path, stored.limit(0), gone)
    return _shown(buckets.read_buckets(spark, path))


def _delete(spark: SparkSession, sf: str) -> DataFrame:
    change = maintenance.delete_tasks(_tasks(spark, sf), fx.derive(spark, sf, fx.DELETIONS))
    return change.tasks.select("id", F.lit("kept").alias("outcome")).unionByName(
        change.refused.select("id", F.lit("refused").alias("outcome"))
    )


def _transition_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.TRANSITIONS, busy=True)
    return lifecycle.apply_transitions(_tasks(spark, sf, busy=True), requests, AT).verdicts


def _transitions(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.TRANSITIONS, busy=True)
    return _shown(lifecycle.apply_transitions(_tasks(spark, sf, busy=True), requests, AT).tasks)


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.BLOCKS, busy=True)
    return _shown(lifecycle.apply_blocks(_tasks(spark, sf, busy=True), requests, AT).tasks, "id", "blocked_by", "updated")


def _block_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.BLOCKS, busy=True)
    return lifecycle.apply_blocks(_tasks(spark, sf, busy=True), requests, AT).verdicts


def _unblocks(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.UNBLOCKS, busy=True)
    return _shown(lifecycle.apply_unblocks(_tasks(spark, sf, busy=True), requests, AT).tasks, "id", "blocked_by", "updated")


def _unblock_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    requests = fx.derive(spark, sf, fx.UNBLOCKS, busy=True)
    return lifecycle.apply_unblocks(_tasks(spark, sf, busy=True), requests, AT).verdicts


def _search_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Searches over whole documents, by an index that is written and read again."""
    path = scratch_path(spark, "text-index")
    documents = fx.spread(fx.table(spark, sf, "documents"))
    textindex.write_index(documents, path, "doc_id", ["text"])
    index = textindex.read_index(spark, path, documents, "doc_id", ["text"])
    return textindex.search_index(index, fx.derive(spark, sf, fx.TEXT_SEARCHES)).withColumnRenamed("id", "doc_id")


# Spellings of filter values: accepted ones in any letter case, with a hyphen or an underscore, and refused ones.
SPELLINGS = (
    ("state", "in-progress"), ("state", "IN_PROGRESS"), ("state", "In-Progress"), ("state", "done"), ("state", "Cancelled"), ("state", "inbox"), ("state", "open"),
    ("priority", "HIGH"), ("priority", "Low"), ("priority", "urgent"), ("kind", "bug"), ("kind", "Regression"), ("kind", "chore"),
)


def _filter_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """How many tasks a filter value selects, or why it is refused; all counted in one pass."""
    rows = []
    for name, spelling in SPELLINGS:
        try:
            value = getattr(ListOptions(**{name: spelling}), name)
            found, error = F.count_if(F.col(name) == value), F.lit("")
        except ValueError as refusal:
            found, error = F.lit(0).cast("long"), F.lit(str(refusal))
        rows.append(F.struct(F.lit(name).alias("filter"), F.lit(spelling).alias("spelling"), found.alias("n"), error.alias("error")))
    return _tasks(spark, sf).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _all_in_inbox(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf, busy=True).withColumn("state", F.lit("INBOX"))


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    return replay(_all_in_inbox(spark, sf), fx.derive(spark, sf, fx.LOG, busy=True)).history


def _replay_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks for all but the quietest tasks, over a log with gaps."""
    log = fx.derive(spark, sf, fx.LOG_WITH_GAPS, busy=True)
    return replay(_all_in_inbox(spark, sf), log, hot_commands=3).history


def _replay_final(spark: SparkSession, sf: str) -> DataFrame:
    final = replay(_all_in_inbox(spark, sf), fx.derive(spark, sf, fx.LOG, busy=True)).tasks
    return _shown(final, "id", "state", "updated")


def _export(fmt: str, **filters) -> Callable[[SparkSession, str], str]:
    def write(spark: SparkSession, sf: str) -> str:
        path = scratch_path(spark, f"export-{fmt}")
        exports.export_tasks(_tasks(spark, sf), fmt, path, **filters)
        return path

    return write


def _export_json(spark: SparkSession, sf: str) -> DataFrame:
    names = exports.json_columns(_tasks(spark, sf)).columns
    schema = ", ".join(f"{name} string" for name in names)
    return spark.read.schema(schema).json(_export("json")(spark, sf))


def _export_csv(spark: SparkSession, sf: str) -> DataFrame:
    names = exports.csv_columns(_tasks(spark, sf)).columns
    schema = ", ".join(f"{name} string" for name in names)
    path = _export("csv", active=True, tag="ui")(spark, sf)
    rows = spark.read.schema(schema).options(**{**exports.CSV_OPTIONS, "nullValue": "\0"}).csv(path)
    return rows.select(*(F.coalesce(name, F.lit("")).alias(name) for name in names))


def _export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return exports.numbered_lines(spark, _export("markdown", kind="bug", state="in-progress")(spark, sf))


def _export_standard(spark: SparkSession, sf: str) -> DataFrame:
    return exports.numbered_lines(spark, _export("standard", priority="low", state="in-progress")(spark, sf))


def _export_chosen(rows: Callable[[DataFrame], DataFrame], fmt: str) -> Query:
    """An export in the order of its source, newest first."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, f"export-{fmt}")
        exports.export_rows(rows(_tasks(spark, sf)), fmt, path, order="newest")
        return exports.numbered_lines(spark, path)

    return run


def _list_text(spark: SparkSession, sf: str) -> DataFrame:
    return exports.list_text(_tasks(spark, sf), ListOptions(all=True, show_done=True, show_cancelled=True))


def _stored_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The table written and read again in two parts."""
    path = scratch_path(spark, "stored")
    tasks = _tasks(spark, sf)
    write_tasks(tasks.where("parent IS NULL"), path)
    write_tasks(tasks.where("parent IS NOT NULL"), path)
    return _shown(read_tasks(spark, path))


def _parse_heredocs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = ingest.parse_messages(fx.derive(spark, sf, fx.HEREDOCS), heredoc=True)
    return parsed.select("doc_id", "title", "description", "parse_error")


def _export_oneline(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(_export("oneline", priority="HIGH")(spark, sf))


def _stream_capture(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-capture")
    messages = spark.sql(fx.MESSAGES, documents=fx.feed(spark, sf, "documents"))
    capture_stream(messages, path, "doc_id", at=AT, author=AUTHOR).trigger(availableNow=True).start().awaitTermination()
    rows = captured_rows(spark, path, True).unionByName(captured_rows(spark, path, False))
    return _shown(rows, "doc_id", *TASK_SCHEMA.names, "error")


def _stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-replay")
    log = spark.sql(fx.LOG, events=fx.feed(spark, sf, "events"))
    replay_stream(log, _all_in_inbox(spark, sf), path).trigger(availableNow=True).start().awaitTermination()
    return verdicts(spark, path).drop("batch")


def _deliver(rows: DataFrame, count: int, path: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Write one delivery after the other; a stream takes each in a batch, restarted from its checkpoint."""
    spark = rows.sparkSession
    rows = materialise(rows)
    for number in range(count):
        rows.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(f"{path}/feed")
        feed = spark.readStream.schema(rows.drop("delivery").schema).parquet(f"{path}/feed")
        with state_partitions(spark):
            start(feed).trigger(availableNow=True).start().awaitTermination()
    release(rows)


def _stream_capture_late(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-late")
    feed = fx.derive(spark, sf, fx.FEED).withColumn("at", F.timestamp_seconds("at_second")).drop("at_second")
    span = f"{fx.REDELIVERY} seconds"
    _deliver(feed, fx.DELIVERIES, path, lambda f: capture_stream(f, path, "doc_id", event_time="at", redelivery=span, author=AUTHOR))
    rows = captured_rows(spark, path, True).unionByName(captured_rows(spark, path, False))
    return _shown(rows, "doc_id", "kind", "priority", "title", "description", "created", "source", "tags", "error")


def _stream_replay_keyed(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-keyed")
    states = keyed_replay.initial_states(_all_in_inbox(spark, sf).select("id", "parent", "state"))
    log = fx.derive(spark, sf, fx.LOG_FEED).select("seq", "id", "command", "delivery")
    _deliver(log, fx.LOG_DELIVERIES, path, lambda f: keyed_replay.keyed_replay_stream(f, states, path))
    return keyed_replay.keyed_verdicts(spark, path)


QUERIES: dict[str, Query] = {
    "list_default": _top(ListOptions()),
    "list_all": _all(ListOptions(all=True, show_done=True, show_cancelled=True)),
    "list_open": _all(ListOptions(all=True)),
    "list_by_state": _top(ListOptions(state="in-progress", limit=50)),
    "list_by_priority": _top(ListOptions(priority="high", limit=50)),
    "list_by_kind": _top(ListOptions(kind="bug", show_done=True, limit=50)),
    "list_by_tag": _top(ListOptions(tag="UI", limit=100)),
    "list_by_exact_tag": _top(ListOptions(tag="ui", tag_match="exact", limit=100)),
    "filter_spellings": _filter_spellings,
    "list_blocked": _all(ListOptions(blocked=True, limit=0)),
    "list_done": lambda s, d: _numbered(listing.matching(_tasks(s, d), ListOptions(state="DONE", all=True))),
    "list_cancelled": lambda s, d: _numbered(listing.list_cancelled(_tasks(s, d))),
    "list_with_progress": flagship,
    "list_all_with_progress": _list_all_with_progress,
    "inbox": lambda s, d: _numbered(listing.inbox(_tasks(s, d)), "newest"),
    "active_count": _over_tasks(listing.active_count),
    "search_title_body": lambda s, d: _numbered(listing.search(_tasks(s, d), "order 1_%CUSTOMER 2"), "newest"),
    "search_literal": lambda s, d: _numbered(listing.search(_tasks(s, d), "Priority 2-HIGH"), "newest"),
    "search_many": _search_many,
    "search_documents": _search_documents,
    "summary_counts": _over_tasks(summary.summary_counts),
    "summary_counts_active": _over_tasks(lambda t: summary.summary_counts(t, active_only=True)),
    "summary_totals": _over_tasks(summary.summary_totals),
    "summary_totals_active": _over_tasks(lambda t: summary.summary_totals(t, active_only=True)),
    "tag_counts": _over_tasks(summary.tag_counts),
    "tag_list": _over_tasks(
        lambda t: t.select("id", F.posexplode(C.tag_list()).alias("pos", "tag"))
    ),
    "progress": _over_tasks(hierarchy.progress),
    "child_breakdown": _over_tasks(hierarchy.child_breakdown),
    "children": _children,
    "with_parent": _over_tasks(
        lambda t: hierarchy.with_parent(t).select("id", "parent", "parent_short", "parent_title")
    ),
    "with_blocker": _over_tasks(
        lambda t: hierarchy.with_blocker(t).select("id", "blocked_by", "blocker_short", "blocker_title")
    ),
    "completable": _over_tasks(
        lambda t: hierarchy.completable(t).select(
            "id", "completable", "open_children", "open_child", "open_child_state"
        )
    ),
    "resolve_refs": _with_refs(matching.resolve, fx.REFS),
    "suggest": _with_refs(matching.suggest, fx.NEAR_REFS),
    "fuzzy_match": _with_refs(matching.fuzzy_match, fx.TYPO_REFS),
    "fuzzy_short": _with_refs(matching.fuzzy_match, fx.SHORT_REFS),
    "fuzzy_titles": lambda s, d: matching.fuzzy_titles(fx.derive(s, d, fx.TYPO_TITLES), fx.derive(s, d, fx.TITLED)),
    "cards": lambda s, d: cards_.cards(_tasks(s, d, busy=True), fx.derive(s, d, fx.REFS)),
    "columns": _columns,
    "oneline": _line(X.oneline),
    "logstyle": _logstyle,
    "subtask_line": _line(X.subtask_line),
    "markdown_rows": _over_tasks(exports.markdown_rows),
    "markdown_detail": _over_tasks(exports.markdown_detail),
    "next_states": _next_states,
    "parse_messages": _parse_messages,
    "new_tasks": _new_tasks,
    "validate_tasks": _validate_tasks,
    "capture": _capture,
    "capture_subtasks": _capture_subtasks,
    "capture_family": _capture_family,
    "audit": _audit,
    "audit_cycles": lambda s, d: maintenance.audit(fx.derive(s, d, fx.CYCLIC_TASKS)),
    "upgrade_snapshot": _upgrade,
    "append_tasks": _append,
    "append_refused": _append_refused,
    "append_family": _append_family,
    "audit_upgraded": _audit_upgraded,
    "upsert_fields": _upsert,
    "stored_changes": _stored_changes,
    "stored_deletions": _stored_deletions,
    "delete_tasks": _delete,
    "transition_verdicts": _transition_verdicts,
    "apply_transitions": _transitions,
    "apply_blocks": _blocks,
    "block_verdicts": _block_verdicts,
    "apply_unblocks": _unblocks,
    "unblock_verdicts": _unblock_verdicts,
    "replay": _replay,
    "replay_hot": _replay_hot,
    "replay_final": _replay_final,
    "export_json": _export_json,
    "export_csv": _export_csv,
    "export_markdown": _export_markdown,
    "export_oneline": _export_oneline,
    "export_standard": _export_standard,
    "export_inbox": _export_chosen(listing.inbox, "markdown"),
    "export_search": _export_chosen(lambda t: listing.search(t, "order 1_%CUSTOMER 2"), "oneline"),
    "list_text": _list_text,
    "stored_tasks": _stored_tasks,
    "parse_heredocs": _parse_heredocs,
    "stream_capture": _stream_capture,
    "stream_replay": _stream_replay,
    "stream_capture_late": _stream_capture_late,
    "stream_replay_keyed": _stream_replay_keyed,
}
