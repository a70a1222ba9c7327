"""Writing tasks as JSON lines, CSV, Markdown and plain text, in parallel part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import ordering as O
from ..operators.listing import ListOptions, list_with_progress, matching

# What an export may be sorted by: the order of listings, or that of the inbox and of searches.
ORDERS = {"list": O.list_order, "newest": O.newest_first}

# The layout of the Markdown export.
MARKDOWN_TITLE = "# Tasks Export"
MARKDOWN_HEADER = "| ID | Type | State | Priority | Title | Tags | Source | Parent | Blocked By |"
MARKDOWN_RULE = "|---|---|---|---|---|---|---|---|---|"
MARKDOWN_DETAILS = "## Task Details"

# RFC 4180: quotes doubled, blanks kept, nothing written for an absent value.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# The names of the columns in the JSON and CSV exports.
def json_columns(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        "id", "kind", "state", "priority", "title", "description", "tags", "source", "parent", "blocked_by",
        C.stamp("created").alias("created_at"),
        C.stamp("updated").alias("updated_at"),
    )


def csv_columns(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        F.col("id").alias("ID"),
        F.col("kind").alias("Type"),
        F.col("state").alias("State"),
        F.col("priority").alias("Priority"),
        F.col("title").alias("Title"),
        F.col("tags").alias("Tags"),
        F.col("source").alias("Source"),
        F.col("parent").alias("Parent"),
        F.col("blocked_by").alias("BlockedBy"),
        C.stamp("created").alias("Created"),
        C.stamp("updated").alias("Updated"),
    )


def export_json(tasks: DataFrame, path: str, order: str = "list") -> None:
    """One JSON object per line; absent links are left out."""
    json_columns(tasks.orderBy(*ORDERS[order]())).write.option("ignoreNullFields", "true").json(path)


def export_csv(tasks: DataFrame, path: str, order: str = "list") -> None:
    csv_columns(tasks.orderBy(*ORDERS[order]())).write.options(**CSV_OPTIONS).csv(path)


def markdown_rows(tasks: DataFrame, order: str = "list") -> DataFrame:
    """The numbered rows of the Markdown table: (no, id, line)."""
    numbered = O.running_number(tasks, ORDERS[order](), name="no")
    return numbered.select("no", "id", X.markdown_cells("no").alias("line"))


def markdown_detail(tasks: DataFrame) -> DataFrame:
    """The detail section of every task: (id, line)."""
    return tasks.select("id", X.markdown_section().alias("line"))


def markdown_document(tasks: DataFrame, order: str = "list") -> DataFrame:
    """The whole Markdown export as sorted lines."""
    numbered = O.running_number(tasks, ORDERS[order](), name="no")

    entry = lambda part, no, line: F.struct(
        F.lit(part).alias("part"), no.cast("long").alias("no"), line.alias("line")
    )
    total = F.concat(F.lit("Total tasks: "), F.col("n").cast("string"))
    head = F.concat_ws(
        "\n", F.lit(MARKDOWN_TITLE), F.lit(""), total, F.lit(""), F.lit(MARKDOWN_HEADER), F.lit(MARKDOWN_RULE)
    )
    frame = tasks.agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(
            F.array(entry(1, F.lit(0), head), entry(3, F.lit(0), F.lit(f"\n{MARKDOWN_DETAILS}\n")))
        ).alias("entry")
    )
    body = numbered.select(
        F.explode(
            F.array(entry(2, F.col("no"), X.markdown_cells("no")), entry(4, F.col("no"), X.markdown_section()))
        ).alias("entry")
    )
    return frame.unionByName(body).orderBy("entry.part", "entry.no").select("entry.line")


def export_markdown(tasks: DataFrame, path: str, order: str = "list") -> None:
    markdown_document(tasks, order).write.text(path)


def text_lines(tasks: DataFrame, form: str, order: str = "list") -> DataFrame:
    """Tasks in order in a plain text form: one column, one task per row."""
    if form == "oneline":
        line = X.oneline()
    else:
        blank = F.lit(0)
        line = X.logstyle(blank, blank)
    return tasks.orderBy(*ORDERS[order]()).select(line.alias("line"))


def list_text(tasks: DataFrame, options: ListOptions = ListOptions()) -> DataFrame:
    """The listing in log form, in order, with the progress of root tasks: (id, line)."""
    return list_with_progress(tasks, options).select("id", X.logstyle().alias("line"))


def _export_text(form: str):
    return lambda tasks, path, order: text_lines(tasks, form, order).write.text(path)


WRITERS = {
    "json": export_json,
    "csv": export_csv,
    "markdown": export_markdown,
    "standard": _export_text("standard"),
    "oneline": _export_text("oneline"),
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text export in the order of its files: (no, value)."""
    lines = spark.read.text(path).select(
        "value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_line")
    )
    numbered = O.running_number(lines, [F.asc(n) for n in ("file_name", "file_block_start", "_line")], name="no")
    return numbered.select("no", "value")


def export_options(active: bool = False, **filters) -> ListOptions:
    """What an export selects: all states by default, only open accepted ones with ``active``."""
    return ListOptions(
        all=not active, show_done=not active, show_cancelled=not active, limit=0, **filters
    )


def export_rows(rows: DataFrame, fmt: str, path: str, order: str = "list") -> None:
    """Write rows that are chosen already, as an inbox or a search's hits, in the given order.

    The format name is not case-sensitive.
    """
    name = (fmt or "standard").lower()
    if name not in WRITERS:
        raise ValueError(f"unsupported format: {fmt}")
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order}")
    WRITERS[name](rows, path, order)


def export_tasks(tasks: DataFrame, fmt: str, path: str, active: bool = False, order: str = "list", **filters) -> None:
    """Filter, put in order and write."""
    export_rows(matching(tasks, export_options(active, **filters)), fmt, path, order)
