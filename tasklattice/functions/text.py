"""Text forms of tasks, one column per form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

LINE_WIDTH = 80
BODY_INDENT = "    "


def optional_line(present: Column, *parts: Column | str) -> Column:
    """A line that is only there under a condition; empty otherwise."""
    pieces = [F.lit(part) if isinstance(part, str) else part for part in parts]
    return F.when(present, F.concat(*pieces, F.lit("\n"))).otherwise("")


def headline(title: Column | str = "title") -> Column:
    """``bug(high): title``."""
    return F.concat(F.lower("kind"), F.lit("("), F.col("priority"), F.lit("): "), C.as_col(title))


def oneline() -> Column:
    blocked = F.when(C.is_blocked(), " [BLOCKED]").otherwise("")
    return F.concat(C.short_id(), F.lit(" "), C.state_icon(), F.lit(" "), headline(), blocked)


def compact() -> Column:
    """The one-line form with tags and a blocked mark."""
    return F.concat_ws(
        " ",
        C.short_id(),
        C.export_icon(),
        headline(),
        F.when(F.col("tags") != "", C.tag_marks()),
        F.when(C.is_blocked(), "⊘"),
    )


def logstyle(done: Column | str = "subtasks_done", total: Column | str = "subtasks_total") -> Column:
    """The multi-line log form. Progress shows when the task has subtasks."""
    done, total = C.as_col(done), C.as_col(total)
    progress = F.when(
        total > 0,
        F.concat(F.lit(" ["), done.cast("string"), F.lit("/"), total.cast("string"), F.lit("]")),
    ).otherwise("")
    body = F.concat(
        F.lit(BODY_INDENT), F.replace("description", F.lit("\n"), F.lit("\n" + BODY_INDENT))
    )
    notes = F.concat(
        optional_line(F.col("source") != "", BODY_INDENT + "Source: ", F.col("source")),
        optional_line(C.is_blocked(), BODY_INDENT + "Blocked-by: ", C.short_id("blocked_by")),
        optional_line(F.col("tags") != "", BODY_INDENT + "Tags: ", F.col("tags")),
    )
    return F.concat(
        F.lit("task "), F.col("id"), F.lit("\n"),
        F.lit("Author: "), F.col("author"), F.lit("\n"),
        F.lit("Date:   "), C.mail_date("created"), F.lit("\n"),
        optional_line(F.col("parent").isNotNull(), "Parent: ", F.col("parent")),
        F.lit("\n  "), C.state_icon(), F.lit(" "), headline(), progress, F.lit("\n"),
        optional_line(F.col("description") != "", body),
        F.when(notes != "", F.concat(F.lit("\n"), notes)).otherwise(""),
    )


def subtask_line() -> Column:
    """Title on the left, details on the right, aligned by bytes."""
    left = F.concat(C.short_id(), F.lit(" "), C.state_icon(), F.lit(" - "), F.col("title"))
    right = F.concat_ws(
        ", ", F.lower("kind"), F.col("priority"), F.when(C.is_blocked(), "blocked")
    )
    bar = "| "
    free = F.lit(LINE_WIDTH - len(bar) - 1) - F.octet_length(left) - F.octet_length(right)
    return F.concat(left, F.repeat(F.lit(" "), F.greatest(F.lit(2), free)), F.lit(bar), right)


def markdown_cells(number: Column | str) -> Column:
    """One row of the Markdown table."""
    link = lambda name: F.when(
        F.col(name).isNotNull(), F.concat(F.lit("#"), C.short_id(name))
    ).otherwise("-")
    filled = lambda name: F.when(F.col(name) != "", F.col(name)).otherwise("-")
    cells = F.concat_ws(
        " | ",
        C.as_col(number).cast("string"),
        "kind",
        "state",
        "priority",
        "title",
        filled("tags"),
        filled("source"),
        link("parent"),
        link("blocked_by"),
    )
    return F.concat(F.lit("| "), cells, F.lit(" |"))


def markdown_section() -> Column:
    """The detail section of one task, up to and including its closing blank line."""
    bullet = lambda label, *parts: F.concat(F.lit(f"- **{label}:** "), *parts, F.lit("\n"))
    when_set = lambda present, line: F.when(present, line).otherwise("")
    return F.concat(
        F.lit("### #"), F.col("id"), F.lit(": "), F.col("title"), F.lit("\n\n"),
        when_set(F.col("description") != "", F.concat(F.col("description"), F.lit("\n\n"))),
        bullet("Type", C.kind_label()),
        bullet("State", F.col("state"), F.lit(" "), C.export_icon()),
        bullet("Priority", F.col("priority"), F.lit(" "), C.priority_mark()),
        when_set(F.col("tags") != "", bullet("Tags", F.col("tags"))),
        when_set(F.col("source") != "", bullet("Source", F.col("source"))),
        when_set(F.col("parent").isNotNull(), bullet("Parent", F.lit("#"), F.col("parent"))),
        when_set(F.col("blocked_by").isNotNull(), bullet("Blocked by", F.lit("#"), F.col("blocked_by"))),
        bullet("Created", C.stamp("created")),
        bullet("Updated", C.stamp("updated")),
    )
