"""Scalar column expressions. All are built-in expressions, none needs Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_AUTHOR, SHORT_ID_LENGTH

# Every code point with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Marks used by the text forms.
STATE_ICONS = {
    "INBOX": "?",
    "NEW": "◆",
    "IN_PROGRESS": "▶",
    "DONE": "✓",
    "CANCELLED": "✗",
    "INVALID": "⊘",
}
EXPORT_ICONS = {"NEW": "◆", "IN_PROGRESS": "▶", "DONE": "✓", "CANCELLED": "✗"}
PRIORITY_MARKS = {"high": "!", "medium": "=", "low": "-"}
STATE_VERBS = {"IN_PROGRESS": "in progress", "DONE": "done", "CANCELLED": "cancelled"}
KIND_LABELS = {"BUG": "Bug", "FEATURE": "Feature", "REGRESSION": "Regression"}


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(as_col(text), F.lit(WHITESPACE))


def cases(branches: Iterable[tuple[Column, Any]], otherwise: Any = None) -> Column:
    """The value of the first branch whose condition holds."""
    chain = None
    for condition, value in branches:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)


def lookup(value: Column | str, table: Mapping[str, str], default: Column) -> Column:
    """Map a value through a fixed table."""
    value = as_col(value)
    return cases(((value == key, label) for key, label in table.items()), default)


def short_id(task_id: Column | str = "id") -> Column:
    return F.substring(as_col(task_id), 1, SHORT_ID_LENGTH)


def tag_list(tags: Column | str = "tags") -> Column:
    """Tags as an array: split at commas, trimmed, empties dropped."""
    parts = F.transform(F.split(as_col(tags), ","), strip)
    return F.coalesce(F.filter(parts, lambda tag: tag != ""), F.array().cast("array<string>"))


def tags_text(tags: Column | str) -> Column:
    return F.array_join(as_col(tags), ",")


def tag_marks(tags: Column | str = "tags") -> Column:
    """Tags as ``#a #b``; empty elements stay, an empty text stays empty."""
    tags = as_col(tags)
    marks = F.transform(F.split(tags, ","), lambda tag: F.concat(F.lit("#"), strip(tag)))
    return F.when(tags == "", "").otherwise(F.array_join(marks, " "))


def is_blocked(blocker: Column | str = "blocked_by") -> Column:
    return as_col(blocker).isNotNull()


def kind_label(kind: Column | str = "kind") -> Column:
    return lookup(kind, KIND_LABELS, as_col(kind))


def state_icon(state: Column | str = "state") -> Column:
    return lookup(state, STATE_ICONS, F.lit("·"))


def export_icon(state: Column | str = "state") -> Column:
    return lookup(state, EXPORT_ICONS, F.lit("?"))


def priority_mark(priority: Column | str = "priority") -> Column:
    return lookup(priority, PRIORITY_MARKS, F.lit("."))


def state_verb(state: Column | str = "state") -> Column:
    return lookup(state, STATE_VERBS, as_col(state))


def first_line(text: Column | str = "description") -> Column:
    return F.substring_index(as_col(text), "\n", 1)


def stamp(moment: Column | str) -> Column:
    """Timestamps as ``2024-01-15 10:30:00``."""
    return F.date_format(as_col(moment).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def mail_date(moment: Column | str) -> Column:
    """Timestamps as ``Mon, 15 Jan 2024 10:30:00 +0000``; stored times are UTC."""
    text = F.date_format(as_col(moment).cast("timestamp_ntz"), "EEE, dd MMM yyyy HH:mm:ss")
    return F.concat(text, F.lit(" +0000"))


def count_label(n: Column | str, singular: str) -> Column:
    n = as_col(n)
    ending = F.when(n == 1, "").otherwise("s")
    return F.concat(n.cast("string"), F.lit(f" {singular}"), ending)


def created_message(task_id: Column | str = "id", kind: Column | str = "kind") -> Column:
    return F.concat(F.lit("Created "), F.lower(as_col(kind)), F.lit(" task "), as_col(task_id))


def author_or_default(author: Column | str = "author") -> Column:
    author = as_col(author)
    return F.when(strip(author) != "", author).otherwise(DEFAULT_AUTHOR)


def task_id(kind: Column, title: Column, description: Column, created: Column, nonce: Column) -> Column:
    """Content hash. The nonce is a key of the input row, so a retried task repeats the id."""
    seconds = F.unix_timestamp(created.cast("timestamp_ntz").cast("timestamp"))
    return F.sha1(F.concat(kind, title, description, seconds.cast("string"), nonce.cast("string")))


def escape_like(text: str) -> str:
    """Quote a literal for use inside a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
