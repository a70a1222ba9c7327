"""The task table: columns, value sets, rank orders and the state rules."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the established task model.
STATES = ("INBOX", "NEW", "IN_PROGRESS", "DONE", "CANCELLED", "INVALID")
KINDS = ("BUG", "FEATURE", "REGRESSION")
PRIORITIES = ("high", "medium", "low")
LISTABLE_STATES = ("NEW", "IN_PROGRESS", "DONE", "CANCELLED")
ACTIVE_STATES = ("NEW", "IN_PROGRESS")
CLOSED_STATES = ("DONE", "CANCELLED")

DEFAULT_PRIORITY = "medium"
DEFAULT_STATE = "INBOX"
DEFAULT_AUTHOR = "Unknown <unknown@example.com>"
DEFAULT_LIMIT = 20

ID_LENGTH = 40
SHORT_ID_LENGTH = 7
MIN_PREFIX_LENGTH = 4

# Fixed values: (command, state it applies to, state it leads to).
COMMAND_RULES = (
    ("accept", "INBOX", "NEW"),
    ("reject", "INBOX", "INVALID"),
    ("in-progress", "NEW", "IN_PROGRESS"),
    ("in-progress", "DONE", "IN_PROGRESS"),
    ("in-progress", "CANCELLED", "IN_PROGRESS"),
    ("done", "NEW", "DONE"),
    ("done", "IN_PROGRESS", "DONE"),
    ("cancel", "NEW", "CANCELLED"),
    ("cancel", "IN_PROGRESS", "CANCELLED"),
    ("reopen", "CANCELLED", "NEW"),
)
COMMANDS = ("accept", "reject", "in-progress", "done", "cancel", "reopen")

# Only `done` looks beyond its own task: every direct child must be closed.
GUARDED_COMMAND = "done"

TASK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("parent", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created", T.TimestampNTZType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("blocked_by", T.StringType()),
        T.StructField("tags", T.StringType()),
    ]
)
TASK_COLUMNS = tuple(TASK_SCHEMA.names)

# Every column an update may replace; `id` and `created` stay, `updated` is set.
MUTABLE_COLUMNS = (
    "parent",
    "priority",
    "state",
    "kind",
    "title",
    "description",
    "author",
    "source",
    "blocked_by",
    "tags",
)
