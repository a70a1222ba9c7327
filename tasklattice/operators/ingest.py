"""From raw messages to validated tasks. Everything here is narrow: one pass, no shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import DEFAULT_PRIORITY, DEFAULT_STATE, KINDS, PRIORITIES, STATES, TASK_COLUMNS
from ..session import materialise
from .joins import left_lookup
from .lifecycle import moment
from .links import leading_to, on_cycles, single_links
from .matching import resolve

# Shell here-document endings that may be left at the end of a body.
HEREDOC_TAILS = ("EOF < /dev/null", "EOL < /dev/null", "END < /dev/null", "DONE < /dev/null")

EMPTY_TITLE = "no title line"
NO_PARENT = "parent_ref fits no single task"
NO_PARENT_ROW = "parent_key names no row"


def parse_messages(messages: DataFrame, raw: str = "text", heredoc: bool = False) -> DataFrame:
    """Add title, description and parse_error from ``title / blank / body`` texts.

    The title is the trimmed first line, the body all the rest, trimmed.
    ``heredoc`` also removes one left-over here-document ending.
    """
    # A line ends at \\n and loses one \\r before it.
    text = F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    title = C.strip(F.substring_index(text, "\n", 1))
    cut = F.locate("\n", text)
    body = C.strip(F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(""))
    if heredoc:
        without = lambda ending: C.strip(F.substring(body, F.lit(1), F.length(body) - len(ending)))
        body = C.cases(((body.endswith(ending), without(ending)) for ending in HEREDOC_TAILS), body)
    return messages.withColumns(
        {"title": title, "description": body, "parse_error": F.when(title == "", EMPTY_TITLE)}
    )


def new_tasks(drafts: DataFrame, at: datetime | str | Column, nonce: str, author: str | None = None) -> DataFrame:
    """Fill a draft (kind, title, description and any other task column) up to a whole task.

    ``nonce`` names a column that identifies the input row; with it the id is
    the same however often a lost task is run again.
    """

    def given(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in drafts.columns else otherwise

    created = moment(at)
    written_by = F.col("author") if "author" in drafts.columns else F.lit(author).cast("string")
    values = {
        "id": C.task_id(F.col("kind"), F.col("title"), F.col("description"), created, F.col(nonce)),
        "parent": given("parent", F.lit(None).cast("string")),
        "priority": given("priority", F.lit(DEFAULT_PRIORITY)),
        "state": F.lit(DEFAULT_STATE),
        "author": C.author_or_default(written_by),
        "created": created,
        "updated": created,
        "source": given("source", F.lit("")),
        "blocked_by": F.lit(None).cast("string"),
        "tags": given("tags", F.lit("")),
    }
    return drafts.withColumns(values)


def validation_error() -> Column:
    """The first rule a task breaks; NULL if none."""

    def blank(name: str) -> Column:
        return C.strip(F.coalesce(name, F.lit(""))) == ""

    def unknown(name: str, allowed: tuple[str, ...]) -> Column:
        value = F.coalesce(name, F.lit(""))
        return F.when(~value.isin(*allowed), F.concat(F.lit(f"{name} not allowed: "), value))

    return F.coalesce(
        F.when(blank("title"), "title is blank"),
        F.when(blank("description"), "description is blank"),
        unknown("kind", KINDS),
        unknown("priority", PRIORITIES),
        unknown("state", STATES),
    )


def validate_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("error", validation_error())


def capture(
    messages: DataFrame,
    at: datetime | str | Column,
    nonce: str,
    raw: str = "text",
    author: str | None = None,
    heredoc: bool = False,
    refused: Column | None = None,
) -> DataFrame:
    """Messages (raw text, kind, and any of priority, source, tags, author) as tasks with ``error``.

    Rows without an error are ready to append; the others are the quarantine.
    ``refused`` is an error that comes before all others.
    """
    drafts = parse_messages(messages.withColumn("kind", F.upper("kind")), raw, heredoc)
    early = F.col("parse_error") if refused is None else F.coalesce(refused, "parse_error")
    return _finish(drafts, at, nonce, author, early)


def capture_subtasks(
    messages: DataFrame,
    tasks: DataFrame,
    at: datetime | str | Column,
    nonce: str,
    raw: str = "text",
    author: str | None = None,
) -> DataFrame:
    """Messages (raw text, parent_ref, kind, priority) as subtasks of existing tasks.

    A kind is written all lower or all upper case. Subtasks have no source and no tags.
    """
    found = materialise(resolve(messages.select(F.col("parent_ref").alias("ref")), tasks))
    parents = found.select(F.col("ref").alias("parent_ref"), F.col("id").alias("parent"))
    kind = F.when(F.col("kind").isin(*KINDS, *(k.lower() for k in KINDS)), F.upper("kind")).otherwise(F.col("kind"))
    drafts = left_lookup(
        messages.drop("source", "tags", "parent").withColumn("kind", kind), parents, "parent_ref", nonce
    )
    drafts = parse_messages(drafts, raw)
    bad_kind = F.when(
        ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        F.concat(F.lit("kind not allowed: "), F.coalesce("kind", F.lit(""))),
    )
    orphan = F.when(F.col("parent").isNull(), NO_PARENT)
    return _finish(drafts, at, nonce, author, F.coalesce(bad_kind, orphan, F.col("parse_error")))


def capture_family(
    messages: DataFrame,
    tasks: DataFrame,
    at: datetime | str | Column,
    nonce: str,
    raw: str = "text",
    author: str | None = None,
) -> DataFrame:
    """Messages whose parents may come in the same batch, as tasks with ``error``.

    ``parent_ref`` names an existing task, ``parent_key`` the ``nonce`` of another row, before
    or after it; a row with neither is a task of its own, with a kind in any letter case. A row
    whose parent row is refused is refused as well, and so is every row of a cycle.
    Refusals go down by doubling, in rounds that grow with the logarithm of a family's depth.
    Rows of one key share their fate.
    """
    below = F.col("parent_ref").isNotNull() | F.col("parent_key").isNotNull()
    single_case = F.col("kind").isin(*KINDS, *(k.lower() for k in KINDS))
    kind = F.when(~below | single_case, F.upper("kind")).otherwise(F.col("kind"))
    refs = messages.where(F.col("parent_ref").isNotNull())
    found = materialise(resolve(refs.select(F.col("parent_ref").alias("ref")), tasks))
    parents = found.select(F.col("ref").alias("parent_ref"), F.col("id").alias("parent"))
    drafts = left_lookup(messages.drop("parent").withColumn("kind", kind), parents, "parent_ref", nonce)
    drafts = parse_messages(drafts, raw)
    bad_kind = F.when(
        below & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        F.concat(F.lit("kind not allowed: "), F.coalesce("kind", F.lit(""))),
    )
    orphan = F.when(F.col("parent_ref").isNotNull() & F.col("parent").isNull(), NO_PARENT)
    made = materialise(_finish(drafts, at, nonce, author, F.coalesce(bad_kind, orphan, F.col("parse_error"))))

    key = F.col(nonce).cast("string")
    links = single_links(messages.select(key.alias("id"), F.col("parent_key").cast("string").alias("link")), "link")
    keys = made.where(F.col(nonce).isNotNull()).select(key.alias("id"), F.col("id").alias("made"), "error")
    lost = links.join(keys.select(F.col("id").alias("to")), "to", "left_anti").select("id", F.lit(NO_PARENT_ROW).alias("why"))
    rounds = on_cycles(links).select("id", F.lit("its parents form a cycle").alias("why"))
    own = keys.where(F.col("error").isNotNull()).select("id", F.col("error").alias("why"))
    refused = materialise(own.unionByName(lost).unionByName(rounds))
    heirs = leading_to(refused.select("id").distinct(), links).select("id", F.lit("the parent was refused").alias("why"))
    inherited = materialise(lost.unionByName(rounds).unionByName(heirs).groupBy(F.col("id").alias("_key")).agg(F.max("why").alias("_why")))
    above = keys.groupBy(F.col("id").alias("to")).agg(F.min("made").alias("_made"))
    placed = materialise(links.join(above, "to").select(F.col("id").alias("_key"), "_made"))

    result = left_lookup(made.withColumn("_key", key), inherited, "_key", "id")
    result = left_lookup(result, placed, "_key", "id")
    return result.withColumns(
        {"parent": F.coalesce("parent", "_made"), "error": F.coalesce("error", "_why")}
    ).drop("_key", "_why", "_made")


def _finish(drafts: DataFrame, at, nonce: str, author: str | None, early: Column) -> DataFrame:
    """Whole tasks with the first error met on the way."""
    drafts = drafts.withColumn("_early", early)
    return (
        validate_tasks(new_tasks(drafts, at, nonce, author))
        .withColumn("error", F.coalesce("_early", "error"))
        .select(*dict.fromkeys([nonce, *TASK_COLUMNS, "error"]))
    )
