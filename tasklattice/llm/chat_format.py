"""Chat formatting by a grammar round trip: render, parse again, compare, escape until identical.

The text of a conversation is a row of turns, ``### role: body</turn>`` and a line feed each:

    role  up to the first ``: ``      ``\\\\``, ``\\###``, ``\\</turn>`` and ``\\:`` stand for what follows the backslash
    body  up to the first ``</turn>``  ``\\\\``, ``\\###`` and ``\\</turn>`` do; any other backslash is itself
    a bare ``###`` in either, or a bare ``</turn>`` in a role, is an error

A turn is written as it is, then parsed. If anything else comes back, its marks are escaped; if
that does not help, as its backslashes meet the escapes, these are doubled too, which always
reads back. A turn ends where its own text says so, so turns can be put together freely.

Order: by turn, null first; rows of one turn by role, then by their first 32 code points, then
by a hash. Repeated rows are turns of their own. Null role and null text are empty ones; rows
of a null conversation are one conversation. An empty table has no conversations. Texts of any
length are one turn. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.llm.common import steps

OPEN, SAYS, CLOSE = "### ", ": ", "</turn>"
LOSS_ROLES = ("assistant",)
# A part of a formatted conversation has so many code points, or is a single turn.
PART_CHARS = 1 << 16
# Bytes of text in one batch of rows that a task hands on.
OUT_BYTES = 1 << 22

_MARKS = r"###|</turn>"
_ROLE = re.compile(rf"\\(\\|{_MARKS}|:)|({_MARKS})|{SAYS}")
_BODY = re.compile(rf"\\(\\|{_MARKS})|(###)|{CLOSE}")
_ROLE_MARK, _BODY_MARK = re.compile(rf"{_MARKS}|:"), re.compile(_MARKS)
_ROLE_ALL, _BODY_ALL = re.compile(rf"\\|{_MARKS}|:"), re.compile(rf"\\|{_MARKS}")
# What is put behind a backslash, by step: nothing, marks, marks and backslashes.
STEPS = ((None, None), (_ROLE_MARK, _BODY_MARK), (_ROLE_ALL, _BODY_ALL))


class Turn(NamedTuple):
    role: str
    body: str
    # Where the body stands in the text.
    start: int
    end: int


def _escape(text: str, what: re.Pattern | None) -> str:
    return what.sub(lambda m: "\\" + m[0], text) if what else text


def render(role: str, body: str, step: int) -> str:
    """One turn, escaped by the given step of ``STEPS``."""
    role_mark, body_mark = STEPS[step]
    return f"{OPEN}{_escape(role, role_mark)}{SAYS}{_escape(body, body_mark)}{CLOSE}\n"


def _read(text: str, at: int, marks: re.Pattern) -> tuple[str, int, int]:
    """The text from ``at`` to its end mark without escapes, and where that mark begins and ends."""
    pieces = []
    for mark in marks.finditer(text, at):
        if mark[1]:
            pieces += text[at : mark.start()], mark[1]
            at = mark.end()
        elif mark[2]:
            raise ValueError(f"a bare mark at {mark.start()}")
        else:
            pieces.append(text[at : mark.start()])
            return "".join(pieces), mark.start(), mark.end()
    raise ValueError(f"no end after {at}")


def parse(text: str) -> list[Turn]:
    """The turns of a formatted text; ValueError if it is none."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role, _, start = _read(text, at + len(OPEN), _ROLE)
        body, end, at = _read(text, start, _BODY)
        if not text.startswith("\n", at):
            raise ValueError(f"no line feed at {at}")
        turns.append(Turn(role, body, start, end))
        at += 1
    return turns


def unescape(text: str) -> str:
    """A stretch of a body as it was before it was escaped."""
    return _BODY.sub(lambda m: m[1] or m[0], text)


def _returns(text: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [t[:2] for t in parse(text)] == turns
    except ValueError:
        return False


def round_trip(turns: list[tuple[str, str]]) -> list[str]:
    """The turns' texts, such that all of them together parse to the turns again."""
    chosen = [0] * len(turns)
    texts = [render(*turn, 0) for turn in turns]
    while not _returns("".join(texts), turns):
        for k, turn in enumerate(turns):
            if chosen[k] + 1 < len(STEPS) and not _returns(texts[k], [turn]):
                chosen[k] += 1
                texts[k] = render(*turn, chosen[k])
    return texts


PART_SCHEMA = "part long, n_turns int, formatted string, mask array<struct<start int, length int>>"
_MASK = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _assemble(part_chars: int, loss_roles: tuple[str, ...]):
    """Over turns sorted by conversation: parts of whole turns, none with turns of two conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[str] = []
        conv = kind = None
        chars = waiting = part = 0

        def close() -> None:
            nonlocal held, chars, part
            if held:
                text = "".join(held)
                found = parse(text)
                mask = [{"start": t.start, "length": t.end - t.start} for t in found if t.role in loss_roles]
                rows.append((conv, part, len(found), text, mask))
                held, chars, part = [], 0, part + 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            types = [kind, pa.int64(), pa.int32(), pa.string(), _MASK]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "part", "n_turns", "formatted", "mask"])

        for step in steps(batches):
            kind = step.column("conv").type
            part = part or step.column("base")[0].as_py()
            owners = step.column("conv").to_pylist()
            texts = round_trip(list(zip(step.column("role").to_pylist(), step.column("text").to_pylist())))
            for owner, text in zip(owners, texts):
                if held and (owner != conv or chars + len(text) > part_chars):
                    close()
                conv = owner
                held.append(text)
                chars += len(text)
                waiting += len(text)
            if waiting >= OUT_BYTES and rows:
                yield batch()
                rows, waiting = [], chars
        close()
        if rows:
            yield batch()

    return run


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_chars: int = PART_CHARS, loss_roles: tuple[str, ...] = LOSS_ROLES,
) -> DataFrame:
    """Formatted conversations in parts: (conv, part, n_turns, formatted, mask).

    The parts of a conversation by ascending ``part``, put together, are its text; most have
    one. ``mask`` tells the code points of a part that are learnt from: the bodies of
    ``loss_roles``. Turns are range-partitioned by conversation and turn, so a conversation with
    a large share of all turns is formatted by many tasks, each a part at a time.
    """
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    role = F.coalesce(turns[role_col].cast("string"), F.lit(""))
    keys = ["conv", "turn", "role", "head", "hash"]
    rows = turns.select(
        turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("head"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["conv"].dataType.simpleString()
    based = ranges.select("conv", "role", "text", F.shiftleft(F.spark_partition_id().cast("long"), 33).alias("base"))
    return based.mapInArrow(_assemble(part_chars, tuple(loss_roles)), f"conv {kind}, {PART_SCHEMA}")


READ_SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over parts sorted by conversation: counts and digests of each, of which only running hashes are held."""
    rows: list[tuple] = []
    conv = kind = None
    state: list | None = None

    def close() -> None:
        if state:
            n_turns, said, loss_chars, loss, chars = state
            rows.append((conv, n_turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def batch() -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv", *(f.split()[0] for f in READ_SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for step in steps(batches, "formatted"):
        kind = step.column("conv").type
        for owner, text, mask in zip(*(step.column(c).to_pylist() for c in ("conv", "formatted", "mask"))):
            if state is None or owner != conv:
                close()
                conv, state = owner, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(text)
            learnt = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
            state[0] += len(turns)
            state[1].update("".join(f"{t.role}\n{t.body}\n" for t in turns).encode())
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(text)
        if rows:
            yield batch()
            rows.clear()
    close()
    if rows:
        yield batch()


def read_back(parts: DataFrame) -> DataFrame:
    """What formatted conversations say: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A digest is made front to back, so a conversation's parts pass one task, one after the other.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    ordered = parts.select("conv", "part", "formatted", "mask").repartition("conv").sortWithinPartitions("conv", "part")
    return ordered.mapInArrow(_read_back, f"conv {kind}, {READ_SCHEMA}")


# A conversation that says the template's own marks.
MARKS_CONV = -7
MARKS_TEXT = "\\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of all conversations, read back from their formatted texts."""
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(MARKS_CONV).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS_TEXT).alias("text")
    )
    found = read_back(format_conversations(stored.unionByName(marks)))
    return found.withColumnRenamed("conv", "conv_id")


def _sql() -> str:
    """The length of a formatted turn follows from the marks and backslashes in it."""

    def times(text: str, what: str) -> str:
        return f"((length({text}) - length(replace({text}, '{what}', ''))) // {len(what)})"

    def length(text: str, marks: tuple[str, ...]) -> str:
        escaped = " + ".join(times(text, mark) for mark in marks)
        bare = " OR ".join(f"contains({text}, '{mark}')" for mark in ("###", "</turn>", "\\\\", *(f"\\{m}" for m in marks)))
        last = " OR ".join(f"contains({text}, '{mark}')" for mark in ("\\\\", *(f"\\{m}" for m in marks)))
        ends = f"ends_with({text}, '\\')"
        return f"(length({text}) + CASE WHEN NOT ({bare} OR {ends}) THEN 0 WHEN NOT ({last} OR {ends}) THEN {escaped} ELSE {escaped} + {times(text, chr(92))} END)"

    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({MARKS_CONV}, 0, 'user', '{MARKS_TEXT}'), ({MARKS_CONV}, 1, 'assistant', '{MARKS_TEXT}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({len(OPEN + SAYS + CLOSE) + 1} + length(role) + {length("text", ("###", "</turn>"))}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


OP13_SQL = _sql()
