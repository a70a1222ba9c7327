"""Formatted conversations: the grammar, the round trip and what is read back."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tasklattice.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["\\", "#", "###", "<", "</turn>", ": ", ":", " ", "\n", "a", "é", "### user: x</turn>\n"]
MARKED = st.lists(st.sampled_from(PIECES), max_size=10).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(MARKED, MARKED), max_size=6))
def test_any_turns_come_back(turns):
    text = "".join(cf.round_trip(turns))
    found = cf.parse(text)
    assert [t[:2] for t in found] == turns
    assert [cf.unescape(text[t.start : t.end]) for t in found] == [body for _, body in turns]


def test_only_what_conflicts_is_escaped():
    plain, marks, slashes = ("user", "a \\ b # c < d"), ("user", "### x </turn>"), ("user", "\\### \\\\ y\\")
    assert cf.round_trip([plain, marks, slashes]) == [cf.render(*plain, 0), cf.render(*marks, 1), cf.render(*slashes, 2)]
    assert cf.render(*marks, 1) == "### user: \\### x \\</turn></turn>\n"
    assert cf.round_trip([("a: b", "t")]) == ["### a\\: b: t</turn>\n"]


@pytest.mark.parametrize("text", ["x", "### user", "### user: t", "### user: t</turn>", "### user: ### t</turn>\n", "### a</turn>: b</turn>\n"])
def test_other_texts_are_errors(text):
    with pytest.raises(ValueError):
        cf.parse(text)


def brute(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_with_cases():
    rng = random.Random(3)
    words = ["\\", "###", "</turn>", "word", "é\n", ": ", "### assistant: "]
    rows = [(k % 9, k // 9, rng.choice(["system", "user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(120)]
    # A conversation with a third of all turns, texts of a long one, nulls, ties, repeated rows.
    rows += [(50, k, "assistant" if k % 2 else "user", f"turn {k} </turn>") for k in range(90)]
    rows += [(51, 0, "user", "#" * 300_000), (51, 1, "assistant", "\\" * 100_001)]
    rows += [(None, None, None, None), (None, 1, "assistant", None), (52, 1, "user", "b"), (52, 1, "assistant", "a"), (52, 1, "user", "a")]
    return rows + [(53, 0, "assistant", "same")] * 3


@pytest.mark.parametrize("part_chars", [100, cf.PART_CHARS])
def test_read_back_equals_the_turns(spark, part_chars):
    rows = rows_with_cases()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = turns.withColumns({name: F.lit("x") for name in ("conv", "part", "head", "hash", "base", "formatted", "mask")})
    parts = cf.format_conversations(clash, part_chars=part_chars)
    got = sorted((tuple(r)[:5] for r in cf.read_back(parts).collect()), key=repr)
    assert got == brute(rows)
    stored = parts.collect()
    assert all(len(p.formatted) <= part_chars or p.n_turns == 1 for p in stored)
    whole = {}
    for p in sorted(stored, key=lambda p: p.part):
        whole[p.conv] = whole.get(p.conv, "") + p.formatted
    assert {c: len(cf.parse(t)) for c, t in whole.items()} == {r[0]: r[1] for r in brute(rows)}


def test_empty_table(spark):
    assert cf.read_back(cf.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_adds_the_conversation_of_marks(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in cf.op13_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, -7}
    assert got[-7].loss_chars == len(cf.MARKS_TEXT)
    assert got[-7].loss_sha256 == hashlib.sha256(cf.MARKS_TEXT.encode()).hexdigest()
    # Both texts have three marks or backslashes to escape.
    assert got[-7].formatted_chars == 2 * (len(cf.MARKS_TEXT) + 3 + len("### : </turn>\n")) + len("user") + len("assistant")
