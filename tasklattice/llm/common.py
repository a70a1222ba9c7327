"""Helpers the operators share: hashed words in numpy, sliced Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.session import materialise

# Bytes of text that one numpy step takes at once; a longer document makes a step of its own.
STEP_BYTES = 1 << 19
SHINGLE_WORDS = 5

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_random = np.random.default_rng(20240607)
_BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def text_column(docs: DataFrame, name: str = "text") -> Column:
    """The whole text as bytes; a null text is an empty one."""
    return F.coalesce(docs[name].cast("string"), F.lit("")).cast("binary")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key of a row's id and text; repeated rows share it."""
    return F.xxhash64(docs[id_col].cast("string"), F.lit("\0"), F.coalesce(docs[text_col], F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_rest(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` each; a row counts as ``least`` bytes at least.

    What Arrow still holds for reuse behind the last slice goes back, as the worker may wait long for its next task.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.maximum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), least)
        group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            yield batch.slice(start, end - start)
        del batch
    pa.default_memory_pool().release_unused()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, count: int) -> np.ndarray:
    """1, base, base^2, ...; kept for the usual lengths."""
    table = _tables.get(int(base))
    if table is None or len(table) < count:
        table = np.full(max(count, 2 * STEP_BYTES), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if count <= 2 * STEP_BYTES:
            _tables[int(base)] = table
    return table[:count]


def located_words(texts: list[bytes], table: bytes = LOWER) -> tuple[np.ndarray, ...]:
    """The folded bytes of all texts, where each word begins and ends in them, its 64-bit hash, and where each text's words begin.

    Words are runs of anything but ASCII white space, and only A-Z are folded.
    The last array has one entry more than there are texts. ``table`` may map
    further bytes, as to white space.
    """
    joined = b" ".join(texts).translate(table)
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACES[data]
    change = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = change[::2], change[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _powers(_BASE, len(data)), out=total[1:])
    words = mix((total[last] - total[first]) * _powers(_INVERSE, len(data))[first] + (last - first).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, first, last, words, np.searchsorted(first, begins).astype(np.int64)


def hashed_words(texts: list[bytes], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin; see ``located_words``."""
    return located_words(texts, table)[3:]


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words has one run, all its words; a text of none has no run.
    """
    words, edges = hashed_words(texts)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs = runs * _STEP + words[k : k + len(runs)]
    runs = mix(runs)
    out = []
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if end - start >= width:
            ordered = np.sort(runs[start : end - width + 1])
            out.append(ordered[np.diff(ordered, prepend=~ordered[:1]) != 0])
        elif end > start:
            short = np.array([end - start], np.uint64)
            for k in range(start, end):
                short = short * _STEP + words[k : k + 1]
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node reaches, for links ``a``-``b`` of long ids: (node, component).

    Rounds of: every node hooks on to its smallest neighbour; chains of hooks are
    halved until they are stars; the links are contracted to the star centres.
    Only aggregates and joins of written tables, so a node with very many links
    is combined before the shuffle and split by adaptive execution.
    """
    links = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while links.head(1):
        both = links.union(links.select("b", "a"))
        hooks = materialise(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        )
        while True:
            further = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialise(hooks.join(further, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            hooks = jumped.select("node", "to")
            if not jumped.where("moved").head(1):
                break
        maps.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = hooks.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        links = materialise(
            links.join(left, "a").join(right, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        )
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "node", F.coalesce("next", "to").alias("to")
        )
    return materialise(found.select("node", F.col("to").alias("component")))
