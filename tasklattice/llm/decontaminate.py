"""Benchmark decontamination by greedy string tiling.

Documents that share a run of words (a seed) with a benchmark item are joined with
it. For such a pair the longest common runs that do not overlap are marked again and
again, down to the seed's length, each found by Karp-Rabin fingerprints of all
unmarked windows. The share of the item that is marked decides: the order of its parts
does not matter, so reordered passages are caught too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import LOWER, free_name, hashed_words, mix, steps
from tasklattice.session import materialise

SEED_WORDS = 5
COVERAGE = 0.5
# Benchmark text that is sent to all tasks at once; a larger benchmark takes further passes.
BLOCK_BYTES = 16 << 20

_STEP = np.array([0xD6E8FEB86659FD93], np.uint64)
# Words are split at ASCII white space and punctuation.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def fingerprints(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin fingerprints of all windows of ``width`` words, by prefix sums."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    # Doubling: a window of 2k words is its two halves.
    out, have = words.copy(), 1
    factor = _STEP
    built = {1: (out, factor)}
    while have * 2 <= width:
        out = out[: len(out) - have] * factor + out[have:]
        have *= 2
        factor = factor * factor
        built[have] = (out, factor)
    rest = width - have
    while rest:
        part = 1 << (rest.bit_length() - 1)
        more, scale = built[part]
        size = len(words) - have - part + 1
        out = out[:size] * scale + more[have : have + size]
        have += part
        rest -= part
    return mix(out)


def _windows(marked: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` hold no marked word."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[width:] == total[:-width]


def tile(document: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (place in document, place in item, words), longest first, none overlapping another."""
    in_doc, in_item = np.zeros(len(document), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ours = np.flatnonzero(_windows(in_item, width))
        theirs = np.flatnonzero(_windows(in_doc, width))
        left, right = fingerprints(item, width)[ours], fingerprints(document, width)[theirs]
        return ours[np.isin(left, right)], theirs, right

    most = min(len(document), len(item))
    while most >= least:
        # A common run of some length holds one of every shorter length: search by halving.
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        ours, theirs, prints = common(low)
        order = np.argsort(prints, kind="stable")
        for place, code in zip(ours.tolist(), fingerprints(item, low)[ours]):
            if in_item[place : place + low].any():
                continue
            start, end = np.searchsorted(prints[order], code, "left"), np.searchsorted(prints[order], code, "right")
            for where in theirs[order[start:end]].tolist():
                if not in_doc[where : where + low].any():
                    in_doc[where : where + low] = True
                    in_item[place : place + low] = True
                    tiles.append((where, place, low))
                    break
        # The first of these marks at least one run, so the length never grows again.
        most = low
    return tiles


class Items:
    """A block of benchmark items with an index of their seeds.

    A seed has ``SEED_WORDS`` words, in a shorter item all its words. Seeds of each width have an index of their own.
    """

    def __init__(self, keys: list, texts: list[bytes]):
        words, edges = hashed_words(texts, _TABLE)
        self.keys = keys
        self.words = [words[a:b] for a, b in zip(edges[:-1], edges[1:])]
        widths = [min(SEED_WORDS, len(w)) for w in self.words]
        self.indexes = {}
        for width in sorted(set(widths) - {0}):
            mine = [k for k, w in enumerate(widths) if w == width]
            seeds = [fingerprints(self.words[k], width) for k in mine]
            codes = np.concatenate(seeds)
            order = np.argsort(codes, kind="stable")
            owner = np.repeat(np.array(mine), [len(s) for s in seeds])[order]
            self.indexes[width] = codes[order], owner, np.concatenate([np.arange(len(s)) for s in seeds])[order]

    def matches(self, texts: list[bytes], coverage: float) -> list[tuple]:
        """(text index, item key, item words, marked words, tiles, longest tile) of pairs with enough coverage."""
        words, edges = hashed_words(texts, _TABLE)
        out = []
        for width, index in self.indexes.items():
            out += self._matches(words, edges, coverage, width, *index)
        return out

    def _matches(self, words: np.ndarray, edges: np.ndarray, coverage: float, width: int, known: np.ndarray, owners: np.ndarray, starts: np.ndarray) -> list[tuple]:
        codes = fingerprints(words, width)
        at = np.searchsorted(known, codes)
        at[at == len(known)] = 0
        hits = np.flatnonzero(known[at] == codes)
        owner = np.searchsorted(edges, hits, "right") - 1
        whole = hits + width <= edges[owner + 1]
        hits, owner = hits[whole], owner[whole]
        out = []
        for text in np.unique(owner).tolist():
            found = np.unique(codes[hits[owner == text]])
            start, end = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            index = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist())])
            items, places = owners[index], starts[index]
            for item in np.unique(items).tolist():
                mine = self.words[item]
                # No tile reaches beyond the words of the seeds that were found.
                seen = np.zeros(len(mine), bool)
                for k in range(width):
                    seen[places[items == item] + k] = True
                if seen.sum() < coverage * len(mine):
                    continue
                tiles = tile(words[edges[text] : edges[text + 1]], mine, width)
                marked = sum(t[2] for t in tiles)
                if marked >= coverage * len(mine):
                    out.append((text, self.keys[item], len(mine), marked, len(tiles), max(t[2] for t in tiles)))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` of text."""
    rows = benchmark.select(benchmark[id_col].alias("key"), F.lower(F.coalesce(benchmark[text_col].cast("string"), F.lit(""))).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = total // BLOCK_BYTES + 1
    for block in range(count):
        some = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == block).collect()
        if some:
            yield Items([r.key for r in some], [bytes(r.text) for r in some])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Pairs whose item is covered to ``coverage`` or more.

    (doc_id, item_id, item_tokens, covered_tokens, n_tiles, longest_tile, coverage).
    Words are lower-cased and split at white space and ASCII punctuation. An item of fewer
    than five words must stand in the document whole; one without words, as null and empty ones, matches nothing.
    Of equally long runs the first in the item is marked first, at its first place in the document. Each row is judged by
    itself; repeated rows give repeated pairs; empty tables give an empty result. Other columns, whatever
    their names, are not read. Blocks of the benchmark are taken one after the other, each a pass over the documents.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), F.lower(F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("binary").alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, item_tokens int, covered_tokens int, n_tiles int, longest_tile int, coverage double"
    item_type = pa.array([], _arrow(benchmark.schema[item_id].dataType)).type

    def judge(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in steps(batches):
                found = items.matches(batch.column("text").to_pylist(), coverage)
                if found:
                    index, keys, sizes, marked, tiles, longest = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(index)), pa.array(keys, item_type), *(pa.array(x, pa.int32()) for x in (sizes, marked, tiles, longest)),
                         pa.array([m / s for m, s in zip(marked, sizes)])],
                        names=["doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "longest_tile", "coverage"],
                    )

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = out.union(materialise(rows.mapInArrow(judge(shared), schema)))
        shared.destroy()
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that cover no item; decided in place, without a shuffle.

    Repeated rows are judged alike; other columns may have any names.
    """
    names = docs.columns
    lowered = free_name(docs, "lowered")
    out, shared = docs, None

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in steps(batches, lowered):
                bad = {m[0] for m in items.matches(batch.column(lowered).to_pylist(), coverage)}
                mask = pa.array([k not in bad for k in range(batch.num_rows)])
                yield batch.select(names).filter(mask)

        return run

    for items in _blocks(benchmark, item_id, item_text):
        if shared is not None:
            # One block is in the tasks' memory at a time.
            out = materialise(out)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(items)
        text = F.lower(F.coalesce(out[text_col].cast("string"), F.lit(""))).cast("binary")
        out = out.withColumn(lowered, text).mapInArrow(keep(shared), docs.schema)
    return out


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
