"""Packing of tokenised documents into sequences, as a cutting-stock problem.

Every document gives whole sequences of full length and one rest. The rests'
lengths, rounded up to a unit, form a histogram of bounded size. A linear program
over patterns (which lengths share a sequence) is solved by column generation: a
knapsack by dynamic programming finds the pattern that helps most at the current
prices. Patterns are rounded down to whole numbers, what is left is packed best-fit,
and the pieces, ranked within their length, take the slots of the patterns.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import steps, text_column
from tasklattice.session import materialise

LENGTH = 4096
END_ID = 2
UNIT = 8
TOKENIZER = "word_bpe_49k.json"
# Pieces that one window task numbers, and words whose ids a Python worker remembers.
GROUP = 50_000
CACHED_WORDS = 200_000
# Bytes of text that are cut into words at once.
TOKEN_STEP_BYTES = 4 << 20
# What stands between words that are encoded together, and how many are.
MARKER = "<|endoftext|>"
JOINED_WORDS = 128
# Steps before the merges for which a word of letters and then marks is two words, and for which lower-case ASCII letters stay as they are.
FOLDING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Latin letters that NFC leaves as they are, and the ASCII marks that may stand behind them.
_LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u024f]+")
_MARKS = string.punctuation.encode()
PIECE_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"

_tokenizers: dict[str, Vocabulary] = {}
_young: dict[bytes, bytes] = {}
_old: dict[bytes, bytes] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Vocabulary(NamedTuple):
    """A tokenizer; its merges alone, and by id whether it ends a word, if it folds words as ``FOLDING`` says."""

    tokenizer: object
    merges: object | None = None
    ends: np.ndarray | None = None


def _load(path: str) -> Vocabulary:
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    suffix = spec["model"].get("end_of_word_suffix")
    if not suffix or any(spec[part] != FOLDING[part] for part in FOLDING):
        return Vocabulary(tokenizer)
    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokens = spec["model"]["vocab"]
    ends = np.zeros(max(tokens.values()) + 1, bool)
    ends[[number for token, number in tokens.items() if token.endswith(suffix)]] = True
    return Vocabulary(tokenizer, merges, ends)


def _joined_ids(tokenizer, words: list[str], between: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, "<u4")


def _encode_letters(words: list[bytes], tokenizer, ends: np.ndarray) -> None:
    """Remember the ids of words of letters only; each has one id with the end of a word, its last."""
    for at in range(0, len(words), JOINED_WORDS):
        part = words[at : at + JOINED_WORDS]
        ids = _joined_ids(tokenizer, [w.decode() for w in part], " ")
        stops = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
        data = ids.tobytes()
        _young.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)], strict=True))


def _encode_whole(words: list[bytes], tokenizer) -> None:
    """Remember the ids of any words.

    Many words go through the tokenizer as one string with its end-of-text marker between
    them: it cuts at markers before anything else, so each word is encoded as if alone, at
    about half the cost. Words that could hold a marker of their own go one by one.
    """
    marker = tokenizer.token_to_id(MARKER)
    alone = words if marker is None else [w for w in words if b"<" in w or b">" in w]
    if alone:
        for word, found in zip(alone, tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False)):
            _young[word] = np.array(found.ids, "<u4").tobytes()
        several = [w for w in words if w not in _young]
    else:
        several = words
    for at in range(0, len(several), JOINED_WORDS):
        part = several[at : at + JOINED_WORDS]
        ids = _joined_ids(tokenizer, [w.decode("utf-8", "replace") for w in part], MARKER)
        marks = 4 * np.flatnonzero(ids == marker)
        data = ids.tobytes()
        starts, ends = [0, *(marks + 4).tolist()], [*marks.tolist(), len(data)]
        _young.update(zip(part, [data[a:b] for a, b in zip(starts, ends)], strict=True))


def _recall(words: set[bytes]) -> set[bytes]:
    """Those of the words whose ids are not remembered."""
    missing = words.difference(_young)
    if _old:
        known = [w for w in missing if w in _old]
        _young.update((w, _old[w]) for w in known)
        missing.difference_update(known)
    return missing


def _encode_words(words: set[bytes], path: str) -> None:
    """Remember the ids of words: what is left of letters, in lower case and without the marks behind, is encoded once."""
    tokenizer, merges, ends = _tokenizers[path]
    if ends is None:
        _encode_whole(list(words), tokenizer)
        return
    whole, parts = [], []
    for word in words:
        core = word.rstrip(_MARKS)
        if core.isalpha():
            parts.append((word, core.lower(), word[len(core) :]))
        elif found := _LETTERS.fullmatch(core.decode("utf-8", "replace").lower()):
            parts.append((word, found[0].encode(), word[len(core) :]))
        else:
            whole.append(word)
    letters = _recall({core for _, core, _ in parts})
    marks = _recall({tail for _, _, tail in parts}).difference(whole)
    _encode_letters([w for w in letters if w.isascii()], merges, ends)
    _encode_letters([w for w in letters if not w.isascii()], tokenizer, ends)
    _encode_whole([*whole, *marks], tokenizer)
    _young.update([(word, _young[core] + _young[tail]) for word, core, tail in parts])


def encode_all(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's ids begin; one entry more than there are texts.

    The vocabulary drops white space and no id spans it, so texts are cut at ASCII
    white space, and each distinct word is looked up among those met before.
    """
    global _young, _old
    if path not in _tokenizers:
        _tokenizers.clear()
        _young.clear()
        _old.clear()
        _tokenizers[path] = _load(path)
    split = pc.ascii_split_whitespace(texts.cast(pa.binary()).view(pa.string()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.view(pa.binary()).to_pylist()
    missing = _recall(set(words))
    if missing:
        _encode_words(missing, path)
    found = [_young[word] for word in words]
    if len(_young) > CACHED_WORDS:
        _old, _young = _young, {}
    # Each word's ids are a stretch of the distinct words' ids.
    ids = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(lengths) - lengths
    word = coded.indices.to_numpy()
    edges = np.zeros(len(word) + 1, np.int64)
    np.cumsum(lengths[word], out=edges[1:])
    at = np.repeat(starts[word] - edges[:-1], lengths[word])
    at += np.arange(len(at))
    return ids[at], edges[split.offsets.to_numpy() - split.offsets[0].as_py()]


def encode(text: bytes, path: str) -> bytes:
    """The ids of one text, four bytes each, little-endian."""
    return encode_all(pa.array([text], pa.binary()), path)[0].tobytes()


def _cut(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in steps(batches, limit=TOKEN_STEP_BYTES):
            index, starts, lengths, crcs, totals = [], [], [], [], []
            ids, edges = encode_all(batch.column("text"), path)
            data, edges = ids.tobytes(), (4 * edges).tolist()
            for row, (first, last) in enumerate(zip(edges, edges[1:])):
                text = data[first:last] + end
                for start in range(0, len(text), step):
                    piece = text[start : start + step]
                    index.append(row)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(text) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def cut_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document, its end id included.

    A null or empty text is the end id alone. Repeated rows give repeated pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(_cut(path or default_tokenizer(), length, end_id), PIECE_SCHEMA.format(kind))


def _best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(prices) that fits: knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        most = min(room, len(prices))
        options = prices[:most] + value[room - 1 :: -1][:most]
        best = int(options.argmax())
        value[room], taken[room] = value[room - 1], 0
        if options[best] > value[room - 1] + 1e-12:
            value[room], taken[room] = options[best], best + 1
    pattern = np.zeros(len(prices), np.int64)
    room = capacity
    while room > 0:
        if taken[room]:
            pattern[taken[room] - 1] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def solve_patterns(counts: np.ndarray, capacity: int, rounds: int = 8000, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering all ``counts`` (by size 1..capacity) exactly.

    Revised simplex on the sizes that occur. It stops at a proven relative gap to the
    optimum or after ``rounds``; the patterns are then a little less tight, never wrong.
    """
    sizes = np.flatnonzero(counts) + 1
    if not len(sizes):
        return []
    demand = counts[sizes - 1].astype(float)
    fit = capacity // sizes
    columns = np.diag(fit.astype(float))
    inverse = np.diag(1.0 / fit)
    used = demand / fit
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        dense = np.zeros(capacity)
        dense[sizes - 1] = np.maximum(prices, 0)
        value, found = _best_pattern(dense, capacity)
        # used.sum() / value is a lower bound on the number of sequences.
        if value <= 1 + gap:
            break
        column = found[sizes - 1].astype(float)
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, used / np.maximum(direction, 1e-9), np.inf)
        leaves = int(ratios.argmin())
        step = ratios[leaves]
        used = np.maximum(used - step * direction, 0)
        used[leaves] = step
        columns[:, leaves] = column
        pivot = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
    left = counts.astype(np.int64).copy()
    out = []
    for k in range(len(sizes)):
        pattern = np.zeros(capacity, np.int64)
        pattern[sizes - 1] = np.round(columns[:, k]).astype(np.int64)
        hold = pattern > 0
        times = int(min(np.floor(used[k] + 1e-6), (left[hold] // pattern[hold]).min()))
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Pack what rounding has left, always the largest size that still fits."""
    out = []
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        while room and left[:room].any():
            size = int(np.flatnonzero((left - pattern)[:room] > 0).max(initial=-1)) + 1
            if not size:
                break
            pattern[size - 1] += min(room // size, int((left - pattern)[size - 1]))
            room = capacity - int((pattern * np.arange(1, len(left) + 1)).sum())
        hold = pattern > 0
        times = int((left[hold] // pattern[hold]).min())
        left = left - times * pattern
        out.append((pattern, times))
    return out


def _slots(patterns: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per size the runs of ranks: first rank, pieces per sequence, first sequence, place of the first piece."""
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        place = 0
        for size in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[size])
            slots.setdefault(size + 1, []).append((ranks.get(size, 0), each, sequence, place))
            ranks[size] = ranks.get(size, 0) + each * times
            place += each
        sequence += times
    return {size: np.array(runs, np.int64) for size, runs in slots.items()}


def _seat(slots: dict[int, np.ndarray], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("size").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                mine = sizes == size
                runs = slots[size]
                run_of = runs[np.searchsorted(runs[:, 0], ranks[mine], side="right") - 1]
                after = ranks[mine] - run_of[:, 0]
                sequence[mine] = run_of[:, 2] + after // run_of[:, 1]
                place[mine] = run_of[:, 3] + after % run_of[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(place)], names=[*kept, "sequence_id", "place"]
            )

    return run


def pack(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Give each piece a sequence and an offset in it: the pieces' columns, sequence_id, offset.

    ``pieces`` has a ``length`` of 1 to the sequence length. Sequences are numbered from 0
    without gaps; in each the offsets have no gap either. Order of rows does not matter,
    and of equal pieces any may take a slot. The driver sees only the histogram.
    """
    kept = pieces.columns
    capacity = length // unit
    sized = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("long"))
    sized = sized.withColumn("chunk", F.xxhash64(*kept))
    histogram = sized.groupBy("size").count().collect()
    counts = np.zeros(capacity, np.int64)
    for row in histogram:
        counts[row["size"] - 1] = row["count"]
    slots = _slots(solve_patterns(counts, capacity))
    chunks = max(1, int(counts.sum()) // GROUP)
    sized = sized.withColumn("chunk", F.pmod("chunk", F.lit(chunks)))
    per_chunk = sized.groupBy("size", "chunk").count()
    before = per_chunk.withColumn(
        "before", F.sum("count").over(Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    ).select("size", "chunk", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("size", "chunk").orderBy(*(F.col(c) for c in kept)))
    ranked = sized.withColumn("within", within).join(before, ["size", "chunk"])
    ranked = ranked.select(*kept, "size", (F.col("before") + F.col("within") - 1).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    seated = ranked.mapInArrow(_seat(slots, kept), f"{schema}, sequence_id long, place long")
    # A sequence has at most as many pieces as tokens.
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return seated.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).select(*kept, "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialise(cut_pieces(docs)))
