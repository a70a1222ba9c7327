"""LM scoring with a hashed maximum-entropy model.

The most frequent words are sorted into classes; all others are one class more, dealt to
cells by their hash. The chance of a word is that of its class times that of its place in the
class, a member or a cell, times its share of a cell, which follows its count. Classes, members and
cells are softmaxes over hashed features of the text before: the last word, the one before it (a
skip), and both together. So the text before counts for every word. The weights are trained by
rounds of distributed gradient updates, each over all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import crc_rest, hashed_words, mix, steps, text_column
from tasklattice.session import materialise

CLASSES, MEMBERS = 32, 64
# Cells of the words outside the classes: the uppermost bits of their hashes.
CELLS, CELL_SHIFT = 16, 60
BUCKETS = 1 << 13
ROUNDS = 3
# Length of a step, and what a feature seen rarely is held back by.
RATE, DAMPING = 1.0, 4.0
# Most frequent words whose counts are sent to all tasks; rarer ones are joined.
KNOWN_WORDS = 1 << 17
END = np.uint64(1)
FEATURES = 3
_CLASS_CODES = np.arange(CLASSES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
TASK_STEP = 1 << 18
# Bytes of text whose gradients are added up at once; bytes and rows of logits that stay in a core's cache.
LEARN_STEP, TOKEN_STEP, BLOCK = 1 << 20, 1 << 16, 1 << 12
# Neighbouring buckets that share a product of matrices, and those that share a row of the shuffle.
LANES, PART = 8, 512
# Logits beyond this are shifted by the largest of their row.
LARGE = 40.0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text's end after its words, and where each text begins."""
    words, edges = hashed_words(texts)
    out = np.full(len(words) + len(texts), END, np.uint64)
    begins = edges + np.arange(len(edges))
    inside = np.ones(len(out), bool)
    inside[begins[1:] - 1] = False
    out[inside] = words
    return out, begins


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of the task, combined before they leave it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def combined() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return words, np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int64)

    for batch in steps(batches):
        words, _ = tokens(batch.column("text").to_pylist())
        found = np.unique(words, return_counts=True)
        held.append(found)
        size += len(found[0])
        if size > 4_000_000:
            held = [combined()]
            if len(held[0][0]) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "n"])
                held = []
            size = sum(len(h[0]) for h in held)
    if held:
        words, counts = combined()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])


def cells_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(CELL_SHIFT)).astype(np.int64)


# The class of each slot; that of the rest, whose slot is -1, is the last.
_OF_SLOT = np.append(np.repeat(np.arange(CLASSES), MEMBERS), CLASSES)


def classes_of(slots: np.ndarray) -> np.ndarray:
    return _OF_SLOT[slots]


class Model:
    """Counts of the frequent words, biases and weights; a fixed size whatever the corpus."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n_tokens: int, n_words: int, cells: np.ndarray | None = None):
        """``cells``: tokens and words of the training rows by cell, those with a class included; by default of ``words``."""
        if cells is None:
            cells = np.array([np.bincount(cells_of(words), n, CELLS) for n in (counts, counts > 0)])
        order = np.argsort(words)
        self.known, self.known_counts = words[order], counts[order]
        self.n_tokens, self.n_words = n_tokens, n_words
        # The end of a text is always among the words with a class.
        size = CLASSES * MEMBERS
        top = np.argsort(-counts, kind="stable")
        top = top[words[top] != END][: size - 1]
        ends = int(counts[words == END].sum())
        head, head_counts = np.append(words[top], END), np.append(counts[top], ends)
        rank = np.argsort(-head_counts, kind="stable")
        head, head_counts = head[rank], head_counts[rank]
        by_word = np.argsort(head)
        self.head, self.head_slot = head[by_word], by_word.astype(np.int64)
        self.slot_counts = self.counts(head)
        # Where the head's words are found by 16 bits of their hash; those that share them, by other bits.
        self.lookup: list[tuple[int, np.ndarray]] = []
        left = np.arange(len(self.head))
        while len(left):
            shift = 8 * (len(self.lookup) % 7)
            key = (self.head[left] >> np.uint64(shift)).astype(np.uint16)
            _, first = np.unique(key, return_index=True)
            table = np.zeros(1 << 16, np.int16)
            table[key[first]] = left[first]
            self.lookup.append((shift, table))
            left = np.delete(left, first)
        slots = np.full(size, -1e9, np.float32)
        slots[: len(head)] = np.log(head_counts + 1.0)
        self.member_bias = slots.reshape(CLASSES, MEMBERS)
        mass = np.zeros(CLASSES + 1)
        np.add.at(mass, np.arange(len(head)) // MEMBERS, head_counts)
        # The chances in a cell add up to one over its known words and one unknown.
        inside = [np.bincount(cells_of(head), n, CELLS) for n in (head_counts, head_counts > 0)]
        self.cell_totals = cells.sum(axis=0) - inside[0] - inside[1] + 1
        self.rest_total = int(self.cell_totals.sum())
        mass[CLASSES] = n_tokens - int(head_counts.sum())
        bias = np.log(mass + 1.0)
        bias[:CLASSES][np.arange(CLASSES) * MEMBERS >= len(head)] = -1e9
        self.class_bias = bias.astype(np.float32)
        self.class_weights = np.zeros((BUCKETS, CLASSES + 1), np.float32)
        self.member_weights = np.zeros((BUCKETS, MEMBERS), np.float32)
        self.cell_bias = np.log(self.cell_totals).astype(np.float32)
        self.cell_weights = np.zeros((BUCKETS, CELLS), np.float32)

    def tables(self) -> tuple[np.ndarray, ...]:
        """All weights, in the order of their numbers in training."""
        return self.class_weights, self.member_weights, self.cell_weights

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the classes, -1 for the rest."""
        out = np.full(len(words), -1)
        for shift, table in self.lookup:
            at = table[(words >> np.uint64(shift)).astype(np.uint16)]
            np.copyto(out, self.head_slot[at], where=self.head[at] == words)
        return out

    def counts(self, words: np.ndarray, slots: np.ndarray | None = None) -> np.ndarray:
        """Training counts of frequent words, -1 for words that have to be joined; ``slots``: of the words, if known."""
        if not len(self.known):
            return np.full(len(words), -1)
        if slots is not None:
            out = self.slot_counts[slots]
            rest = np.flatnonzero(slots < 0)
            out[rest] = self.counts(words[rest])
            return out
        at = np.searchsorted(self.known, words)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == words, self.known_counts[at], -1)


def contexts(words: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The hashed features of what stands before each token; before a text stands an end."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[begins[:-1]] = END
    second = np.empty_like(words)
    second[1:] = before[:-1]
    second[begins[:-1]] = END
    return [mix(before + np.uint64(11)), mix(second + np.uint64(23)), mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(second + np.uint64(37)))]


def _bucket(feature: np.ndarray, of_class: np.ndarray | None = None) -> np.ndarray:
    if of_class is not None:
        feature = mix(feature + _CLASS_CODES[of_class])
    return (feature & np.uint64(BUCKETS - 1)).view(np.int64)


def _shifted(bias: np.ndarray) -> np.ndarray:
    """The same chances, with 0 as the largest logit of a row."""
    return bias - bias.max(axis=-1, keepdims=True)


def _logits(bias: np.ndarray, weights: np.ndarray, buckets: list[np.ndarray], rows: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """The logits of all tokens, a block at a time; ``rows``: which row of the bias each token has."""
    bias = _shifted(bias)
    large = FEATURES * np.abs(weights).max() > LARGE
    for start in range(0, len(buckets[0]), BLOCK):
        some = slice(start, start + BLOCK)
        out = weights.take(buckets[0][some], axis=0)
        for bucket in buckets[1:]:
            out += weights.take(bucket[some], axis=0)
        out += bias if rows is None else bias.take(rows[some], axis=0)
        if large:
            out -= out.max(axis=1, keepdims=True)
        yield some, out


def _log_picked(answers: np.ndarray, bias: np.ndarray, weights: np.ndarray, buckets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the chance of each token's answer."""
    found = np.empty(len(answers), np.float32)
    ones = np.ones(weights.shape[1], np.float32)
    for some, logits in _logits(bias, weights, buckets, rows):
        picked = logits[np.arange(len(logits)), answers[some]]
        found[some] = picked - np.log(np.exp(logits, out=logits) @ ones)
    return found


def log_chances(model: Model, words: np.ndarray, begins: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's chance; of the rest that of its class, and how much likelier its cell is here than by counts."""
    features = contexts(words, begins)
    of_class = classes_of(slots)
    out = _log_picked(of_class, model.class_bias, model.class_weights, [_bucket(f) for f in features]).astype(np.float64)
    head = np.flatnonzero(slots >= 0)
    classes = of_class[head]
    out[head] += _log_picked(slots[head] & (MEMBERS - 1), model.member_bias, model.member_weights, [_bucket(f[head], classes) for f in features], classes)
    rest = np.flatnonzero(slots < 0)
    cells = cells_of(words[rest])
    out[rest] += _log_picked(cells, model.cell_bias, model.cell_weights, [_bucket(f[rest], of_class[rest]) for f in features])
    out[rest] -= np.log(model.cell_totals[cells] / model.rest_total)
    return out


def _add_rows(total: np.ndarray, buckets: list[np.ndarray], rows: np.ndarray) -> None:
    """Add each row to the rows of ``total`` that its buckets name: by products of matrices, over rows sorted by bucket."""
    bucket = np.concatenate(buckets).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    order %= max(1, len(rows))
    lane, every = (bucket % LANES).astype(np.uint8), np.arange(LANES, dtype=np.uint8)[:, None]
    edges = np.searchsorted(bucket, np.arange(0, BUCKETS + 1, LANES, dtype=np.uint16)).tolist()
    for at, (start, end) in enumerate(zip(edges, edges[1:])):
        if end > start:
            total[at * LANES : (at + 1) * LANES] += (lane[start:end] == every).astype(np.float32) @ rows.take(order[start:end], axis=0)


def _learned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple]:
    """By step, and by table: its number, its bias and which row of it each token has, the tokens' buckets, and their answers."""
    for batch in steps(batches, limit=LEARN_STEP):
        found = [tokens(some.column("text").to_pylist()) for some in steps([batch], limit=TOKEN_STEP)]
        words = np.concatenate([f[0] for f in found])
        begins = np.cumsum([0, *(n for f in found for n in np.diff(f[1]))])
        slots = model.slots(words)
        features = contexts(words, begins)
        of_class = classes_of(slots)
        yield 0, model.class_bias, None, [_bucket(f) for f in features], of_class
        head = np.flatnonzero(slots >= 0)
        classes = of_class[head]
        yield 1, model.member_bias, classes, [_bucket(f[head], classes) for f in features], slots[head] & (MEMBERS - 1)
        rest = np.flatnonzero(slots < 0)
        yield 2, model.cell_bias, None, [_bucket(f[rest], of_class[rest]) for f in features], cells_of(words[rest])


_SUMS = "table int, part int, sums binary"


def _sent(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sums of a task, by parts of each table."""
    for number, table in enumerate(tables):
        starts = range(0, BUCKETS, PART)
        sums = [table[start : start + PART].astype(np.float32).tobytes() for start in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.binary())], names=["table", "part", "sums"]
        )


def _count_answers(shared):
    """What each feature saw: per table and bucket the tokens of each answer; and those of each class in the buckets of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        seen = [np.zeros(BUCKETS * width) for width in (*(t.shape[1] for t in model.tables()), CLASSES)]

        def add(table: int, buckets: list[np.ndarray], answers: np.ndarray) -> None:
            width = len(seen[table]) // BUCKETS
            for bucket in buckets:
                np.add.at(seen[table], bucket * width + answers, 1.0)

        for table, _, rows, buckets, answers in _learned(batches, model):
            add(table, buckets, answers)
            if rows is not None:
                add(len(seen) - 1, buckets, rows)
        yield from _sent([s.reshape(BUCKETS, -1) for s in seen])

    return run


def _expect(shared):
    """What the model expects each feature to see, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        expected = [np.zeros_like(table, np.float64) for table in model.tables()]
        for table, bias, rows, buckets, answers in _learned(batches, model):
            weights = model.tables()[table]
            chances = np.empty((len(answers), weights.shape[1]), np.float32)
            ones = np.ones(weights.shape[1], np.float32)
            for some, logits in _logits(bias, weights, buckets, rows):
                np.exp(logits, out=logits)
                np.divide(logits, (logits @ ones)[:, None], out=chances[some])
            _add_rows(expected[table], buckets, chances)
        yield from _sent(expected)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of a table."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for table, part, some in zip(*(batch.column(c).to_pylist() for c in ("table", "part", "sums"))):
            one = np.frombuffer(some, np.float32)
            if (table, part) not in sums:
                sums[table, part] = np.zeros(len(one))
            sums[table, part] += one
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            names=["table", "part", "sums"],
        )


def _summed(texts: DataFrame, model: Model, of_task, widths: list[int]) -> list[np.ndarray]:
    """Tables of sums over all rows; each task sends them in parts, and a part is added up in one place."""
    sums = texts.mapInArrow(of_task(texts.sparkSession.sparkContext.broadcast(model)), _SUMS)
    out = [np.zeros((BUCKETS, width)) for width in widths]
    for row in sums.repartition("table", "part").mapInArrow(_add_up, _SUMS).collect():
        part = np.frombuffer(row.sums, np.float64).reshape(-1, widths[row.table])
        out[row.table][row.part * PART : row.part * PART + len(part)] = part
    return out


def train(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of all words' counts (word hash, n) of all training rows.

    Every row teaches in every round. What the features saw is counted once. Before the first round
    all weights are 0, so what the model expects follows from these counts. The driver holds
    the model only: three weight tables, their sums, and counts of ``KNOWN_WORDS`` words at most.
    """
    texts = training.select(text_column(training, text_col).alias("text"))
    counts = materialise(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).toPandas()
    cells = np.zeros((2, CELLS))
    for row in counts.groupBy(F.shiftrightunsigned("word", CELL_SHIFT).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        cells[:, row.cell] = row.n, row.v
    model = Model(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), int(total.n), int(total.v), cells)
    widths = [table.shape[1] for table in model.tables()]
    *seen, by_class = _summed(texts, model, _count_answers, [*widths, CLASSES])
    chances = [np.exp(_shifted(bias.astype(np.float64))) for bias in (model.class_bias, model.member_bias, model.cell_bias)]
    chances = [c / c.sum(axis=-1, keepdims=True) for c in chances]
    all_of = [table.sum(axis=1, keepdims=True) for table in seen]
    for number in range(rounds):
        if number:
            expected = _summed(texts, model, _expect, widths)
        else:
            expected = [all_of[0] * chances[0], by_class @ chances[1], all_of[2] * chances[2]]
        for table, saw, thought in zip(model.tables(), seen, expected):
            table += (RATE * (saw - thought) / (saw + thought + DAMPING)).astype(np.float32)
    return model, counts


_PART = "n_tokens long, n_known long, base double, score double, rest array<long>, rest_n array<int>, rest_class array<int>"


def _score(shared, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        rest_log = np.log10(model.rest_total)
        for batch in steps(batches, limit=TASK_STEP):
            words, begins = tokens(batch.column("text").to_pylist())
            slots = model.slots(words)
            counts = model.counts(words, slots)
            chances = log_chances(model, words, begins, slots) / np.log(10)
            found = counts >= 0
            base = np.where(found, np.log10(counts + 1.0, where=found, out=np.zeros(len(words))), 0.0)
            chances += np.where(slots < 0, base - rest_log, 0.0)
            known = found & (counts > 0)
            rests, rest_ns, rest_classes = [], [], []
            unfound = np.flatnonzero(~found)
            edges = np.searchsorted(unfound, begins).tolist()
            unfound, outside = words[unfound], slots[unfound] < 0
            for start, end in zip(edges, edges[1:]):
                word, first, n = np.unique(unfound[start:end], return_index=True, return_counts=True)
                rests.append(word.view(np.int64))
                rest_ns.append(n.astype(np.int32))
                rest_classes.append(outside[start:end][first].astype(np.int32))
            cuts = begins[:-1]
            arrays = [pa.array(np.diff(begins)), pa.array(np.add.reduceat(known.astype(np.int64), cuts)), pa.array(np.add.reduceat(base, cuts)),
                      pa.array(np.add.reduceat(chances, cuts)), pa.array(rests, pa.list_(pa.int64())), pa.array(rest_ns, pa.list_(pa.int32())),
                      pa.array(rest_classes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *(f.split()[0] for f in _PART.split(", "))])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is one token, its end. The score is the log10 of a proper
    probability over all texts. Repeated rows have equal scores; words met in no
    training row have count 0.
    """
    rows = docs.select(*keep, text_column(docs, text_col).alias("text"))
    kept = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    parts = materialise(rows.mapInArrow(_score(shared, kept), f"{schema}, {_PART}").withColumn("_row", F.monotonically_increasing_id()))
    rest = parts.select("_row", F.explode(F.arrays_zip("rest", "rest_n", "rest_class")).alias("x"))
    rest = rest.select("_row", F.col("x.rest").alias("word"), F.col("x.rest_n").alias("times"), F.col("x.rest_class").alias("outside"))
    joined = rest.join(counts, "word")
    sums = joined.groupBy("_row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_log"), F.sum(F.col("outside") * F.col("times") * F.log10(F.col("n") + 1)).alias("_out")
    )
    size = float(np.log10(model.n_tokens + model.n_words + 1))
    zero = F.lit(0.0)
    return parts.join(sums, "_row", "left").select(
        *kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_log", zero) - F.col("n_tokens") * size).alias("base_score"),
        (F.col("score") + F.coalesce("_out", zero)).alias("score"),
    )


def op4_maxent_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_rest(docs["doc_id"], 7) == 2
    model, counts = train(docs.where(~held_out))
    return score(docs, model, counts, [docs["doc_id"], held_out.alias("held_out")])
