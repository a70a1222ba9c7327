"""Secret scans: known shapes, and strings that pass a battery of randomness tests.

A candidate is a long run of key characters. For the encoding its characters suggest
(digits, hex, base 32, letters, letters and digits, base 64 and their mixture) three tests ask
if it could be uniformly random: chi-squared over the alphabet, runs above and below the
middle, and serial correlation; together they fail it below ``ALPHA``. What passes is asked the
other way round: how likely would ordinary text of the corpus, at that length, have so even
a chi-squared, and so many runs of digits and of letters? Twice the smaller chance
is the candidate's; one that failed the battery has chance 1. All candidates of similar length are
held against one false-discovery rate, those that failed included.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import steps, text_column
from tasklattice.session import materialise

# The shapes of known kinds, and the order of kinds that start together.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
ENCODINGS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("lower36", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)

MIN_LENGTH = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)
# The battery fails a candidate below this probability; discoveries may be false at this rate.
ALPHA = 0.001
FALSE_RATE = 0.01
# Steps of the histogram of -log10(p), and its end.
BINS_PER_DECADE, MOST_DECADES = 20, 300
FOUND_SCHEMA = "doc_id {}, base array<struct<kind:int,start:int,end:int>>, random array<struct<start:int,end:int,band:int,level:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known shapes in code points, by start and then by kind."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits is matched whole, so asking for 24 drops the same runs.
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


# Digits and letters: what runs are made of. Signs part ordinary words, and capitals begin them, so neither counts.
_CLASS = np.array([1 if 48 <= c <= 57 else 2 if chr(c).isascii() and chr(c).isalpha() else 0 for c in range(256)], np.int8)


_KEY = np.zeros(256, bool)
_KEY[[c for c in range(256) if CANDIDATE.match(chr(c) * MIN_LENGTH)]] = True


def _outside(data: np.ndarray) -> np.ndarray:
    """Which bytes are in no candidate: what ordinary text is like shall not depend on the keys in it."""
    inside = _KEY[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    some = ends - starts >= MIN_LENGTH
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts[some]] = 1
    depth[ends[some]] = -1
    return np.cumsum(depth[:-1], dtype=np.int8) == 0


def _changes(kinds: np.ndarray) -> tuple[int, int]:
    """Places between two digits or letters, and how many of these are between one of either kind."""
    inside = (kinds[1:] > 0) & (kinds[:-1] > 0)
    return int(inside.sum()), int((inside & (kinds[1:] != kinds[:-1])).sum())


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _many(changes: int, places: int, rate: float) -> float:
    """A bound on the chance of so many changes at so many places, each a change at the given rate (Chernoff)."""
    share = changes / places
    if share <= rate:
        return 1.0
    other = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return math.exp(-places * (share * math.log(share / rate) + other))


class Battery:
    """The tests, for one table of how often each byte occurs in the corpus, and its changes between digits and letters."""

    def __init__(self, byte_counts: np.ndarray, places: int, changes: int):
        self.parts = []
        for _, letters in ENCODINGS:
            share = byte_counts[[ord(c) for c in letters]] + 0.5
            share = share / share.sum()
            place = np.zeros(256, np.int64)
            place[[ord(c) for c in letters]] = np.arange(len(letters))
            self.parts.append((frozenset(letters), place, len(letters), float((share**2).sum()), float((share**3).sum())))
        self.rate = (changes + 0.5) / (places + 1)

    def uniform(self, values: np.ndarray, size: int) -> float:
        """The chance that a uniformly random string fails one of the three tests as badly."""
        n = len(values)
        same = int((np.bincount(values, minlength=size) ** 2).sum())
        free = size - 1
        chi = _normal_tail(((max(size * same / n - n, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
        high = values * 2 >= size
        ones = int(high.sum())
        zeros = n - ones
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * ones * zeros / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = 2 * _normal_tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
        centred = values - values.mean()
        square = float((centred**2).sum())
        serial = 2 * _normal_tail(abs(float((centred[1:] * centred[:-1]).sum()) / square) * math.sqrt(n)) if square else 0.0
        return min(1.0, 3 * min(chi, runs_p, serial))

    def judge(self, token: str) -> float:
        """The chance that ordinary text looks as random; 1 for what fails the battery."""
        symbols = frozenset(token)
        _, place, size, s2, s3 = next(p for p in self.parts if symbols <= p[0])
        codes = np.frombuffer(token.encode(), np.uint8)
        values, n = place[codes], len(codes)
        if self.uniform(values, size) < ALPHA:
            return 1.0
        places, changes = _changes(_CLASS[codes])
        runs = _many(changes, places, self.rate) if places else 1.0
        # The chi-squared counts pairs of equal letters; in ordinary text of this length their mean and variance are these.
        same = int((np.bincount(values, minlength=size) ** 2).sum())
        pairs = n * (n - 1) / 2
        mean = pairs * s2
        variance = pairs * (s2 - s2**2) + pairs * 2 * (n - 2) * (s3 - s2**2)
        even = _normal_tail((mean - (same - n) / 2) / math.sqrt(variance)) if variance > 0 else 1.0
        return min(1.0, 2 * min(runs, even))


# Rows of the counts that stand for no byte: places between two digits or letters outside of candidates, and changes there.
PLACES, CHANGES = 256, 257


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(258, np.int64)
    for batch in steps(batches):
        data = np.frombuffer(b" ".join(batch.column("text").to_pylist()), np.uint8)
        total[:256] += np.bincount(data, minlength=256)
        places, changes = _changes(np.where(_outside(data), _CLASS[data], 0))
        total[PLACES] += places
        total[CHANGES] += changes
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(258)), pa.array(total)], names=["byte", "n"])


def length_band(length: int) -> int:
    return length.bit_length()


def _scan(counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        battery = Battery(counts[:256], int(counts[PLACES]), int(counts[CHANGES]))
        for batch in steps(batches):
            bases, randoms = [], []
            for raw in batch.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                found = []
                for match in CANDIDATE.finditer(text):
                    start, end = match.span()
                    if any(b[1] < end and start < b[2] for b in base):
                        continue
                    level = min(MOST_DECADES, -math.log10(max(battery.judge(match[0]), 1e-300))) * BINS_PER_DECADE
                    found.append({"start": start, "end": end, "band": length_band(end - start), "level": int(level)})
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                randoms.append(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(bases, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(randoms, pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "band", "level")]))),
                ],
                names=["doc_id", "base", "random"],
            )

    return run


def discovery_levels(histogram: dict[int, dict[int, int]], tested: dict[int, int], rate: float = FALSE_RATE) -> dict[int, int]:
    """Per band the lowest level that keeps the false-discovery rate (Benjamini-Hochberg).

    A level stands for the largest probability in it, so the rule errs to the safe side.
    """
    out = {}
    for band, levels in histogram.items():
        above = 0
        for level in sorted(levels, reverse=True):
            above += levels[level]
            # At level 0 stands what failed the battery.
            if level and 10 ** (-level / BINS_PER_DECADE) <= rate * above / max(tested[band], above):
                out[band] = level
    return out


def _finish(levels: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for base, random in zip(batch.column("base").to_pylist(), batch.column("random").to_pylist()):
                known = [(b["start"], b["kind"], b["end"]) for b in base]
                added = [(r["start"], 3, r["end"]) for r in random if r["level"] >= levels.get(r["band"], 1 << 30)]
                shown = [f"{KINDS[k]}:{s}:{e}" for s, k, e in known]
                counts.append([sum(k == kind for _, k, _ in known) for kind in range(3)] + [len(added)])
                digests.append(hashlib.sha256(",".join(shown).encode()).hexdigest())
                spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(known + added)))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_RATE) -> DataFrame:
    """Secrets in every text: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ``spans`` lists kind:start:end, code points, end exclusive, by start. Random strings
    that overlap a known shape are not listed again. A null or empty text has none.
    Each row is scanned by itself; repeated rows give equal rows, an empty table none. Spans that
    begin together stand in the order of their kinds. Texts are read whole; other columns,
    whatever their names, are not. Only a histogram of
    fixed size and the counts of bytes pass through the driver.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), text_column(docs, text_col).alias("text"))
    counts = np.zeros(258)
    for row in rows.select("text").mapInArrow(_count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[row.byte] = row.n
    found = materialise(rows.mapInArrow(_scan(counts), FOUND_SCHEMA.format(kind)))
    histogram: dict[int, dict[int, int]] = {}
    for row in found.select(F.explode("random").alias("r")).groupBy("r.band", "r.level").count().collect():
        histogram.setdefault(row.band, {})[row.level] = row["count"]
    tested = {band: sum(levels.values()) for band, levels in histogram.items()}
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return found.mapInArrow(_finish(discovery_levels(histogram, tested, rate)), schema)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
