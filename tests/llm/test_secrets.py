"""The randomness battery against plain arithmetic, and how many planted keys it finds."""

from __future__ import annotations

import math
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from tasklattice.llm import secret_scan as ss

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": string.ascii_uppercase + "234567",
    "alnum": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}
LENGTHS = (20, 32, 40, 64)


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_chance(token, texts):
    """The chance of ordinary text, by loops over the string and the corpus."""
    letters = next(a for _, a in ss.ENCODINGS if set(token) <= set(a))
    n, size = len(token), len(letters)
    values = [letters.index(c) for c in token]
    chi = sum((values.count(k) - n / size) ** 2 / (n / size) for k in range(size))
    free = size - 1
    p_chi = tail(((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    side = [2 * v >= size for v in values]
    runs, ones = 1 + sum(a != b for a, b in zip(side, side[1:])), sum(side)
    mean = 1 + 2 * ones * (n - ones) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = 2 * tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0
    middle = sum(values) / n
    square = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / square if square else 1
    p_serial = 2 * tail(abs(serial) * math.sqrt(n)) if square else 0
    if 3 * min(p_chi, p_runs, p_serial) < ss.ALPHA:
        return 1.0
    kind = lambda c: 1 if c.isdigit() else 2 if c.isalpha() else 0
    steps = lambda text: [(kind(a), kind(b)) for a, b in zip(text, text[1:]) if a.isascii() and b.isascii() and kind(a) and kind(b)]
    ordinary = [s for t in texts for s in steps(re.sub(r"[A-Za-z0-9+/_-]{%d,}" % ss.MIN_LENGTH, " ", t))]
    rate = (sum(a != b for a, b in ordinary) + 0.5) / (len(ordinary) + 1)
    own = steps(token)
    share = sum(a != b for a, b in own) / max(1, len(own))
    p_many = 1.0
    if share > rate:
        p_many = math.exp(-len(own) * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0)))
    weights = [sum(t.count(c) for t in texts) + 0.5 for c in letters]
    s2, s3 = (sum((w / sum(weights)) ** k for w in weights) for k in (2, 3))
    pairs, equal = n * (n - 1) / 2, sum(a == b for i, a in enumerate(values) for b in values[:i])
    variance = pairs * (s2 - s2**2) + pairs * 2 * (n - 2) * (s3 - s2**2)
    return min(1.0, 2 * min(p_many, tail((pairs * s2 - equal) / math.sqrt(variance))))


def plain_found(texts, rate):
    """Benjamini-Hochberg by length band over the sorted chances of all candidates."""
    bands = {}
    for k, text in enumerate(texts):
        base = ss.base_spans(text)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{%d,}" % ss.MIN_LENGTH, text):
            if not any(b[1] < m.end() and m.start() < b[2] for b in base):
                bands.setdefault(len(m[0]).bit_length(), []).append((plain_chance(m[0], texts), k, *m.span()))
    found = set()
    for rows in bands.values():
        rows.sort()
        last = max((i for i, r in enumerate(rows, 1) if r[0] <= rate * i / len(rows)), default=0)
        found |= {r[1:] for r in rows[:last]}
    return found


def corpus(seed, keys):
    rng = random.Random(seed)
    syllables = ["the", "an", "ing", "er", "on", "th", "ed", "in", "ber", "ung", "schen", "ly"]
    texts = []
    for key in keys:
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 6))).capitalize() if rng.random() < 0.1 else "".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(60)]
        words += [rng.choice(["2024-01-15", "some-long-slug-of-words", "1234567890123456", "getTheNameFromIt", "a/b-c_d+e/f-g_h", "AAAAAAAAAAAAAAAA", "v2.1"])]
        if key:
            words.insert(rng.randrange(60), key)
        texts.append(" ".join(words))
    return texts


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({n: F.lit("x") for n in ("base", "random", "byte", "n", "spans")})
    rows = ss.scan(docs).collect()
    return {(r.doc_id, int(s.split(":")[1]), int(s.split(":")[2])) for r in rows for s in r.spans.split(",") if s.startswith("random")}


def test_equals_plain_tests(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in LENGTHS] + [None] * 24
    texts = corpus(1, keys)
    for key in filter(None, keys):
        counts = np.array(next(ss._count_bytes(iter([ss.pa.RecordBatch.from_arrays([ss.pa.array([t.encode() for t in texts])], names=["text"])]))).column("n").to_pylist())
        got = ss.Battery(counts[:256], int(counts[ss.PLACES]), int(counts[ss.CHANGES])).judge(key)
        assert math.isclose(got, plain_chance(key, texts), rel_tol=1e-6)
    found = spans(spark, texts)
    # The levels of the histogram are rounded to the safe side, by a twentieth of a power of ten.
    assert plain_found(texts, ss.FALSE_RATE * 10 ** (-1 / ss.BINS_PER_DECADE)) <= found <= plain_found(texts, ss.FALSE_RATE)


def test_recall_of_planted_keys(spark):
    """Ten keys of every length and encoding among ordinary words, slugs, names and numbers."""
    rng = random.Random(7)
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS.values() for n in LENGTHS for _ in range(10)]
    texts = corpus(3, keys + [None] * 40)
    found = spans(spark, texts)
    planted, base = set(), 0
    for k, key in enumerate(keys):
        start = texts[k].index(key)
        if any(s < start + len(key) and start < e for _, s, e in ss.base_spans(texts[k])):
            base += 1
        else:
            planted.add((k, start, start + len(key)))
    assert base >= 30  # long hexadecimal ones have a known shape
    assert len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.02 * len(planted)


def test_short_mixed_and_numeric_candidates_are_judged():
    battery = ss.Battery(np.full(256, 100), 10_000, 3)
    assert battery.judge("k3Zq9PfX2mLw") < 1e-6
    assert battery.judge("a+b/c-d_e" * 3) == 1.0 or battery.judge("a+b/c-d_e" * 3) > 0.001
    assert battery.judge("31415926535897932384") > 0.001
