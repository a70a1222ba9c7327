"""Greedy string tiling by plain lists of words."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasklattice.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def plain_tiles(document, item, least):
    """Mark the longest run that both still have unmarked, first in the item and then in the document, until none is left."""
    free_doc, free_item, tiles = [True] * len(document), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(document)):
                n = 0
                while i + n < len(item) and d + n < len(document) and free_item[i + n] and free_doc[d + n] and item[i + n] == document[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least or n == 0:
            return tiles
        tiles.append((d, i, n))
        for k in range(n):
            free_doc[d + k] = free_item[i + k] = False


def plain_pairs(docs, items, coverage):
    out = []
    for doc, text in docs:
        for item, wanted in items:
            ours, mine = words_of(text), words_of(wanted)
            if not mine:
                continue
            tiles = plain_tiles(ours, mine, min(dc.SEED_WORDS, len(mine)))
            marked = sum(n for *_, n in tiles)
            if tiles and marked >= coverage * len(mine):
                out.append((doc, item, len(mine), marked, len(tiles), max(n for *_, n in tiles), marked / len(mine)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    """Items copied whole, in part and in another order, of one to thirty words; few different words, so that runs repeat."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 12, 30])))) for k in range(24)] + [(90, None), (91, ""), (92, ".,-")]
    docs = []
    for k in range(40):
        text = rng.choices(words, k=rng.randint(0, 50))
        item = words_of(rng.choice(items)[1])
        cut = len(item) // 2
        kind = rng.randrange(4)
        at = rng.randint(0, len(text))
        text[at:at] = [item, item[cut:] + ["between"] + item[:cut], item[: cut + 1], []][kind]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text).upper() if k % 3 else " ".join(text)))
    return [*docs, docs[0], (None, docs[1][1]), (200, None), (201, "")], [*items, items[0]]


@pytest.mark.parametrize("coverage", [0.5, 1.0])
def test_pairs_equal_plain_tiling(spark, case, coverage, monkeypatch):
    docs, items = case
    table = spark.createDataFrame(docs, DOCS).withColumns({n: F.lit("x") for n in ("lowered", "item_id", "coverage", "_lowered")})
    benchmark = spark.createDataFrame(items, ITEMS)
    expected = plain_pairs(docs, items, coverage)
    assert sorted((tuple(r) for r in dc.contaminated(table, benchmark, coverage).collect()), key=repr) == expected
    # The same in blocks of a few items.
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    assert sorted((tuple(r) for r in dc.contaminated(table, benchmark, coverage).collect()), key=repr) == expected
    clean = dc.clean_documents(table, benchmark, coverage)
    assert clean.columns == table.columns
    bad = {r[0] for r in expected}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((k for k, _ in docs if k not in bad), key=repr)


def test_tiles_equal_plain_tiles():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.randint(2, 6)
        document, item = ([rng.randrange(letters) for _ in range(rng.randint(0, 25))] for _ in range(2))
        least = rng.randint(1, 5)
        code = lambda seq: dc.mix(np.array(seq, np.uint64) + np.uint64(1))
        assert sorted(dc.tile(code(document), code(item), least)) == sorted(plain_tiles(document, item, least))
