"""Ranked search by dual trees against scoring every pair."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasklattice.llm import lexical_search as ls

DOCS, ITEMS = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    split = [(key, terms(text)) for key, text in docs]
    split = [(key, found) for key, found in split if found]
    count, words = len(split), sum(len(found) for _, found in split)
    held = {}
    for _, found in split:
        for term in set(found):
            held[term] = held.get(term, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for key, found in split:
            m = 100 - 25 + (25 * len(found) * count) // words
            score = 0
            for term in terms(text):
                tf = found.count(term)
                w = math.floor(1000 * math.log((2 * count + 2) / (2 * held.get(term, 0) + 1)))
                score += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, key is not None, key or 0))
        out += [(item, rank, key if there else None, -score) for rank, (score, there, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(300)]
    texts += [texts[0]] * 150 + [t.upper() + "!" for t in texts[:10]]
    docs = list(enumerate(texts)) + [(900, None), (901, ""), (902, " .-\n"), (None, texts[1]), (None, texts[2]), (3, texts[3]), (903, "Ab, " * 20_000)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for k in range(70)]
    items += [(100, None), (101, ""), (102, "unheard-of wordsss"), (103, texts[0]), (None, texts[1]), (5, "ab ab AB é"), (5, "ab ab AB é")]
    return docs, items


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "id", "score").collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_scoring_every_pair(spark, corpus, monkeypatch, small):
    """Also with blocks, batches and trees of the smallest sizes."""
    docs, items = corpus
    if small:
        for name, value in (("BLOCK_ITEMS", 40), ("BLOCK_BYTES", 1500), ("BATCH_DOCS", 30), ("BATCH_POSTINGS", 200), ("TREE_CELLS", 300), ("LEAF_DOCS", 2)):
            monkeypatch.setattr(ls, name, value)
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS).repartition(3)
    clash = table.withColumns({name: F.lit("x") for name in ("id", "n", "terms", "times", "item", "item_id", "score", "rank")})
    asked = spark.createDataFrame(items, ITEMS).withColumns({name: F.lit("x") for name in ("place", "chunk", "block", "rank")})
    assert found(ls.search_documents(clash, asked)) == brute(docs, items)


def test_equal_hashes_are_told_apart(monkeypatch):
    items = ls.index_items([1], ["aa bb cc"], ls.pa.int64())
    low = items._replace(hashes=np.zeros(3, np.uint64), terms=np.arange(3), twins=3)
    data = np.frombuffer(b"bb dd cc aaa aa", np.uint8)
    first, last = np.array([0, 3, 6, 9, 13]), np.array([2, 5, 8, 12, 15])
    assert ls.find_terms(low, data, first, last, np.zeros(5, np.uint64)).tolist() == [1, -1, 2, -1, 0]


def test_trees_prune_and_lose_nothing(corpus):
    """With a kth score known, leaves are left out, and every document that reaches it stands in those left."""
    docs, items = corpus
    texts = [t for _, t in docs if terms(t)]
    block = ls.index_items(list(range(len(items))), [t for _, t in items], ls.pa.int64())
    found = [[(block_word, terms(t).count(word)) for block_word, word in enumerate(words_of(block)) if word in set(terms(t))] for t in texts]
    held = np.bincount([w for row in found for w, _ in row], minlength=len(block.hashes))
    weights = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * h + 1))) for h in held], np.int64)
    levels, order = ls.item_tree(block, weights)
    n = np.array([len(terms(t)) for t in texts])
    search = ls.Search(block, weights, len(texts), int(n.sum()), levels, order, np.ones(len(items), np.int64))
    offsets = np.cumsum([0, *(len(r) for r in found)])
    flat = np.array([p for row in found for p in row], np.int64)
    tree = ls.DocTree(search, ls.pa.array(range(len(texts))), n, offsets, flat[:, 0], flat[:, 1])
    leaves = np.arange(tree.levels[0].shape[1])
    totals = [tree.scores(*ls._item_weights(search, k), leaves) for k in range(len(items))]
    kth = np.array([np.sort(s)[-20] if len(s) >= 20 else 1 for _, s in totals], np.int64)
    left = dict(ls.live_leaves(search, tree, kth))
    kept = 0
    for k, (docs_of, scores) in enumerate(totals):
        wanted = set((docs_of[scores >= kth[k]] // tree.leaf_docs).tolist())
        assert wanted <= set(left.get(k, np.zeros(0)).tolist())
        kept += len(left.get(k, ()))
    assert kept < len(items) * len(leaves) * 0.9


def words_of(block):
    return [block.words[b : b + n].tobytes().decode() for b, n in zip(block.begins, block.lengths)]


def test_empty_sides(spark, corpus):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS)
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert found(ls.search_documents(docs.limit(0), items)) == []
    assert found(ls.search_documents(docs, items.limit(0))) == []
    assert found(ls.search_documents(docs.withColumn("text", F.lit(None).cast("string")), items)) == []
