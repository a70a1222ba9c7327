"""Ranked lexical search by dual trees: bounds of node pairs prune batches of documents for batches of items.

Documents become sparse vectors over the items' terms once. A task sorts a batch of them so
that documents with the same strong term are neighbours, and builds a tree over them; each
node holds the largest impact of every term below it. The items have such a tree too, with
the largest weights. The sum of both nodes' products bounds the score of every pair below
them: if it is under the weakest kth score of the node's items, the pair of nodes goes. Pairs
of an item and a leaf that are left are scored in whole numbers. kth scores start from
documents that a first pass has scored for every item, so every batch prunes from its beginning.

Items are taken by blocks of bounded size, one after the other; what a block broadcasts, its
terms and vectors, is bounded by it. Every item meets all documents.

Ties go to the smaller id, null first. Repeated documents rank each for itself, repeated
items each get a ranking. A null or empty text has no term: such a document is in no result
and no count, such an item has no rows. Long texts are read whole. With an empty table on
either side there are no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tasklattice.llm.common import located_words, steps, text_column
from tasklattice.operators.ordering import numbered
from tasklattice.session import materialise, release

K = 20
# A block of items: bytes of text (or a single item), and items at most.
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 4096
# A batch of documents: postings (or a single document), documents and cells of a tree's maxima at most.
BATCH_POSTINGS = 1 << 20
BATCH_DOCS = 4096
TREE_CELLS = 1 << 22
LEAF_DOCS = 16
FANOUT = 8
# Bounds are sums of doubles; scores are whole numbers.
SLACK = 1 + 1e-9

# Letters, digits and everything beyond ASCII are term bytes; the rest parts terms.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Items(NamedTuple):
    """A block of items: its vocabulary, and each item's terms with their numbers of times."""

    ids: pa.Array
    words: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    # Hashes in order, and the term of each.
    hashes: np.ndarray
    terms: np.ndarray
    # How many terms share a hash at most: one, but for an accident.
    twins: int
    vectors: list[tuple[np.ndarray, np.ndarray]]


def index_items(ids: list, texts: list[str | None], kind: pa.DataType) -> Items:
    counts = [Counter(TERM.findall((text or "").encode().translate(FOLD))) for text in texts]
    vocabulary = sorted(set().union(*counts))
    place = {word: k for k, word in enumerate(vocabulary)}
    vectors = []
    for count in counts:
        found = sorted((place[word], times) for word, times in count.items())
        vectors.append((np.array([t for t, _ in found], np.int64), np.array([q for _, q in found], np.int64)))
    data, first, last, hashes, _ = located_words(vocabulary, FOLD)
    order = np.argsort(hashes, kind="stable")
    twins = max(Counter(hashes.tolist()).values(), default=1)
    return Items(pa.array(ids, kind), data, first, last - first, hashes[order], order, twins, vectors)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def find_terms(items: Items, data: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The term of every word, -1 for words that no item has; equal hashes are held against the bytes."""
    found = np.full(len(hashes), -1, np.int64)
    if not len(items.hashes):
        return found
    at = np.searchsorted(items.hashes, hashes)
    for shift in range(items.twins):
        place = np.minimum(at + shift, len(items.hashes) - 1)
        hit = np.flatnonzero((items.hashes[place] == hashes) & (found < 0))
        term, length = items.terms[place[hit]], last[hit] - first[hit]
        same = items.lengths[term] == length
        hit, term, length = hit[same], term[same], length[same]
        if len(hit):
            equal = data[_ranges(first[hit], length)] == items.words[_ranges(items.begins[term], length)]
            whole = np.logical_and.reduceat(equal, np.cumsum(length) - length)
            found[hit[whole]] = term[whole]
    return found


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        size = max(1, len(items.hashes))
        for step in steps(batches):
            data, first, last, hashes, edges = located_words(step.column("text").to_pylist(), FOLD)
            lengths = np.diff(edges)
            term = find_terms(items, data, first, last, hashes)
            known = term >= 0
            doc = np.repeat(np.arange(len(lengths)), lengths)
            keys, times = np.unique(doc[known] * size + term[known], return_counts=True)
            kept = np.flatnonzero(lengths)
            offsets = np.append(np.searchsorted(keys // size, kept), len(keys)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    step.column("id").take(pa.array(kept)),
                    pa.array(lengths[kept]),
                    pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                names=["id", "n", "terms", "times"],
            )

    return run


class Search(NamedTuple):
    """What every task gets: the items' trees, lowest level first, and the corpus counts."""

    items: Items
    weights: np.ndarray
    docs: int
    words: int
    # Per level, the terms and the largest weight of each node.
    levels: list[list[tuple[np.ndarray, np.ndarray]]]
    # The items in the order of the lowest level.
    order: np.ndarray
    # Per item, a score that k documents reach, else 1.
    least: np.ndarray


def item_tree(items: Items, weights: np.ndarray) -> tuple[list, np.ndarray]:
    """Items that share their weightiest term are neighbours; nodes of ``FANOUT`` children hold the largest weights."""
    strong = [int(t[np.argmax(weights[t])]) if len(t) else -1 for t, _ in items.vectors]
    order = np.argsort(strong, kind="stable")
    level = [(items.vectors[k][0], (items.vectors[k][1] * weights[items.vectors[k][0]]).astype(np.float64)) for k in order]
    levels = [level]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), FANOUT):
            terms = np.concatenate([t for t, _ in level[start : start + FANOUT]])
            tops = np.concatenate([w for _, w in level[start : start + FANOUT]])
            by = np.argsort(terms, kind="stable")
            terms, tops = terms[by], tops[by]
            edges = np.flatnonzero(np.diff(terms, prepend=-1))
            above.append((terms[edges], np.maximum.reduceat(tops, edges) if len(edges) else tops))
        levels.append(level := above)
    return levels, order


class DocTree:
    """A batch of documents in the order of their strongest terms, its postings by term, and the maxima of its nodes."""

    def __init__(self, search: Search, ids: pa.Array, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, times: np.ndarray):
        # The product may leave 64 bits in a very large corpus, so it is Python's.
        norm = np.array([75 + 25 * x * search.docs // search.words for x in n.tolist()], np.int64)
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), sizes)
        impact = (1_000_000_000 * times) // (1000 * times + 12 * norm[doc])
        strong = np.full(len(n), -1, np.int64)
        by = np.lexsort((impact * search.weights[terms], doc))
        filled = np.flatnonzero(sizes)
        strong[filled] = terms[by[np.cumsum(sizes)[filled] - 1]]
        order = np.argsort(strong, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        self.ids = ids.take(pa.array(order))
        self.docs = len(n)

        present, row = np.unique(terms, return_inverse=True)
        self.row = np.full(len(search.weights), -1, np.int64)
        self.row[present] = np.arange(len(present))
        keys = row * self.docs + place[doc]
        by = np.argsort(keys)
        self.keys, self.impact = keys[by], impact[by]

        leaves = max(1, min(-(-self.docs // LEAF_DOCS), TREE_CELLS // max(1, len(present))))
        self.leaf_docs = -(-self.docs // leaves)
        leaves = -(-self.docs // self.leaf_docs)
        maxima = np.zeros((len(present), leaves))
        if len(self.keys):
            cell = self.keys // self.docs * leaves + self.keys % self.docs // self.leaf_docs
            edges = np.flatnonzero(np.diff(cell, prepend=-1))
            maxima.ravel()[cell[edges]] = np.maximum.reduceat(self.impact, edges)
        self.levels = [maxima]
        while maxima.shape[1] > 1:
            maxima = np.maximum.reduceat(maxima, np.arange(0, maxima.shape[1], FANOUT), axis=1)
            self.levels.append(maxima)

    def bounds(self, level: int, terms: np.ndarray, tops: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """No document below a node scores more than this."""
        row = self.row[terms]
        here = row >= 0
        return tops[here] @ self.levels[level][np.ix_(row[here], nodes)]

    def scores(self, terms: np.ndarray, weights: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the leaves that score, and their scores."""
        row = self.row[terms]
        here = row >= 0
        base = row[here, None] * self.docs
        start = np.searchsorted(self.keys, base + leaves * self.leaf_docs)
        size = np.searchsorted(self.keys, base + np.minimum((leaves + 1) * self.leaf_docs, self.docs)) - start
        at = _ranges(start.ravel(), size.ravel())
        total = np.zeros(self.docs, np.int64)
        np.add.at(total, self.keys[at] % self.docs, self.impact[at] * np.repeat(weights[here], size.sum(axis=1)))
        docs = np.flatnonzero(total)
        return docs, total[docs]


def _doc_trees(search: Search, batches: Iterator[pa.RecordBatch]) -> Iterator[DocTree]:
    for batch in batches:
        lists = batch.column("terms")
        offsets = lists.offsets.to_numpy()
        terms = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        times = batch.column("times").values.to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + BATCH_POSTINGS, "right")) - 1
            end = min(max(end, start + 1), start + BATCH_DOCS, batch.num_rows)
            low, high = offsets[start], offsets[end]
            yield DocTree(search, batch.column("id").slice(start, end - start), n[start:end], offsets[start : end + 1] - low, terms[low:high], times[low:high])
            start = end


class Best:
    """An item's best documents so far, at most k of them."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.found = k, least, []

    def add(self, tree: DocTree, docs: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:
            floor = max(self.least, int(np.partition(scores, -self.k)[-self.k]))
        else:
            floor = self.least
        good = scores >= floor
        if not good.any():
            return
        ids = tree.ids.take(pa.array(docs[good])).to_pylist()
        # Null sorts before any id.
        rows = [(-score, key is not None, key if key is not None else 0) for score, key in zip(scores[good].tolist(), ids)]
        self.found = heapq.nsmallest(self.k, self.found + rows)
        if len(self.found) == self.k:
            self.least = max(self.least, -self.found[-1][0])


def live_leaves(search: Search, tree: DocTree, least: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Down both trees at once: for each item the leaves whose bound reaches its kth score."""
    item_floor = [least[search.order].astype(np.float64)]
    while len(item_floor[-1]) > 1:
        item_floor.append(np.minimum.reduceat(item_floor[-1], np.arange(0, len(item_floor[-1]), FANOUT)))
    high, deep = len(search.levels) - 1, len(tree.levels) - 1
    pairs = {0: np.arange(tree.levels[deep].shape[1])}
    while True:
        left = {}
        for node, nodes in pairs.items():
            terms, tops = search.levels[high][node]
            bounds = tree.bounds(deep, terms, tops, nodes)
            live = nodes[(bounds > 0) & (bounds * SLACK >= item_floor[high][node])]
            if len(live):
                left[node] = live
        if not high and not deep:
            break
        if deep:
            deep -= 1
            width = tree.levels[deep].shape[1]
            left = {node: (c := (live[:, None] * FANOUT + np.arange(FANOUT)).ravel())[c < width] for node, live in left.items()}
        if high:
            high -= 1
            count = len(search.levels[high])
            left = {child: live for node, live in left.items() for child in range(node * FANOUT, min(count, (node + 1) * FANOUT))}
        pairs = left
    for node, leaves in left.items():
        yield int(search.order[node]), leaves


def _item_weights(search: Search, item: int) -> tuple[np.ndarray, np.ndarray]:
    terms, times = search.items.vectors[item]
    return terms, times * search.weights[terms]


def _seed(shared, k: int):
    """Each item's best scores in the leaf of the highest bound of every batch: (item, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        best = [np.zeros(0, np.int64) for _ in search.items.vectors]
        for tree in _doc_trees(search, batches):
            nodes = np.arange(tree.levels[0].shape[1])
            for item in range(len(best)):
                terms, weights = _item_weights(search, item)
                leaf = nodes[[int(np.argmax(tree.bounds(0, terms, weights.astype(np.float64), nodes)))]]
                _, scores = tree.scores(terms, weights, leaf)
                best[item] = np.sort(np.concatenate([best[item], scores]))[-k:]
        if total := sum(map(len, best)):
            items = np.repeat(np.arange(len(best), dtype=np.int32), [len(b) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.concatenate(best)[:total])], names=["item", "score"])

    return run


def _find(shared, k: int):
    """Each item's best documents of this task: (item, item_id, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        best = [Best(k, int(least)) for least in search.least]
        kind = None
        for tree in _doc_trees(search, batches):
            kind = tree.ids.type
            for item, leaves in live_leaves(search, tree, np.array([b.least for b in best])):
                best[item].add(tree, *tree.scores(*_item_weights(search, item), leaves))
        rows = [(item, key if there else None, -score) for item, b in enumerate(best) for score, there, key in b.found]
        if rows:
            items, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int32()), search.items.ids.take(pa.array(items)), pa.array(keys, kind), pa.array(scores, pa.int64())],
                names=["item", "item_id", "id", "score"],
            )

    return run


def _blocks(items: DataFrame) -> DataFrame:
    """(item_id, text, chunk, block): chunks of ``BLOCK_ITEMS`` items, in them blocks of ``BLOCK_BYTES``."""
    rows = numbered(items, [F.asc("item_id"), F.asc(F.xxhash64("text"))], "place")
    in_chunk = Window.partitionBy("chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(F.octet_length("text")).over(in_chunk), F.lit(0))
    return materialise(rows.withColumn("chunk", F.floor(F.col("place") / BLOCK_ITEMS)).withColumn("block", F.floor(so_far / BLOCK_BYTES)))


def _search_block(spark: SparkSession, docs: DataFrame, ids: list, texts: list, item_kind: pa.DataType, k: int, columns: str) -> DataFrame:
    items = index_items(ids, texts, item_kind)
    id_type = docs.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(items)
    vectors = materialise(docs.mapInArrow(_vectors(shared), f"id {id_type}, n long, terms array<int>, times array<long>"))
    shared.destroy()
    count, words = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(items.hashes), np.int64)
    # One row per term of the block.
    for term, found in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * found + 1)))
    levels, order = item_tree(items, weights)
    search = Search(items, weights, count, words, levels, order, np.ones(len(ids), np.int64))
    seeding = spark.sparkContext.broadcast(search)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"))
    seeds = vectors.mapInArrow(_seed(seeding, k), "item int, score long").withColumn("rank", F.row_number().over(ranked))
    for item, score in seeds.where(F.col("rank") == k).select("item", "score").collect():
        search.least[item] = max(1, score)
    seeding.destroy()
    finding = spark.sparkContext.broadcast(search)
    found = materialise(vectors.mapInArrow(_find(finding, k), columns))
    finding.destroy()
    release(vectors)
    order_by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
    return materialise(found.withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= k))


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = K,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, id, score): for every item the k documents of the highest score above 0."""
    spark = docs.sparkSession
    plain = docs.select(docs[id_col].alias("id"), text_column(docs, text_col).alias("text"))
    asked = items.select(items[item_col].alias("item_id"), F.coalesce(items[item_text_col].cast("string"), F.lit("")).alias("text"))
    item_type = asked.schema["item_id"].dataType
    columns = f"item int, item_id {item_type.simpleString()}, id {plain.schema['id'].dataType.simpleString()}, score long"
    blocks = _blocks(asked)
    kind = to_arrow_type(item_type)
    results = spark.createDataFrame([], columns + ", rank int")
    for chunk, block in blocks.select("chunk", "block").distinct().orderBy("chunk", "block").collect():
        rows = blocks.where((F.col("chunk") == chunk) & (F.col("block") == block)).orderBy("place").select("item_id", "text").collect()
        results = results.unionByName(_search_block(spark, plain, [r[0] for r in rows], [r[1] for r in rows], kind, k, columns))
    return results.select("item_id", "rank", "id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that answer each item of the benchmark best."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = search_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


_TERMS = r"list_filter(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"

OP11_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
lengths AS (SELECT doc, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
counts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY doc, term),
spread AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
asked AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM benchmark),
queried AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(terms) AS term FROM asked) GROUP BY item, item_id, term),
weighed AS (
  SELECT item, item_id, term, q, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM queried JOIN spread USING (term), totals
),
scored AS (
  SELECT item, item_id, doc, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM weighed JOIN counts USING (term) JOIN lengths USING (doc), totals GROUP BY item, item_id, doc, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20"""
