"""Embedding near-dedup by an epsilon grid order join.

Unit vectors within a cosine lie within a distance eps of each other. They are sorted
by the grid cells (of width eps) of their leading principal dimensions, cut into
blocks, and blocks whose boxes lie further apart than eps are never paired. A pair of
blocks is joined recursively: intervals of the sequence are halved, distant halves
skipped, and near ones compared by one matrix product. Pairs at the threshold are
decided in double precision from the raw values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import components
from tasklattice.session import materialise

COSINE = 0.95
# Leading dimensions in the sort order, and in the boxes that prove blocks distant.
GRID_DIMENSIONS, BOX_DIMENSIONS = 4, 8
BLOCK_BYTES = 1 << 20
LEAF = 256
# Single-precision products of unit vectors are right to this.
SLACK = 2e-5


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector's bytes in double precision, null if it can link with nothing."""
    for batch in batches:
        keys = []
        for value in batch.column("value").to_pylist():
            data = None if value is None or None in value else np.array(value, np.float64)
            keys.append(data.tobytes() if data is not None and data.size and np.isfinite(data).all() and data.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], names=["vec_id", "key"])


def _matrix(keys: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.float64).reshape(-1, size)


def _units(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            units = _units(_matrix(batch.column("key").to_pylist(), size)) if batch.num_rows else np.zeros((0, size))
            total += units.T @ units
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    return run


def principal_basis(vectors: DataFrame, size: int) -> np.ndarray:
    """The leading principal directions of all vectors, size x BOX_DIMENSIONS; only size x size numbers reach the driver."""
    parts = vectors.select("key").mapInArrow(_moments(size), "row int, sums array<double>")
    cells = parts.select("row", F.posexplode("sums").alias("column", "value")).groupBy("row", "column").agg(F.sum("value").alias("value"))
    total = np.zeros((size, size))
    for cell in cells.collect():
        total[cell["row"], cell["column"]] = cell["value"]
    _, directions = np.linalg.eigh(total)
    return np.ascontiguousarray(directions[:, ::-1][:, :BOX_DIMENSIONS])


def _cells(basis: np.ndarray, size: int, eps: float):
    count = min(GRID_DIMENSIONS, basis.shape[1])
    names = [f"c{k}" for k in range(GRID_DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.zeros((batch.num_rows, GRID_DIMENSIONS), np.int32)
                cells[:, :count] = np.floor(_units(_matrix(batch.column("key").to_pylist(), size)) @ basis[:, :count] / eps)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k].copy()) for k in range(GRID_DIMENSIONS))], names=[*batch.schema.names, *names])

    return run


def _blocks(basis: np.ndarray, size: int, eps: float, rows: int):
    def pack(part: int, number: int, nodes: list, copies: list, keys: list) -> pa.RecordBatch:
        spots = _units(_matrix(keys, size)) @ basis
        low, high = spots.min(axis=0), spots.max(axis=0)
        second = min(1, len(low) - 1)
        cover = [np.arange(np.floor(low[k] / eps), np.floor(high[k] / eps) + 1) for k in (0, second)]
        cells = [int(a) * (1 << 20) + int(b) for a in cover[0] for b in cover[1]]
        around = sorted({c + a * (1 << 20) + b for c in cells for a in (-1, 0, 1) for b in (-1, 0, 1)})
        arrays = [pa.array([(part << 32) + number]), pa.array([np.array(nodes, np.int64).tobytes()]), pa.array([np.array(copies, np.int64).tobytes()]),
                  pa.array([b"".join(keys)], pa.binary()), pa.array([low.tolist()]), pa.array([high.tolist()]),
                  pa.array([cells], pa.list_(pa.int64())), pa.array([around], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "nodes", "copies", "data", "low", "high", "cells", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        part = number = 0
        for batch in batches:
            for node, copies, key, at in zip(*(batch.column(c).to_pylist() for c in ("node", "copies", "key", "part"))):
                part = at
                for values, value in zip(held, (node, copies, key)):
                    values.append(value)
                if len(held[0]) == rows:
                    yield pack(part, number, *held)
                    held, number = ([], [], []), number + 1
        if held[0]:
            yield pack(part, number, *held)

    return run


class _Block:
    def __init__(self, nodes: bytes, copies: bytes, data: bytes, size: int, basis: np.ndarray):
        self.nodes, self.copies = np.frombuffer(nodes, np.int64), np.frombuffer(copies, np.int64)
        self.raw = np.frombuffer(data, np.float64).reshape(-1, size)
        self.units = _units(self.raw)
        self.small = self.units.astype(np.float32)
        self.spots = self.units @ basis
        self.links = np.zeros(len(self.nodes), np.int64)


def _linked(a: _Block, b: _Block, rows: slice, columns: slice, cosine: float) -> np.ndarray:
    products = a.small[rows] @ b.small[columns].T
    hits = products >= cosine - SLACK
    unsure = np.argwhere(hits & (products < cosine + SLACK))
    if len(unsure):
        left, right = a.units[rows][unsure[:, 0]], b.units[columns][unsure[:, 1]]
        exact = np.einsum("ij,ij->i", left, right)
        hits[unsure[:, 0], unsure[:, 1]] = exact >= cosine
    return hits


def join_blocks(a: _Block, b: _Block, same: bool, eps: float, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Count the links of two blocks in both; return links that connect what the links connect."""
    edges = []
    todo = [(0, len(a.nodes), 0, len(b.nodes))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1 or (same and b1 <= a0):
            continue
        left, right = a.spots[a0:a1], b.spots[b0:b1]
        gap = np.maximum(0, np.maximum(left.min(axis=0) - right.max(axis=0), right.min(axis=0) - left.max(axis=0)))
        if gap @ gap > eps * eps:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            # Multiples of the leaf size, so that the leaves of a block with itself meet on the diagonal.
            middle_a, middle_b = a0 + _half(a1 - a0), b0 + _half(b1 - b0)
            todo += [(a0, middle_a, b0, middle_b), (a0, middle_a, middle_b, b1), (middle_a, a1, b0, middle_b), (middle_a, a1, middle_b, b1)]
            continue
        rows, columns = slice(a0, a1), slice(b0, b1)
        hits = _linked(a, b, rows, columns, cosine)
        if same and a0 == b0:
            np.fill_diagonal(hits, False)
        if not hits.any():
            continue
        numbers = hits.astype(np.float64)
        a.links[rows] += (numbers @ b.copies[columns].astype(np.float64)).astype(np.int64)
        if not (same and a0 == b0):
            b.links[columns] += (a.copies[rows].astype(np.float64) @ numbers).astype(np.int64)
        edges.append(_spanning(a.nodes[rows], b.nodes[columns], hits))
    return edges


def _half(count: int) -> int:
    leaves = -(-count // LEAF)
    return count if leaves == 1 else leaves // 2 * LEAF


def _spanning(left: np.ndarray, right: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has a hit with the smallest node of its component within the hits."""
    most = np.iinfo(np.int64).max
    of_left, of_right = left.copy(), right.copy()
    while True:
        new_left = np.minimum(of_left, np.where(hits, of_right[None, :], most).min(axis=1))
        new_right = np.minimum(of_right, np.where(hits, new_left[:, None], most).min(axis=0))
        if (new_left == of_left).all() and (new_right == of_right).all():
            break
        of_left, of_right = new_left, new_right
    rows, columns = hits.any(axis=1), hits.any(axis=0)
    return np.concatenate([left[rows], right[columns]]), np.concatenate([of_left[rows], of_right[columns]])


def _join(size: int, basis: np.ndarray, eps: float, cosine: float):
    """Rows of one centre block, itself first, then its partners: partial link counts and connecting links."""

    def emit(nodes: list, counts: list, edges: list) -> Iterator[pa.RecordBatch]:
        a = np.concatenate([*nodes, *(e[0] for e in edges)]).astype(np.int64)
        b = np.concatenate([*(np.zeros(len(n), np.int64) for n in nodes), *(e[1] for e in edges)]).astype(np.int64)
        n = np.concatenate([*counts, *(np.full(len(e[0]), -1) for e in edges)]).astype(np.int64)
        some = n != 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (a, b, n)], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, number = None, None
        for batch in batches:
            for a, b, nodes, copies, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "nodes", "copies", "data"))):
                block = _Block(nodes, copies, data, size, basis)
                if b is None:
                    centre, number = block, a
                    continue
                other = centre if a == b else block
                assert number == a
                centre.links[:] = 0
                edges = join_blocks(centre, other, a == b, eps, cosine)
                yield from emit([centre.nodes] if a == b else [centre.nodes, other.nodes], [centre.links.copy()] if a == b else [centre.links.copy(), other.links], edges)

    return run


def _links_of(distinct: DataFrame, size: int, cosine: float) -> DataFrame:
    """(a, b, links) of all distinct vectors of one size: partial counts, and links where ``links`` is -1."""
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    basis = principal_basis(distinct, size)
    cells = [f"c{k}" for k in range(GRID_DIMENSIONS)]
    placed = materialise(distinct.mapInArrow(_cells(basis, size, eps), "node long, copies long, key binary, " + ", ".join(f"{c} int" for c in cells)))
    rows = max(LEAF, BLOCK_BYTES // (4 * size) // LEAF * LEAF)
    ordered = placed.repartitionByRange(*cells, "node").sortWithinPartitions(*cells, "node").withColumn("part", F.spark_partition_id())
    schema = "block long, nodes binary, copies binary, data binary, low array<double>, high array<double>, cells array<long>, around array<long>"
    blocks = materialise(ordered.mapInArrow(_blocks(basis, size, eps, rows), schema))
    boxes = blocks.drop("nodes", "copies", "data")
    one = boxes.select(F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode("cells").alias("cell"))
    two = boxes.select(F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode("around").alias("cell"))
    near = " + ".join(f"pow(greatest(0, low_a[{k}] - high_b[{k}], low_b[{k}] - high_a[{k}]), 2)" for k in range(basis.shape[1]))
    pairs = materialise(one.join(two, "cell").where(f"a <= b and {near} <= {eps * eps}").select("a", "b").distinct())
    contents = blocks.select("block", "nodes", "copies", "data")
    partners = pairs.join(contents.withColumnRenamed("block", "b"), "b").select("a", "b", "nodes", "copies", "data")
    # Every pair travels with a copy of its centre, so the pairs of one centre are spread too.
    salted = partners.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)))
    centres = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(8)).alias("salt")).distinct().join(contents.withColumnRenamed("block", "a"), "a")
    centres = centres.select("a", F.lit(None).cast("long").alias("b"), "nodes", "copies", "data", "salt")
    tasks = salted.union(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return tasks.select("a", "b", "nodes", "copies", "data").mapInArrow(_join(size, basis, eps, cosine), "a long, b long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors are compared once and
    counted as often as they occur. Rows of a null id keep it as component_id if no id is
    reachable. An empty table gives an empty result.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("value"))
    keyed = materialise(rows.mapInArrow(_keys, f"vec_id {kind}, key binary").withColumn("node", F.when(F.col("key").isNotNull(), F.xxhash64("key"))))
    distinct = materialise(keyed.where("key is not null").groupBy("key", "node").agg(F.count("*").alias("copies")).select("node", "copies", "key"))
    found = None
    for row in distinct.select((F.length("key") / 8).cast("int").alias("size")).distinct().collect():
        part = _links_of(distinct.where(F.length("key") == 8 * row.size), row.size, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found)
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(found.where("links = -1").select("a", "b"))
    known = materialise(
        distinct.select("node", "copies").join(counts, "node", "left").join(groups, "node", "left").select("node", "copies", "links", F.coalesce("component", "node").alias("label"))
    )
    labelled = materialise(keyed.select("vec_id", "node").join(known, "node", "left"))
    least = materialise(labelled.where("label is not null").groupBy("label").agg(F.min("vec_id").alias("least")))
    out = labelled.join(least, "label", "left")
    component = F.coalesce("least", "vec_id")
    links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_join(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.node
"""
