"""Merkle dataset manifest: trees of digests per group under one root, with a proof for every row.

A run of ``FANOUT`` neighbouring nodes is pivoted into as many columns by conditional
aggregates. The columns put together are hashed to the parent; without a node's own
column they are its siblings. Levels are tables a sixteenth of the one below, and on the
way down a run hands its children their siblings and its own path: a row meets its
whole path in one join with a sixteenth of the rows.

Nulls: a null value is ``-`` in a leaf; a null group comes before all others, a null id
before all other ids. Repeated rows are leaves of their own with equal digests; which of
their places each takes is open. An empty text is a value of no bytes, long texts are
hashed whole. An empty table has no root and no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.operators.ordering import numbered
from tasklattice.session import materialise, release

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"
SLOTS = [f"slot_{k}" for k in range(FANOUT)]


class Manifest(NamedTuple):
    """The runs of every level, lowest first: (tree, run, nodes, digest, slot_0 ... slot_15).

    ``groups`` are the levels of the trees of the groups, ``top`` those of the one tree
    over their roots; ``names`` tells (grp, tree, size). A slot of ``groups[0]`` is a
    struct with the leaf's row, any other slot a digest.
    """

    groups: list[DataFrame]
    top: list[DataFrame]
    names: DataFrame

    def release(self) -> None:
        release(*self.groups, *self.top, self.names)


def field(value: Column) -> Column:
    """One value of a leaf: its length in bytes and itself, or a sign for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = COLUMNS, **more: Column) -> DataFrame:
    """(grp, row): a struct of every row's id, its leaf digest and the expressions ``more``."""
    row = F.struct(docs[id_col].alias("id"), leaf_digest([docs[c] for c in columns]).alias("leaf"), *(v.alias(k) for k, v in more.items()))
    return docs.select(docs[group_col].alias("grp"), row.alias("row"))


def _digest(slot: Column, lowest: bool) -> Column:
    return slot["leaf"] if lowest else slot


def _pivot(nodes: DataFrame, lowest: bool = False) -> DataFrame:
    """Runs of the nodes (tree, pos, nodes, node); a tree that is down to one node hands it on."""
    run, slot = F.floor(F.col("pos") / FANOUT).alias("run"), F.col("pos") % FANOUT
    spread = [F.max(F.when(slot == k, F.col("node"))).alias(name) for k, name in enumerate(SLOTS)]
    runs = nodes.groupBy("tree", run).agg(F.max("nodes").alias("nodes"), *spread)
    digests = [_digest(F.col(name), lowest) for name in SLOTS]
    parent = F.when(F.col("nodes") == 1, digests[0]).otherwise(F.sha2(F.concat_ws("", *digests), 256))
    return materialise(runs.withColumn("digest", parent))


def _levels(nodes: DataFrame, most: int, lowest: bool) -> list[DataFrame]:
    """All levels over trees of at most ``most`` nodes, one at least."""
    levels = [_pivot(nodes, lowest)]
    while (most := -(-most // FANOUT)) > 1:
        above = F.ceil(F.col("nodes") / FANOUT).cast("long").alias("nodes")
        levels.append(_pivot(levels[-1].select("tree", F.col("run").alias("pos"), above, F.col("digest").alias("node"))))
    return levels


def manifest(leaf_rows: DataFrame) -> Manifest:
    """The trees over the rows of ``leaves``: groups in order, in each the rows by id.

    Rows are placed by range partitions and carried counts, so neither a large group nor
    a common id is one task's. The driver learns the size of the largest group only.
    """
    # What tells equal rows apart is written with them.
    stored = materialise(leaf_rows.withColumn("salt", F.monotonically_increasing_id()))
    placed = numbered(stored, [F.asc("grp"), F.asc("row.id"), F.asc("row.leaf"), F.asc("salt")], "place")
    sizes = materialise(placed.groupBy("grp").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size")))
    names = materialise(numbered(sizes, [F.asc("grp")], "tree"))
    count, most = names.agg(F.count(F.lit(1)), F.max("size")).first()
    named = names.select(F.col("grp").alias("own"), "tree", "start", F.col("size").alias("nodes"))
    nodes = placed.join(named, F.col("grp").eqNullSafe(F.col("own"))).select(
        "tree", (F.col("place") - F.col("start")).alias("pos"), "nodes", F.col("row").alias("node")
    )
    groups = _levels(nodes, most or 0, True)
    release(stored, sizes)
    roots = groups[-1].select(F.lit(0).alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(count).alias("nodes"), F.col("digest").alias("node"))
    return Manifest(groups, _levels(roots, count, False), names)


def _descend(levels: list[DataFrame], paths: DataFrame, lowest: bool) -> DataFrame:
    """From paths of the trees' roots (tree, pos, path, ...) to (tree, pos, node, path, ...) of their lowest nodes."""
    keep = [c for c in paths.columns if c not in ("tree", "pos", "path")]
    for level in range(len(levels) - 1, -1, -1):
        leafy = lowest and level == 0
        digests = [_digest(F.col(name), leafy) for name in SLOTS]
        children = F.array(
            *(
                F.struct(
                    F.lit(k).alias("slot"),
                    F.col(name).alias("node"),
                    F.struct(F.concat_ws("", *digests[:k]).alias("left"), F.concat_ws("", *digests[k + 1 :]).alias("right")).alias("step"),
                )
                for k, name in enumerate(SLOTS)
            )
        )
        above = paths.select("tree", F.col("pos").alias("run"), "path", *keep)
        found = levels[level].join(above, ["tree", "run"]).select("tree", "run", "nodes", "path", *keep, F.explode(children).alias("child"))
        path = F.when(F.col("nodes") == 1, F.col("path")).otherwise(F.concat(F.array("child.step"), "path"))
        paths = found.where("child.node IS NOT NULL").select(
            "tree", (F.col("run") * FANOUT + F.col("child.slot")).alias("pos"), F.col("child.node").alias("node"), path.alias("path"), *keep
        )
        if level:
            paths = paths.drop("node")
    return paths


def proofs(made: Manifest) -> DataFrame:
    """(id, leaf, ..., subroot, root, path): for every row the siblings to both sides of it, level by level."""
    root = made.top[-1].select("tree", F.col("run").alias("pos"), F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = _descend(made.top, root, False)
    starts = tops.select((F.col("pos") + 1).alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "root", F.col("node").alias("subroot"))
    return _descend(made.groups, materialise(starts), True).select("node.*", "subroot", "root", "path")


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the proof holds after a fifth of the texts were tampered with.

    A row without an id is not tampered with.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = [F.translate(docs[c], UPPER, LOWER) if c == "text" else docs[c] for c in COLUMNS]
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, leaf_digest(changed))
    proved = proofs(manifest(leaves(docs, tampered=tampered)))
    return proved.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# Levels that the SQL unrolls: groups of up to 16^6 rows, up to 16^4 groups.
_GROUP_LEVELS, _TOP_LEVELS = 6, 4


def _sql() -> str:
    def part(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE concat(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR), ':', CAST({column} AS VARCHAR)) END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(part(text if c == "text" else c) for c in COLUMNS) + "))"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bit = "list_reduce(list_prepend({0}, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    step = "xor(a >> 8, " + bit.format("xor(a, b) & 255") + ")"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {step}), 4294967295)"
    texts = [
        f"leafs AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,"
        " dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS size FROM leafs)",
        "g0 AS (SELECT tree, pos, size AS n, leaf AS d FROM placed)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            texts.append(f"{name}r{k} AS (SELECT tree, pos // 16 AS run, n, list(d ORDER BY pos) AS ds FROM {name}{k} GROUP BY tree, pos // 16, n)")
            texts.append(
                f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}r{k})"
            )

    levels("g", _GROUP_LEVELS)
    texts.append(f"t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, d FROM g{_GROUP_LEVELS})")
    levels("t", _TOP_LEVELS)
    texts.append(f"w0 AS (SELECT p.doc_id, p.leaf, p.tree, p.pos, p.changed AS folded, '' AS said, g.d AS subroot, t.d AS root FROM placed p JOIN g{_GROUP_LEVELS} g USING (tree), t{_TOP_LEVELS} t)")
    runs = [(f"gr{k}", "w.tree", f"w.pos // {16 ** (k + 1)}", f"(w.pos // {16**k}) % 16") for k in range(_GROUP_LEVELS)]
    runs += [(f"tr{k}", "0", f"w.tree // {16 ** (k + 1)}", f"(w.tree // {16**k}) % 16") for k in range(_TOP_LEVELS)]
    for k, (run, tree, place, slot) in enumerate(runs):
        left, right = f"array_to_string(r.ds[1:{slot}], '')", f"array_to_string(r.ds[{slot} + 2:], '')"
        texts.append(
            f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN r.n = 1 THEN w.folded ELSE sha256(concat({left}, w.folded, {right})) END AS folded,"
            f" CASE WHEN r.n = 1 THEN w.said ELSE concat(w.said, {left}, {right}) END AS said) FROM w{k} w JOIN {run} r ON r.tree = {tree} AND r.run = {place})"
        )
    return "WITH " + ",\n".join(texts) + (
        f"\nSELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM w{len(runs)}"
    )


OP12_SQL = _sql()
