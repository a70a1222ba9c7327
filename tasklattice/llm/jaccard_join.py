"""N-gram Jaccard join: documents whose sets of word runs overlap by a share or more.

Documents with equal sets are one set from the start. Sets that link share a run
among their first ones in a common order, rare runs first (prefix filter). The sets
that share such a run form a tile; tiles with equal members are one. Within a tile the
sets are banded by size, and bitmaps of run parities bound the overlap from above:
runs only one side has are at least as many as the bits that differ. The pairs that
are left are checked exactly on sorted arrays.

Stars first: every set is checked with the set it shares most tiles with, and what
links is one component. Then rounds over neighbours in the tiles join what they can,
and at last every tile gives all its pairs of sets of different components; a large
tile is cut into blocks, and a task holds two blocks at a time. So a large
group of near copies costs its size, not its square, and no link that joins two
components is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import SHINGLE_WORDS, components, free_name, row_key, shingle_sets, steps, text_column
from tasklattice.session import materialise, release

PERCENT = 80
# A run met so often within one task, and so often in all, is put last in the order.
# Any order gives the same links: these only keep tiles small.
OFTEN_IN_TASK, OFTEN, MOST_COMMON = 4, 32, 1 << 17
# Partners of one star centre that one task checks.
STAR = 2000
# Rounds before the last: how many neighbours in a tile a set is held against, and how
# many of them, by tiles shared, are checked.
WINDOWS, PARTNERS = (1, 8), 4
# Bits of the filter that tells which sets will be checked; false hits only cost time.
FILTER_BITS = 1 << 22
# Rows of a run, and sets of a tile, from which they are dealt to several tasks; the buckets that look for such runs.
HOT_RUN, BLOCK_SETS, RUN_BUCKETS = 1 << 14, 1 << 10, 1 << 16


def _set_id(runs: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(runs.tobytes()) - (1 << 63)


def parity_bits(runs: np.ndarray) -> bytes:
    """A bitmap of a power of two of about as many bits as runs: the parity of the runs on each bit."""
    size = 64
    while size < len(runs) and size < 1 << 16:
        size *= 2
    counts = np.bincount((runs & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap for fewer bits: the parts of it, xor-ed."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


_SUMMARY = "doc_id {}, sid long, n int, bits binary, runs array<long>, often array<int>"


def _summaries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        low: list[np.ndarray] = []
        last = None
        for batch in steps(batches):
            sids, sizes, maps = [], [], []
            for runs in shingle_sets(batch.column("text").to_pylist(), width):
                sid = _set_id(runs) if len(runs) else None
                sids.append(sid)
                sizes.append(len(runs))
                new = sid is not None and sid not in seen
                maps.append(parity_bits(runs) if new else None)
                if new:
                    seen.add(sid)
                    # Only about the smallest fifth can come into a prefix; twice that is counted.
                    low.append(runs[: 1 + 2 * len(runs) // 5])
            empty = [None] * len(sids)
            if last is not None:
                yield last
            last = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary()),
                 pa.array(empty, pa.list_(pa.int64())), pa.array(empty, pa.list_(pa.int32()))],
                names=["doc_id", "sid", "n", "bits", "runs", "often"],
            )
        if last is not None:
            runs, counts = np.unique(np.concatenate(low) if low else np.zeros(0, np.uint64), return_counts=True)
            many = counts >= OFTEN_IN_TASK
            rest = [None] * (last.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [*last.columns[:4], pa.array([runs[many].view(np.int64).tolist(), *rest], pa.list_(pa.int64())),
                 pa.array([counts[many].tolist(), *rest], pa.list_(pa.int32()))],
                names=last.schema.names,
            )

    return run


def _prefixes(common: np.ndarray, percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in steps(batches):
            heads, sids, sizes = [], [], []
            for runs in shingle_sets(batch.column("text").to_pylist(), width):
                if not len(runs):
                    continue
                sid = _set_id(runs)
                if sid in seen:
                    continue
                seen.add(sid)
                size = len(runs)
                length = size - (percent * size + 99) // 100 + 1
                if len(common):
                    place = np.searchsorted(common, runs)
                    place[place == len(common)] = 0
                    last = common[place] == runs
                    runs = np.concatenate([runs[~last], runs[last]])
                heads.append(runs[:length])
                sids.append(sid)
                sizes.append(size)
            if heads:
                lengths = [len(h) for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), lengths)),
                     pa.array(np.repeat(np.array(sizes, np.int32), lengths))],
                    names=["run", "sid", "n"],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str, limit: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """The columns, cut so that rows of equal ``key``, which stand together, are not cut apart before they are ``limit``."""
    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = cols[key]
        cut = int(np.argmax(keys == keys[-1]))
        if cut or (held and held[-1][key][-1] != keys[0]):
            first = {n: a[:cut] for n, a in cols.items()}
            yield {n: np.concatenate([*(h[n] for h in held), first[n]]) for n in cols}
            held = []
        held.append({n: a[cut:] for n, a in cols.items()})
        if limit and sum(len(h[key]) for h in held) >= limit:
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held = []
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _centres(members: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The first of each size band, for members sorted by size."""
    centre = np.empty(len(members), np.int64)
    at = 0
    while at < len(members):
        to = int(np.searchsorted(n, int(n[at]) * 100 // percent, side="right"))
        centre[at:to] = members[at]
        at = to
    return centre


def _tiles(percent: int):
    """Rows sorted by (run, n, sid) to tiles of two sets or more, with the smallest of each size band as centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for cols in _groups(batches, "run"):
            runs, sids, sizes = cols["run"], cols["sid"], cols["n"]
            if not len(runs):
                continue
            new = np.ones(len(runs), bool)
            new[1:] = (runs[1:] != runs[:-1]) | (sids[1:] != sids[:-1])
            runs, sids, sizes = runs[new], sids[new], sizes[new]
            starts = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1) != 0)
            lengths = np.diff(np.append(starts, len(runs)))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for start, length in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist()):
                members, n = sids[start : start + length], sizes[start : start + length]
                tile = xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)
                if tile in seen:
                    continue
                seen.add(tile)
                centre = _centres(members, n, percent)
                for part, values in zip(out, (np.full(length, tile), members, n, centre)):
                    part.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], names=["tile", "sid", "n", "centre"])

    return run


def _hot_centres(percent: int):
    """Rows (tile, n, sid) of the smallest set of each size, sorted, to the centre of each size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, "tile"):
            if not len(cols["tile"]):
                continue
            starts = np.flatnonzero(np.diff(cols["tile"], prepend=cols["tile"][0] - 1) != 0)
            centres = [_centres(m, n, percent) for m, n in zip(np.split(cols["sid"], starts[1:]), np.split(cols["n"], starts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(cols["tile"]), pa.array(cols["n"]), pa.array(np.concatenate(centres))], names=["tile", "n", "centre"])

    return run


def _all_tiles(heads: DataFrame, percent: int, hot_run: int) -> DataFrame:
    """(tile, sid, n, centre) of the written heads; the rows of a run of ``hot_run`` or more never meet in one task."""
    bucket = F.col("run").bitwiseAND(RUN_BUCKETS - 1)
    full = materialise(heads.groupBy(bucket.alias("bucket")).count().where(F.col("count") >= hot_run).select("bucket"))
    schema = "tile long, sid long, n int, centre long"
    hot = None
    if full.head(1):
        hot = materialise(heads.join(F.broadcast(full), bucket == F.col("bucket"), "left_semi").groupBy("run").count().where(F.col("count") >= hot_run).select("run"))
        hot = hot if hot.head(1) else None
    cold = heads.join(hot, "run", "left_anti") if hot else heads
    cold = cold.repartition("run").sortWithinPartitions("run", "n", "sid").mapInArrow(_tiles(percent), schema)
    if not hot:
        return materialise(cold.dropDuplicates(["tile", "sid"]))
    # Runs with equal members are one tile: told by sums over the members, combined before the shuffle.
    members = materialise(heads.join(hot, "run", "left_semi").dropDuplicates(["run", "sid"]))
    code = F.xxhash64("sid")
    tile = F.xxhash64(F.count("*"), F.bit_xor(code), F.bit_xor(F.xxhash64(code, F.lit(1))))
    kept = members.groupBy("run").agg(tile.alias("tile"), F.count("*").alias("size")).where("size > 1").groupBy("tile").agg(F.min("run").alias("run"))
    named = materialise(members.join(materialise(kept), "run").select("tile", "sid", "n"))
    least = named.groupBy("tile", "n").agg(F.min("sid").alias("sid")).select("tile", "n", "sid")
    centres = least.repartition("tile").sortWithinPartitions("tile", "n").mapInArrow(_hot_centres(percent), "tile long, n int, centre long")
    dealt = named.join(materialise(centres), ["tile", "n"]).select("tile", "sid", "n", "centre")
    tiles = materialise(cold.union(dealt).dropDuplicates(["tile", "sid"]))
    release(members, named)
    return tiles


def _cut_blocks(limit: int):
    """Rows sorted by (tile, label, n) with the number of their block: at most ``limit`` rows of one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, filled, block = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for now in batch.column("tile").to_pylist():
                if now != tile or filled == limit:
                    tile, filled, block = now, 0, block + 1
                filled += 1
                out.append(block)
            numbers = (batch.column("part")[0].as_py() << 32) + np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tile", "sid", "n", "bits", "label")), pa.array(numbers)], names=["tile", "sid", "n", "bits", "label", "block"])

    return run


def _block_pairs(percent: int):
    """Rows sorted by (key, first, second, side, n), one block against one: the pairs that ``_tile_pairs`` would find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, "key"):
            if not len(cols["key"]):
                continue
            new = (np.diff(cols["first"], prepend=cols["first"][0] - 1) != 0) | (np.diff(cols["second"], prepend=cols["second"][0]) != 0)
            starts = np.flatnonzero(new)
            for start, end in zip(starts.tolist(), np.append(starts[1:], len(new)).tolist()):
                alone = cols["first"][start] == cols["second"][start]
                middle = start if alone else start + int(np.searchsorted(cols["side"][start:end], 1))
                n, labels, sids = (cols[c][middle:end] for c in ("n", "label", "sid"))
                words = [np.frombuffer(b, np.uint64) for b in cols["bits"][middle:end]]
                lengths = np.array([len(w) for w in words])
                stacks: dict[int, np.ndarray] = {}
                for k in range(start, end if alone else middle):
                    size = int(cols["n"][k])
                    low = k - start + 1 if alone else int(np.searchsorted(n, -(-size * percent // 100), side="left"))
                    others = np.arange(low, int(np.searchsorted(n, size * 100 // percent, side="right")))
                    others = others[labels[others] != cols["label"][k]]
                    if not len(others):
                        continue
                    mine = np.frombuffer(cols["bits"][k], np.uint64)
                    width = int(min(len(mine), lengths[others].min()))
                    if width not in stacks:
                        stacks[width] = np.stack([_fold(w, width) if len(w) >= width else np.zeros(width, np.uint64) for w in words])
                    differ = np.bitwise_count(stacks[width][others] ^ _fold(mine, width)).sum(axis=1).astype(np.int64)
                    total = n[others].astype(np.int64) + size
                    found = sids[others[(100 + percent) * ((total - differ) // 2) >= percent * total]]
                    if len(found):
                        me = np.full(len(found), cols["sid"][k])
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(me, found)), pa.array(np.maximum(me, found)), pa.array(np.ones(len(found), np.int64))], names=["a", "b", "shared"])

    return run


def _blocked(marked: DataFrame, percent: int, limit: int) -> DataFrame:
    """All pairs of different components of tiles of any size: blocks of ``limit`` sets, block against block."""
    order = ["tile", "label", "n", "sid"]
    placed = materialise(marked).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blocks = materialise(placed.mapInArrow(_cut_blocks(limit), "tile long, sid long, n int, bits binary, label long, block long"))
    edges = blocks.groupBy("tile", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("least"), F.max("label").alias("most"))
    edges = materialise(edges)
    first, second = edges.alias("f"), edges.alias("s")
    # Two blocks of the same component have nothing to check; nor have those of sizes too far apart.
    meet = first.join(second, F.expr("f.tile = s.tile and f.block <= s.block")).where(
        f"(f.least <> s.least or f.most <> s.most or f.least <> f.most) and f.high * 100L >= s.low * {percent}L and s.high * 100L >= f.low * {percent}L"
    )
    meet = materialise(meet.select(F.col("f.block").alias("first"), F.col("s.block").alias("second")))
    sides = meet.select(F.col("first").alias("block"), "first", "second", F.lit(0).alias("side")).union(
        meet.where("first <> second").select(F.col("second").alias("block"), "first", "second", F.lit(1).alias("side"))
    )
    rows = blocks.join(materialise(sides), "block").select(F.xxhash64("first", "second").alias("key"), "first", "second", "side", "sid", "n", "bits", "label")
    rows = rows.repartition("first", "second").sortWithinPartitions("key", "first", "second", "side", "n")
    return rows.mapInArrow(_block_pairs(percent), "a long, b long, shared long")


def _tile_pairs(percent: int, window: int | None = None, limit: int | None = None):
    """Rows sorted by (tile, n) to the pairs of different components whose bound allows a link.

    With a ``window`` a set is paired with so many that follow it in the tile only, or in
    its stretch of ``limit`` rows. ``shared`` counts the tiles that hold the pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches, "tile", limit):
            tiles, sids, sizes, labels = cols["tile"], cols["sid"], cols["n"], cols["label"]
            if not len(tiles):
                continue
            starts = np.flatnonzero(np.diff(tiles, prepend=tiles[0] - 1) != 0)
            found: Counter[tuple[int, int]] = Counter()
            for start, end in zip(starts.tolist(), np.append(starts[1:], len(tiles)).tolist()):
                if (labels[start:end] == labels[start]).all():
                    continue
                n, mine = sizes[start:end], labels[start:end]
                # Bitmaps of a tile side by side, folded to the shortest of the two bands that meet.
                words = [np.frombuffer(b, np.uint64) for b in cols["bits"][start:end]]
                lengths = np.array([len(w) for w in words])
                stacks: dict[int, np.ndarray] = {}
                for k in range(end - start - 1):
                    to = int(np.searchsorted(n, int(n[k]) * 100 // percent, side="right"))
                    to = to if window is None else min(to, k + 1 + window)
                    others = np.arange(k + 1, to)
                    others = others[mine[k + 1 : to] != mine[k]]
                    if not len(others):
                        continue
                    width = int(min(lengths[k], lengths[others].min()))
                    if width not in stacks:
                        stacks[width] = np.stack([_fold(w, width) if len(w) >= width else np.zeros(width, np.uint64) for w in words])
                    stack = stacks[width]
                    differ = np.bitwise_count(stack[others] ^ stack[k]).sum(axis=1).astype(np.int64)
                    total = n[others].astype(np.int64) + int(n[k])
                    passed = (100 + percent) * ((total - differ) // 2) >= percent * total
                    a = int(sids[start + k])
                    found.update((a, b) for b in sids[start + others[passed]].tolist())
            if found:
                pairs = np.array(list(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(list(found.values()), pa.int64())], names=["a", "b", "shared"])

    return run


def _may_link(percent: int):
    """The pairs whose bitmaps' bound allows a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, bits_a, bits_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                a, b = np.frombuffer(bits_a, np.uint64), np.frombuffer(bits_b, np.uint64)
                width = min(len(a), len(b))
                differ = int(np.bitwise_count(_fold(a, width) ^ _fold(b, width)).sum())
                keep.append((100 + percent) * ((n_a + n_b - differ) // 2) >= percent * (n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    sides = [maps.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_may_link(percent), "a long, b long")


def _sets(width: int, wanted: np.ndarray):
    """The sorted runs of the sets that the filter lets pass, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in steps(batches):
            sids, sets = [], []
            for runs in shingle_sets(batch.column("text").to_pylist(), width):
                sid = _set_id(runs) if len(runs) else None
                if sid is None or sid in seen:
                    continue
                place = sid % FILTER_BITS
                if wanted[place >> 6] >> np.uint64(place & 63) & np.uint64(1):
                    seen.add(sid)
                    sids.append(sid)
                    sets.append(runs.tobytes())
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "runs"])

    return run


def _check(percent: int):
    """Rows of one (star, salt) with its centre first: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_runs = None, None
        for batch in batches:
            left, right = [], []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "runs"))):
                runs = np.frombuffer(data, np.uint64)
                if b is None:
                    centre, centre_runs = a, runs
                elif a == centre:
                    common = len(np.intersect1d(centre_runs, runs, assume_unique=True))
                    if 100 * common >= percent * (len(centre_runs) + len(runs) - common):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose sets really link; ``pairs`` is a written table of (a, b)."""
    bit = F.pmod("sid", F.lit(FILTER_BITS))
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))
    words = ends.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(sid, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    wanted = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.collect():  # at most FILTER_BITS / 64 rows
        wanted[row.word] = np.uint64(row.bits & (2**64 - 1))
    sets = materialise(rows.select("text").mapInArrow(_sets(width, wanted), "sid long, runs binary"))
    # Copies in several tasks give equal rows.
    salts = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    partners = materialise(salted).join(sets.withColumnRenamed("sid", "b"), "b").select("a", "salt", "b", "runs")
    centres = salts.join(sets.withColumnRenamed("sid", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "runs"
    )
    stars = partners.union(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    links = materialise(stars.select("a", "b", "runs").mapInArrow(_check(percent), "a long, b long").distinct())
    release(sets)
    return links


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with sid and n_shingles, components of the set ids that link with another).

    A document without a word has no sid and links with nothing.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), text_column(docs, text_col).alias("text"))
    summary = materialise(rows.mapInArrow(_summaries(width), _SUMMARY.format(kind)))
    often = summary.where("runs is not null").select(F.explode(F.arrays_zip("runs", "often")).alias("x"))
    often = often.groupBy(F.col("x.runs").alias("run")).agg(F.sum("x.often").alias("n")).where(F.col("n") >= OFTEN)
    common = np.sort(np.array([r.run for r in often.orderBy(F.desc("n"), "run").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))
    heads = rows.select("text").mapInArrow(_prefixes(common, percent, width), "run long, sid long, n int")
    heads = materialise(heads)
    tiles = _all_tiles(heads, percent, HOT_RUN)
    release(heads)
    best = tiles.where("sid <> centre").groupBy("sid", "centre").count().groupBy("sid").agg(F.max_by("centre", F.struct("count", "centre")).alias("a"))
    maps = materialise(summary.where("bits is not null").groupBy("sid").agg(F.first("bits").alias("bits"), F.first("n").alias("n")))
    stars = _verify(materialise(_bounded(best.select("a", F.col("sid").alias("b")), maps, percent)), rows, percent, width)
    links = stars
    # Rounds over a window of neighbours join most of a large group; the last round leaves out no pair.
    for window in (*WINDOWS, None):
        labels = components(links).withColumnRenamed("node", "sid")
        label = F.coalesce("component", "sid")
        # A tile of one component has nothing left to check, and its bitmaps need not travel.
        several = tiles.join(labels, "sid", "left").groupBy("tile").agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("size")).where("low <> high")
        several = materialise(several.select("tile", (F.col("size") > BLOCK_SETS).alias("large")))
        open_tiles = tiles.join(several, "tile")
        marked = open_tiles.join(maps.select("sid", "bits"), "sid").join(labels, "sid", "left").select("tile", "sid", "n", "bits", label.alias("label"), "large")
        placed = marked.where("not large").drop("large").repartition("tile").sortWithinPartitions("tile", "n", "sid")
        found = placed.mapInArrow(_tile_pairs(percent, window), "a long, b long, shared long")
        if several.where("large").head(1):
            large = marked.where("large").drop("large")
            if window is None:
                found = found.union(_blocked(large, percent, BLOCK_SETS))
            else:
                large = materialise(large).repartitionByRange("tile", "n", "sid").sortWithinPartitions("tile", "n", "sid")
                found = found.union(large.mapInArrow(_tile_pairs(percent, window, BLOCK_SETS), "a long, b long, shared long"))
        found = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        if window is not None:
            closest = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
            found = found.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= PARTNERS)
        further = materialise(found.select("a", "b"))
        if further.head(1):
            links = links.union(_verify(further, rows, percent, width))
    release(tiles, maps)
    return summary.select("doc_id", "sid", "n"), components(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    component_id is the smallest id reachable over links of ``percent`` or more. Rows of a
    null id keep it null and count for their group only if it has no other id. An empty
    table gives an empty result. Set ids are 64-bit hashes of the sorted runs.
    """
    summary, groups = linked_sets(docs, id_col, text_col, percent, width)
    labelled = materialise(
        summary.join(groups.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "sid", "n", F.coalesce("component", "sid").alias("label"))
    )
    least = materialise(labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")))
    return labelled.join(least, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The documents with one of each near-duplicate group, the smallest id; all columns stay.

    Of repeated rows of equal id and text one stays. Documents without a word all stay. Other
    columns may have any names.
    """
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_key(docs, id_col, text_col))
    ids = keyed.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("doc_id"), F.col(text_col).alias("text"))
    judged = materialise(near_duplicates(ids, "doc_id", "text", percent, width))
    # The rows that go are fewer than those that stay; Spark broadcasts them if their table is small.
    losers = materialise(judged.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row)).distinct())
    left = keyed.join(losers, row, "left_anti")
    if judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words")).where("n > 1 and words > 0").head(1):
        empty = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
        left = left.where(empty).union(left.where(~empty).dropDuplicates([row]))
    return left.select(*docs.columns)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.seen) AS component_id
FROM documents d JOIN reach r ON d.doc_id = r.node LEFT JOIN sizes s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
