"""Line dedup: hashed lines in range partitions, streamed in order, to keep bitmaps per document.

The lines' hashes are range-partitioned by (hash, document) and sorted by document
and position within, so that a common line is spread over as many partitions as its
rows need. One pass over the sorted rows finds the lines to drop; only a hash at the
edge of a partition needs its counts added up with those of the next one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import LOWER, free_name, row_key, steps, text_column
from tasklattice.session import materialise

SPACE = b" \t\n\v\f\r"
MIN_DOCS = 10
MIN_CHARS = 1
# What stands for a null id.
NO_ID = -(1 << 63) + 1
LINE_SCHEMA = "row long, doc long, high long, low long, pos int, n_lines int"
HIT_SCHEMA = "row long, pos int, n_lines int, part int, edge boolean, high long, low long, part_docs long, first boolean"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.translate(LOWER).split(b"\n")]


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows, docs, codes, places, sizes = [], [], [], [], []
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys = line_keys(text)
                for place, key in enumerate(keys):
                    # A key has at most as many code points as bytes.
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        rows.append(row)
                        docs.append(doc)
                        codes.append(xxhash.xxh3_128_digest(key))
                        places.append(place)
                        sizes.append(len(keys))
            pair = np.frombuffer(b"".join(codes), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(pair[::2]), pa.array(pair[1::2]),
                 pa.array(places, pa.int32()), pa.array(sizes, pa.int32())],
                names=["row", "doc", "high", "low", "pos", "n_lines"],
            )

    return run


def _stream(min_docs: int):
    """Over rows sorted by (high, low, doc, row, pos): the lines of keys in ``min_docs`` documents.

    The rows of the first and the last key of the partition are passed on as edge
    rows, as the key may go on in the neighbour. A hash's rows within one partition
    are held at a time, which the range partitioning bounds.
    """
    names = ["row", "doc", "high", "low", "pos", "n_lines"]

    def out(cols: dict, part: int, edge: np.ndarray, docs: np.ndarray, first: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        size = int(keep.sum())
        arrays = [cols["row"][keep], cols["pos"][keep], cols["n_lines"][keep], np.full(size, part, np.int32), edge[keep],
                  cols["high"][keep], cols["low"][keep], docs[keep], first[keep]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[f.split()[0] for f in HIT_SCHEMA.split(", ")])

    def judge(cols: dict, part: int, at_start: bool, at_end: bool) -> pa.RecordBatch:
        high, low, doc = cols["high"], cols["low"], cols["doc"]
        new_key = np.ones(len(high), bool)
        new_key[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        new_doc = new_key.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        starts = np.flatnonzero(new_key)
        lengths = np.diff(np.append(starts, len(high)))
        docs = np.repeat(np.add.reduceat(new_doc.astype(np.int64), starts), lengths)
        edge = np.zeros(len(high), bool)
        if at_start:
            edge[: lengths[0]] = True
        if at_end:
            edge[starts[-1] :] = True
        return out(cols, part, edge, docs, new_key, (docs >= min_docs) | edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at_start, part, last = True, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            key = (int(cols["high"][-1]), int(cols["low"][-1]))
            open_from = int(np.argmax((cols["high"] == key[0]) & (cols["low"] == key[1])))
            if key == last and open_from == 0:
                held.append(cols)
                continue
            done = [*held, {n: a[:open_from] for n, a in cols.items()}]
            held, last = [{n: a[open_from:] for n, a in cols.items()}], key
            whole = {n: np.concatenate([d[n] for d in done]) for n in names}
            if len(whole["row"]):
                yield judge(whole, part, at_start, False)
                at_start = False
        if held:
            yield judge({n: np.concatenate([d[n] for d in held]) for n in names}, part, at_start, True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for size, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()):
            keep = np.ones(size, np.uint8)
            keep[places] = 0
            dropped.append(len(places))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n_lines"), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["row", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep: str = "none",
) -> DataFrame:
    """Which lines to keep: (row, n_lines, n_dropped, keep_bitmap), documents that lose a line only.

    ``row`` is ``row_key``. The bitmap is zlib-compressed, one bit per line, first line
    in the highest bit of the first byte. Keys (white space stripped, A-Z folded) of
    ``min_chars`` code points or more that ``min_docs`` documents hold lose all their
    lines (``keep="none"``) or all but the first by document and position (``"first"``).
    Documents are told apart by id; rows of a null id are one document. A null or
    empty text is one empty line. An empty table gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    # No null gets to numpy: it would make the ids floating-point numbers, which are neither exact nor equal to themselves.
    known = docs[id_col].cast("long") if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(docs[id_col])
    rows = docs.select(
        row_key(docs, id_col, text_col).alias("row"),
        F.coalesce(known, F.lit(NO_ID)).alias("doc"),
        text_column(docs, text_col).alias("text"),
    )
    lines = materialise(rows.mapInArrow(_hash_lines(min_chars), LINE_SCHEMA))
    order = ["high", "low", "doc"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "pos")
    placed = placed.withColumn("part", F.spark_partition_id())
    hits = materialise(placed.mapInArrow(_stream(min_docs), HIT_SCHEMA))
    # At most two keys per partition are at an edge, so their totals may be sent to all tasks.
    edges = hits.where("edge").groupBy("high", "low", "part").agg(F.max("part_docs").alias("n"))
    totals = edges.groupBy("high", "low").agg(F.sum("n").alias("total"), F.min("part").alias("first_part"))
    judged = hits.join(F.broadcast(totals), ["high", "low"], "left").where(F.coalesce("total", "part_docs") >= min_docs)
    if keep == "first":
        judged = judged.where(~(F.col("first") & (F.col("part") == F.coalesce("first_part", "part"))))
    grouped = judged.groupBy("row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("places"))
    return grouped.mapInArrow(_bitmaps, "row long, n_lines int, n_dropped int, keep_bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before dropping, lines dropped, and the text that stays."""
    if bitmap is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    left = [line for line, bit in zip(lines, bits.tolist()) if bit]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """The documents with the lines that the bitmaps drop left out; all other columns stay, whatever their names.

    A document that loses all its lines has an empty text, a null text stays null. With
    ``drop_emptied`` a document that had a word and is left without one goes. Repeated rows are
    treated alike; an empty table stays empty.
    """
    names = docs.columns
    place = names.index(text_col)
    row, bitmap = free_name(docs, "row"), free_name(docs, "bitmap")
    marked = docs.withColumn(row, row_key(docs, id_col, text_col)).join(
        bitmaps.select(F.col("row").alias(row), F.col("keep_bitmap").alias(bitmap)).hint("merge"), row, "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.select(names)
            texts = batch.column(text_col).to_pylist()
            new = [
                t if t is None or m is None else kept_lines(t.encode(), m)[2].decode()
                for t, m in zip(texts, batch.column(bitmap).to_pylist())
            ]
            arrays = [pa.array(new, pa.string()) if k == place else table.column(k) for k in range(len(names))]
            out = pa.RecordBatch.from_arrays(arrays, names=names)
            if drop_emptied:
                blank = lambda text: text is None or not text.encode().strip(SPACE)
                out = out.filter(pa.array([not blank(n) or blank(t) for t, n in zip(texts, new)], pa.bool_()))
            yield out

    return marked.mapInArrow(run, docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        found = [kept_lines(t, m) for t, m in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bitmaps = materialise(keep_bitmaps(docs))
    rows = docs.select("doc_id", row_key(docs).alias("row"), text_column(docs).alias("text"))
    # One plan for every size: the bitmaps grow with the corpus and are never broadcast.
    joined = rows.join(bitmaps.hint("merge"), "row", "left").select("doc_id", "text", "keep_bitmap")
    return joined.mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
"""
