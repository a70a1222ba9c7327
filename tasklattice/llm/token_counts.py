"""Token counts of flat token files by a separator scan.

A flat file is token ids one after another, two or four bytes each, every document
ended by a separator id; there is no index. The files are cut into blocks by their lengths,
a task reads the byte ranges of its blocks, each block is searched at once in numpy, and a prefix scan over a file's blocks tells each block
where the document begins that is open at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklattice.llm.common import steps, text_column
from tasklattice.llm.packing import TOKEN_STEP_BYTES, default_tokenizer, encode_all
from tasklattice.session import materialise, scratch_path

# Beyond the vocabulary, so that no text holds it, and within two bytes.
SEPARATOR = 65535
WIDTH = 2
BLOCK_TOKENS = 1 << 20
FILE_DOCUMENTS = 5000
# Bytes that one task scans, where there are more blocks than cores.
TASK_BYTES = 64 << 20
BLOCK_SCHEMA = "path string, block long, first long, n_tokens long, ends array<long>"


def _token_rows(path: str, separator: int, width: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in steps(batches, limit=TOKEN_STEP_BYTES):
            ids, edges = encode_all(batch.column("text"), path)
            if len(ids) and int(ids.max()) >= separator:
                raise ValueError(f"id {ids.max()} is not below the separator {separator}")
            data, edges = ids.astype(kind).tobytes(), (width * edges).tolist()
            rows = [data[a:b] for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    return run


def write_token_files(
    docs: DataFrame, target: str, path: str | None = None, text_col: str = "text", separator: int = SEPARATOR, width: int = WIDTH, file_documents: int = FILE_DOCUMENTS
) -> None:
    """Write the documents' tokens as flat files of at most ``file_documents`` documents each.

    Spark's text writer puts the separator's bytes after each row. A null or empty text is a
    separator alone. All ids must be below the separator, so none is mistaken for it. Repeated rows
    are documents of their own; an empty table gives no documents. Other columns are not read.
    """
    rows = docs.select(text_column(docs, text_col).alias("text")).mapInArrow(_token_rows(path or default_tokenizer(), separator, width), "value binary")
    end = separator.to_bytes(width, "little").decode("latin-1")
    writer = rows.select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", file_documents).text(target)


def document_places(docs: DataFrame, id_col: str = "doc_id", file_documents: int = FILE_DOCUMENTS) -> DataFrame:
    """(file, document, id): where ``write_token_files`` puts each document of the same scan.

    A task writes its rows in order, so a row's place follows from its partition and its position there.
    ``docs`` is a plain scan of files, which Spark cuts alike whenever it reads them, whatever the columns.
    """
    at = F.monotonically_increasing_id()
    placed = docs.select(docs[id_col].alias("id"), at.alias("at"))
    position = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    file = F.format_string("%05d-%03d", F.shiftright("at", 33), F.floor(position / file_documents))
    return placed.select(file.alias("file"), (position % file_documents).alias("document"), "id")


def file_number(path: str = "path") -> Column:
    """The task and file number in Spark's names of files, which also hold a random part."""
    return F.regexp_replace(path, r"^.*/part-(\d+)-.*-c(\d+)\.txt$", "$1-$2")


def _open(path: str):
    """The file system of a path as Spark names it, and the path in it."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _block_row(path: str, block: int, first: int, part: np.ndarray, separator: int) -> pa.RecordBatch:
    ends = np.flatnonzero(part == separator) + first
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
        names=["path", "block", "first", "n_tokens", "ends"],
    )


def _scan_ranges(separator: int, width: int, block_tokens: int):
    """Rows of (path, length, block): each block's bytes alone are read."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None
        try:
            for batch in batches:
                for path, length, block in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block"))):
                    if length % width:
                        raise ValueError(f"{path} is no file of {width}-byte ids")
                    if path != held:
                        if file is not None:
                            file.close()
                        system, inner = _open(path)
                        held, file = path, system.open_input_file(inner)
                    first = block * block_tokens
                    size = min(block_tokens * width, length - first * width)
                    data = file.read_at(size, first * width)
                    if len(data) != size:
                        raise OSError(f"{path} ended before byte {first * width + size}")
                    yield _block_row(path, block, first, np.frombuffer(data, kind), separator)
        finally:
            if file is not None:
                file.close()

    return run


def _scan_whole(separator: int, width: int, block_tokens: int):
    """Rows of (path, content): for stores that only Spark's reader opens."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                if len(data) % width:
                    raise ValueError(f"{path} is no file of {width}-byte ids")
                tokens = np.frombuffer(data, kind)
                for block, first in enumerate(range(0, len(tokens), block_tokens)):
                    yield _block_row(path, block, first, tokens[first : first + block_tokens], separator)

    return run


def _blocks(spark: SparkSession, folder: str, separator: int, width: int, block_tokens: int) -> DataFrame:
    """One row per block of the files; a task reads the byte ranges of its blocks only."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    # Without the content Spark only lists the files, of whatever size.
    sizes = materialise(files.select("path", "length"))
    some = sizes.head(1)
    try:
        if some:
            system, inner = _open(some[0].path)
            system.get_file_info(inner)
    except (OSError, ValueError, NotImplementedError):
        return files.select("path", "content").mapInArrow(_scan_whole(separator, width, block_tokens), BLOCK_SCHEMA)
    step = block_tokens * width
    total = sizes.agg(F.sum(F.ceil(F.col("length") / step)).alias("blocks"), F.sum("length").alias("bytes")).first()
    ranges = sizes.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    tasks = min(total.blocks or 1, max(spark.sparkContext.defaultParallelism, (total.bytes or 0) // TASK_BYTES))
    return ranges.repartition(tasks).sortWithinPartitions("path", "block").mapInArrow(_scan_ranges(separator, width, block_tokens), BLOCK_SCHEMA)


def scan_token_files(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: (path, document, start, n_tokens, closed).

    ``document`` counts from 0 in each file, ``start`` is its first token's place, and
    ``n_tokens`` leaves out the separator. Tokens after a file's last separator are a document
    that is not ``closed``; an empty file has none. Each file is one stream of any size, read by
    blocks through pyarrow's file systems. In a store that pyarrow cannot open, Spark
    hands each file whole to one task and refuses those over 2 GB.
    """
    # The blocks' sums are scanned without the separators, and joined to them again.
    blocks = materialise(_blocks(spark, folder, separator, width, block_tokens))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("block"))) == 1
    # The scan carries the last separator so far and the number of separators so far.
    sums = blocks.select("path", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end"))
    carried = sums.select(
        "path",
        "block",
        F.coalesce(F.last("end", ignorenulls=True).over(before), F.lit(-1)).alias("open"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seen"),
        last.alias("last"),
    )
    carried = blocks.join(carried, ["path", "block"])
    size = F.col("first") + F.col("n_tokens")
    final_end = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("open"))
    stops = F.when(F.col("last") & (final_end + 1 < size), F.concat("ends", F.array(size))).otherwise(F.col("ends"))
    stitched = carried.select("path", "seen", "open", size.alias("size"), stops.alias("stops"))
    documents = stitched.select("path", "seen", "size", F.posexplode(F.arrays_zip(F.concat(F.array("open"), "stops").alias("from"), F.col("stops").alias("to"))).alias("k", "x"))
    documents = documents.where("x.to is not null")
    return documents.select(
        "path",
        (F.col("seen") + F.col("k")).alias("document"),
        (F.col("x.from") + 1).alias("start"),
        (F.col("x.to") - F.col("x.from") - 1).alias("n_tokens"),
        (F.col("x.to") < F.col("size")).alias("closed_here"),
    ).withColumnRenamed("closed_here", "closed")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder)
    found = scan_token_files(spark, folder).withColumn("file", file_number())
    named = found.join(document_places(docs).withColumnRenamed("id", "doc_id"), ["file", "document"])
    return named.select("doc_id", "file", "document", "start", "n_tokens")
