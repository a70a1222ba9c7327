"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage works on all rows that the one before has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklattice.llm.common import crc_rest
from tasklattice.llm.decontaminate import clean_documents
from tasklattice.llm.jaccard_join import keep_one
from tasklattice.llm.language_id import UNKNOWN, learn_profiles, predict
from tasklattice.llm.line_dedup import drop_lines, keep_bitmaps
from tasklattice.llm.packing import cut_pieces, pack
from tasklattice.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    profiles = materialise(learn_profiles(docs.where(crc_rest(docs["doc_id"], 4) != 2)))
    others = [c for c in docs.columns if c != "text"]
    judged = predict(docs, profiles, [F.struct(*(docs[c] for c in others)).alias("_document")], keep_text=True)
    text = F.col("_text").cast(docs.schema["text"].dataType).alias("text")
    known = judged.where(F.col("lang_pred") != UNKNOWN)
    return known.select(*(text if c == "text" else F.col("_document").getField(c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines: of lines that ten or more of them share the first one stays.

    So no line is lost from the corpus. Copies that are left without a word go.
    """
    left = drop_lines(docs, materialise(keep_bitmaps(docs, keep="first")), drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover an item of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their places in the sequences."""
    return pack(materialise(cut_pieces(docs)))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# Neither the learnt profiles nor the tokenizer can be put in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
