"""The corpus pipeline: documents through five stages, each written before the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept. All but the
last return the columns of the documents; a stage that changes a text also brings ``n_chars`` up to date.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import decontam, linededup, neardup, packing, quality
from parcelwise.llm.common import table
from parcelwise.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    rows = linededup.strip_lines(docs, min_docs=10)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    # A text that lost nothing stays as it was, null included.
    same = F.col("n_dropped") == 0
    columns = [
        F.when(same, F.col(f"doc.`{c}`")).otherwise(new[c]).alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns
    ]
    return rows.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack(docs, added=True)
    return pieces.select(
        F.col("doc").alias("doc_id"),
        "start",
        F.col("size").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_neardup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Near duplicates by signature and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from its Parquet files."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
