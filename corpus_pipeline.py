"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.llm.chunk_dedup import substring_dedup
from tribunal.llm.common import table, written
from tribunal.llm.line_quality import keep_good
from tribunal.llm.mixing import in_order, mix
from tribunal.llm.near_dup import Banding, keep_one_of_each
from tribunal.llm.packing import pack, row_bytes
from tribunal.llm.queries import MIXTURE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bad lines go, then documents that fail or lost too much; ``n_chars`` follows the text."""
    return keep_good(docs, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return keep_one_of_each(docs, banding=Banding(words=5, percent=80))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; no document goes."""
    cleaned = substring_dedup(docs)
    return cleaned.withColumn("n_chars", F.when(
        F.col("llm_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")
    ).drop("llm_spans", "llm_removed_words")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: every file is a slice of it, every prefix has its weights."""
    n_files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return in_order(mix(docs, MIXTURE), n_files).drop("llm_block", "llm_slot", "llm_position")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 1,024 ids; one row per piece, ids as 32-bit integers.

    Sequences are slices of the mixture's order, which is found again from the
    rows: neither Parquet nor the columns of documents carry it.
    """
    sized = docs.select("doc_id", "text", "source", row_bytes("text").alias("llm_bytes"))
    return pack(mix(sized, MIXTURE), public_tokenizers.path("byte_bpe_50k.json"), order="llm_position", size="llm_bytes")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("substring deduplication", substrings),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL cannot express content-defined chunks and tokenizers; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
