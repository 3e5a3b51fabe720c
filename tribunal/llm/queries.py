"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.llm.chunk_dedup import substring_dedup
from tribunal.llm.common import table
from tribunal.llm.lexical import lexical_search
from tribunal.llm.line_quality import quality_columns
from tribunal.llm.line_runs import dedup_lines
from tribunal.llm.mixing import mix
from tribunal.llm.near_dup import near_duplicates
from tribunal.llm.packing import pack
from tribunal.llm.pivots import vector_duplicates
from tribunal.llm.records import read_records, with_starts, write_records
from tribunal.llm.repair import audited
from tribunal.llm.sharding import write_shuffled
from tribunal.llm.url_filter import Rule, judge_urls
from tribunal.llm.warc import chunk_table, read_archives, records, write_archives

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
             Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: Target weights of the sources, in parts; a source that is not named shares one part.
MIXTURE = {"src0": 24} | {f"src{i}": 4 for i in range(1, 20)}


def op1_cost_balanced_packing(spark, folder):
    """Pieces of all documents in sequences of 1,024 byte-level tokens."""
    packed = pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op2_external_shuffle(spark, folder):
    """All documents in 16 shuffled shards, read back from the shard files."""
    shards = write_shuffled(table(spark, folder, "documents"))
    return shards.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("llm_shard").alias("shard"), F.col("llm_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_tensored_near_duplicates(spark, folder):
    """Near-duplicate groups of all documents: three-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, folder, "documents"))


def op4_chunked_warc(spark, folder):
    """All pages written as WARC records and read back in chunks."""
    archives = write_archives(chunk_table(table(spark, folder, "pages")))
    return records(read_archives(spark, archives, payload=False))


def op5_record_files(spark, folder):
    """All documents written as token records and read back."""
    files = write_records(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return with_starts(read_records(spark, files), files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_url_trees(spark, folder):
    """Verdict on every page's URL: rules, else boosted trees trained on the URLs that rules decide."""
    return judge_urls(table(spark, folder, "pages"), URL_RULES)


def op7_pivot_permutations(spark, folder):
    """Near-duplicate vectors of each label, cosine 0.98 or more."""
    return vector_duplicates(table(spark, folder, "embeddings"))


def op8_gear_chunks(spark, folder):
    """All documents without the passages that an earlier document has."""
    cleaned = substring_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "text", F.col("llm_removed_words").alias("removed_words"),
        F.coalesce(F.size("llm_spans"), F.lit(0)).alias("n_spans"))


def op9_pfair_mixture(spark, folder):
    """Place of every document in a mixture of the sources by target weights."""
    mixed = mix(table(spark, folder, "documents"), MIXTURE)
    return mixed.select("doc_id", "source", F.col("llm_block").alias("block"), F.col("llm_slot").alias("slot"),
                        F.col("llm_position").alias("position"))


def op10_line_quality(spark, folder):
    """Quality counts and verdict of every document."""
    return quality_columns(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "lost_chars", "kept")


def op11_line_runs(spark, folder):
    """All documents without the lines that ten or more documents have."""
    cleaned = dedup_lines(table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id", F.col("llm_lines").alias("n_lines"), F.col("llm_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op12_interval_repair(spark, folder):
    """Faults planted in all conversations, and the cheapest edits that repair them."""
    return audited(table(spark, folder, "conversations"))


def op13_max_sketches(spark, folder):
    """The 50 best documents of every benchmark item."""
    return lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_cost_balanced_packing": op1_cost_balanced_packing,
    "op2_external_shuffle": op2_external_shuffle,
    "op3_tensored_near_duplicates": op3_tensored_near_duplicates,
    "op4_chunked_warc": op4_chunked_warc,
    "op5_record_files": op5_record_files,
    "op6_url_trees": op6_url_trees,
    "op7_pivot_permutations": op7_pivot_permutations,
    "op8_gear_chunks": op8_gear_chunks,
    "op9_pfair_mixture": op9_pfair_mixture,
    "op10_line_quality": op10_line_quality,
    "op11_line_runs": op11_line_runs,
    "op12_interval_repair": op12_interval_repair,
    "op13_max_sketches": op13_max_sketches,
}
