"""Global shuffle into shards by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tribunal.llm.common import prepare_workers, total, written
from tribunal.session import new_path

_OWN = ("llm_shard", "llm_slot", "llm_row", "llm_bucket", "llm_place", "llm_of", "llm_base", "llm_rows")


def write_shuffled(
    rows: DataFrame, n_shards: int = 16, seed: int = 1, bucket_bytes: int = 16 << 20, text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Shuffle all rows, write them as ``n_shards`` shards and read them back.

    Pass one scatters rows evenly over buckets of about ``bucket_bytes`` of
    text by a seeded hash of the row's place in the input, so equal rows and
    equal keys spread too.  Pass two brings each bucket into input order, does a
    Fisher-Yates shuffle seeded by (seed, bucket) and writes it.  Buckets follow
    one another, and a shard is an equal slice of that order: shard sizes differ
    by one row at most, and a shard's reader opens a run of bucket files.

    The files are counted once they are written, so a row that another attempt
    of a task dealt elsewhere is counted where it lies.  The table read back
    has the columns of ``rows`` and two more, ``llm_shard`` and ``llm_slot``
    (from 0 in each shard, without gaps); columns of these names in the input
    are replaced.  Null texts count as empty; an empty table gives no rows.
    """
    prepare_workers(rows)
    spark = rows.sparkSession
    rows = rows.drop(*_OWN)
    text_size = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)
    n_buckets = max(1, -(-total(rows.select(text), text_size) // bucket_bytes))
    placed = rows.withColumn("llm_row", F.monotonically_increasing_id()).withColumn(
        "llm_bucket", F.pmod(F.xxhash64("llm_row", F.lit(seed)), F.lit(n_buckets)))
    titles = rows.columns
    schema = rows.withColumn("llm_bucket", F.lit(0).cast("long")).withColumn("llm_place", F.lit(0).cast("long")).schema

    def shuffle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("llm_row")
        order = np.random.default_rng([seed, bucket["llm_bucket"][0].as_py()]).permutation(len(bucket))   # Fisher-Yates
        out = bucket.take(pa.array(order)).select([*titles, "llm_bucket"])
        return out.append_column("llm_place", pa.array(np.arange(len(out), dtype=np.int64)))

    folder = folder or new_path(spark, "shards")
    placed.groupBy("llm_bucket").applyInArrow(shuffle, schema).write.parquet(folder)
    return read_shards(spark, folder, schema, n_shards)


def read_shards(spark: SparkSession, folder: str, schema: StructType, n_shards: int) -> DataFrame:
    """Rows of the bucket files with their shard and slot."""
    stored = spark.read.schema(schema).parquet(folder)
    counts = stored.groupBy("llm_bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket is summed up in order.
    before = Window.orderBy("llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select(
        F.col("llm_bucket").alias("llm_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("llm_base"),
        F.sum("n").over(Window.partitionBy()).alias("llm_rows")), "bases")
    place = F.col("llm_base") + F.col("llm_place")
    shard = F.expr(f"(llm_base + llm_place) * {n_shards}L div llm_rows")
    first = F.expr(f"(llm_shard * llm_rows + {n_shards - 1}L) div {n_shards}L")
    return (
        stored.join(bases, F.col("llm_bucket") == F.col("llm_of"))
        .withColumn("llm_shard", shard).withColumn("llm_slot", place - first)
        .withColumn("llm_shard", F.col("llm_shard").cast("int"))
        .drop("llm_bucket", "llm_place", "llm_of", "llm_base", "llm_rows")
    )
