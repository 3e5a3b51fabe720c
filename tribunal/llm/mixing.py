"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's documents are cut into blocks.  A source of weight w releases its
block number j at time floor(j / w) and wants it placed by ceil((j + 1) / w).
One block is placed per time slot, of those released the one with the earliest
deadline.  In every prefix a source is then less than one block away from its
share.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from tribunal.operators.ordering import earlier_sums

#: Expected rows that one task numbers at once.
ROWS_PER_BUCKET = 2_000
OTHER = "*"


def pfair_slots(parts: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) for one period of ``sum(parts)`` slots, with weights parts / period.

    Earliest deadline first over the released blocks; ties go to the smaller
    name.  All deadlines are met, as the weights add up to one.
    """
    period = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts) if parts[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        assert slot < deadline
        out.append((s, j, slot))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * period // parts[s], s, j + 1))
    return out


def mix(
    docs: DataFrame, parts: Mapping[str, int], source: str = "source", order: tuple[str, ...] = ("doc_id", "text"),
    block: int = 16, rest: int = 1,
) -> DataFrame:
    """All rows and columns of ``docs`` and their place in the mixture.

    ``parts`` gives the weights as whole parts; sources it does not name, and
    null, share ``rest`` parts.  Inside a source documents follow an md5 of the
    ``order`` columns, so only rows equal in all of them are in no fixed order.
    New columns: ``llm_block`` (number of the document's block in its
    source), ``llm_slot`` (time slot of that block) and ``llm_position``
    (slot x block + place in the block: the order of the mixture).  Columns of
    these names are replaced.  No row is left out or repeated: when a source
    has no blocks left, its slots stay empty and the others keep their
    proportions.  An empty table gives no rows.
    """
    if any(int(p) != p or p <= 0 for p in [*parts.values(), rest]):
        raise ValueError("parts are positive whole numbers")
    spark = docs.sparkSession
    own = docs.drop("llm_block", "llm_slot", "llm_position", "llm_source", "llm_hash", "llm_bucket", "llm_rank")
    weights = {f"={s}": int(p) for s, p in parts.items()} | {OTHER: int(rest)}
    named = F.when(F.col(source).isin(list(parts)), F.concat(F.lit("="), F.col(source).cast("string"))).otherwise(OTHER)
    digest = F.md5(F.concat_ws("#", *[F.col(c).cast("string") for c in order]))
    n_rows = docs.count()
    digits = max(1, math.ceil(math.log(max(n_rows, 1) / ROWS_PER_BUCKET, 16))) if n_rows else 1
    keyed = own.withColumn("llm_source", F.coalesce(named, F.lit(OTHER))).withColumn("llm_hash", digest).withColumn(
        "llm_bucket", F.substring("llm_hash", 1, digits))
    inside = Window.partitionBy("llm_source", "llm_bucket").orderBy("llm_hash")
    counts = keyed.groupBy("llm_source", "llm_bucket").agg(F.count(F.lit(1)).alias("llm_rows"))
    offsets = earlier_sums(
        counts, ["llm_source"], "llm_bucket", F.substring("llm_bucket", 1, max(0, digits - 3)), "llm_rows"
    ).withColumnRenamed("_offset", "llm_before")
    ranked = (
        keyed.withColumn("llm_rank", F.row_number().over(inside) - 1)
        .join(offsets, ["llm_source", "llm_bucket"])
        .withColumn("llm_rank", F.col("llm_rank") + F.col("llm_before"))
        .withColumn("llm_block", F.floor(F.col("llm_rank") / block))
    )
    sizes = spark.createDataFrame(list(weights.items()), "llm_name string, llm_parts int")
    slots = spark.createDataFrame(pfair_slots(weights), "llm_of string, llm_turn long, llm_at long")
    period = sum(weights.values())
    # Both tables have as many rows as the weights have parts.
    timed = (
        ranked.join(F.broadcast(sizes), F.col("llm_source") == F.col("llm_name"))
        .withColumn("llm_round", F.floor(F.col("llm_block") / F.col("llm_parts")))
        .withColumn("llm_turn_of", F.col("llm_block") % F.col("llm_parts"))
        .join(F.broadcast(slots), (F.col("llm_source") == F.col("llm_of")) & (F.col("llm_turn_of") == F.col("llm_turn")))
        .withColumn("llm_slot", F.col("llm_round") * period + F.col("llm_at"))
        .withColumn("llm_position", F.col("llm_slot") * block + F.col("llm_rank") % block)
    )
    return timed.select(*own.columns, "llm_block", "llm_slot", "llm_position")


def in_order(mixed: DataFrame, n_files: int) -> DataFrame:
    """Rows in the order of the mixture, each file a slice of it."""
    return mixed.repartitionByRange(n_files, "llm_position").sortWithinPartitions("llm_position")
