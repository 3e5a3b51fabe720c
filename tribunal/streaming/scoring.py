"""Scores rows as they arrive.

Scoring is a projection over stored parameters, so the batch plan runs
unchanged on a stream.  Neighbour winners and targets with many classes need a
join that aggregates, which a stream cannot do row by row; they are scored per
micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tribunal.functions import rules
from tribunal.operators.score import Scorer


def score_stream(stream: DataFrame, scorer: Scorer, row_id: str, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends scored rows to ``folder`` as Parquet."""
    if scorer.model is not None and (scorer.labels or scorer.problem_type == rules.REGRESSION):
        return scorer.score(stream, row_id).writeStream.format("parquet").option("path", folder).option(
            "checkpointLocation", checkpoint).outputMode("append")

    def batch(rows: DataFrame, batch_id: int) -> None:
        # the batch number names the folder, so a repeated batch replaces itself
        scorer.score(rows, row_id).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
