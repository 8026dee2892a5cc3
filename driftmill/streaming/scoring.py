"""Continuous scoring: each micro-batch of feature rows goes through the batch scorer and is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftmill.operators.models import score


def score_stream(rows: DataFrame, keep: list[str], features: str, models: list[tuple[str, str]], out: str, checkpoint: str) -> StreamingQuery:
    """Scored rows in parquet under ``out``, a folder for each batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch, keep, features, models).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
