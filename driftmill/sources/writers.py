"""Sinks. None replaces what is there: Spark's errorifexists is kept, and Spark commits a write as a whole."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    (df.write.mode("errorifexists").partitionBy(*partition_by) if partition_by else df.write.mode("errorifexists")).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def prepared_json(records: DataFrame, path: str, dataset_version: str, feature_version: str, benchmark_ready: bool | None = None) -> None:
    """One JSON document, an exchange format: records are streamed line by line through one task, none is held."""
    head = {"format_version": "prepared-dataset-v2", "dataset_version": dataset_version, "feature_version": feature_version, "benchmark_ready": benchmark_ready}
    first = json.dumps(head)[:-1] + ', "records": ['

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began = False
        for b in batches:
            out = []
            for place, line in zip(b.column("place").to_pylist(), b.column("line").to_pylist()):
                out.append("," + line if place == 1 and began else line)
                began |= place == 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    ends = records.sparkSession.createDataFrame([(0, first), (2, "]}")], "place int, line string")
    lines = records.select(F.lit(1).alias("place"), F.to_json(F.struct(*records.columns)).alias("line")).unionByName(ends)
    lines.repartition(1).sortWithinPartitions("place").mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def text(spark_df_session, content: str, path: str) -> None:
    """A small document (a model, a report) as one file of a new folder."""
    spark_df_session.createDataFrame([(content,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
