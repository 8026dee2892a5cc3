"""Matrices too large for a row, as (row, col, value); cells that are not there are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: a join on the inner index, then sums by cell. Cells given twice add up; nulls count as 0."""
    left = a.select(F.col("row").alias("row"), F.col("col").alias("_k"), F.col("value").alias("_x"))
    right = b.select(F.col("row").alias("_k"), F.col("col").alias("col"), F.col("value").alias("_y"))
    return left.join(right, "_k").groupBy("row", "col").agg(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
