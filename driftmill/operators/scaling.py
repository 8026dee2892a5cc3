"""Per-place mean and population deviation of feature rows, and the transforms built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, features: str, width: int) -> DataFrame:
    """One row: means, deviations (population; 0 becomes 1), n. Rows of another width are left aside; without any, there is
    one row of nulls.

    Values are grouped by place: ``width`` groups with map-side combine and one running mean and deviation, where an
    aggregate for every place would be one operator of twice as many functions.
    """
    rows = df.filter(F.size(features) == width)
    per = rows.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n"))
    at = F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))))  # width entries
    one = per.agg(at.alias("a"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    none = F.array_repeat(F.lit(None).cast("double"), width)
    whole = F.size("a") == width
    return one.select(F.when(whole, F.col("a.m")).otherwise(none).alias("means"), F.when(whole, F.col("a.s")).otherwise(none).alias("deviations"), "n")


def transform(df: DataFrame, features: str, scaler: DataFrame, out: str = "scaled") -> DataFrame:
    """Standardised rows; a row of another width is an error. ``scaler`` is one row."""
    s = F.broadcast(scaler.select(F.col("means").alias("_m"), F.col("deviations").alias("_d")))
    joined = df.crossJoin(s)  # one row
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("_m").alias("m"), F.col("_d").alias("d")), lambda v: (v["x"] - v["m"]) / v["d"])
    fits = F.size(features) == F.size("_m")
    return joined.withColumn(out, F.when(fits, z).otherwise(F.raise_error(F.lit("dimension mismatch")))).drop("_m", "_d")


def restore(df: DataFrame, scaled: str, scaler: DataFrame, out: str = "features") -> DataFrame:
    s = F.broadcast(scaler.select(F.col("means").alias("_m"), F.col("deviations").alias("_d")))
    z = F.transform(F.arrays_zip(F.col(scaled).alias("x"), F.col("_m").alias("m"), F.col("_d").alias("d")), lambda v: v["x"] * v["d"] + v["m"])
    return df.crossJoin(s).withColumn(out, z).drop("_m", "_d")  # one row
