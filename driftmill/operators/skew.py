"""Skew-proof building blocks: unique-key lookups and prefix sums with no unbounded group in one task."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.runtime import cut

#: At most this many keys can each hold more than 1/HOT_KEYS of the rows: the bound of what is broadcast.
HOT_KEYS = 1000
#: Nodes of a plan that are dearer than reading a table twice.
DEAR = re.compile(r"\b(Aggregate|Join|Window|MapInArrow|MapInPandas|FlatMapGroupsInPandas|Distinct|Sort)\b")


def _same(a: str, left: DataFrame, right: DataFrame) -> Column:
    return left[a].eqNullSafe(right[a])


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", least: int = 50_000) -> DataFrame:
    """Join ``left`` to ``right``, which is unique on ``on`` (nulls match nothing).

    Keys with more than 1/1000 of the rows of ``left`` (and more than ``least`` rows), of which there can be
    no more than 1000, take a broadcast join with their rows of ``right``; all others a shuffle join. ``left`` is read
    once to count it and three times beyond ``least``: it is written first where that would repeat more than a scan.
    """
    total = left.count()
    if total <= least:
        return left.join(right, on, how)
    if DEAR.search(left._jdf.queryExecution().optimizedPlan().toString()):
        left = cut(left, "lookup")
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.filter(F.col("_n") > max(least, total // HOT_KEYS)).select(*on)
    keys = hot.limit(HOT_KEYS).collect()
    if not keys:
        return left.join(right, on, how)
    spark = left.sparkSession
    few = F.broadcast(spark.createDataFrame(keys, hot.schema))
    hot_right = F.broadcast(right.join(few, on, "left_semi"))
    return left.join(few, on, "left_semi").join(hot_right, on, how).unionByName(left.join(few, on, "left_anti").join(right, on, how))


def prefix_sum(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exact running sum of ``value`` (inclusive) within ``groups`` in the order of (bucket, order).

    ``bucket`` must not decrease along ``order`` and must split each group into parts of bounded size; only a
    bucket is ever sorted in one task, the buckets' totals are chained apart. ``df`` is read twice: cut it first
    where it is dear.
    """
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_t"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    keyed = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*groups, bucket])], "_before")
    local = df.withColumn("_local", F.sum(value).over(inner))
    match = reduce(lambda a, b: a & b, [local[c].eqNullSafe(keyed[f"_k{i}"]) for i, c in enumerate([*groups, bucket])])
    return local.join(keyed, match).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", *[f"_k{i}" for i in range(len(groups) + 1)])
