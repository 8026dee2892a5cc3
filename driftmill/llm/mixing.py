"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.runtime import Cut, bounded_broadcast, cut, parallelism, unit_hash

#: Documents of a source (and round) that are ordered in one task, and rows of one stretch of the mixture.
PART_ROWS = 50_000
STRETCH_ROWS = 200_000
#: Targets that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def source_key(col: Column) -> Column:
    """Letter case, blanks, hyphens and underscores do not tell sources apart."""
    return F.regexp_replace(F.lower(col), r"[-_\s]+", "")


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.filter("source is not null").groupBy(source_key(F.col("source")).alias("_key"))
    return t.agg(F.min("source").alias("source"), F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"), F.max("budget_tokens").alias("budget_tokens"))


def source_sizes(sized: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Every target with the documents and tokens its source has, and what it has to give (``needed``)."""
    have = sized.groupBy(source_key(F.col(source)).alias("_key")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    t = _targets(targets).join(have, "_key", "left")
    return t.select("_key", "source", "target_share", "max_repeats", "budget_tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("longest", F.lit(0)).alias("longest"), F.round(F.col("target_share") * F.col("budget_tokens"), 6).alias("needed"))


def last_time(goals: list[Row], budget: float) -> float:
    """A virtual time no document of the mixture finishes after.

    At time t a source has given share * t tokens, but for its last document, and no more than all its rounds hold; the
    time is that at which the sources together have given the budget and one document each.
    """
    ends = sorted((g["tokens"] * g["max_repeats"] / g["target_share"], g["target_share"]) for g in goals)
    wanted, rate, given, now = budget + sum(g["longest"] for g in goals), sum(s for _, s in ends), 0.0, 0.0
    for end, share in ends:
        if given + rate * (end - now) >= wanted:
            return now + (wanted - given) / rate
        given, now, rate = given + rate * (end - now), end, rate - share
    return float("inf")


def mix(sized: DataFrame, doc_id: str, source: str, targets: DataFrame, seed: int | str = 0) -> DataFrame:
    """(position, doc_id, source, repeat, n_tokens, virtual_finish) of the mixture, in order of ``virtual_finish``.

    Each source's documents are shuffled (a hash of seed, repeat and document), round after round up to max_repeats
    rounds. A document's virtual finish time is the source's tokens up to its end, divided by the target weight; the
    mixture is all documents, globally range-sorted by finish time, up to the last one that fits the budget. At any
    place of it a source that still has documents lies within one document of its weight; once a source is used up the
    others go on in proportion.

    A source's shuffled order is cut into parts of about 50,000 documents whose totals are chained, so no source is
    sorted in one task. No document can be in the mixture that finishes after ``last_time``: parts behind it are never
    written or sorted. The running total within a stretch of the sorted mixture is taken where it is sorted, the
    totals of the stretches are chained apart. The table of targets is read by the driver. ``sized`` is read three
    times: cut it first.

    Null and unlisted sources take no part. Documents without tokens are left out. Rows repeated under one id are
    documents of their own. Weights of zero or less contribute nothing; an empty table gives an empty mixture.
    """
    kind = sized.schema[doc_id].dataType.simpleString()
    spark = sized.sparkSession
    goals = source_sizes(sized, source, targets).filter("target_share > 0 and tokens > 0 and max_repeats > 0 and budget_tokens > 0").collect()  # one row for each target
    budget = max((g["budget_tokens"] for g in goals), default=0)
    until = last_time(goals, budget)
    plan = []
    for g in goals:
        rounds = g["max_repeats"] if until == float("inf") else min(g["max_repeats"], int(until * g["target_share"] // g["tokens"]) + 1)
        plan.append((g["_key"], g["source"], float(g["target_share"]), rounds, -(-g["n_docs"] // PART_ROWS)))
    known = bounded_broadcast(spark.createDataFrame(plan, "_key string, _source string, share double, rounds int, parts bigint"), BROADCAST_ROWS)
    docs = sized.filter("n_tokens > 0").select(F.col(doc_id).alias("_id"), source_key(F.col(source)).alias("_key"), "n_tokens")
    queued = docs.join(known, "_key").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("rounds")))).withColumn("u", unit_hash(seed, F.col("repeat"), F.col("_id")))
    queued = queued.withColumn("part", F.col("repeat") * F.col("parts") + F.floor(F.col("u") * F.col("parts"))).select("_id", "_key", "_source", "share", "repeat", "u", "part", "n_tokens")
    totals = queued.groupBy("_key", "part").agg(F.sum("n_tokens").alias("_t"), F.first("share").alias("_share"))
    chain = Window.partitionBy("_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_before", F.coalesce(F.sum("_t").over(chain), F.lit(0))).filter(F.col("_before") / F.col("_share") <= F.lit(until))
    kept = Cut(starts.select("_key", "part", "_before"), "p8-parts")
    inner = Window.partitionBy("_key", "part").orderBy("u", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    timed = queued.join(kept.df, ["_key", "part"]).withColumn("finish", (F.col("_before") + F.sum("n_tokens").over(inner)) / F.col("share"))
    written = Cut(timed.filter(F.col("finish") <= F.lit(until)).select("_id", "_source", "repeat", "n_tokens", "finish"), "p8-timed")
    timed = written.df
    order = ["finish", "_source", "repeat", "_id", "n_tokens"]
    stretches = max(1, min(parallelism(spark), timed.count() // 5000), -(-timed.count() // STRETCH_ROWS))
    ordered = timed.repartitionByRange(stretches, *order).sortWithinPartitions(*order).withColumn("stretch", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = 0
        for b in batches:
            upto = np.cumsum(b.column("n_tokens").to_numpy()) + given
            given = int(upto[-1]) if len(upto) else given
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], names=[*b.schema.names, "upto"])

    ordered = cut(ordered.mapInArrow(run, f"_id {kind}, _source string, repeat int, n_tokens bigint, finish double, stretch int, upto bigint"), "p8-ordered")
    kept.drop()
    written.drop()
    sums = ordered.groupBy("stretch").agg(F.max("upto").alias("_t"))  # one row for each stretch
    offset = F.coalesce(F.sum("_t").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(F.broadcast(sums.select("stretch", offset.alias("_before"))), "stretch").withColumn("position", F.col("upto") + F.col("_before"))
    return placed.filter(F.col("position") <= budget).select("position", F.col("_id").alias(doc_id), F.col("_source").alias("source"), "repeat", "n_tokens", F.round("finish", 3).alias("virtual_finish"))


def share_report(mixture: DataFrame, sized: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """Per target: target and actual share, tokens taken, documents taken, the most a document is used, whether the
    target is out of reach, and by how many tokens.

    A source is ``short`` where the mixture holds less of it than it should and even all its documents, each used
    max_repeats times, do not come to that.
    """
    goals = source_sizes(sized, source, targets)
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("taken"), F.count(F.lit(1)).alias("n_taken"), F.max("repeat").alias("repeats"))
    joined = goals.join(got, "source", "left").select("source", "target_share", "max_repeats", "tokens", "needed", "budget_tokens", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_taken", F.lit(0)).alias("n_taken"), F.coalesce("repeats", F.lit(0)).alias("repeats"))
    lacks = F.col("needed") - F.col("tokens") * F.col("max_repeats")
    total = F.sum("taken").over(Window.partitionBy())  # one row for each target
    return joined.select(
        "source", "target_share", F.round(F.col("taken") / F.when(total > 0, total), 6).alias("actual_share"), "taken", "n_taken", "repeats", "max_repeats",
        F.coalesce((F.col("taken") < F.col("needed")) & (lacks > 0), F.lit(False)).alias("short"), F.round(F.greatest(lacks, F.lit(0.0)), 3).alias("deficit_tokens"),
    )


def short_sources(report: DataFrame) -> DataFrame:
    """(source) of a report's targets that are out of reach."""
    return report.filter("short").select("source")
