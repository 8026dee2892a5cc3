"""A sample that matches target category proportions, with minima and a report of what fell short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.runtime import Cut, cut, unit_hash

#: Parts into which a category's accepted rows are cut by their draw; only one part of each is ever ranked.
PARTS = 4096


def category_key(col: Column) -> Column:
    """Letter case, outer blanks, hyphens and underscores do not tell categories apart; null has no category."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), "[-_]", "")


def _goals(targets: DataFrame) -> DataFrame:
    """Targets with ``field``, ``key``, the exact share in rows, what counts as short, and the rows to take.

    Minima come first; what they take beyond a category's share is taken from the others in proportion to what
    those have above their own minimum. Fractions are rounded by largest remainder, so the total is kept.
    """
    quota = F.round(F.col("target_share") * F.col("sample_rows"), 6)
    w = Window.partitionBy("request_no")
    t = targets.withColumn("quota", F.coalesce(quota, F.lit(0.0))).withColumn("least", F.coalesce("min_rows", F.lit(0)).cast("double"))
    t = t.withColumn("floor_at", F.greatest("quota", "least")).withColumn("above", F.greatest(F.col("quota") - F.col("least"), F.lit(0.0)))
    over = F.sum(F.col("floor_at") - F.col("quota")).over(w)
    room = F.sum("above").over(w)
    exact = F.when(room > 0, F.col("floor_at") - F.col("above") * F.least(over / F.when(room > 0, room), F.lit(1.0))).otherwise(F.col("floor_at"))
    t = t.withColumn("exact", F.round(exact, 6)).withColumn("whole", F.floor("exact"))
    left = F.round(F.sum("exact").over(w)) - F.sum("whole").over(w)
    rank = F.row_number().over(w.orderBy((F.col("exact") - F.col("whole")).desc(), F.col("category")))
    t = t.withColumn("_left", left).withColumn("_rank", rank)
    t = t.withColumn("want", (F.col("whole") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long"))
    parts = F.split("category", r"\|")
    return t.select("request_no", "category", "target_share", "min_rows", "sample_rows", "quota", "want", F.col("strat_field").alias("field"), F.array_join(F.transform(parts, category_key), "|").alias("key"))


def _keyed(records: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(id, field, key): a row for each record and stratification in which it has a category; each id once."""
    singles = sorted({f for name in fields for f in name.split("|")})
    keys = records.select(F.col(record_id).alias("_id"), *[category_key(F.col(f)).alias(f"_c_{f}") for f in singles])
    once = keys.groupBy("_id").agg(*[F.min(f"_c_{f}").alias(f"_c_{f}") for f in singles])
    each = [F.struct(F.lit(name).alias("field"), F.concat(*[p for i, f in enumerate(name.split("|")) for p in ([F.lit("|")] if i else []) + [F.col(f"_c_{f}")]]).alias("key")) for name in fields]
    return once.select("_id", F.explode(F.array(*each)).alias("x")).select("_id", "x.field", "x.key").filter("key is not null")


def _fields(targets: DataFrame, records: DataFrame) -> list[str]:
    """The stratifications asked for: a list of column names, bounded by the combinations of the table's columns."""
    names = [r[0] for r in targets.select("strat_field").distinct().collect()]
    return sorted(n for n in names if n and all(f in records.columns for f in n.split("|")))


def availability(records: DataFrame, record_id: str, targets: DataFrame) -> DataFrame:
    """Every target with ``available``, the number of distinct records in its category."""
    fields = _fields(targets, records)
    goals = _goals(targets)
    if not fields:
        return goals.withColumn("available", F.lit(0).cast("long"))
    counts = _keyed(records, record_id, fields).groupBy("field", "key").agg(F.count(F.lit(1)).alias("available"))
    return goals.join(counts, ["field", "key"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))


def shortfalls(report: DataFrame) -> DataFrame:
    """(request_no, category) of a sample's report that fell short of the share wanted or of the minimum."""
    return report.filter("deficit > 0").select("request_no", "category").distinct()


def sample(records: DataFrame, record_id: str, targets: DataFrame, seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every request in ``targets``.

    A record of a category with ``want`` rows to give out of ``available`` is accepted on its own with probability
    (want + 4 sqrt(want) + 8) / available, by a draw that is a hash of seed, request and record. The accepted rows
    are then cut to exactly ``want`` by their draws: counts by 4096 parts of the draw find the part in which the
    count is reached, and only that part's rows are ranked. Should a category have drawn too few (about 1 in
    30,000), all its records are accepted before the cut. Requests are independent of each other.

    Nulls: a record with a null field has no category under it. Repeated ids count once; a target without records
    gives a deficit, an unknown field gives a deficit of everything, an empty table an empty sample.
    """
    known = cut(availability(records, record_id, targets), "p2-goals")
    take = known.filter((F.col("want") > 0) & (F.col("available") > 0))
    rate = F.least(F.lit(1.0), (F.col("want") + 4 * F.sqrt("want") + 8) / F.col("available"))
    take = take.select("request_no", "field", "key", "category", "want", "available", rate.alias("rate"))
    fields = _fields(targets, records)
    if not fields:
        empty = known.filter("false").select("request_no", F.col("category"), F.lit(None).cast(records.schema[record_id].dataType).alias(record_id))
        return empty, _report(known, empty)
    held = [Cut(_keyed(records, record_id, fields), "p2-keyed")]  # superseded by the sample
    keyed = held[0].df

    def accepted(goals: DataFrame) -> DataFrame:
        drawn = keyed.join(goals, ["field", "key"]).withColumn("u", unit_hash(seed, F.col("request_no"), F.col("_id")))
        return drawn.filter(F.col("u") < F.col("rate")).select("request_no", "category", "want", "_id", "u", F.least(F.floor(F.col("u") / F.col("rate") * PARTS), F.lit(PARTS - 1)).cast("int").alias("part"))

    held.append(Cut(accepted(take), "p2-accepted"))
    first = held[-1].df
    got = first.groupBy("request_no", "category").agg(F.count(F.lit(1)).alias("got"))
    few = take.join(got, ["request_no", "category"], "left").filter(F.coalesce("got", F.lit(0)) < F.least("want", "available")).drop("got").withColumn("rate", F.lit(1.0))
    held.append(Cut(few, "p2-few"))
    few = held[-1].df
    if few.isEmpty():
        pool = first
    else:
        held.append(Cut(first.join(few.select("request_no", "category"), ["request_no", "category"], "left_anti").unionByName(accepted(few)), "p2-pool"))
        pool = held[-1].df
    parts = pool.groupBy("request_no", "category", "part").agg(F.count(F.lit(1)).alias("n"))
    chain = Window.partitionBy("request_no", "category").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(chain), F.lit(0)))
    placed = pool.join(parts, ["request_no", "category", "part"]).filter(F.col("before") < F.col("want"))
    full = placed.filter(F.col("before") + F.col("n") <= F.col("want"))
    rank = F.row_number().over(Window.partitionBy("request_no", "category").orderBy("u", "_id"))
    edge = placed.filter(F.col("before") + F.col("n") > F.col("want")).withColumn("rank", rank).filter(F.col("before") + F.col("rank") <= F.col("want"))
    drawn = full.select("request_no", "category", F.col("_id").alias(record_id)).unionByName(edge.select("request_no", "category", F.col("_id").alias(record_id)))
    drawn = cut(drawn, "p2-sample")  # the sample is drawn once; the report counts what was drawn
    for table in held:
        table.drop()
    return drawn, _report(known, drawn)


def _report(known: DataFrame, drawn: DataFrame) -> DataFrame:
    taken = drawn.groupBy("request_no", "category").agg(F.count(F.lit(1)).alias("taken"))
    least = F.greatest(F.ceil("quota"), F.coalesce("min_rows", F.lit(0)))
    # the second part is never more than the first: what was drawn is held against what was to be drawn
    deficit = F.greatest(least - F.col("available"), F.col("want") - F.col("taken"), F.lit(0))
    return (
        known.join(taken, ["request_no", "category"], "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .withColumn("share", F.col("taken") / F.when(F.sum("taken").over(Window.partitionBy("request_no")) > 0, F.sum("taken").over(Window.partitionBy("request_no"))))
        .select("request_no", "category", "target_share", F.round("share", 6).alias("actual_share"), "available", "want", "taken", deficit.alias("deficit"))
    )
