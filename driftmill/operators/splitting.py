"""Ordered, seeded and family-aware splits, mini-batches, quotas and source samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.functions.hashing import FNV_BASIS, FNV_PRIME, fnv_rank
from driftmill.operators.skew import lookup

SPLITS = ("train", "validation", "test")
#: Records that the sequential splits take at most; they are defined by one pass in order and hold a permutation.
SEQUENTIAL_LIMIT = 5_000_000
MASK = (1 << 64) - 1


def ranked(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """0-based place in the whole order: range-sorted, then counted per task, with no single-task window."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("*", F.monotonically_increasing_id().alias("_mid")).transform(lambda d: _dense(d, out))


def _dense(df: DataFrame, out: str) -> DataFrame:
    from driftmill.runtime import cut

    kept = cut(df.withColumn("_task", F.shiftright("_mid", 33)), "ranked")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    sizes = kept.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return kept.join(F.broadcast(sizes), "_task").withColumn(out, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_mid", "_before")


def minibatches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Row order cut in batches; the last may be short."""
    if size < 1:
        raise ValueError("batches need at least one row")
    return ranked(df, order).withColumn("batch", F.floor(F.col("row_no") / size).cast("long"))


def ordered_split(df: DataFrame, order: list[str], test_ratio: float) -> DataFrame:
    """The last round(n x ratio) rows are the test split; both splits get at least one row."""
    if not 0 <= test_ratio < 1:
        raise ValueError("not a split ratio")
    n = df.count()
    if n < 2:
        raise ValueError("too few rows")
    test = min(max(math.floor(n * test_ratio + 0.5), 1), n - 1)
    return ranked(df, order).withColumn("partition", F.when(F.col("row_no") < n - test, "train").otherwise("test"))


def split_sizes(n: int, ratios: tuple[float, float, float]) -> list[int]:
    """Whole shares first, the rest by largest remainder (the later split wins a tie), none empty."""
    exact = [r * n for r in ratios]
    sizes = [math.floor(x) for x in exact]
    for _ in range(n - sum(sizes)):
        rest = [x - s for x, s in zip(exact, sizes)]
        sizes[max(range(3), key=lambda i: (rest[i], i))] += 1
    sizes = [max(1, s) for s in sizes]
    while sum(sizes) > n:
        big = max((i for i in range(3) if sizes[i] > 1), key=lambda i: (sizes[i], i))
        sizes[big] -= 1
    return sizes


def lcg_order(n: int, seed: int) -> list[int]:
    """Fisher-Yates from the back, drawn from the 64-bit congruential generator (x * 6364136223846793005 + 1)."""
    out, state = list(range(n)), seed & MASK
    for i in range(n - 1, 0, -1):
        state = (state * 6364136223846793005 + 1) & MASK
        j = state % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def seeded_split(df: DataFrame, order: list[str], ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """A shuffled three-way split that is the same for a seed everywhere. The shuffle is sequential by its definition:
    the driver holds a permutation of at most SEQUENTIAL_LIMIT numbers; beyond it use the hashed group split."""
    n = df.count()
    if n < 3:
        raise ValueError("too few rows")
    if n > SEQUENTIAL_LIMIT:
        raise ValueError("too many rows for a sequential shuffle")
    a, b, _ = split_sizes(n, ratios)
    where = [(row, SPLITS[0 if i < a else 1 if i < a + b else 2]) for i, row in enumerate(lcg_order(n, seed))]
    table = df.sparkSession.createDataFrame(where, "row_no long, partition string")
    return ranked(df, order).join(table, "row_no")


def fnv(text: str, seed: int) -> int:
    h = (seed ^ FNV_BASIS) & MASK
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & MASK
    return h


def group_split(df: DataFrame, group: str, label: Column, role: Column, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """(group, partition): whole groups of standard records, the largest first, each where the balance of records and
    classes gets better most. Targets count all records, challenge ones included. The assignment is sequential by its
    definition; groups (not records) come to the driver, at most SEQUENTIAL_LIMIT of them."""
    classes = ("safe", "warning", "breaking")
    rows = df.select(F.col(group).alias("g"), label.alias("l"), role.alias("r"))
    everything = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("l") == c, 1).otherwise(0)).alias(c) for c in classes]).first()
    per = rows.filter("r = 'standard' and g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("l") == c, 1).otherwise(0)).alias(c) for c in classes])
    groups = per.limit(SEQUENTIAL_LIMIT + 1).collect()
    if len(groups) > SEQUENTIAL_LIMIT:
        raise ValueError("too many groups for a sequential assignment")
    if len(groups) < 3:
        raise ValueError("too few groups")
    groups.sort(key=lambda r: (-r["n"], fnv(r["g"], seed)))
    want = [max(x * everything["n"], 1.0) for x in ratios]
    want_class = [[max(x * (everything[c] or 0), 1.0) for c in classes] for x in ratios]
    size, by_class, used = [0] * 3, [[0] * 3 for _ in range(3)], [0] * 3

    def gain(p: int, r) -> float:
        s = ((size[p] + r["n"] - want[p]) ** 2 - (size[p] - want[p]) ** 2) / want[p]
        for k, c in enumerate(classes):
            t, h = want_class[p][k], by_class[p][k]
            s += ((h + r[c] - t) ** 2 - (h - t) ** 2) / t
        return s

    out = []
    for i, r in enumerate(groups):
        empty = [p for p in range(3) if not used[p]]
        among = empty if len(groups) - i <= len(empty) else [0, 1, 2]
        p = min(among, key=lambda q: (gain(q, r), q))
        size[p] += r["n"]
        used[p] += 1
        for k, c in enumerate(classes):
            by_class[p][k] += r[c]
        out.append((r["g"], SPLITS[p]))
    return df.sparkSession.createDataFrame(out, f"{group} string, partition string")


def source_priority(candidates: DataFrame, by: str) -> DataFrame:
    """(by, priority): 0 where an enum value can be added, 1 where anything can be changed; others have no row."""
    return candidates.groupBy(by).agg(F.min(F.when(F.col("kind") == "enum_value_added", 0).otherwise(1)).alias("priority"))


def top_sample(df: DataFrame, id_col: str, n: int, seed: int, priority: Column | None = None, order: str | None = None) -> DataFrame:
    """The first n ids by (priority, 64-bit rank of the id, id). Rows of one id are one: the last by ``order`` wins, or the
    greatest content where there is none."""
    rank = fnv_rank(F.col(id_col), seed)
    rows = df.filter(F.trim(id_col) != "").withColumn("_p", F.lit(0) if priority is None else priority).withColumn("_rank", rank)
    others = F.struct(*[c for c in rows.columns if c != id_col])
    one = rows.groupBy(id_col).agg((F.max(others) if order is None else F.max_by(others, F.struct(order, others))).alias("_x")).select(id_col, "_x.*")
    return one.orderBy("_p", "_rank", id_col).limit(n).select(*rows.columns).drop("_p")


def balanced_sample(df: DataFrame, id_col: str, profile: str, n: int, seed: int, priority: Column | None = None) -> DataFrame:
    """Half open (rounded down), the rest closed; neither makes up for the other. Ordered by rank and id."""
    half = n // 2
    a = top_sample(df.filter(F.col(profile) == "open"), id_col, half, seed, priority)
    b = top_sample(df.filter(F.col(profile) == "closed"), id_col, n - half, seed, priority)
    return a.unionByName(b)


def quota(df: DataFrame, stratum: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each stratum in order; a stratum is thinned in 64 parts before it is ranked."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    inner = F.row_number().over(Window.partitionBy(*stratum, "_quota_part").orderBy(*order))
    few = df.withColumn("_quota_part", part).withColumn("_quota_rank", inner).filter(F.col("_quota_rank") <= most)
    outer = F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))
    return few.withColumn("_quota_rank", outer).filter(F.col("_quota_rank") <= most).drop("_quota_rank", "_quota_part")


def reserve_missing(df: DataFrame, label: str, order: str) -> DataFrame:
    """Roles in which every (change, label) of a change with several labels has a challenge record: where one lacks, the
    first standard family with it becomes challenge as a whole."""
    role = F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard"))
    rows = df.withColumn("_role", role)
    seen = rows.filter(F.col("mutation").isNotNull() & F.col(label).isNotNull()).groupBy("mutation", label).agg(
        F.max(F.when(F.col("_role") == "challenge", 1).otherwise(0)).alias("_has"), F.min_by(F.when(F.col("_role") == "standard", F.col("family_id")), F.when(F.col("_role") == "standard", F.col(order))).alias("_first")
    )
    many = seen.groupBy("mutation").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("mutation")
    moved = seen.join(many, "mutation", "left_semi").filter("_has = 0 and _first is not null").select(F.col("_first").alias("family_id")).distinct().withColumn("_moved", F.lit(True))
    return lookup(rows, moved, ["family_id"]).withColumn("dataset_role", F.when(F.col("_moved"), "challenge").otherwise(F.col("_role"))).drop("_moved", "_role")
