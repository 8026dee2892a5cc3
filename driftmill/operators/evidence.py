"""Evidence from recorded oracle runs: cells, cross-policy agreement, promotion, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds unless a report names its own. Fixed values.
MIN_FAMILIES, MIN_POLICIES, MIN_CHECKS = 25, 3, 75
KEYS = ("mutation", "mode", "policy_pack", "label", "oracle_hash", "policy_hash")


def _accepted() -> Column:
    return F.col("outcome") != "rejected"


def cells(runs: DataFrame, families: int = MIN_FAMILIES, policies: int = MIN_POLICIES, checks: int = MIN_CHECKS) -> DataFrame:
    """By change, mode and policy: families, checks, accepted checks, counts by label, and whether the label never varies.

    runs: (family_id, mutation, mode, policy_pack, outcome). Rejected runs count as checks only.
    """
    by = ("mutation", "mode", "policy_pack")
    labelled = runs.groupBy(*by, "outcome").agg(F.count(F.lit(1)).alias("n"))
    labels = labelled.groupBy(*by).agg(F.sum("n").alias("checks"), F.sum(F.when(_accepted(), F.col("n")).otherwise(0)).alias("accepted"), F.map_from_entries(F.array_sort(F.collect_list(F.when(_accepted(), F.struct("outcome", "n"))))).alias("labels"))
    seen = runs.filter(_accepted()).groupBy(*by).agg(F.countDistinct("family_id").alias("families"))
    out = labels.join(seen, list(by), "left").withColumn("families", F.coalesce("families", F.lit(0)))
    enough = (F.col("families") >= families) & (F.col("accepted") >= -(-checks // policies)) & (F.size("labels") == 1)
    return out.withColumn("invariant", enough).select(*by, "families", "checks", "accepted", "labels", "invariant")


def cross_policy(runs: DataFrame, families: int = MIN_FAMILIES, policies: int = MIN_POLICIES, checks: int = MIN_CHECKS) -> DataFrame:
    """By change and mode over all policies: accepted policies and whether one label holds for all."""
    ok = runs.filter(_accepted())
    out = ok.groupBy("mutation", "mode").agg(F.countDistinct("family_id").alias("families"), F.countDistinct("policy_pack").alias("policies"), F.count(F.lit(1)).alias("accepted"), F.sort_array(F.collect_set("outcome")).alias("labels"))
    one = (F.size("labels") == 1) & (F.col("families") >= families) & (F.col("policies") >= policies) & (F.col("accepted") >= checks)
    return out.withColumn("invariant", one)


def promote(cell: DataFrame, cross: DataFrame) -> DataFrame:
    """Cells whose change and mode have one label across policies."""
    ok = cross.filter("invariant").select("mutation", "mode", F.get("labels", F.lit(0)).alias("label"))
    return cell.filter("accepted > 0").join(ok, ["mutation", "mode"]).select("mutation", "mode", "policy_pack", "label", "families", F.col("accepted").alias("checks"))


def with_promotion(records: DataFrame, promotions: DataFrame) -> DataFrame:
    """Records with the promotion that agrees on all six keys, where there is one."""
    return records.join(promotions.select(*KEYS, F.lit(True).alias("promoted")).distinct(), list(KEYS), "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def unique(df: DataFrame, keys: tuple[str, ...], what: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {twice[0].asDict()} occurs more than once")
    return df


def merge_runs(left: DataFrame, right: DataFrame, identity: tuple[str, ...] = ("family_id", "mutation", "mutation_variant", "profile", "mode", "policy_pack"), same: tuple[str, ...] = ("oracle_hash", "policy_hash"), thresholds: tuple[dict, dict] | None = None) -> DataFrame:
    """Both reports' runs; they must come from the same oracle and policies, rest on the same ``thresholds`` (one mapping for
    each report) and share no run."""
    if thresholds is not None and thresholds[0] != thresholds[1]:
        raise ValueError("the reports rest on different thresholds")
    both = left.unionByName(right)
    odd = both.agg(*[F.countDistinct(c).alias(c) for c in same]).first()
    if any((odd[c] or 0) > 1 for c in same):
        raise ValueError("the reports come from different oracles or policies")
    return unique(both, identity, "runs")


def merge_promotions(left: DataFrame, right: DataFrame) -> DataFrame:
    return unique(left.unionByName(right), ("mutation", "mode", "policy_pack"), "promotions")


def reclassify_fatal(runs: DataFrame) -> DataFrame:
    """A run that ended with 1 because the process died is rejected, not breaking."""
    from driftmill.functions.labels import fatal_exit

    died = (F.col("exit_code") == 1) & fatal_exit(F.col("stdout"), F.col("stderr"))
    return runs.withColumn("outcome", F.when(died, "rejected").otherwise(F.col("outcome")))


def admitted_families(preflight: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of families with no rejected preflight."""
    return runs.join(preflight.filter("outcome = 'rejected'").select("family_id").distinct(), "family_id", "left_anti")


def matrix(candidates: DataFrame, policies: list[str], modes: list[str], profiles: list[str] | None = None) -> DataFrame:
    """Every candidate under every policy and mode (and root profile): short lists, exploded in place."""
    out = candidates.withColumn("policy_pack", F.explode(F.array(*map(F.lit, policies)))).withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    return out if profiles is None else out.withColumn("profile", F.explode(F.array(*map(F.lit, profiles))))


def replay_summary(df: DataFrame, first: str, second: str, match: str) -> DataFrame:
    """Invocations and mismatches over everything and by each of two columns."""
    df.createOrReplaceTempView("_driftmill_replay")
    return df.sparkSession.sql(
        f"SELECT CASE grouping_id({first}, {second}) WHEN 3 THEN 'overall' WHEN 1 THEN '{first}' ELSE '{second}' END AS report, {first}, {second}, count(*) AS n, sum(CASE WHEN {match} THEN 0 ELSE 1 END) AS n_mismatch "
        f"FROM _driftmill_replay GROUP BY GROUPING SETS ((), ({first}), ({second}))"
    )


def trace_per(df: DataFrame, by: str, order: str, keep: list[str]) -> DataFrame:
    """The first row of each value of ``by``: an aggregate, so no value is ranked in one task."""
    first = F.min_by(F.struct(*keep), order)
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(first.alias("x")).select(by, *[F.col(f"x.{k}").alias(k) for k in keep])
