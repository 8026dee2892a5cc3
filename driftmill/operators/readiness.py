"""Verdicts over labelled records: whether a benchmark may generalise, whether training may start, and why not.

Each verdict is a table of facts (fact, value, failed). A data set is ready where no fact failed; the facts that did are
the reasons. All come from aggregates with map-side combine; only policies, changes and profiles are ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.operators import evidence
from driftmill.operators.splitting import group_split
from driftmill.runtime import cut

#: The change whose records must name an open or closed root object, and the least families, policies and labels. Fixed values.
OPTIONAL, PROFILES = "optional_field_added", ("open", "closed")
LEAST_FAMILIES, LEAST_POLICIES, LEAST_LABELS = 3, 3, 2


def _role() -> Column:
    return F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard"))


def _long(df: DataFrame, failed: dict[str, Column]) -> DataFrame:
    """One row of values as (fact, value, failed)."""
    each = [F.struct(F.lit(n).alias("fact"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value"), F.coalesce(bad, F.lit(False)).alias("failed")) for n, bad in failed.items()]
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def invariant_changes(df: DataFrame, label: str, promotions: DataFrame | None) -> DataFrame:
    """(mutation) whose records all carry one label, and are all promoted under one rationale. Promotions agree on change,
    mode, policy, label and both hashes (evidence.KEYS)."""
    made = df.filter("mutation is not null")
    if promotions is None:
        return made.select("mutation").filter("false")
    told = promotions.groupBy(*evidence.KEYS).agg(F.min("rationale").alias("_why"))
    rows = made.withColumn("label", F.col(label)).join(told, list(evidence.KEYS), "left")
    per = rows.groupBy("mutation").agg(F.count(F.lit(1)).alias("n"), F.count("_why").alias("promoted"), F.countDistinct("_why").alias("reasons"), F.countDistinct("label").alias("labels"))
    return per.filter("labels = 1 and reasons = 1 and promoted = n").select("mutation")


def shortcut_risks(df: DataFrame, label: str, invariant: DataFrame) -> DataFrame:
    """(risk, value): policies with one label that hold other than invariant changes, changes with one label that are not
    invariant, changes under fewer than three policies."""
    marked = df.join(F.broadcast(invariant.withColumn("_fixed", F.lit(True))), "mutation", "left")
    policies = marked.filter("policy_pack is not null").groupBy(F.col("policy_pack").alias("value")).agg(F.countDistinct(label).alias("k"), F.max((F.col("mutation").isNotNull() & F.col("_fixed").isNull()).cast("int")).alias("open"))
    changes = marked.filter("mutation is not null").groupBy(F.col("mutation").alias("value")).agg(F.countDistinct(label).alias("k"), F.countDistinct("policy_pack").alias("p"), F.max(F.col("_fixed").isNull().cast("int")).alias("open"))
    return (
        policies.filter("k = 1 and open = 1").select(F.lit("policy has one label").alias("risk"), "value")
        .unionByName(changes.filter("k = 1 and open = 1").select(F.lit("change has one label").alias("risk"), "value"))
        .unionByName(changes.filter(F.col("p") < LEAST_POLICIES).select(F.lit("change under few policies").alias("risk"), "value"))
    )


def challenge_protocols(df: DataFrame, label: str, invariant: DataFrame) -> DataFrame:
    """(protocol, n_records, n_labels, meaningful, needed) of each policy and change held out and of the paired protocol;
    invariant changes are kept but need no second label."""
    ch = df.filter(_role() == "challenge")
    many = ch.filter("mutation is not null").groupBy("family_id", "mutation").agg(F.countDistinct("policy_pack").alias("k")).filter("k >= 2").select("family_id", "mutation", F.lit(True).alias("_paired"))
    rows = ch.join(many, ["family_id", "mutation"], "left").join(F.broadcast(invariant.withColumn("_fixed", F.lit(True))), "mutation", "left")
    named = F.array_compact(F.array(
        F.when(F.col("policy_pack").isNotNull(), F.struct(F.concat(F.lit("held-out-policy:"), "policy_pack").alias("p"), F.lit(True).alias("need"))),
        F.when(F.col("mutation").isNotNull(), F.struct(F.concat(F.lit("held-out-mutation:"), "mutation").alias("p"), F.col("_fixed").isNull().alias("need"))),
        F.when(F.col("_paired"), F.struct(F.lit("same-mutation-different-policy").alias("p"), F.lit(True).alias("need"))),
    ))
    per = rows.select(F.explode(named).alias("x"), F.col(label).alias("_label")).groupBy(F.col("x.p").alias("protocol")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("_label").alias("n_labels"), F.max("x.need").alias("needed"))
    known = df.sparkSession.createDataFrame([("same-mutation-different-policy",)], "protocol string").join(per, "protocol", "left_anti")
    none = known.select("protocol", F.lit(0).cast("long").alias("n_records"), F.lit(0).cast("long").alias("n_labels"), F.lit(True).alias("needed"))
    return per.unionByName(none).select("protocol", "n_records", "n_labels", (F.col("n_labels") >= LEAST_LABELS).alias("meaningful"), "needed")


def generalization(df: DataFrame, label: str, promotions: DataFrame | None = None) -> DataFrame:
    """The facts a generalisation benchmark rests on. df: family_id, dataset_role, policy_pack, mutation,
    root_object_profile, oracle_outcome, oracle_stdout, pair_fingerprint, ``label`` (with promotions also evidence.KEYS).

    A null role is standard; a record without a mutation has no provenance and counts for families and policies only.
    """
    invariant = cut(invariant_changes(df, label, promotions), "invariant")
    rows = df.withColumn("_role", _role())
    here = lambda cond, c: F.countDistinct(F.when(cond, F.col(c)))
    optional = F.col("mutation") == OPTIONAL
    sides = {f"optional_{p}_{r}_families": here(optional & (F.col("root_object_profile") == p) & (F.col("_role") == r), "family_id").alias(f"optional_{p}_{r}_families") for p in PROFILES for r in ("standard", "challenge")}
    plain = rows.agg(
        F.sum(((F.col("oracle_outcome") == "breaking") & F.col("mutation").isNotNull() & (F.trim(F.coalesce("oracle_stdout", F.lit(""))) == "")).cast("int")).alias("breaking_without_decision"),
        here(F.col("_role") == "standard", "family_id").alias("standard_families"), F.sum((F.col("_role") == "challenge").cast("int")).alias("challenge_records"),
        F.sum(optional.cast("int")).alias("_optional"), F.sum((optional & ~F.coalesce(F.col("root_object_profile").isin(*PROFILES), F.lit(False))).cast("int")).alias("optional_without_profile"), *sides.values(),
    )
    facts = _long(plain, {
        "breaking_without_decision": F.col("breaking_without_decision") > 0, "standard_families": F.col("standard_families") < LEAST_FAMILIES, "challenge_records": F.coalesce("challenge_records", F.lit(0)) == 0,
        "optional_without_profile": F.col("optional_without_profile") > 0, **{n: (F.col("_optional") > 0) & (F.col(n) == 0) for n in sides},
    })

    def leaked(column: str, name: str) -> DataFrame:
        both = rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.countDistinct("_role").alias("k")).filter("k > 1")
        return _long(both.agg(F.count(F.lit(1)).alias(name)), {name: F.col(name) > 0})

    pairs = rows.filter("mutation is not null").groupBy("family_id", "mutation").agg(F.countDistinct("policy_pack").alias("k"))
    pair = pairs.agg(F.count(F.lit(1)).alias("family_changes"), F.sum((F.col("k") >= LEAST_POLICIES).cast("int")).alias("complete_counterfactuals"))
    risks = shortcut_risks(df, label, invariant).agg(F.count(F.lit(1)).alias("shortcut_risks"))
    dull = challenge_protocols(df, label, invariant).filter("needed and not meaningful").agg(F.count(F.lit(1)).alias("unmeaningful_protocols"))
    return (
        facts.unionByName(leaked("family_id", "leaked_families")).unionByName(leaked("pair_fingerprint", "leaked_pairs"))
        .unionByName(_long(pair, {"family_changes": F.col("family_changes") == 0, "complete_counterfactuals": (F.col("family_changes") > 0) & (F.coalesce("complete_counterfactuals", F.lit(0)) == 0)}))
        .unionByName(_long(risks, {"shortcut_risks": F.col("shortcut_risks") > 0})).unionByName(_long(dull, {"unmeaningful_protocols": F.col("unmeaningful_protocols") > 0}))
    )


def training(df: DataFrame, group: str, label: str, three_way: bool, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """The facts a grouped training run rests on: standard groups, classes, and whether a split of whole groups exists.
    Records of a null group are in no split; a null label counts as none."""
    rows = df.withColumn("_role", _role()).withColumn("_label", F.lower(F.trim(F.col(label))))
    std = F.col("_role") == "standard"
    of = lambda c: F.sum((std & (F.col("_label") == c)).cast("int")).alias(c)
    plain = cut(rows.agg(F.countDistinct(F.when(std, F.col(group))).alias("standard_groups"), of("safe"), of("warning"), of("breaking")), "training-facts")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("safe", "warning", "breaking")}
    facts = _long(plain, {"standard_groups": F.col("standard_groups") < LEAST_FAMILIES, "safe": n["safe"] == 0, "warning": F.lit(three_way) & (n["warning"] == 0), "breaking": n["breaking"] == 0})
    if (plain.first()["standard_groups"] or 0) < 3:
        none = df.sparkSession.createDataFrame([("partitions", 0, True)], "fact string, value long, failed boolean")
        return facts.unionByName(none)
    placed = group_split(rows, group, F.col("_label"), F.col("_role"), ratios, seed)
    parts = rows.filter(std).join(placed, group).groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    twice = placed.groupBy(group).agg(F.countDistinct("partition").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("leaked_groups"))
    found = parts.agg(F.count(F.lit(1)).alias("partitions"))
    sized = parts.select(F.concat(F.col("partition"), F.lit("_records")).alias("fact"), F.col("n").alias("value"), F.lit(False).alias("failed"))
    return facts.unionByName(sized).unionByName(_long(found, {"partitions": F.col("partitions") < 3})).unionByName(_long(twice, {"leaked_groups": F.col("leaked_groups") > 0}))


def required(facts: DataFrame, what: str) -> None:
    """Refuses with the facts that failed."""
    failed = [f"{r['fact']}={r['value']}" for r in facts.filter("failed").orderBy("fact").collect()]  # a few named facts
    if failed:
        raise ValueError(f"{what} is not ready: {', '.join(failed)}")
