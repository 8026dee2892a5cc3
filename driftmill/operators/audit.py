"""Audits of labelled records: counts, coverage, shortcuts, leakage, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.operators.skew import lookup


def statistics(df: DataFrame) -> DataFrame:
    """One row of counts over records."""
    role = F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard"))
    return df.agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("family_id").alias("n_families"), F.countDistinct("policy_pack").alias("n_policies"), F.countDistinct("mutation").alias("n_mutations"),
        F.sum(F.when(role == "standard", 1).otherwise(0)).alias("n_standard"), F.sum(F.when(role == "challenge", 1).otherwise(0)).alias("n_challenge"),
    )


def label_counts(df: DataFrame, first: str, second: str, label: str) -> DataFrame:
    """Records by first x label, second x label and both x label: three reports in one pass of grouping sets."""
    df.createOrReplaceTempView("_driftmill_labels")
    return df.sparkSession.sql(
        f"SELECT CASE WHEN grouping({second}) = 1 THEN '{first}' WHEN grouping({first}) = 1 THEN '{second}' ELSE '{first}:{second}' END AS report, {first}, {second}, {label} AS label, count(*) AS n "
        f"FROM _driftmill_labels GROUP BY GROUPING SETS (({first}, {label}), ({second}, {label}), ({first}, {second}, {label}))"
    )


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(label), F.lit("missing")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def counterfactual_pairs(df: DataFrame, least: int = 3) -> DataFrame:
    """Families and changes seen under at least ``least`` policies, counted by change."""
    groups = df.groupBy("family_id", "mutation").agg(F.countDistinct("policy_pack").alias("policies")).filter(F.col("policies") >= least)
    return groups.groupBy("mutation").agg(F.count(F.lit(1)).alias("n_complete"))


def shortcut_risks(df: DataFrame, label: str) -> DataFrame:
    """Policies and changes with one label only, and changes under fewer than three policies."""
    known = df.filter(F.col(label).isNotNull())
    one = lambda by: known.groupBy(F.col(by).alias("value")).agg(F.countDistinct(label).alias("k")).filter("k = 1").select(F.lit(f"{by} has one label").alias("risk"), "value")
    few = df.groupBy(F.col("mutation").alias("value")).agg(F.countDistinct("policy_pack").alias("k")).filter("k < 3").select(F.lit("mutation under fewer than 3 policies").alias("risk"), "value")
    return one("policy_pack").unionByName(one("mutation")).unionByName(few)


def invariant_exceptions(df: DataFrame, label: str, promoted: DataFrame) -> DataFrame:
    """Changes with one label whose promoted policies are all the generated ones. promoted: (mutation, policy_pack, rationale)."""
    made = df.groupBy("mutation").agg(F.countDistinct(label).alias("labels"), F.countDistinct("policy_pack").alias("generated"))
    said = promoted.groupBy("mutation").agg(F.countDistinct("rationale").alias("rationales"), F.countDistinct("policy_pack").alias("promoted"))
    return made.join(said, "mutation").filter("labels = 1 and rationales = 1 and promoted = generated").select("mutation", "generated")


def profile_coverage(df: DataFrame, profiles: tuple[str, ...] = ("open", "closed")) -> DataFrame:
    """Families and records of each profile, 0 where a profile has none."""
    grid = df.sparkSession.createDataFrame([(p,) for p in profiles], "profile string")
    n = df.groupBy(F.col("root_object_profile").alias("profile")).agg(F.countDistinct("family_id").alias("n_families"), F.count(F.lit(1)).alias("n_records"))
    return F.broadcast(grid).join(n, "profile", "left").select("profile", F.coalesce("n_families", F.lit(0)).alias("n_families"), F.coalesce("n_records", F.lit(0)).alias("n_records"))


def challenge_view(df: DataFrame, policy: str | None = None, mutation: str | None = None) -> DataFrame:
    """Challenge records, of one policy or change; none at all is an error for whoever needs some (``required``)."""
    out = df.filter(F.lower(F.trim("dataset_role")) == "challenge")
    if policy is not None:
        out = out.filter(F.col("policy_pack") == policy)
    return out if mutation is None else out.filter(F.col("mutation") == mutation)


def required(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no records for {what}")
    return df


def same_change_other_policy(df: DataFrame) -> DataFrame:
    """Challenge records whose family and change occur under at least two policies."""
    ch = df.filter(F.lower(F.trim("dataset_role")) == "challenge")
    many = ch.groupBy("family_id", "mutation").agg(F.countDistinct("policy_pack").alias("k")).filter("k >= 2").drop("k")
    return lookup(ch, many.withColumn("_many", F.lit(True)), ["family_id", "mutation"], "inner").drop("_many")


def standard_records(df: DataFrame, keep: Column | None = None) -> DataFrame:
    out = df.filter(F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard")) == "standard")
    return out if keep is None else out.filter(keep)


def without_held_out(df: DataFrame, column: str, value: str) -> DataFrame:
    """Records whose column is not the held-out value; those without provenance are kept."""
    return df.filter(F.col(column).isNull() | (F.col(column) != value))


def peer_variant_exists(df: DataFrame, mutation: str, variant: str) -> bool:
    """Whether training records hold the change in another structural variant (mutation_variant, or the root profile)."""
    from driftmill.functions.labels import variant_key

    key = variant_key(F.col("mutation"), F.col("root_object_profile"), F.col("mutation_variant"))
    return bool(df.filter((F.col("mutation") == mutation) & ~key.eqNullSafe(F.lit(variant))).limit(1).collect())


def peer_variants(df: DataFrame) -> DataFrame:
    """(mutation, variant, has_peer): ``peer_variant_exists`` for every variant of ``df`` at once."""
    from driftmill.functions.labels import variant_key

    rows = df.filter("mutation is not null").select("mutation", variant_key(F.col("mutation"), F.col("root_object_profile"), F.col("mutation_variant")).alias("variant")).distinct()
    n = rows.groupBy("mutation").agg(F.count(F.lit(1)).alias("_n"))
    return rows.filter("variant is not null").join(n, "mutation").select("mutation", "variant", (F.col("_n") > 1).alias("has_peer"))


def protocols(df: DataFrame) -> DataFrame:
    """(protocol): normal, each policy and each change held out, and paired policies, as the records allow."""
    p = df.filter("policy_pack is not null").select(F.concat(F.lit("held-out-policy:"), "policy_pack").alias("protocol")).distinct()
    m = df.filter("mutation is not null").select(F.concat(F.lit("held-out-mutation:"), "mutation").alias("protocol")).distinct()
    fixed = df.sparkSession.createDataFrame([("normal-family-split",), ("same-mutation-different-policy",)], "protocol string")
    return fixed.unionByName(p).unionByName(m)


def held_out_by(df: DataFrame) -> Column:
    """The protocols that hold a record out: its policy's, its change's and its structural variant's. The variant of an
    added optional field is its root object's profile. Columns ``mutation_variant`` and ``root_object_profile`` may be absent."""
    of = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    form = F.when(F.col("mutation") == "optional_field_added", F.concat(F.lit("root-"), of("root_object_profile"))).when(F.trim(of("mutation_variant")) != "", of("mutation_variant"))
    return F.array_compact(F.array(F.concat(F.lit("held-out-policy:"), "policy_pack"), F.concat(F.lit("held-out-mutation:"), "mutation"), F.concat(F.lit("held-out-mutation-variant:"), "mutation", F.lit(":"), form)))


def protocol_report(df: DataFrame, label: str) -> DataFrame:
    """Challenge records, families and labels of each held-out protocol; the records are read once."""
    ch = df.filter(F.lower(F.trim("dataset_role")) == "challenge")
    each = ch.select("family_id", label, F.explode(F.array_compact(F.array(F.concat(F.lit("held-out-policy:"), "policy_pack"), F.concat(F.lit("held-out-mutation:"), "mutation")))).alias("protocol"))
    return each.groupBy("protocol").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("family_id").alias("n_families"), F.countDistinct(label).alias("n_labels"))


def partition_counts(df: DataFrame, partition: str, *columns: str) -> DataFrame:
    """Records by partition and each of the columns."""
    each = df.select(partition, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(partition, "x.*")
    return each.groupBy(partition, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def overlap_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values both sides hold (leakage where it must be empty); null is no value."""
    a, b = (d.filter(F.col(column).isNotNull()).select(column) for d in (left, right))
    return a.intersect(b)


def leaked_groups(df: DataFrame, group: str, partition: str) -> DataFrame:
    """Groups with records in more than one partition."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(partition).alias("n_partitions")).filter("n_partitions > 1")


def missing_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of the left side that the right side lacks."""
    return left.filter(F.col(column).isNotNull()).select(column).subtract(right.filter(F.col(column).isNotNull()).select(column))


def policy_components(packs: DataFrame, held_out: str) -> DataFrame:
    """(rule, action) of a held-out pack that no other pack has: what a model cannot have learnt. packs: (pack, rule, action)."""
    held = packs.filter(F.col("pack") == held_out).select("rule", "action")
    return held.join(packs.filter(F.col("pack") != held_out).select("rule", "action").distinct(), ["rule", "action"], "left_anti")


def repeated(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after the first of their key, without ranking a hot key: its first row is found by an aggregate."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return lookup(df.filter(F.col(key).isNotNull()), first, [key], "inner").filter(F.col(order) > F.col("_first")).drop("_first")


def first_families(df: DataFrame, family: str, order: str, n: int) -> DataFrame:
    """Records of the first n families in order of appearance."""
    firsts = df.groupBy(family).agg(F.min(order).alias("_at")).orderBy("_at", family).limit(n).select(family)
    return df.join(firsts, family, "left_semi")


def declared_counts(df: DataFrame, column: str, declared: DataFrame) -> DataFrame:
    """Counted against declared (value, n_declared); only what disagrees."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_counted"))
    return n.join(declared, "value", "full_outer").filter(~F.coalesce("n_counted", F.lit(0)).eqNullSafe(F.coalesce("n_declared", F.lit(0))))


def provenance_gate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(field, n_values, passed): each provenance column must hold exactly one value, the one supplied."""
    aggs = [F.struct(F.lit(c).alias("field"), F.countDistinct(c).alias("n_values"), F.max(c).alias("v"), F.lit(want).alias("want")) for c, want in columns.items()]
    one = df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x"))
    return one.select("x.field", "x.n_values", F.coalesce((F.col("x.n_values") == 1) & (F.col("x.v") == F.col("x.want")), F.lit(False)).alias("passed"))


def benchmark_ready(flag: bool | None) -> None:
    """Absent and false both refuse."""
    if flag is not True:
        raise ValueError("the data set is not marked as benchmark ready")
