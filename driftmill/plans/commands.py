"""The reference's commands as functions of DataFrames. Each composes operators; none starts a process or a server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmill.functions import hashing, labels
from driftmill.operators import admission, audit, candidates, evidence, external, models, policy, readiness, reports, retention, schema_diff, similarity, splitting
from driftmill.runtime import cut


def generate(schemas: DataFrame, packs: DataFrame, modes: list[str], recorded: DataFrame | None, challenge_ratio: float, seed: int, per_stratum: int | None = None, kinds: tuple[str, ...] = (), allowed: DataFrame | None = None) -> DataFrame:
    """Labelled, featured records of (unique_id, json_schema): every candidate under every pack and mode.

    ``recorded`` (pair_fingerprint, outcome) holds the oracle's answers; without one for a pair, the label is a heuristic
    from the active rules and says so in label_source. Repeated fingerprints keep their first candidate. ``kinds`` keeps
    some changes only, ``allowed`` (unique_id, variant) the variants listed for a schema; one that is not listed has none.
    """
    names = [r["pack"] for r in packs.select("pack").distinct().collect()]  # a policy file's packs
    # fingerprints of one pack and mode repeat only where a whole schema does, and no change gives what another one gives: the
    # first is found before packs and modes multiply the rows, among schemas, or among what is allowed of them
    base = F.sha2(F.coalesce(hashing.canonical_json(F.col("json_schema")), F.col("json_schema")), 256)
    known = schemas.select("unique_id", "json_schema", base.alias("_base"))
    own = ["unique_id", "ordinal", "kind", "variant"]
    if allowed is None:
        known = known.groupBy("_base").agg(F.min(F.struct("unique_id", "json_schema")).alias("_x")).select("_x.*")
        c = candidates.candidate_table(known, ["unique_id", "json_schema"], "json_schema")
    else:
        c = candidates.allowed_variants(candidates.candidate_table(known, ["unique_id", "json_schema", "_base"], "json_schema"), allowed)
        c = c.groupBy("_base", "variant").agg(F.min(F.struct("unique_id", "ordinal", "kind", "json_schema", "candidate")).alias("_x")).select("_x.*", "variant")
    if kinds:
        c = c.filter(F.col("kind").isin(*kinds))
    # what does not depend on pack and mode is made once for a candidate, features once for a candidate and pack
    c = schema_diff.measured(c, [*own, "json_schema", "candidate"], "json_schema", "candidate", "v6")
    c = c.select(*own, "_s", "_r", "_more", hashing.canonical_json(F.col("json_schema")).alias("_b"), hashing.canonical_json(F.col("candidate")).alias("_c"), F.when(hashing.is_reserved(F.col("unique_id"), challenge_ratio, seed=seed), "challenge").otherwise("standard").alias("dataset_role"))
    c = c.withColumn("policy_pack", F.explode(F.array(*map(F.lit, names))))
    f = schema_diff.featured(c, [*own, "policy_pack", "dataset_role", "_b", "_c"], "v6", "policy_pack", policy.action_rows(packs))
    f = f.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    f = f.withColumn("pair_fingerprint", hashing.pair_fingerprint(F.col("_b"), F.col("_c"), F.col("policy_pack"), F.col("mode"), F.lit("recorded")))
    f = f.select(*own, "policy_pack", "mode", "pair_fingerprint", "dataset_role", "features")
    if per_stratum is not None:
        f = splitting.quota(f, ["unique_id", "kind", "policy_pack"], ["ordinal", "mode"], per_stratum)
    guess = F.when(F.col("features")[61] > 0, "breaking").when(F.col("features")[60] > 0, "warning").otherwise("safe")
    if recorded is None:
        return f.withColumn("compatibility_label", guess).withColumn("label_source", F.lit("heuristic"))
    known = recorded.groupBy("pair_fingerprint").agg(F.min("outcome").alias("outcome"))
    told = labels.outcome_label(F.col("outcome"))
    return f.join(known, "pair_fingerprint", "left").withColumn("label_source", F.when(told.isNotNull(), "recorded").otherwise("heuristic")).withColumn("compatibility_label", F.coalesce(told, guess)).drop("outcome")


def retained(made: DataFrame, seed_order: str, policies: list[str], per_stratum: int | None, per_outcome: int | None = None, within_family: bool = False, keep_variants: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, report) of ``generate`` under the generator's own caps, families in order of ``seed_order``, each change
    under ``policies`` in their order. The report counts what was kept, repeated, over quota and not reached."""
    place = F.array_position(F.array(*map(F.lit, policies)), F.col("policy_pack"))
    rows = made.select(F.col(seed_order).cast("long").alias("seed_no"), F.col("unique_id").alias("seed_id"), "ordinal", "kind", "variant", place.cast("int").alias("policy_no"), "policy_pack", F.col("compatibility_label").alias("outcome"), F.col("pair_fingerprint").alias("fingerprint"))
    told = cut(retention.retain(rows, per_stratum, per_outcome, within_family, keep_variants), "retained")
    kept = told.filter("decision = 'retained'").select(F.col("seed_no").alias("_s"), F.col("ordinal").alias("_o"), F.col("policy_no").alias("_p"))
    on = (F.col(seed_order).cast("long") == F.col("_s")) & (F.col("ordinal") == F.col("_o")) & (place == F.col("_p"))
    return made.join(kept, on, "left_semi"), retention.report(told)


def refeature(records: DataFrame, schemas: DataFrame, packs: DataFrame, oracle: str | None = None) -> DataFrame:
    """Records with v6 features made anew, labels kept. records: record_id, family_id, kind, variant, policy_pack, and
    anything else; a family without a schema or a change that no longer applies is an error. With ``oracle`` (its identity,
    which all records must share as oracle_hash) also records whose pair_fingerprint (under their mode) is not that of the
    rebuilt pair. Where policy_pack is an array, a record stands for one under each of its packs."""
    if oracle is not None:
        from driftmill.operators.integrity import one_identity

        if one_identity(records, "oracle_hash") != oracle:
            raise ValueError("the records come from another oracle")
    made = candidates.candidate_table(schemas.select(F.col("unique_id").alias("family_id"), "json_schema"), ["family_id", "json_schema"], "json_schema")
    # a candidate is parsed and measured once, however many records there are of it; the texts go along only where they are compared
    texts = [] if oracle is None else ["json_schema", "candidate"]
    on, values = ["family_id", "kind", "variant"], ["_s", "_r", "_more", *texts]
    made = schema_diff.measured(made, [*on, "ordinal", *texts], "json_schema", "candidate", "v6")
    made = made.groupBy(*on).agg(F.min_by(F.struct(*values, F.lit(True).alias("_made")), "ordinal").alias("x")).select(*on, "x.*")
    # never broadcast: the planner takes what Python multiplied for smaller than its input, and would send it all to the driver
    joined = records.drop("features").join(made.hint("merge"), on, "left")
    lost = F.raise_error(F.concat(F.lit("no candidate for record "), "record_id")).cast("array<double>")
    joined = joined.withColumn("_s", F.when(F.col("_made").isNull(), lost).otherwise(F.col("_s")))
    if isinstance(records.schema["policy_pack"].dataType, T.ArrayType):  # packs multiply the rows once nothing moves them any more
        joined = joined.withColumn("policy_pack", F.explode_outer("policy_pack"))
    if oracle is not None:
        made_of = hashing.pair_fingerprint(hashing.canonical_json(F.col("json_schema")), hashing.canonical_json(F.col("candidate")), F.col("policy_pack"), F.col("mode"), F.lit(oracle))
        differs = F.raise_error(F.concat(F.lit("another pair than that of record "), "record_id")).cast("string")
        joined = joined.withColumn("pair_fingerprint", F.when(made_of.eqNullSafe(F.col("pair_fingerprint")), F.col("pair_fingerprint")).otherwise(differs))
    keep = [c for c in joined.columns if c not in (*values, "_made")]
    return schema_diff.featured(joined, keep, "v6", "policy_pack", policy.action_rows(packs))


def audit_report(records: DataFrame, label: str) -> dict[str, DataFrame]:
    return {
        "statistics": audit.statistics(records), "labels": audit.label_counts(records, "policy_pack", "mutation", label), "pairs": audit.counterfactual_pairs(records),
        "shortcuts": audit.shortcut_risks(records, label), "profiles": audit.profile_coverage(records), "readiness": readiness.generalization(records, label), "protocols": audit.protocol_report(records, label),
    }


def coverage_status(records: DataFrame, label: str, min_records: int, min_standard_families: int, min_challenge_families: int, min_pairs: int, per_profile: tuple[int, int] | None = None, gate: bool = False, promotions: DataFrame | None = None) -> DataFrame:
    """(target, reached, wanted, met) of a generation run. ``per_profile``: least standard and challenge families with an
    added optional field of each root profile. With ``gate`` the facts of readiness.generalization that failed are rows too."""
    role = F.coalesce("dataset_role", F.lit("standard"))
    profiled = {f"optional_{p}_{r}_families": F.countDistinct(F.when((F.col("mutation") == "optional_field_added") & (F.col("root_object_profile") == p) & (role == r), F.col("family_id"))).alias(f"optional_{p}_{r}_families") for p in readiness.PROFILES for r in ("standard", "challenge")} if per_profile else {}
    a = records.agg(F.count(F.lit(1)).alias("records"), F.countDistinct(F.when(role == "standard", F.col("family_id"))).alias("standard_families"), F.countDistinct(F.when(role == "challenge", F.col("family_id"))).alias("challenge_families"), *profiled.values())
    pairs = audit.counterfactual_pairs(records).agg(F.coalesce(F.sum("n_complete"), F.lit(0)).alias("complete_pairs"))
    wanted = {"records": min_records, "standard_families": min_standard_families, "challenge_families": min_challenge_families, **{n: per_profile[n.endswith("challenge_families")] for n in profiled}}
    one = lambda d, n, w: d.select(F.lit(n).alias("target"), F.col(n).cast("long").alias("reached"), F.lit(w).cast("long").alias("wanted"), (F.col(n) >= w).alias("met"))
    out = one(pairs, "complete_pairs", min_pairs)
    for n, w in wanted.items():
        out = out.unionByName(one(a, n, w))
    if gate:
        failed = readiness.generalization(records, label, promotions).filter("failed")
        out = out.unionByName(failed.select(F.concat(F.lit("gate: "), "fact").alias("target"), F.col("value").alias("reached"), F.lit(None).cast("long").alias("wanted"), F.lit(False).alias("met")))
    return out


def matched_optional(schemas: DataFrame, policies: list[str], modes: list[str], most: int, preflight: DataFrame | None = None) -> DataFrame:
    """(family_no, unique_id, profile, kind, variant, base_schema, candidate, policy_pack, mode): each schema as an open and
    as a closed base, with every optional field added, under each policy and mode. A family that a recorded preflight
    (family_id, outcome) rejects in any of its pairs takes no part; the first ``most`` of the others in order of family_no do.
    schemas: family_no, unique_id, json_schema."""
    if not policies or any(not p.strip() for p in policies) or not modes or most < 1:
        raise ValueError("policies, modes and families must be named")

    def bases(text: str | None) -> list[tuple[str, str]]:
        both = [(p, candidates.with_profile(text, p)) for p in readiness.PROFILES]
        return [(p, t) for p, t in both if t is not None]

    open_closed = candidates.generate_rows(schemas, ["family_no", "unique_id"], {"_t": "json_schema"}, "side int, profile string, base_schema string", bases).drop("side")
    c = candidates.candidate_table(open_closed, ["family_no", "unique_id", "profile", "base_schema"], "base_schema").filter("kind = 'optional_field_added'").drop("ordinal")
    if preflight is not None:
        c = evidence.admitted_families(preflight, c.withColumnRenamed("unique_id", "family_id")).withColumnRenamed("family_id", "unique_id")
    return evidence.matrix(audit.first_families(c, "unique_id", "family_no", most), policies, modes)


def oracle_conformance(runs: DataFrame, preflight: DataFrame | None = None, **thresholds: int) -> tuple[DataFrame, DataFrame]:
    """(cells, cross-policy) of recorded runs whose family no preflight rejected."""
    ok = runs if preflight is None else evidence.admitted_families(preflight, runs)
    return evidence.cells(ok, **thresholds), evidence.cross_policy(ok, **thresholds)


def reclassify_conformance(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    fixed = cut(evidence.reclassify_fatal(runs), "reclassified")
    return fixed, *oracle_conformance(fixed)


def merge_conformance(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    both = evidence.merge_runs(left, right)
    return both, *oracle_conformance(both)


def promote_invariants(runs: DataFrame, rationale: str) -> DataFrame:
    if not rationale.strip():
        raise ValueError("a promotion needs a rationale")
    return evidence.promote(*oracle_conformance(runs)).withColumn("rationale", F.lit(rationale))


def audit_forward_removals(runs: DataFrame) -> DataFrame:
    return admission.removal_audit(runs)


def audit_equivalence(expected: DataFrame, actual: DataFrame, key: str = "invocation_no") -> tuple[DataFrame, DataFrame]:
    """(comparisons, verdict) of recorded runs and their replay, row by row; see reports.replay."""
    compared = cut(reports.replay(expected, actual, key), "replay")
    return compared, reports.replay_verdict(compared)


def train(records: DataFrame, split: DataFrame, group: str, order: str, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), **how) -> dict[str, DataFrame]:
    """A binary run: model, metrics, threshold sweep and baselines. records as for models.pipeline, target an array of 1."""
    return models.pipeline(records, split, group, order, thresholds, **how)


def train_three_way(records: DataFrame, split: DataFrame, group: str, order: str, **how) -> dict[str, DataFrame]:
    """A three-way run: model, scores, accuracy by partition and the confusion of the test rows."""
    return models.pipeline(records, split, group, order, **how)


def evaluate_three_way_mutation(records: DataFrame, mutation: str, split: DataFrame, group: str, order: str, **how) -> DataFrame:
    return models.experiment(records, [f"held-out-mutation:{mutation}"], split, group, order, **how)


def run_binary_experiment(records: DataFrame, ratios: tuple[float, float, float], seeds: list[int], group: str, order: str, ready: bool | None, **how) -> DataFrame:
    """Metrics of a binary model for each seed on its test rows and on the challenge records; refuses data that is not
    marked ready or cannot be split."""
    audit.benchmark_ready(ready)
    facts = readiness.training(records.withColumn("dataset_role", F.col("role")), group, "label", False, ratios, seeds[0])
    readiness.required(facts, "binary training")
    splits = None
    for seed in seeds:
        part = splitting.group_split(records, group, F.col("label"), F.col("role"), ratios, seed).withColumn("seed", F.lit(seed))
        splits = part if splits is None else splits.unionByName(part)
    return models.binary_experiment(records, splits, group, order, **how)


def evaluate_protocols(records: DataFrame, protocols: list[str], split: DataFrame, group: str, order: str, **how) -> DataFrame:
    """Binary metrics of each protocol under a model of its own."""
    return models.binary_protocols(records, protocols, split, group, order, **how)


def run_experiments(records: DataFrame, protocols: list[str], ratios: tuple[float, float, float], seeds: list[int], group: str, order: str, ready: bool | None, **how) -> DataFrame:
    """(protocol, mean, least and greatest accuracy) over seeds; refuses data that is not marked ready."""
    audit.benchmark_ready(ready)
    readiness.required(readiness.training(records.withColumn("dataset_role", F.col("role")), group, "label", True, ratios, min(seeds)), "three-way training")
    out = None
    for seed in sorted(set(seeds)):
        split = splitting.group_split(records, group, F.col("label"), F.col("role"), ratios, seed)
        part = cut(models.experiment(records, protocols, split, group, order, **how), "seed")
        out = part if out is None else out.unionByName(part)
    from driftmill.operators.metrics import across_seeds

    return across_seeds(out, "protocol")


def feature_ablation(records: DataFrame, place: int, label: str) -> DataFrame:
    """How far one feature alone goes: the rule of its two buckets, and its accuracy."""
    from driftmill.operators.metrics import bucket_rule

    bucket = F.when(F.col("features")[place] > 0, "positive").otherwise("zero")
    rule = bucket_rule(records, bucket, label)
    return rule.agg(F.round(F.sum(F.greatest("ones", "zeros")) / F.sum(F.col("ones") + F.col("zeros")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n_buckets"))


def audit_near_duplicates(records: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    return similarity.near_duplicate_audit(records, most)


def preflight_external(manifest: DataFrame, corpus: DataFrame) -> DataFrame:
    return external.contamination(manifest, corpus)


def diagnose_external(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, limit: int) -> DataFrame:
    return similarity.nearest_listing(queries, base, query_id, base_id, limit)


def evaluate_external(manifest: DataFrame, corpus: DataFrame, scored_by: list[tuple[str, str]]) -> DataFrame:
    return external.evaluate(external.contamination(manifest, corpus), scored_by)


def generate_isolated(families: DataFrame, packs: list[str], directions: list[str]) -> DataFrame:
    """The optional-addition corpus in several directions, ids marked with theirs."""
    rows = admission.isolation_manifest(families, packs).withColumn("mode", F.explode(F.array(*map(F.lit, directions))))
    return rows.withColumn("record_id", F.concat_ws(":", "mode", "record_id"))


def promote_benchmark_ready(meta: DataFrame, facts: DataFrame) -> DataFrame:
    """Metadata stamped ready where no fact of readiness.generalization failed; otherwise refused with those that did."""
    readiness.required(facts, "the benchmark")
    return meta.withColumn("benchmark_ready", F.lit(True))


def shadow_predict(requests: DataFrame, keep: list[str], packs: DataFrame, scored_by: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(predictions, refusals) of (base_schema, candidate_schema, policy_pack): every model's own answer, none averaged;
    requests with schemas outside the contract are refused with their error."""
    told = cut(requests.withColumn("error", F.coalesce(admission.admission(F.col("base_schema")), admission.admission(F.col("candidate_schema")))), "requests")
    known = packs.select(F.col("pack").alias("_p")).distinct()
    told = told.join(F.broadcast(known), F.lower(F.trim("policy_pack")) == F.col("_p"), "left").withColumn("error", F.coalesce("error", F.when(F.col("_p").isNull(), F.lit("UNKNOWN_POLICY")))).drop("_p")
    ok = told.filter("error is null")
    rows = schema_diff.extract(ok, [*keep, "policy_pack"], "base_schema", "candidate_schema", "v6", "policy_pack", policy.action_rows(packs))
    answers = models.score(rows, keep, "features", scored_by).withColumn("predicted", labels.upper_label(F.col("predicted")))
    return answers, told.filter("error is not null").select(*keep, "error")


def health(scored_by: list[tuple[str, str]], wanted: int) -> bool:
    """Whether all models load and fit."""
    try:
        return len([models.from_artifact(t) for _, t in scored_by]) == wanted
    except (ValueError, KeyError):
        return False
