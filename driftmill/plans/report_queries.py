"""Queries of readiness, operation classes, component joins, projections, replays and manifests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.functions import hashing, labels, signatures, vectors
from driftmill.operators import audit, candidates, external, integrity, matrices, metrics, models, policy, readiness, reports, retention, splitting
from driftmill.plans import commands, schema_sql
from driftmill.plans.feature_queries import EPOCHS, MODES, SEEDS, hashed_split, pairs_once, protocol_records
from driftmill.plans.record_queries import REC, ROLE, records
from driftmill.plans.registry import Registry
from driftmill.runtime import cut, table
from driftmill.sources import fixtures

_PROTOCOLS = (
    f", ch as (select * from rec where {ROLE} = 'challenge'), x as (select 'held-out-policy:' || policy_pack as protocol, compatibility_label as label from ch where policy_pack is not null "
    "union all select 'held-out-mutation:' || mutation, compatibility_label from ch where mutation is not null "
    "union all select 'same-mutation-different-policy', compatibility_label from ch where (family_id, mutation) in (select (family_id, mutation) from ch where mutation is not null and family_id is not null group by family_id, mutation having count(distinct policy_pack) >= 2)), "
    "pr as (select protocol, count(*) as n_records, count(distinct label) as n_labels from x group by 1 union all select 'same-mutation-different-policy', 0, 0 where 'same-mutation-different-policy' not in (select protocol from x))"
)
_SIDES = [(p, r) for p in readiness.PROFILES for r in ("standard", "challenge")]
_OPT = "mutation = 'optional_field_added'"
GENERAL = (
    REC + _PROTOCOLS + f", t as (select *, {ROLE} as role from rec), pol as (select policy_pack, count(distinct compatibility_label) as k, bool_or(mutation is not null) as has from t where policy_pack is not null group by 1), "
    "chg as (select mutation, count(distinct compatibility_label) as k, count(distinct policy_pack) as p from t where mutation is not null group by 1), fc as (select family_id, mutation, count(distinct policy_pack) as k from t where mutation is not null group by 1, 2), "
    "a as (select count(*) filter (oracle_outcome = 'breaking' and mutation is not null and trim(coalesce(oracle_stdout, '')) = '') as bd, count(distinct case when role = 'standard' then family_id end) as sf, count(*) filter (role = 'challenge') as cr, "
    f"count(*) filter ({_OPT}) as o, count(*) filter ({_OPT} and coalesce(root_object_profile, '') not in ('open', 'closed')) as owp, "
    + ", ".join(f"count(distinct case when {_OPT} and root_object_profile = '{p}' and role = '{r}' then family_id end) as {p}_{r}" for p, r in _SIDES)
    + " from t), risk as (select (select count(*) from pol where k = 1 and has) + (select count(*) from chg where k = 1) + (select count(*) from chg where p < 3) as n), "
    "lf as (select count(*) as n from (select family_id from t where family_id is not null and family_id <> '' group by 1 having count(distinct role) > 1)), lp as (select count(*) as n from (select pair_fingerprint from t where pair_fingerprint is not null and pair_fingerprint <> '' group by 1 having count(distinct role) > 1)) "
    "select 'breaking_without_decision' as fact, bd as value, bd > 0 as failed from a union all select 'standard_families', sf, sf < 3 from a union all select 'challenge_records', cr, cr = 0 from a union all select 'optional_without_profile', owp, owp > 0 from a "
    + " ".join(f"union all select 'optional_{p}_{r}_families', {p}_{r}, o > 0 and {p}_{r} = 0 from a" for p, r in _SIDES)
    + " union all select 'leaked_families', n, n > 0 from lf union all select 'leaked_pairs', n, n > 0 from lp union all select 'family_changes', count(*), count(*) = 0 from fc "
    "union all select 'complete_counterfactuals', count(*) filter (k >= 3), count(*) > 0 and count(*) filter (k >= 3) = 0 from fc union all select 'shortcut_risks', n, n > 0 from risk union all select 'unmeaningful_protocols', count(*), count(*) > 0 from pr where n_labels < 2"
)
_STATUS = "case when not list_contains(map_keys(bp), name) then 'added' when not list_contains(map_keys(cp), name) then 'removed' when {same} then 'same' else 'changed' end"
_EACH = f"from_json({{x}}[name], {schema_sql._MAP})"
_SAME = f"{schema_sql.canonical(_EACH.format(x='bp'))} = {schema_sql.canonical(_EACH.format(x='cp'))}"
COMPONENTS = schema_sql.PAIRS + f", e as (select pair_no, unnest(list_distinct(list_concat(map_keys(bp), map_keys(cp)))) as name, bp, cp from m) select pair_no, name as component, {_STATUS.format(same=_SAME)} as status from e"
_META, _CON = ", ".join(map(repr, candidates.METADATA)), ", ".join(map(repr, (*candidates.CONSTRAINTS, "required")))
#: Operations on members at any depth.
OPERATIONS = (
    schema_sql.PAIRS.replace("with p as", "with recursive p as")
    + f", node as (select pair_no, []::varchar[] as path, bt::json as l, ct::json as r from d union all select pair_no, list_append(path, k), lm[k], rm[k] from (select pair_no, path, lm, rm, unnest(list_distinct(list_concat(map_keys(lm), map_keys(rm)))) as k "
    f"from (select pair_no, path, from_json(l, {schema_sql._MAP}) as lm, from_json(r, {schema_sql._MAP}) as rm from node where json_type(l) = 'OBJECT' and json_type(r) = 'OBJECT'))), "
    "op as (select pair_no, path, case when l is null then 'add' when r is null then 'remove' else 'change' end as operation from node where l::varchar is distinct from r::varchar and not (coalesce(json_type(l), '') = 'OBJECT' and coalesce(json_type(r), '') = 'OBJECT'))"
)
CLASSES = OPERATIONS + (
    f", kind as (select pair_no, case when len(list_filter(path, lambda v: v in ({_META}))) > 0 then null when len(path) >= 2 and path[-2] = 'properties' and path[-1] <> 'properties' and operation = 'add' then 'FIELD_ADDED' when len(path) >= 2 and path[-2] = 'properties' and path[-1] <> 'properties' and operation = 'remove' then 'FIELD_REMOVED' "
    f"when path[-1] = 'type' and operation = 'change' then 'TYPE_CHANGED' when path[-1] = 'enum' then 'ENUM_CHANGED' when path[-1] in ({_CON}) then 'CONSTRAINT_OR_RESTRICTION_CHANGED' else 'UNMAPPED' end as kind from op), "
    "u as (select pair_no, count(*) as n_operations, count(kind) as n, list_aggregate(list_sort(list_distinct(list(kind))), 'string_agg', ',') as kinds from kind group by 1) "
    "select pair_no, n_operations, case when n = 0 then 'METADATA_ONLY' when n > 1 then 'COMPOUND' when kinds = 'UNMAPPED' then 'UNMAPPED_SINGLE_CHANGE' else kinds end as decision, coalesce(kinds, '') as kinds from u"
)
_CURRENT = "with l as (select * from invocation_log qualify row_number() over (partition by invocation_no order by recorded_at desc) = 1)"
REPLAY = _CURRENT + ", r as (select invocation_no, expected_v9_outcome is not distinct from actual_v10_outcome as outcome_match, expected_stdout_sha256 is not distinct from actual_stdout_sha256 as stdout_match, coalesce(stderr_empty, false) as stderr_empty, true as found from l)"
_BLANK = "coalesce(trim({c}), '') = ''"
MANIFEST = (
    REC + ", f as (select record_id, coalesce(family_id, '') as family_id, coalesce(contract_id, '') as contract_id, coalesce(policy_pack, '') as policy_pack, coalesce(mutation, '') as mutation_id, coalesce(source, '') as source, coalesce(dataset_role, '') as role from rec where record_id is not null), "
    "x as (" + " union all ".join(f"select record_id, 'blank {c}' as problem from f where trim({c}) = ''" for c in ("record_id", "source", "family_id", "contract_id", "policy_pack", "mutation_id"))
    + " union all select record_id, 'unknown external_use' from f where role <> 'challenge' union all select record_id, 'a public source needs a web address' from f where role = 'standard' union all select record_id, 'repeated record_id' from f group by record_id having count(*) > 1) select problem, count(*) as n from x group by 1"
)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as proposals of the generator: families by name, changes by record, in the order of packs."""
    rows = records(spark, sf_dir).filter("family_id is not null and mutation is not null and policy_pack is not null")
    first = rows.groupBy("family_id").agg(F.min("record_no").alias("seed_no"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, policy.NAMED_PACKS)), F.col("policy_pack")), F.lit(0))
    return rows.join(first, "family_id").select("seed_no", F.col("family_id").alias("seed_id"), F.col("record_no").cast("int").alias("ordinal"), F.col("mutation").alias("kind"), F.col("mutation_variant").alias("variant"), place.cast("int").alias("policy_no"), "policy_pack", F.col("oracle_outcome").alias("outcome"), F.coalesce("pair_fingerprint", F.col("record_no").cast("string")).alias("fingerprint"))


def register(r: Registry) -> None:
    @r.add("generalization_readiness", GENERAL)
    def generalization_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
        return readiness.generalization(cut(records(spark, sf_dir), "records"), "compatibility_label")

    @r.add("challenge_protocols", REC + _PROTOCOLS + " select protocol, n_records, n_labels, n_labels >= 2 as meaningful, true as needed from pr")
    def challenge_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        return readiness.challenge_protocols(rows, "compatibility_label", readiness.invariant_changes(rows, "compatibility_label", None))

    @r.add("training_readiness", REC + f", s as (select * from rec where {ROLE} = 'standard'), a as (select count(distinct split_group_id) as g, count(*) filter (split_group_id is not null) as n, count(*) filter (compatibility_label = 'safe') as s, count(*) filter (compatibility_label = 'warning') as w, count(*) filter (compatibility_label = 'breaking') as b from s) select 'standard_groups' as fact, g as value, g < 3 as failed from a union all select 'safe', s, s = 0 from a union all select 'warning', w, w = 0 from a union all select 'breaking', b, b = 0 from a union all select 'records', n, false from a union all select 'partitions', 3, false from a union all select 'leaked_groups', 0, false from a")
    def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How the groups fall is the greedy rule's; the records of the partitions are summed."""
        facts = readiness.training(records(spark, sf_dir), "split_group_id", "compatibility_label", True, (0.7, 0.15, 0.15), SEEDS[0])
        name = F.when(F.col("fact").endswith("_records"), "records").otherwise(F.col("fact"))
        return facts.groupBy(name.alias("fact")).agg(F.sum("value").alias("value"), F.max("failed").alias("failed"))

    @r.add("peer_variants", REC + ", v as (select distinct mutation, case when mutation = 'optional_field_added' then 'root-' || root_object_profile when trim(mutation_variant) <> '' then mutation_variant end as variant from rec where mutation is not null) select v.mutation, v.variant, (select count(*) from v w where w.mutation = v.mutation) > 1 as has_peer from v where v.variant is not null")
    def peer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.peer_variants(records(spark, sf_dir))

    @r.add("allowed_variants", REC + ", a as (select distinct contract_id, mutation_variant from rec where compatibility_label = 'safe' and contract_id is not null and mutation_variant is not null) select record_no from rec where (contract_id, mutation_variant) in (select (contract_id, mutation_variant) from a)")
    def allowed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir).withColumnsRenamed({"contract_id": "unique_id", "mutation_variant": "variant"})
        return candidates.allowed_variants(rows, rows.filter("compatibility_label = 'safe'")).select("record_no")

    @r.add("generator_retention")
    def generator_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
        return retention.report(retention.retain(_jobs(spark, sf_dir), 3, None, within_family=True, keep_variants=("enum_value_added",)))

    @r.add("component_join", COMPONENTS)
    def component_join(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.component_join(pairs_once(spark, sf_dir), ["pair_no"], "base_schema", "candidate_schema", "properties").select("pair_no", "component", "status")

    within = "kind as (select pair_no, path[2] as component, path[3:] as path, operation from op where len(path) > 2 and path[1] = 'properties')"

    @r.add("component_changes", OPERATIONS + ", " + within + CLASSES[len(OPERATIONS):].replace("(select pair_no, case", "(select pair_no, component, case").replace(" from op),", " from kind),").replace(", kind as", ", kinded as").replace("select pair_no, count(*) as n_operations", "select pair_no, component, count(*) as n_operations").replace("from kind group by 1)", "from kinded group by 1, 2)").replace("select pair_no, n_operations", "select pair_no, component, n_operations"))
    def component_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = cut(reports.component_join(pairs_once(spark, sf_dir), ["pair_no"], "base_schema", "candidate_schema", "properties"), "components")
        return reports.component_changes(joined, ["pair_no"]).withColumn("kinds", F.concat_ws(",", "kinds"))

    @r.add("operation_classes", CLASSES)
    def operation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
        ops = candidates.operation_table(pairs_once(spark, sf_dir), ["pair_no"], "base_schema", "candidate_schema")
        return candidates.classify_operations(ops, ["pair_no"]).withColumn("kinds", F.concat_ws(",", "kinds"))

    @r.add("schema_operations", OPERATIONS + " select pair_no, operation, list_aggregate(path, 'string_agg', '/') as path from op")
    def schema_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
        ops = candidates.operation_table(pairs_once(spark, sf_dir), ["pair_no"], "base_schema", "candidate_schema")
        return ops.select("pair_no", "operation", F.concat_ws("/", "path").alias("path"))

    @r.add("overlap_projection", f"select challenge_record_id as record_id, training_record_id, structural_coordinate_distance as distance, coalesce(structural_coordinate_distance > 1, false) as accepted, case when coalesce(structural_coordinate_distance > 1, false) then '{reports.ACCEPT}' else '{reports.REJECT}' end as decision from near_duplicate_samples")
    def overlap_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "near_duplicate_samples").select(F.col("challenge_record_id").alias("record_id"), "training_record_id", F.col("structural_coordinate_distance").alias("distance"))
        return reports.projection(d)

    @r.add("projection_summary", "select count(*) as candidate_count, count(*) filter (structural_coordinate_distance > 1) as accepted_count, count(*) - count(*) filter (structural_coordinate_distance > 1) as rejected_count, case when count(*) filter (structural_coordinate_distance > 1) = 0 then 'NO_NON_OVERLAPPING_CANDIDATES' else 'NON_OVERLAPPING_CANDIDATES_FOUND' end as outcome from near_duplicate_samples")
    def projection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = table(spark, sf_dir, "near_duplicate_samples").select(F.col("challenge_record_id").alias("record_id"), F.col("structural_coordinate_distance").alias("distance"))
        return reports.projection_summary(reports.projection(d))

    @r.add("raw_traces", schema_sql.PAIRS + " select pair_no::varchar as record_id, json_extract_string(bt, '$.additionalProperties') as before, json_extract_string(ct, '$.additionalProperties') as after, length(ct)::int as candidate_length, 'traceability-only' as use from d")
    def raw_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pairs_once(spark, sf_dir).select(F.col("pair_no").cast("string").alias("record_id"), "base_schema", "candidate_schema")
        plain = lambda c: F.regexp_replace(c, r",(\s*[}\]])", "$1").alias(c)
        return reports.raw_traces(p.select("record_id", plain("base_schema"), plain("candidate_schema")), p.select("record_id", F.length("candidate_schema").alias("candidate_length")), "$.additionalProperties").drop("base_schema", "candidate_schema")

    def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = table(spark, sf_dir, "invocation_log")
        now = log.groupBy("invocation_no").agg(F.max(F.struct("recorded_at", "expected_v9_outcome", "expected_stdout_sha256", "actual_v10_outcome", "actual_stdout_sha256", "stderr_empty")).alias("x")).select("invocation_no", "x.*")
        told = now.select("invocation_no", F.col("expected_v9_outcome").alias("outcome"), F.col("expected_stdout_sha256").alias("stdout_sha256"))
        again = now.select("invocation_no", F.col("actual_v10_outcome").alias("outcome"), F.col("actual_stdout_sha256").alias("stdout_sha256"), F.when(F.col("stderr_empty"), "").otherwise("text").alias("stderr"))
        return reports.replay(told, again, "invocation_no")

    @r.add("replay_comparison", REPLAY + " select * from r")
    def replay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
        return replayed(spark, sf_dir)

    @r.add("replay_verdict", REPLAY + " select count(*) as invocations, count(*) filter (outcome_match) as outcome_matches, count(*) filter (stdout_match) as stdout_matches, count(*) filter (not stderr_empty) as stderr_nonempty, 0::bigint as missing, case when bool_and(outcome_match and stdout_match and stderr_empty) then 'COMPLETE' else 'INCOMPLETE' end as status from r")
    def replay_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.replay_verdict(replayed(spark, sf_dir))

    @r.add("manifest_problems", MANIFEST)
    def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir).filter("record_id is not null")
        fixed = {c: F.lit("x") for c in integrity.REQUIRED if c not in ("record_id", "source", "family_id", "contract_id", "policy_pack", "mutation_id")}
        role = F.coalesce("dataset_role", F.lit(""))
        m = rows.withColumns({**fixed, "mutation_id": F.col("mutation"), "external_use": F.when(role == "challenge", "accuracy-bearing").otherwise("?"), "source_kind": F.when(role == "standard", "public-version-history").otherwise("other")})
        return integrity.manifest_problems(m).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))

    @r.add("seed_reference", REC + ", s as (select hash(policy_pack) is not null as x, policy_pack as seed, count(*) as n, count(distinct family_id) as f from rec where policy_pack is not null group by 2) select seed, f % 2 = 0 as matches from s")
    def seed_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = records(spark, sf_dir).filter("policy_pack is not null").groupBy(F.col("policy_pack").alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("family_id").alias("f"))
        reference = runs.withColumn("n", F.when(F.col("f") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1))
        return reports.against_reference(runs, reference, ["n"])

    synthetic = ", ".join(f"('{x[0]}', {x[1]}.0, {dict(compatible=0.0, unknown=0.5, incompatible=1.0)[x[5]]}, {float(x[6])}, {x[8]}, {x[10]})" for x in fixtures.SYNTHETIC)

    @r.add("synthetic_examples", f"select contract_family, fields::double as fields, status::double as status, breaking_count::double as breaking_count, breaking_change::double as breaking_change, risk_score::double as risk_score from (values {synthetic}) t(contract_family, fields, status, breaking_count, breaking_change, risk_score)")
    def synthetic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = F.col("features")
        return fixtures.synthetic(spark).select("contract_family", f[0].alias("fields"), f[4].alias("status"), f[6].alias("breaking_count"), "breaking_change", "risk_score")

    made = "select name from (values " + ", ".join(f"('{v}')" for v in candidates.ADDED) + ") v(name)"

    @r.add("matched_optional", schema_sql.PAIRS + f", o as (select pair_no, row_number() over (order by pair_no) as k from d where json_type(c['properties']) is not null or json_type(b['properties']) = 'OBJECT') select pair_no::varchar as unique_id, profile, 'optional-' || name || '-field' as variant, {len(policy.NAMED_PACKS) * len(MODES)}::bigint as n from (select * from o where k <= 25), (values ('open'), ('closed')) p(profile), ({made})")
    def matched_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = pairs_once(spark, sf_dir).select(F.col("pair_no").alias("family_no"), F.col("pair_no").cast("string").alias("unique_id"), F.col("base_schema").alias("json_schema"))
        return commands.matched_optional(s, list(policy.NAMED_PACKS), list(MODES), 25).groupBy("unique_id", "profile", "variant").agg(F.count(F.lit(1)).alias("n"))

    @r.add("matrix_product", "with a as (select l_suppkey as r, l_linenumber as c, sum(l_quantity) as v from lineitem group by 1, 2) select x.r as row, y.r as col, round(sum(x.v * y.v), 2) as value from a x join a y on x.c = y.c where x.r <= 20 group by 1, 2")
    def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.sum("l_quantity").alias("value"))
        return matrices.multiply(a.filter("row <= 20"), matrices.transpose(a)).withColumn("value", F.round("value", 2))

    @r.add("binary_experiment")
    def binary_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = protocol_records(spark, sf_dir)
        rows = cut(rows.withColumn("target", F.array((F.col("label") == "breaking").cast("double"))), "binary-records")
        splits = None
        for seed in SEEDS:
            part = hashed_split(rows, seed).withColumn("seed", F.lit(seed))
            splits = part if splits is None else splits.unionByName(part)
        return models.binary_experiment(rows, splits, "family_id", "record_no", epochs=EPOCHS)

    types = "('null', 'boolean', 'object', 'array', 'number', 'string', 'integer')"
    nodes = f", n as (select pair_no, b as n from d union all select pair_no, x from (select pair_no, from_json(bp[k], {schema_sql._MAP}) as x from (select pair_no, bp, unnest(map_keys(bp)) as k from m)) union all select pair_no, from_json(x['items'], {schema_sql._MAP}) from (select pair_no, from_json(bp[k], {schema_sql._MAP}) as x from (select pair_no, bp, unnest(map_keys(bp)) as k from m)) where json_type(x['items']) = 'OBJECT')"

    @r.add("schema_admission", schema_sql.PAIRS + nodes + f" select pair_no, case when bool_or(n['type'] is not null and (n['type']->>'$') not in {types}) then 'INVALID_SCHEMA' when bool_or(n['type'] is null) then 'UNSUPPORTED_SCHEMA' end as error from n group by 1")
    def schema_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
        from driftmill.operators import admission

        return pairs_once(spark, sf_dir).select("pair_no", F.split_part(admission.admission(F.col("base_schema")), F.lit(":"), F.lit(1)).alias("error"))

    @r.add("source_profiles", schema_sql.PAIRS + " select case when json_type(b['properties']) = 'OBJECT' then case when b['additionalProperties']::varchar is not distinct from 'false' then 'closed' else 'open' end end as profile, count(*) as n from d group by 1")
    def source_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
        @F.pandas_udf("string")
        def profile(s: pd.Series) -> pd.Series:
            return s.map(candidates.root_profile)

        return pairs_once(spark, sf_dir).groupBy(profile("base_schema").alias("profile")).agg(F.count(F.lit(1)).alias("n"))

    @r.add("target_encodings", REC + " select record_no, case when compatibility_label = 'breaking' then 1.0::double when compatibility_label is not null then 0.0::double end as binary, case when compatibility_label = 'safe' then 0.0::double when compatibility_label = 'warning' then 0.5::double when compatibility_label = 'breaking' then 1.0::double end as risk, (record_no % 100 / 100.0 >= 0.5)::int as above, lower(trim(policy_pack)) as pack, upper(replace(trim(mutation), '-', '_')) as rule, sha256(coalesce(record_id, '')) as id_sha256, regexp_matches(coalesce(pair_fingerprint, ''), '^[0-9a-f]{64}$') as whole from rec")
    def target_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        label = F.col("compatibility_label")
        risk = labels.task_target("risk", labels.binary_target(label), labels.binary_target(label), labels.risk_target(label))
        binary = labels.task_target("breaking", labels.binary_target(label), F.lit(None), F.lit(None))
        return rows.select(
            "record_no", binary.alias("binary"), risk.alias("risk"), labels.above_threshold(F.col("record_no") % 100 / 100.0, 0.5).alias("above"), labels.pack_name(F.col("policy_pack")).alias("pack"), labels.rule_key(F.col("mutation")).alias("rule"),
            hashing.text_sha256(F.coalesce("record_id", F.lit(""))).alias("id_sha256"), hashing.is_sha256(F.coalesce("pair_fingerprint", F.lit(""))).alias("whole"),
        )

    _v = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), x as (select vec_id, v, list_transform(v[1:3], lambda a: exp(a - list_max(v[1:3]))) as w from e), s as (select vec_id, v, list_transform(w, lambda a: a / list_sum(w)) as p from x)"

    @r.add("loss_gradients", _v + " select vec_id, round(2 * (v[1] - v[2]) / 4, 6) as squared_first, round(2 * (v[4] - v[5]) / 4, 6) as squared_last, round(-1 / p[1], 4) as cross_first, round(p[2] * 0, 4) as cross_second from s")
    def loss_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        squared = vectors.squared_error_gradient(F.slice("v", 1, 4), F.slice("v", 2, 4))
        cross = vectors.cross_entropy_gradient(vectors.softmax(F.slice("v", 1, 3)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return e.select("vec_id", F.round(squared[0], 6).alias("squared_first"), F.round(squared[3], 6).alias("squared_last"), F.round(cross[0], 4).alias("cross_first"), F.round(F.abs(cross[1]), 4).alias("cross_second"))

    @r.add("named_coordinates", "with p as (select record_no, min(features) as f from prepared_records where len(features) = 76 group by 1) select record_no, i::int as place, name, f[i + 1] as value from p, (values (0, 'field_count'), (1, 'fields_added'), (65, 'optional_fields_added')) n(i, name)")
    def named_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "prepared_records").filter("size(features) = 76").groupBy("record_no").agg(F.min("features").alias("features"))
        names = spark.createDataFrame([(0, "field_count"), (1, "fields_added"), (65, "optional_fields_added")], "place int, name string")
        return signatures.named_coordinates(p, "record_no", "features", F.broadcast(names))  # three rows

    @r.add("feature_differences", "with p as (select record_no, min(features) as f from prepared_records where len(features) = 76 group by 1), q as (select min(f) as f from p), d as (select record_no as query_id, 0::bigint as base_id, unnest(range(76)) as i, p.f as a, q.f as b from p, q) select query_id, base_id, i::int as place, 'f' || i as name, a[i + 1] as \"left\", b[i + 1] as \"right\" from d where a[i + 1] is distinct from b[i + 1]")
    def feature_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Where each record departs from the least feature row."""
        p = table(spark, sf_dir, "prepared_records").filter("size(features) = 76").groupBy("record_no").agg(F.min("features").alias("a"))
        least = p.agg(F.min("a").alias("b"))
        pairs = p.join(F.broadcast(least)).select(F.col("record_no").alias("query_id"), F.lit(0).cast("long").alias("base_id"), "a", "b")  # one row
        return external.feature_diagnostic(pairs, "a", "b", [f"f{i}" for i in range(76)])

    @r.add("source_priorities", REC + " select contract_id, min(case when mutation = 'enum_value_added' then 0 else 1 end)::int as priority from rec where contract_id is not null and mutation is not null group by 1")
    def source_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir).filter("contract_id is not null and mutation is not null").withColumn("kind", F.col("mutation"))
        return splitting.source_priority(rows, "contract_id")

    @r.add("summed_confusion", "with inv as (select distinct * from invocation_log), x as (select lower(trim(policy_pack)) as policy_pack, lower(trim(expected_v9_outcome)) as actual, lower(trim(actual_v10_outcome)) as predicted, declared_mutation from inv), n as (select policy_pack, declared_mutation, actual, predicted, count(*) as n from x group by 1, 2, 3, 4) select policy_pack, actual, predicted, sum(n)::bigint as n from n group by 1, 2, 3")
    def summed_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = lambda c, n: F.lower(F.trim(c)).alias(n)
        x = table(spark, sf_dir, "invocation_log").distinct().select(f("policy_pack", "policy_pack"), f("expected_v9_outcome", "actual"), f("actual_v10_outcome", "predicted"), "declared_mutation")
        cells = x.groupBy("policy_pack", "declared_mutation", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
        return metrics.summed_confusion(cells, "policy_pack")
