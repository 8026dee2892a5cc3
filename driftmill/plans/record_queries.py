"""Queries over evidence records: audits, coverage, evidence cells, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.functions import hashing, labels
from driftmill.operators import audit, evidence, metrics, policy, splitting
from driftmill.plans.registry import Registry
from driftmill.runtime import table

FIELDS = ("source", "family_id", "split_group_id", "contract_id", "dataset_role", "mutation", "mutation_variant", "root_object_profile", "policy_pack", "compatibility_mode", "compatibility_label", "oracle_outcome")
_COLS = ", ".join(f"min({'lower(trim(' + c + '))' if c not in ('family_id', 'source', 'split_group_id', 'contract_id') else c}) as {c}" for c in FIELDS)
REC = f"with rec as (select record_no, {_COLS}, min(oracle_stdout) as oracle_stdout, min(record_id) as record_id, min(pair_fingerprint) as pair_fingerprint from generation_evidence group by record_no)"
ROLE = "coalesce(dataset_role, 'standard')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with categories in one spelling."""
    fold = lambda c: F.min(F.col(c) if c in ("family_id", "source", "split_group_id", "contract_id") else F.lower(F.trim(c))).alias(c)
    return table(spark, sf_dir, "generation_evidence").groupBy("record_no").agg(*[fold(c) for c in FIELDS], F.min("oracle_stdout").alias("oracle_stdout"), F.min("record_id").alias("record_id"), F.min("pair_fingerprint").alias("pair_fingerprint"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("mutation is not null and policy_pack is not null and oracle_outcome is not null").select("family_id", "mutation", F.col("compatibility_mode").alias("mode"), "policy_pack", F.col("oracle_outcome").alias("outcome"))


RUNS = REC + ", runs as (select family_id, mutation, compatibility_mode as mode, policy_pack, oracle_outcome as outcome from rec where mutation is not null and policy_pack is not null and oracle_outcome is not null)"
CELLS = (
    RUNS + ", cell as (select mutation, mode, policy_pack, count(distinct case when outcome <> 'rejected' then family_id end) as families, count(*) as checks, count(*) filter (outcome <> 'rejected') as accepted, "
    "count(distinct outcome) filter (outcome <> 'rejected') as n_labels, min(outcome) filter (outcome <> 'rejected') as label from runs group by 1, 2, 3), "
    "crossed as (select mutation, mode, count(distinct family_id) as families, count(distinct policy_pack) as policies, count(*) as accepted, count(distinct outcome) as n_labels, min(outcome) as label from runs where outcome <> 'rejected' group by 1, 2)"
)
#: Low enough for the smallest tables to hold changes that are invariant.
THRESHOLDS = (1, 1, 1)


def register(r: Registry) -> None:
    @r.add("dataset_statistics", REC + f" select count(*) as n_records, count(distinct family_id) as n_families, count(distinct policy_pack) as n_policies, count(distinct mutation) as n_mutations, count(*) filter ({ROLE} = 'standard') as n_standard, count(*) filter ({ROLE} = 'challenge') as n_challenge from rec")
    def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.statistics(records(spark, sf_dir))

    @r.add("label_counts", REC + " select case grouping(policy_pack, mutation) when 1 then 'policy_pack' when 2 then 'mutation' else 'policy_pack:mutation' end as report, policy_pack, mutation, compatibility_label as label, count(*) as n from rec group by grouping sets ((policy_pack, compatibility_label), (mutation, compatibility_label), (policy_pack, mutation, compatibility_label))")
    def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.label_counts(records(spark, sf_dir), "policy_pack", "mutation", "compatibility_label")

    @r.add("label_distribution", REC + " select coalesce(compatibility_label, 'missing') as label, count(*) as n from rec group by 1")
    def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.label_distribution(records(spark, sf_dir), "compatibility_label")

    @r.add("counterfactual_pairs", REC + " select mutation, count(*) as n_complete from (select family_id, mutation from rec group by 1, 2 having count(distinct policy_pack) >= 3) group by 1")
    def counterfactual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.counterfactual_pairs(records(spark, sf_dir))

    @r.add("shortcut_risks", REC + ", known as (select * from rec where compatibility_label is not null) select 'policy_pack has one label' as risk, policy_pack as value from known group by 2 having count(distinct compatibility_label) = 1 union all select 'mutation has one label', mutation from known group by 2 having count(distinct compatibility_label) = 1 union all select 'mutation under fewer than 3 policies', mutation from rec group by 2 having count(distinct policy_pack) < 3")
    def shortcut_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.shortcut_risks(records(spark, sf_dir), "compatibility_label")

    @r.add("profile_coverage", REC + " select p.profile, coalesce(n_families, 0) as n_families, coalesce(n_records, 0) as n_records from (values ('open'), ('closed')) p(profile) left join (select root_object_profile as profile, count(distinct family_id) as n_families, count(*) as n_records from rec group by 1) n using (profile)")
    def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.profile_coverage(records(spark, sf_dir))

    @r.add("challenge_view", REC + " select policy_pack, count(*) as n from rec where dataset_role = 'challenge' and mutation = 'enum_value_added' group by 1")
    def challenge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.challenge_view(records(spark, sf_dir), mutation="enum_value_added").groupBy("policy_pack").agg(F.count(F.lit(1)).alias("n"))

    @r.add("paired_challenge", REC + ", ch as (select * from rec where dataset_role = 'challenge') select record_no, family_id, mutation, policy_pack from ch join (select family_id, mutation from ch group by 1, 2 having count(distinct policy_pack) >= 2) using (family_id, mutation)")
    def paired_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.same_change_other_policy(records(spark, sf_dir)).select("record_no", "family_id", "mutation", "policy_pack")

    @r.add("held_out_training", REC + f" select coalesce(mutation, 'none') as mutation, count(*) as n from rec where {ROLE} = 'standard' and (policy_pack is null or policy_pack <> 'strict') group by 1")
    def held_out_training(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = audit.without_held_out(audit.standard_records(records(spark, sf_dir)), "policy_pack", "strict")
        return kept.groupBy(F.coalesce("mutation", F.lit("none")).alias("mutation")).agg(F.count(F.lit(1)).alias("n"))

    @r.add("variant_challenge", REC + ", v as (select distinct case when mutation = 'optional_field_added' then 'root-' || root_object_profile when trim(mutation_variant) <> '' then mutation_variant end as variant_key, mutation from rec where dataset_role = 'challenge') select mutation, variant_key from v where variant_key is not null")
    def variant_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = labels.variant_key(F.col("mutation"), F.col("root_object_profile"), F.col("mutation_variant"))
        return audit.challenge_view(records(spark, sf_dir)).select("mutation", key.alias("variant_key")).filter("variant_key is not null").distinct()

    @r.add("protocol_report", REC + ", ch as (select * from rec where dataset_role = 'challenge'), x as (select 'held-out-policy:' || policy_pack as protocol, family_id, compatibility_label from ch union all select 'held-out-mutation:' || mutation, family_id, compatibility_label from ch) select protocol, count(*) as n_records, count(distinct family_id) as n_families, count(distinct compatibility_label) as n_labels from x where protocol is not null group by 1")
    def protocol_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.protocol_report(records(spark, sf_dir), "compatibility_label")

    @r.add("protocol_parts", REC + " select distinct 'held-out-mutation:' || mutation || ':' || mutation_variant as protocol, 'held-out-mutation' as kind, mutation as a, nullif(mutation_variant, '') as b from rec where mutation is not null and mutation_variant is not null")
    def protocol_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = records(spark, sf_dir).select(labels.protocol_name(F.lit("held-out-mutation"), F.col("mutation"), F.col("mutation_variant")).alias("protocol"), "mutation", "mutation_variant").filter("mutation is not null and mutation_variant is not null").select("protocol").distinct()
        return p.select("protocol", labels.protocol_parts(F.col("protocol")).alias("x")).select("protocol", "x.*")

    @r.add("partition_counts", REC + f", x as (select {ROLE} as partition, unnest(['compatibility_label', 'policy_pack', 'mutation']) as field, unnest([compatibility_label, policy_pack, mutation]) as value from rec) select partition, field, value, count(*) as n from x group by 1, 2, 3")
    def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.partition_counts(records(spark, sf_dir).withColumn("partition", F.coalesce("dataset_role", F.lit("standard"))), "partition", "compatibility_label", "policy_pack", "mutation")

    @r.add("family_leakage", REC + f" select family_id from rec where {ROLE} = 'standard' and family_id is not null intersect select family_id from rec where dataset_role = 'challenge' and family_id is not null")
    def family_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        return audit.overlap_values(audit.standard_records(rows), audit.challenge_view(rows), "family_id")

    @r.add("leaked_groups", REC + f" select split_group_id, count(distinct {ROLE}) as n_partitions from rec where split_group_id is not null group by 1 having count(distinct {ROLE}) > 1")
    def leaked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.leaked_groups(records(spark, sf_dir).withColumn("partition", F.coalesce("dataset_role", F.lit("standard"))), "split_group_id", "partition")

    @r.add("unsupported_policies", REC + f" select distinct policy_pack from rec where policy_pack is not null and policy_pack not in ({', '.join(repr(p) for p in list(policy.NAMED_PACKS)[:6])})")
    def unsupported_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.createDataFrame([(p,) for p in list(policy.NAMED_PACKS)[:6]], "policy_pack string")
        return audit.missing_values(records(spark, sf_dir), known, "policy_pack")

    packs = " union all ".join(f"select '{p}' as pack, '{rule}' as rule, '{o.get(rule, policy.DEFAULTS[rule])}' as action" for p, o in policy.NAMED_PACKS.items() for rule in policy.RULES)

    @r.add("policy_resolution", packs)
    def policy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
        return policy.resolve(spark, policy.NAMED_PACKS).select("pack", "rule", "action")

    @r.add("policy_identifiability", f"with p as ({packs}) select rule, action from p where pack = 'composition-enum-ignore-constraint-warning' except select rule, action from p where pack <> 'composition-enum-ignore-constraint-warning' and pack not like '%constraint-warning'")
    def policy_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
        resolved = policy.resolve(spark, policy.NAMED_PACKS).filter("pack = 'composition-enum-ignore-constraint-warning' or pack not like '%constraint-warning'")
        return audit.policy_components(resolved, "composition-enum-ignore-constraint-warning")

    @r.add("repeated_pairs", REC + " select record_no, pair_fingerprint from (select *, row_number() over (partition by pair_fingerprint order by record_no) as k from rec where pair_fingerprint is not null) where k > 1")
    def repeated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.repeated(records(spark, sf_dir), "pair_fingerprint", "record_no").select("record_no", "pair_fingerprint")

    @r.add("first_families", REC + " select family_id, count(*) as n from rec where family_id in (select family_id from rec where family_id is not null group by 1 order by min(record_no), 1 limit 25) group by 1")
    def first_families(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.first_families(records(spark, sf_dir).filter("family_id is not null"), "family_id", "record_no", 25).groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))

    @r.add("declared_counts", REC + ", n as (select mutation as value, count(*) as n_counted from rec group by 1), d as (select mutation as value, count(*) as n_declared from generation_evidence where mutation is not null group by 1) select coalesce(n.value, d.value) as value, n_counted, n_declared from n full join d on n.value = d.value where coalesce(n_counted, 0) <> coalesce(n_declared, 0)")
    def declared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        declared = table(spark, sf_dir, "generation_evidence").filter("mutation is not null").groupBy(F.col("mutation").alias("value")).agg(F.count(F.lit(1)).alias("n_declared"))
        return audit.declared_counts(records(spark, sf_dir), "mutation", declared)

    @r.add("provenance_gate", REC + " select 'compatibility_mode' as field, count(distinct compatibility_mode) as n_values, coalesce(count(distinct compatibility_mode) = 1 and max(compatibility_mode) = 'backward', false) as passed from rec union all select 'dataset_role', count(distinct dataset_role), coalesce(count(distinct dataset_role) = 1 and max(dataset_role) = 'standard', false) from rec")
    def provenance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audit.provenance_gate(records(spark, sf_dir), {"compatibility_mode": "backward", "dataset_role": "standard"})

    f, p, c = THRESHOLDS

    @r.add("evidence_cells", CELLS + f" select mutation, mode, policy_pack, families, checks, accepted, n_labels::int as n_labels, families >= {f} and accepted >= {-(-c // p)} and n_labels = 1 as invariant from cell")
    def evidence_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evidence.cells(_runs(spark, sf_dir), *THRESHOLDS).select("mutation", "mode", "policy_pack", "families", "checks", "accepted", F.size("labels").alias("n_labels"), "invariant")

    @r.add("cross_policy", CELLS + f" select mutation, mode, families, policies, accepted, n_labels::int as n_labels, n_labels = 1 and families >= {f} and policies >= {p} and accepted >= {c} as invariant from crossed")
    def cross_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evidence.cross_policy(_runs(spark, sf_dir), *THRESHOLDS).select("mutation", "mode", "families", "policies", "accepted", F.size("labels").alias("n_labels"), "invariant")

    @r.add("promotions", CELLS + f" select cell.mutation, cell.mode, cell.policy_pack, crossed.label, cell.families, cell.accepted as checks from cell join crossed on cell.mutation = crossed.mutation and cell.mode = crossed.mode where cell.accepted > 0 and crossed.n_labels = 1 and crossed.families >= {f} and crossed.policies >= {p} and crossed.accepted >= {c}")
    def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs = _runs(spark, sf_dir)
        return evidence.promote(evidence.cells(runs, *THRESHOLDS), evidence.cross_policy(runs, *THRESHOLDS))

    @r.add("invariant_exceptions", REC + " select m.mutation, generated from (select mutation, count(distinct compatibility_label) as l, count(distinct policy_pack) as generated from rec group by 1) m where l = 1 and m.mutation is not null")
    def invariant_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        promoted = rows.filter("mutation is not null and policy_pack is not null").select("mutation", "policy_pack").distinct().withColumn("rationale", F.lit("recorded"))
        return audit.invariant_exceptions(rows, "compatibility_label", promoted)

    @r.add("six_key_join", REC + ", j as (select record_no, mutation, compatibility_mode as mode, policy_pack, compatibility_label as label, source as oracle_hash, split_group_id as policy_hash from rec), pr as (select distinct mutation, mode, policy_pack, label, oracle_hash, policy_hash from j where record_no % 3 = 0) select promoted, count(*) as n from (select j.record_no, pr.label is not null as promoted from j left join pr on j.mutation = pr.mutation and j.mode = pr.mode and j.policy_pack = pr.policy_pack and j.label = pr.label and j.oracle_hash = pr.oracle_hash and j.policy_hash = pr.policy_hash) group by 1")
    def six_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
        j = records(spark, sf_dir).select("record_no", "mutation", F.col("compatibility_mode").alias("mode"), "policy_pack", F.col("compatibility_label").alias("label"), F.col("source").alias("oracle_hash"), F.col("split_group_id").alias("policy_hash"))
        promoted = j.filter("record_no % 3 = 0")  # a table of its own: which evidence was promoted
        return evidence.with_promotion(j, promoted).groupBy("promoted").agg(F.count(F.lit(1)).alias("n"))

    @r.add("reserve_missing", REC + f", t as (select *, {ROLE} as role from rec), s as (select mutation, compatibility_label, max((role = 'challenge')::int) as has, arg_min(family_id, record_no) filter (role = 'standard' and family_id is not null) as first from t where mutation is not null and compatibility_label is not null group by 1, 2), m as (select mutation from s group by 1 having count(*) > 1), moved as (select distinct first as family_id from s where mutation in (select mutation from m) and has = 0 and first is not null) select case when t.family_id in (select family_id from moved) then 'challenge' else role end as dataset_role, count(*) as n from t group by 1")
    def reserve_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splitting.reserve_missing(records(spark, sf_dir), "compatibility_label", "record_no").groupBy("dataset_role").agg(F.count(F.lit(1)).alias("n"))

    @r.add("quota_per_stratum", REC + " select record_no, mutation, policy_pack from (select *, row_number() over (partition by mutation, policy_pack order by record_no) as k from rec) where k <= 3")
    def quota_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splitting.quota(records(spark, sf_dir), ["mutation", "policy_pack"], ["record_no"], 3).select("record_no", "mutation", "policy_pack")

    @r.add("minibatches", REC + " select floor((row_number() over (order by record_no) - 1) / 16)::bigint as batch, record_no from rec")
    def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splitting.minibatches(records(spark, sf_dir).select("record_no"), ["record_no"], 16).select("batch", "record_no")

    @r.add("ordered_split", REC + ", n as (select count(*) as n from rec) select record_no, case when row_number() over (order by record_no) <= n - greatest(1, least(n - 1, floor(n * 0.2 + 0.5))) then 'train' else 'test' end as partition from rec, n")
    def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splitting.ordered_split(records(spark, sf_dir).select("record_no"), ["record_no"], 0.2).select("record_no", "partition")

    shuffled = (
        "with recursive rec as (select distinct record_no from generation_evidence), n as (select count(*) as n from rec), "
        "e as (select n, floor(0.7 * n) as a, floor(0.15 * n) as b, floor(0.15 * n) as c, 0.7::double * n - floor(0.7::double * n) as ra, 0.15::double * n - floor(0.15::double * n) as rb from n), "
        "z as (select n, (a + (n - a - b - c > 0 and ra > rb)::int + (n - a - b - c > 2)::int)::bigint as a, (b + (n - a - b - c > 1 + (ra > rb)::int)::int)::bigint as b from e), "
        "s(i, st, o) as (select n - 1, 20260826::uhugeint, range(0, n) from n union all select i - 1, t, list_transform(o, lambda x, k: case when k = i + 1 then o[j + 1] when k = j + 1 then o[i + 1] else x end) "
        "from (select i, o, t, (t % (i + 1)::uhugeint)::bigint as j from (select i, o, (st * 6364136223846793005::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint as t from s where i > 0))), "
        "w as (select unnest(o) as row_no, generate_subscripts(o, 1) as k from s where i = 0), x as (select record_no, row_number() over (order by record_no) - 1 as row_no from rec) "
        "select record_no, case when k <= z.a then 'train' when k <= z.a + z.b then 'validation' else 'test' end as partition from x join w using (row_no), z"
    )

    @r.add("seeded_split", shuffled)
    def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splitting.seeded_split(records(spark, sf_dir).select("record_no"), ["record_no"], (0.7, 0.15, 0.15), 20260826).select("record_no", "partition")

    #: The greedy assignment, a group at a time: sizes, groups and classes of the three splits so far.
    ratios, cls = (0.7, 0.15, 0.15), ("safe", "warning", "breaking")
    gain = lambda p: (
        f"((size[{p}] + n - want[{p}]) * (size[{p}] + n - want[{p}]) - (size[{p}] - want[{p}]) * (size[{p}] - want[{p}])) / want[{p}]"
        + "".join(f" + ((held[{3 * p - 2 + k}] + c[{k + 1}] - goal[{3 * p - 2 + k}]) * (held[{3 * p - 2 + k}] + c[{k + 1}] - goal[{3 * p - 2 + k}]) - (held[{3 * p - 2 + k}] - goal[{3 * p - 2 + k}]) * (held[{3 * p - 2 + k}] - goal[{3 * p - 2 + k}])) / goal[{3 * p - 2 + k}]" for k in range(3))
    )
    rank = "list_reduce(list_prepend((xor(20260826::ubigint, 14695981039346656037::ubigint))::hugeint, list_transform(range(0, octet_length(encode(family_id))), lambda i: ('0x' || substr(hex(encode(family_id)), i * 2 + 1, 2))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"
    greedy = (
        REC.replace("with rec as", "with recursive rec as") + f", t as (select family_id, {ROLE} as role, coalesce(compatibility_label, 'safe') as l from rec), a as (select count(*) as n, [{', '.join(f'count(*) filter (l = {c!r})' for c in cls)}] as k from t), "
        f"w as (select [{', '.join(f'greatest({r}::double * n, 1)' for r in ratios)}] as want, [{', '.join(f'greatest({r}::double * k[{i + 1}], 1)' for r in ratios for i in range(3))}] as goal from a), "
        f"g as (select family_id, count(*) as n, [{', '.join(f'count(*) filter (l = {c!r})' for c in cls)}] as c from t where role = 'standard' and family_id is not null group by 1), "
        f"o as (select *, row_number() over (order by n desc, {rank}) as i, count(*) over () as m from g), "
        "s(i, size, used, held, family_id, p) as (select 0::bigint, [0, 0, 0]::bigint[], [0, 0, 0]::bigint[], [0, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], null::varchar, 0::bigint union all "
        "select i, list_transform(size, lambda v, k: v + case when k = p then n else 0 end), list_transform(used, lambda v, k: v + (k = p)::bigint), list_transform(held, lambda v, k: v + case when (k - 1) // 3 + 1 = p then c[(k - 1) % 3 + 1] else 0 end), family_id, p from ("
        "select *, list_position(gains, list_min(gains)) as p from (select i, size, used, held, family_id, n, c, list_transform([1, 2, 3], lambda q: case when m - i + 1 <= len(list_filter(used, lambda u: u = 0)) and used[q] > 0 then 'infinity'::double else raw[q] end) as gains from ("
        f"select o.i, s.size, s.used, s.held, o.family_id, o.n, o.c, o.m, [{gain(1)}, {gain(2)}, {gain(3)}] as raw from s join o on o.i = s.i + 1, w)))) "
        "select family_id, ['train', 'validation', 'test'][p] as partition from s where p > 0"
    )

    @r.add("group_split", greedy)
    def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        return splitting.group_split(rows, "family_id", F.coalesce("compatibility_label", F.lit("safe")), F.coalesce("dataset_role", F.lit("standard")), (0.7, 0.15, 0.15), 20260826)

    @r.add("challenge_reserve", "select distinct family_id, (('0x' || substr(sha256('challenge-v1:20260826:' || family_id), 1, 16))::ubigint)::double / 18446744073709551615.0 < 0.2 as reserved from generation_evidence where family_id is not null")
    def challenge_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "generation_evidence").filter("family_id is not null").select("family_id").distinct()
        return e.select("family_id", hashing.is_reserved(F.col("family_id"), 0.2, "challenge-v1", 20260826).alias("reserved"))

    fnv = "list_reduce(list_prepend((xor({seed}::ubigint, 14695981039346656037::ubigint))::hugeint, list_transform(range(0, octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), i * 2 + 1, 2))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"

    @r.add("fnv_rank", f"select family_id, ({fnv.format(seed=7, c='family_id')})::varchar as family_rank from (select distinct family_id from generation_evidence where family_id is not null and family_id <> '')")
    def fnv_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "generation_evidence").filter("family_id is not null and family_id <> ''").select("family_id").distinct()
        return e.select("family_id", hashing.fnv_rank(F.col("family_id"), 7).cast("string").alias("family_rank"))

    @r.add("topk_sample", f"select contract_id from (select distinct contract_id from generation_evidence where trim(contract_id) <> '') order by {fnv.format(seed=3, c='contract_id')}, contract_id limit 100")
    def topk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "generation_evidence").filter("contract_id is not null").select("contract_id").distinct()
        return splitting.top_sample(e, "contract_id", 100, 3).select("contract_id")

    @r.add("balanced_sample", REC + f", c as (select record_id, min(root_object_profile) as p from rec where record_id is not null group by 1), k as (select record_id, p, row_number() over (partition by p order by {fnv.format(seed=5, c='record_id')}, record_id) as k from c where p in ('open', 'closed')) select record_id, p as root_object_profile from k where k <= 50")
    def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = records(spark, sf_dir).filter("record_id is not null").groupBy("record_id").agg(F.min("root_object_profile").alias("root_object_profile"))
        return splitting.balanced_sample(e, "record_id", "root_object_profile", 100, 5).select("record_id", "root_object_profile")

    @r.add("pair_fingerprint", "select distinct pair_no, sha256('base=' || base_schema || chr(10) || 'candidate=' || candidate_schema || chr(10) || 'policy=' || coalesce(policy_pack, '') || chr(10) || 'mode=backward' || chr(10) || 'oracle=recorded') as fingerprint from generated_pairs")
    def pair_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of the schema texts as they stand; canonical_json puts them in one form first."""
        g = table(spark, sf_dir, "generated_pairs")
        return g.select("pair_no", hashing.pair_fingerprint(F.col("base_schema"), F.col("candidate_schema"), F.coalesce("policy_pack", F.lit("")), F.lit("backward"), F.lit("recorded")).alias("fingerprint")).distinct()

    @r.add("record_labels", REC + " select record_no, coalesce(compatibility_label, case when oracle_outcome = 'breaking' then 'breaking' end, 'safe') as label, case coalesce(compatibility_label, case when oracle_outcome = 'breaking' then 'breaking' end, 'safe') when 'safe' then 0 when 'warning' then 1 when 'breaking' then 2 end as class_index, case coalesce(compatibility_label, case when oracle_outcome = 'breaking' then 'breaking' end, 'safe') when 'safe' then 0.0::double when 'warning' then 0.5::double when 'breaking' then 1.0::double end as risk, upper(compatibility_label) as shown from rec")
    def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
        label = labels.record_label(F.col("compatibility_label"), F.when(F.col("oracle_outcome") == "breaking", 1.0))
        return records(spark, sf_dir).select("record_no", label.alias("label"), labels.class_index(label).alias("class_index"), labels.risk_target(label).alias("risk"), labels.upper_label(F.col("compatibility_label")).alias("shown"))

    @r.add("stdout_classify", REC + " select record_no, list_filter(list_transform(string_split(coalesce(oracle_stdout, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] as first_line, ((length(oracle_stdout) - length(replace(oracle_stdout, 'rule', ''))) // 4)::int as n_rules from rec")
    def stdout_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).select("record_no", labels.first_diagnostic(F.lit(None).cast("string"), F.col("oracle_stdout")).alias("first_line"), F.when(F.col("oracle_stdout").isNotNull(), labels.occurrences(F.col("oracle_stdout"), "rule")).alias("n_rules"))

    @r.add("file_stems", "select distinct family_id, regexp_replace(family_id, '[^A-Za-z0-9]', '-', 'g') as stem from generation_evidence where family_id is not null")
    def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "generation_evidence").filter("family_id is not null").select("family_id", labels.file_stem(F.col("family_id")).alias("stem")).distinct()

    log = "with inv as (select distinct * from invocation_log), x as (select lower(trim(declared_mutation)) as declared_mutation, lower(trim(policy_pack)) as policy_pack, lower(trim(expected_v9_outcome)) as expected, lower(trim(actual_v10_outcome)) as actual, outcome_match from inv)"

    def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = lambda c: F.lower(F.trim(c))
        return table(spark, sf_dir, "invocation_log").distinct().select(f("declared_mutation").alias("declared_mutation"), f("policy_pack").alias("policy_pack"), f("expected_v9_outcome").alias("expected"), f("actual_v10_outcome").alias("actual"), "outcome_match")

    @r.add("confusion_3way", log + " select a.c as actual, p.c as predicted, (select count(*) from x where x.actual = a.c and x.expected = p.c) as n from (values ('safe'), ('warning'), ('breaking')) a(c), (values ('safe'), ('warning'), ('breaking')) p(c)")
    def confusion_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.confusion_cells(invocations(spark, sf_dir), "actual", "expected")

    @r.add("stratified_accuracy", log + " select case grouping(declared_mutation, policy_pack) when 3 then 'overall' when 1 then 'declared_mutation' when 2 then 'policy_pack' else 'declared_mutation:policy_pack' end as stratum, declared_mutation, policy_pack, count(*) as n, sum(case when expected = actual then 1 else 0 end)::bigint as n_correct, round(sum(case when expected = actual then 1 else 0 end) / count(*), 6) as accuracy from x group by grouping sets ((), (declared_mutation), (policy_pack), (declared_mutation, policy_pack))")
    def stratified_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.stratified_accuracy(invocations(spark, sf_dir), F.col("expected") == F.col("actual"), "declared_mutation", "policy_pack")

    b = log + ", m as (select count(*) filter (expected = 'breaking' and actual = 'breaking') as tp, count(*) filter (expected = 'breaking' and actual <> 'breaking') as fp, count(*) filter (expected <> 'breaking' and actual <> 'breaking') as tn, count(*) filter (expected <> 'breaking' and actual = 'breaking') as fn from x where expected is not null and actual is not null)"

    @r.add("binary_metrics", b + " select tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from m")
    def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = invocations(spark, sf_dir).filter("expected is not null and actual is not null")
        one = lambda c: (F.col(c) == "breaking").cast("int")
        return metrics.classification(metrics.confusion(x, one("expected"), one("actual"))).select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])

    @r.add("majority_baseline", log + ", m as (select count(*) as n, sum(case when actual = 'breaking' then 1 else 0 end) as ones from x where actual is not null) select n, case when 2 * ones > n then 1 else 0 end as majority, round(case when 2 * ones > n then ones else n - ones end / n, 6) as accuracy from m")
    def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = invocations(spark, sf_dir).filter("actual is not null")
        return metrics.majority_baseline(x, (F.col("actual") == "breaking").cast("int")).withColumn("accuracy", F.round("accuracy", 6))

    @r.add("baseline_comparison", log + ", y as (select (actual = 'breaking')::int as t, (expected = 'breaking')::int as m, 0 as never from x where expected is not null and actual is not null), z as (select 'model' as rule, t, m as p from y union all select 'never', t, never from y) select rule, count(*) filter (p = 1 and t = 1) as tp, count(*) filter (p = 1 and t = 0) as fp, count(*) filter (p = 0 and t = 0) as tn, count(*) filter (p = 0 and t = 1) as fn from z group by 1")
    def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = invocations(spark, sf_dir).filter("expected is not null and actual is not null")
        return metrics.baseline_comparison(x, (F.col("actual") == "breaking").cast("int"), {"model": F.col("expected") == "breaking", "never": F.lit(0)}).select("rule", "tp", "fp", "tn", "fn")

    @r.add("replay_summary", log + " select case grouping(declared_mutation, policy_pack) when 3 then 'overall' when 1 then 'declared_mutation' else 'policy_pack' end as report, declared_mutation, policy_pack, count(*) as n, sum(case when outcome_match then 0 else 1 end)::bigint as n_mismatch from x group by grouping sets ((), (declared_mutation), (policy_pack))")
    def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evidence.replay_summary(invocations(spark, sf_dir), "declared_mutation", "policy_pack", "outcome_match")

    @r.add("trace_per_mutation", "select declared_mutation, arg_min(record_id, invocation_no) as record_id, min(invocation_no) as invocation_no from (select invocation_no, min(declared_mutation) as declared_mutation, min(record_id) as record_id from invocation_log group by 1) where declared_mutation is not null and record_id is not null group by 1")
    def trace_per_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = table(spark, sf_dir, "invocation_log").groupBy("invocation_no").agg(F.min("declared_mutation").alias("declared_mutation"), F.min("record_id").alias("record_id"))
        return evidence.trace_per(x.filter("record_id is not null"), "declared_mutation", "invocation_no", ["record_id", "invocation_no"])

    @r.add("matrix_cells", REC + ", c as (select mutation, count(*) as n from rec where mutation is not null group by 1) select mutation, policy_pack, mode, profile, n from c, (values ('baseline'), ('strict')) p(policy_pack), (values ('BACKWARD'), ('FORWARD'), ('FULL')) m(mode), (values ('open'), ('closed')) o(profile)")
    def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = records(spark, sf_dir).filter("mutation is not null").groupBy("mutation").agg(F.count(F.lit(1)).alias("n"))
        return evidence.matrix(c, ["baseline", "strict"], ["BACKWARD", "FORWARD", "FULL"], ["open", "closed"])

    @r.add("direction_union", REC + " select compatibility_mode || ':' || record_no as record_id, compatibility_mode as mode from rec where compatibility_mode in ('forward', 'full')")
    def direction_union(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        part = lambda m: rows.filter(F.col("compatibility_mode") == m).select(F.concat_ws(":", F.lit(m), F.col("record_no").cast("string")).alias("record_id"), F.col("compatibility_mode").alias("mode"))
        return part("forward").unionByName(part("full"))

    @r.add("seed_summary", log + ", a as (select policy_pack, declared_mutation, avg((expected = actual)::int) as acc from x where policy_pack is not null and declared_mutation is not null and expected is not null and actual is not null group by 1, 2) select policy_pack, round(avg(acc), 6) as mean_accuracy, round(min(acc), 6) as min_accuracy, round(max(acc), 6) as max_accuracy, count(*) as n_seeds from a group by 1")
    def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = invocations(spark, sf_dir).filter("policy_pack is not null and declared_mutation is not null and expected is not null and actual is not null")
        a = x.groupBy("policy_pack", "declared_mutation").agg(F.avg((F.col("expected") == F.col("actual")).cast("int")).alias("accuracy"))
        return metrics.across_seeds(a, "policy_pack").select("policy_pack", *[F.round(c, 6).alias(c) for c in ("mean_accuracy", "min_accuracy", "max_accuracy")], "n_seeds")

    @r.add("bucket_rule", log + ", y as (select policy_pack as bucket, (actual = 'safe')::int as label from x where policy_pack is not null and actual is not null) select bucket, case when sum(label) * 2 > count(*) then 1 when sum(label) * 2 < count(*) then 0 end as predicted, sum(label)::bigint as ones, sum(1 - label)::bigint as zeros from y group by 1")
    def bucket_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = invocations(spark, sf_dir).filter("policy_pack is not null and actual is not null").withColumn("label", (F.col("actual") == "safe").cast("int"))
        return metrics.bucket_rule(x, F.col("policy_pack"), "label", tie_is_error=False)
