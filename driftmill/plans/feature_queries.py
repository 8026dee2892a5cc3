"""Queries over numbers: vectors, activations, losses, scalers, thresholds, nearest rows, models, schema features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.functions import hashing, signatures, vectors
from driftmill.operators import audit, candidates, external, metrics, models, policy, scaling, schema_diff, similarity
from driftmill.plans import schema_sql
from driftmill.plans.record_queries import records
from driftmill.plans.registry import Registry
from driftmill.runtime import cut, table
from driftmill.sources import fixtures

#: The reference's own for run-three-way-experiments.
SEEDS, EPOCHS = (20260826, 20260827, 20260828), 100
MODES = ("BACKWARD", "FORWARD", "FULL")

_V = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)"
_PREP = "with p as (select record_no, min(features) as f, min(policy_pack) as policy_pack from prepared_records where len(features) = 76 group by record_no)"
_STRUCT = "list_transform(list_concat(list_concat(f[1:24], f[49:59]), f[63:76]), lambda x: case when x = 0 then 0.0 else x end)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full rows, each record once."""
    p = table(spark, sf_dir, "prepared_records").filter(F.size("features") == 76)
    return p.groupBy("record_no").agg(F.min("features").alias("features"), F.min("policy_pack").alias("policy_pack"))


def pairs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "generated_pairs")
    return p.groupBy("pair_no").agg(F.min(F.struct("base_schema", "candidate_schema", "policy_pack")).alias("x")).select("pair_no", "x.*")


_JSON = """
with p as (select pair_no, arg_min(base_schema, base_schema || candidate_schema) as b, arg_min(candidate_schema, base_schema || candidate_schema) as c from generated_pairs group by 1),
k as (select pair_no, b, c, coalesce(json_keys(b, '$.properties'), []) as bk, coalesce(json_keys(c, '$.properties'), []) as ck,
  coalesce(json_extract_string(b, '$.required[*]'), []) as br, coalesce(json_extract_string(c, '$.required[*]'), []) as cr from p),
n as (select pair_no, unnest(list_filter(bk, lambda x: list_contains(ck, x))) as name, b, c from k),
q as (select pair_no, json_extract(b, '$.properties."' || name || '"') as l, json_extract(c, '$.properties."' || name || '"') as r from n),
t as (select pair_no, json_extract_string(l, '$.type') as lt, json_extract_string(r, '$.type') as rt, coalesce(json_extract_string(l, '$.enum[*]'), []) as le, coalesce(json_extract_string(r, '$.enum[*]'), []) as re,
  try_cast(json_extract_string(l, '$.minimum') as double) as l1, try_cast(json_extract_string(r, '$.minimum') as double) as r1, try_cast(json_extract_string(l, '$.maximum') as double) as l2, try_cast(json_extract_string(r, '$.maximum') as double) as r2 from q),
s as (select pair_no, sum((lt is distinct from rt)::int) as type_changes, sum(len(list_filter(list_distinct(re), lambda x: not list_contains(le, x)))) as enum_values_added, sum(len(list_filter(list_distinct(le), lambda x: not list_contains(re, x)))) as enum_values_removed,
  sum(case when l1 is null and r1 is not null or r1 > l1 then 1 else 0 end) as minimum_tightened, sum(case when l2 is null and r2 is not null or r2 < l2 then 1 else 0 end) as maximum_tightened from t group by 1)
"""


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir).select("record_no", "family_id", "mutation", F.coalesce("dataset_role", F.lit("standard")).alias("role"), F.coalesce("compatibility_label", F.lit("safe")).alias("label"))
    from driftmill.functions.labels import one_hot

    return cut(_prepared(spark, sf_dir).join(rec, "record_no").withColumn("target", one_hot(F.col("label"))), "training")

def protocol_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with what protocols hold out, in one spelling; a record without a family is one of its own."""
    spelt = lambda c, a, b: F.translate(F.lower(F.trim(c)), a, b).alias(c)
    form = records(spark, sf_dir).select("record_no", spelt("mutation_variant", "_", "-"), "root_object_profile")
    rows = training_rows(spark, sf_dir).join(form, "record_no")
    return cut(rows.withColumns({"policy_pack": spelt("policy_pack", "_", "-"), "mutation": spelt("mutation", "-", "_"), "family_id": F.coalesce("family_id", F.concat(F.lit("record:"), F.col("record_no").cast("string")))}), "protocol-records")

def hashed_split(rows: DataFrame, *seed: int) -> DataFrame:
    part = F.pmod(F.xxhash64("family_id", *map(F.lit, seed)), F.lit(20))
    return rows.filter("family_id is not null").select("family_id").distinct().withColumn("partition", F.when(part < 14, "train").when(part < 17, "validation").otherwise("test"))


def register(r: Registry) -> None:
    @r.add("vector_norms", _V + " select vec_id, round(sqrt(list_dot_product(v, v)), 4) as magnitude, round(list_dot_product(v, list_reverse(v)), 4) as with_reverse, round(v[1], 4) as first from e")
    def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("v")
        return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.magnitude(v), 4).alias("magnitude"), F.round(vectors.dot(v, F.reverse(v)), 4).alias("with_reverse"), F.round(vectors.get(v, 0), 4).alias("first"))

    @r.add("vector_arithmetic", _V + " select vec_id, round(list_sum(list_transform(v, lambda x: x * 3 - x / 2)), 4) as total, round(sqrt(list_sum(list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v))) ** 2))), 4) as unit_length from e")
    def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("v")
        return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.total(vectors.subtract(vectors.add(v, vectors.scale(v, 2.0)), vectors.scale(v, 0.5))), 4).alias("total"), F.round(vectors.magnitude(vectors.normalize(v)), 4).alias("unit_length"))

    @r.add("matrix_products", _V + " select vec_id, round(2 * list_dot_product(v, v) , 4) as quadratic, round(v[1] * v[1] + v[2] * v[3], 4) as top_left, round(list_sum(v), 4) as identity_sum from e")
    def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.col("v")
        m = F.array(v, v)
        square = F.array(F.slice("v", 1, 2), F.slice("v", 3, 2))
        both = vectors.matrix_subtract(vectors.matrix_add(m, vectors.matrix_scale(m, 2.0)), vectors.matrix_scale(m, 2.0))
        eye = vectors.matvec(vectors.identity(64), v)
        return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.total(vectors.matvec(both, v)), 4).alias("quadratic"), F.round(vectors.matmul(square, square)[0][0], 4).alias("top_left"), F.round(vectors.total(eye), 4).alias("identity_sum"))

    @r.add("activations", _V + " select vec_id, round(1 / (1 + exp(-v[1])), 6) as sigmoid, round(greatest(v[2], 0), 6) as relu, round(tanh(v[3]), 6) as tanh, round((1 / (1 + exp(-v[1]))) * (1 - 1 / (1 + exp(-v[1]))), 6) as sigmoid_slope from e")
    def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = vectors.sigmoid(F.col("v")[0])
        return _embeddings(spark, sf_dir).select("vec_id", F.round(s, 6).alias("sigmoid"), F.round(vectors.relu(F.col("v")[1]), 6).alias("relu"), F.round(F.tanh(F.col("v")[2]), 6).alias("tanh"), F.round(vectors.slope("sigmoid", s), 6).alias("sigmoid_slope"))

    @r.add("softmax", _V + ", x as (select vec_id, list_transform(v, lambda a: exp(a - list_max(v))) as w from e) select vec_id, round(w[1] / list_sum(w), 6) as first, round(list_max(w) / list_sum(w), 6) as most from x")
    def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = vectors.softmax(F.col("v"))
        return _embeddings(spark, sf_dir).select("vec_id", F.round(p[0], 6).alias("first"), F.round(F.array_max(p), 6).alias("most"))

    @r.add("losses", _V + ", x as (select vec_id, v, 1 / (1 + exp(-v[1])) as p, vec_id % 2 as t, list_transform(v[1:3], lambda a: exp(a - list_max(v[1:3]))) as w from e) select vec_id, round(list_sum(list_transform(v[1:4], lambda a: (a - 1) * (a - 1))) / 4, 6) as mse, round(-(t * ln(p) + (1 - t) * ln(1 - p)), 6) as bce, round(-ln(w[1] / list_sum(w)), 6) as ce, round((p - t) / (p * (1 - p)), 4) as bce_gradient from x")
    def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, t = vectors.sigmoid(F.col("v")[0]), (F.col("vec_id") % 2).cast("double")
        ones = F.array(*[F.lit(1.0)] * 4)
        ce = vectors.cross_entropy(vectors.softmax(F.slice("v", 1, 3)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.squared_error(F.slice("v", 1, 4), ones), 6).alias("mse"), F.round(vectors.binary_cross_entropy(p, t), 6).alias("bce"), F.round(ce, 6).alias("ce"), F.round(vectors.binary_cross_entropy_gradient(p, t), 4).alias("bce_gradient"))

    @r.add("argmax_last_tie", _V + ", x as (select vec_id, list_transform(v[1:8], lambda a: round(a, 1)) as w from e) select vec_id, 7 - (list_position(list_reverse(w), list_max(w)) - 1) as place from x")
    def argmax_last_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = F.transform(F.slice("v", 1, 8), lambda a: F.round(a, 1))
        return _embeddings(spark, sf_dir).select("vec_id", vectors.argmax_last(w).alias("place"))

    stats = _PREP + ", s as (select i, avg(x) as m, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as d from (select unnest(range(76)) as i, unnest(f) as x from p) group by 1)"

    @r.add("scaler_fit", stats + " select i::int as place, round(m, 4) as mean, round(d, 4) as deviation from s")
    def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = scaling.fit(_prepared(spark, sf_dir), "features", 76)
        return s.select(F.posexplode(F.arrays_zip("means", "deviations")).alias("place", "x")).select("place", F.round("x.means", 4).alias("mean"), F.round("x.deviations", 4).alias("deviation"))

    @r.add("scaler_transform", stats + ", z as (select record_no, sum((x - m) / d) as z from (select record_no, unnest(range(76)) as i, unnest(f) as x from p) join s using (i) group by 1) select record_no, round(z, 3) as total_scaled, round(list_sum(f), 3) as total_restored from z join p using (record_no)")
    def scaler_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _prepared(spark, sf_dir)
        s = cut(scaling.fit(p, "features", 76), "scaler")
        back = scaling.restore(scaling.transform(p, "features", s), "scaled", s, "restored")
        return back.select("record_no", F.round(vectors.total(F.col("scaled")), 3).alias("total_scaled"), F.round(vectors.total(F.col("restored")), 3).alias("total_restored"))

    @r.add("threshold_sweep", "with x as (select t.t as threshold, value / 100 >= t.t as p, event_type = 'error' as a from events, (values (0.25), (0.5), (0.75)) t(t)) select threshold::double as threshold, count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and not a) as tn, count(*) filter (not p and a) as fn from x group by 1")
    def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events")
        return metrics.threshold_sweep(e, F.col("value") / 100, (F.col("event_type") == "error").cast("int"), [0.25, 0.5, 0.75]).select("threshold", "tp", "fp", "tn", "fn")

    @r.add("regression_metrics", "select l_returnflag, round(avg((l_quantity - l_tax * 100) * (l_quantity - l_tax * 100)), 4) as mse, round(avg(abs(l_quantity - l_tax * 100)), 4) as mae, count(*) as n from lineitem group by 1")
    def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = metrics.regression(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_tax") * 100, "l_returnflag")
        return m.select("l_returnflag", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), "n")

    near = _PREP + f", e as (select record_no, max(coalesce(lower(trim(dataset_role)), 'standard')) as role, min(family_id) as family_id from generation_evidence group by 1), s as (select p.record_no, role, family_id, {_STRUCT} as v from p join e using (record_no)), b as (select distinct v from s where role = 'standard'), q as (select distinct v from s where role = 'challenge'), d as (select q.v, min(list_sum(list_transform(list_zip(q.v, b.v), lambda x: case when x[1] = x[2] then 0 else 1 end))) as distance from q, b group by 1)"

    def sided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        roles = table(spark, sf_dir, "generation_evidence").groupBy("record_no").agg(F.max(F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard"))).alias("role"), F.min("family_id").alias("family_id"))
        s = cut(similarity.signatures(_prepared(spark, sf_dir).join(roles, "record_no"), "record_no", "features", "role", "family_id"), "sides")
        return s.filter("role = 'challenge'"), s.filter("role = 'standard'")

    @r.add("distance_histogram", near + " select distance::int as distance, count(*) as n_records, count(distinct family_id) as n_families from s join d on s.v = d.v where role = 'challenge' group by 1")
    def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.distance_histogram(*sided(spark, sf_dir))

    @r.add("nearest_hamming", near + " select record_no, distance::int as distance from s join d on s.v = d.v where role = 'challenge'")
    def nearest_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
        ch, st = sided(spark, sf_dir)
        return ch.join(similarity.nearest(ch, st), "key").select("record_no", "distance")

    @r.add("nearest_listing", near + ", m as (select q.v, min(struct_pack(d := list_sum(list_transform(list_zip(q.v, b.v), lambda x: case when x[1] = x[2] then 0 else 1 end)), s := b.v)) as x from q, b group by 1), l as (select c.record_no as query_id, t.record_no as base_id, m.x.d as distance, row_number() over (partition by c.record_no order by t.record_no) as k from s c join m on m.v = c.v join s t on t.v = m.x.s where c.role = 'challenge' and t.role = 'standard') select query_id, base_id, distance::int as distance from l where k <= 5")
    def nearest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.nearest_listing(*sided(spark, sf_dir), "record_no", "record_no", 5)

    def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        roles = table(spark, sf_dir, "generation_evidence").groupBy("record_no").agg(F.max(F.coalesce(F.lower(F.trim("dataset_role")), F.lit("standard"))).alias("role"), F.min("family_id").alias("family_id"))
        rows = _prepared(spark, sf_dir).join(roles, "record_no").withColumn("record_id", F.col("record_no"))
        return similarity.near_duplicate_audit(rows, 100)

    @r.add("near_duplicate_audit", near + ", w as (select s.*, d.distance, p.f from s join p using (record_no) left join d on s.v = d.v and role = 'challenge') select count(*) as n_challenge, count(*) filter (list_transform(f, lambda x: case when x = 0 then 0.0 else x end) in (select list_transform(f, lambda x: case when x = 0 then 0.0 else x end) from w where role = 'standard')) as n_full_match, count(*) filter (distance = 0) as n_structural_match, count(*) filter (distance <= 1) as n_within_one, count(distinct case when distance = 0 then family_id end) as n_structural_families from w where role = 'challenge'")
    def near_duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audited(spark, sf_dir)[0]

    def audited_protocols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        rows = protocol_records(spark, sf_dir)
        pairs = records(spark, sf_dir).select("record_no", "pair_fingerprint")
        rows = rows.withColumn("own", audit.held_out_by(rows)).join(pairs, "record_no").withColumn("record_id", F.col("record_no"))
        return similarity.protocol_audit(rows, 100)

    held = (
        _PREP + ", e as (select record_no, min(family_id) as family_id, min(lower(trim(mutation))) as mutation, min(lower(trim(mutation_variant))) as variant, min(lower(trim(root_object_profile))) as profile, coalesce(min(lower(trim(dataset_role))), 'standard') as role, min(pair_fingerprint) as fp from generation_evidence group by 1), "
        "n as (select record_no, role, fp, f, coalesce(family_id, 'record:' || record_no) as family_id, replace(lower(trim(policy_pack)), '_', '-') as pack, replace(mutation, '-', '_') as mutation, replace(variant, '_', '-') as variant, profile from p join e using (record_no)), "
        "o as (select *, case when mutation = 'optional_field_added' then 'root-' || profile when trim(variant) <> '' then variant end as form from n), "
        f"s as (select record_no, role, fp, family_id, list_transform(f, lambda x: case when x = 0 then 0.0 else x end) as full_, {_STRUCT} as v, list_filter(['held-out-policy:' || pack, 'held-out-mutation:' || mutation, 'held-out-mutation-variant:' || mutation || ':' || form], lambda x: x is not null) as own from o), "
        "st as (select * from s where role = 'standard'), ch as (select record_no, family_id, fp, full_, v, unnest(own) as protocol from s where role = 'challenge'), b as (select distinct v, own from st), q as (select distinct v, protocol from ch), "
        "d as (select q.v, q.protocol, min(list_sum(list_transform(list_zip(q.v, b.v), lambda x: case when x[1] = x[2] then 0 else 1 end))) as distance from q join b on not list_contains(b.own, q.protocol) group by 1, 2), "
        "m as (select distinct ch.protocol, ch.full_, true as same from ch join st on st.full_ = ch.full_ and not list_contains(st.own, ch.protocol)), r as (select ch.*, distance, coalesce(same, false) as same from ch join d using (v, protocol) left join m using (protocol, full_)) "
        "select protocol, count(*) as n_challenge, count(*) filter (same) as n_full_match, count(distinct case when same then family_id end) as n_full_families, count(*) filter (distance = 0) as n_structural_match, count(distinct case when distance = 0 then family_id end) as n_structural_families, count(*) filter (distance <= 1) as n_within_one, "
        "(select count(*) from st where not list_contains(st.own, r.protocol)) as n_training, exists (select 1 from ch join st on st.family_id = ch.family_id and ch.family_id <> '' where ch.protocol = r.protocol and not list_contains(st.own, r.protocol)) as family_id_leakage, "
        "exists (select 1 from ch join st on st.fp = ch.fp and ch.fp <> '' where ch.protocol = r.protocol and not list_contains(st.own, r.protocol)) as pair_fingerprint_leakage from r group by 1"
    )

    @r.add("near_duplicate_protocols", held)
    def near_duplicate_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audited_protocols(spark, sf_dir)[0]

    @r.add("near_duplicate_samples")
    def near_duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
        return audited_protocols(spark, sf_dir)[1]

    @r.add("signature_counts", _PREP + f" select count(distinct list_transform(f, lambda x: case when x = 0 then 0.0 else x end)) as n_full, count(distinct {_STRUCT}) as n_structural from p")
    def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _prepared(spark, sf_dir)
        return p.agg(F.countDistinct(signatures.signature_key(signatures.full_signature(F.col("features")))).alias("n_full"), F.countDistinct(signatures.signature_key(signatures.structural(F.col("features")))).alias("n_structural"))

    @r.add("schema_diff_counts", _JSON + " select k.pair_no, len(ck) as field_count, len(list_filter(ck, lambda x: not list_contains(bk, x))) as fields_added, len(list_filter(bk, lambda x: not list_contains(ck, x))) as fields_removed, len(list_distinct(cr)) as required_field_count, len(list_filter(list_distinct(cr), lambda x: not list_contains(br, x))) as required_fields_added, len(list_filter(list_distinct(br), lambda x: not list_contains(cr, x))) as required_fields_removed, coalesce(type_changes, 0)::bigint as type_changes, coalesce(enum_values_added, 0)::bigint as enum_values_added, coalesce(enum_values_removed, 0)::bigint as enum_values_removed from k left join s using (pair_no)")
    def schema_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = schema_diff.extract(pairs_once(spark, sf_dir), ["pair_no"], "base_schema", "candidate_schema", "v2")
        at = {n: i for i, n in enumerate(schema_diff.STRUCTURE_NAMES)}
        names = ("field_count", "fields_added", "fields_removed", "required_field_count", "required_fields_added", "required_fields_removed", "type_changes", "enum_values_added", "enum_values_removed")
        return x.select("pair_no", *[F.col("features")[at[n]].cast("long").alias(n) for n in names])

    def written(df: DataFrame) -> DataFrame:
        """Features as a text of whole numbers: all are counts."""
        return df.withColumn("features", F.array_join(F.transform("features", lambda x: x.cast("long").cast("string")), " "))

    def unresolved(name: str, version: str) -> None:
        @r.add(name, schema_sql.rows(version))
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return written(schema_diff.extract(pairs_once(spark, sf_dir), ["pair_no", "policy_pack"], "base_schema", "candidate_schema", version, "policy_pack"))

    for version in ("v2", "v3"):
        unresolved(f"schema_features_{version}", version)

    def pack_column(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = F.replace(F.lower(F.trim("policy_pack")), F.lit("_"), F.lit("-"))
        return pairs_once(spark, sf_dir).withColumn("policy_pack", policy.requested_pack(name, list(policy.NAMED_PACKS), "baseline"))

    def versioned(name: str, version: str) -> None:
        @r.add(name, schema_sql.rows(version))
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            acts = policy.action_rows(policy.resolve(spark, policy.NAMED_PACKS))
            return written(schema_diff.extract(pack_column(spark, sf_dir), ["pair_no", "policy_pack"], "base_schema", "candidate_schema", version, "policy_pack", acts))

    for version in ("v4", "v5", "v6"):
        versioned(f"schema_features_{version}", version)

    @r.add("active_actions", schema_sql.ACTIVE_ACTIONS)
    def active_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Heuristic labels from the actions of active rules, summed by policy; never an oracle's label."""
        acts = policy.action_rows(policy.resolve(spark, policy.NAMED_PACKS))
        x = schema_diff.extract(pack_column(spark, sf_dir), ["pair_no", "policy_pack"], "base_schema", "candidate_schema", "v6", "policy_pack", acts)
        label = F.when(F.col("features")[61] > 0, "breaking").when(F.col("features")[60] > 0, "warning").otherwise("safe")
        return x.groupBy("policy_pack", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.lit("heuristic").alias("label_source"))

    @r.add("schema_candidates", schema_sql.CANDIDATES)
    def schema_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Which changes apply to which schema; the candidates' texts are looked at through their operations."""
        made = candidates.candidate_table(pairs_once(spark, sf_dir), ["pair_no", "base_schema"], "base_schema")
        ops = candidates.operation_table(made, ["pair_no", "kind", "variant"], "base_schema", "candidate")
        return ops.groupBy("pair_no", "kind", "variant").agg(F.count(F.lit(1)).alias("n_operations"))

    @r.add("canonical_json", schema_sql.PAIRS + f" select pair_no, sha256({schema_sql.canonical_text('bt::json')}) as base_sha256 from d")
    def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs_once(spark, sf_dir).select("pair_no", F.sha2(hashing.canonical_json(F.col("base_schema")), 256).alias("base_sha256"))

    @r.add("fixture_features", "select record_id, field_count::double as field_count, score::double as score, risk_score::double as risk_score from (values " + ", ".join(f"('{x[0]}', {x[3]}.0, {dict(compatible=0.0, unknown=0.5, incompatible=1.0)[x[7]]}, {0.8 if x[10] else 0.15})" for x in fixtures.ROWS) + ") t(record_id, field_count, score, risk_score)")
    def fixture_features(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.prepared(fixtures.contract_changes(spark)).select("record_id", F.col("features")[0].alias("field_count"), F.col("features")[4].alias("score"), "risk_score")

    @r.add("protocol_experiment")
    def protocol_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = protocol_records(spark, sf_dir)
        plan = models.protocol_plan(rows, "family_id")
        todo = spark.createDataFrame(plan, "protocol string, status string, n_challenge long")
        out = None
        for seed in SEEDS:
            part = models.experiment(rows, [p for p, status, _ in plan if status == "scored"], hashed_split(rows, seed), "family_id", "record_no", epochs=EPOCHS)
            part = todo.join(cut(part, "protocol-seed"), "protocol", "left").select(F.lit(seed).alias("seed"), "protocol", "status", F.coalesce("n_test", "n_challenge").alias("n_test"), "accuracy")
            out = part if out is None else out.unionByName(part)
        return out

    @r.add("model_scores")
    def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = protocol_records(spark, sf_dir)
        placed = None
        for seed in SEEDS:  # each seed makes its own split
            part = rows.filter("role = 'standard'").join(hashed_split(rows, seed), "family_id").withColumn("seed", F.lit(str(seed)))
            placed = part if placed is None else placed.unionByName(part)
        made = models.train_models(placed, ["seed"], "record_no", epochs=EPOCHS).filter("model is not null").collect()
        return models.score(rows, ["record_no"], "features", [(m["seed"], m["model"]) for m in made])

    gate = (
        _PREP + ", e as (select record_no, max(coalesce(lower(trim(dataset_role)), 'standard')) as role, min(source) as source, min(family_id) as family_id, min(pair_fingerprint) as fp from generation_evidence group by 1), "
        f"s as (select e.*, list_transform(f, lambda x: case when x = 0 then 0.0 else x end) as v, {_STRUCT} as t from p join e using (record_no)), b as (select * from s where role = 'standard'), "
        "c as (select *, source in (select source from b where source is not null) or family_id in (select family_id from b where family_id is not null) or fp in (select fp from b where fp is not null) or v in (select v from b) or t in (select t from b) or record_no::varchar > min(record_no::varchar) over (partition by fp) and fp is not null as held from s where role = 'challenge') "
        "select count(*) as n_transitions, count(*) filter (not coalesce(held, false)) as n_eligible, count(*) filter (coalesce(held, false)) as n_contaminated, 0::bigint as n_not_for_accuracy from c"
    )

    @r.add("external_gate", gate)
    def external_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = training_rows(spark, sf_dir).join(records(spark, sf_dir).select("record_no", "source", "pair_fingerprint"), "record_no").withColumn("record_id", F.col("record_no").cast("string"))
        gated = external.contamination(rows.filter("role = 'challenge'").withColumn("external_use", F.lit("accuracy-bearing")), rows.filter("role = 'standard'"))
        return external.status_counts(gated)


def register_commands(r: Registry) -> None:
    from driftmill.operators import admission
    from driftmill.plans import commands

    packs, fields = (", ".join(f"('{x}')" for x in xs) for xs in (policy.NAMED_PACKS, candidates.ADDED))

    @r.add("isolation_manifest", schema_sql.PAIRS + f" select pair_no::varchar || '.' || profile || '.optional-' || name || '-field.' || k.pack as record_id, pair_no::varchar as family_id, profile, 'optional-' || name || '-field' as variant, k.pack as policy_pack, 'traceability-only' as external_use, case when profile = 'open' then 'true' else 'false' end as additional, '{candidates.MADE}_optional_' || name as added from d, (values ('open'), ('closed')) o(profile), (values {fields}) f(name), (values {packs}) k(pack)")
    def isolation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = admission.isolation_manifest(pairs_once(spark, sf_dir).select(F.col("pair_no").cast("string").alias("family_id"), F.col("base_schema").alias("schema")), list(policy.NAMED_PACKS))
        there = F.element_at(F.json_object_keys(F.get_json_object("candidate_schema", "$.properties")), -1)
        return rows.select("record_id", "family_id", "profile", "variant", "policy_pack", "external_use", F.get_json_object("candidate_schema", "$.additionalProperties").alias("additional"), there.alias("added"))

    @r.add("generated_records")
    def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        schemas = pairs_once(spark, sf_dir).select(F.col("pair_no").cast("string").alias("unique_id"), F.col("base_schema").alias("json_schema"))
        made = commands.generate(schemas, policy.resolve(spark, policy.NAMED_PACKS), list(MODES), None, 0.2, 20260826)
        return made.groupBy("kind", "policy_pack", "dataset_role", "compatibility_label", "label_source").agg(F.count(F.lit(1)).alias("n"))

    @r.add("refeatured_records")
    def refeatured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the base schema of pairs_once, without moving the other columns
        once = table(spark, sf_dir, "generated_pairs").groupBy("pair_no").agg(F.min(F.struct("base_schema")).alias("x"))
        schemas = once.select(F.col("pair_no").cast("string").alias("unique_id"), F.col("x.base_schema").alias("json_schema"))
        packs = policy.resolve(spark, policy.NAMED_PACKS)
        old = candidates.candidate_table(schemas, ["unique_id"], "json_schema").select(F.concat_ws(":", "unique_id", "ordinal").alias("record_id"), F.col("unique_id").alias("family_id"), "kind", "variant", F.array(*map(F.lit, policy.NAMED_PACKS)).alias("policy_pack"))
        return commands.refeature(old, schemas, packs).select("record_id", "policy_pack", "features")

    @r.add("coverage_status", "with rec as (select record_no, min(family_id) as family_id, min(lower(trim(mutation))) as mutation, min(lower(trim(policy_pack))) as policy_pack, coalesce(min(lower(trim(dataset_role))), 'standard') as role from generation_evidence group by 1) select 'records' as target, count(*) as reached, 100::bigint as wanted, count(*) >= 100 as met from rec union all select 'standard_families', count(distinct family_id), 10, count(distinct family_id) >= 10 from rec where role = 'standard' union all select 'challenge_families', count(distinct family_id), 5, count(distinct family_id) >= 5 from rec where role = 'challenge' union all select 'complete_pairs', count(*), 1, count(*) >= 1 from (select family_id, mutation from rec group by 1, 2 having count(distinct policy_pack) >= 3)")
    def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
        return commands.coverage_status(records(spark, sf_dir), "compatibility_label", 100, 10, 5, 1)

    @r.add("feature_ablation", "with p as (select record_no, min(features) as f, max(breaking_change) as y from prepared_records where len(features) = 76 and breaking_change is not null group by 1), n as (select f[66] > 0 as b, sum(y) as ones, sum(1 - y) as zeros from p group by 1) select round(sum(greatest(ones, zeros)) / sum(ones + zeros), 6) as accuracy, count(*) as n_buckets from n")
    def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "prepared_records").filter("size(features) = 76 and breaking_change is not null").groupBy("record_no").agg(F.min("features").alias("features"), F.max("breaking_change").alias("y"))
        return commands.feature_ablation(p, 65, "y")
