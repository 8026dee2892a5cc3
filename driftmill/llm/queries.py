"""Queries of problems 1 to 4 and 6 to 9, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmill.llm import format_dedup, knn_forest, mixing, overlap, packing, quota_sample, splits, subjects, tokens
from driftmill.plans.registry import Registry
from driftmill.runtime import cut, table

PAIR_FIELDS = ["contract_id", "policy_pack", "base_schema", "candidate_schema"]
COORDINATES = list(overlap.PLACES)
SPLIT_CONFIG = 1

_MARKS = "|".join(splits.FAMILY_MARKS)
_NAMED = "case when lower(trim({c}, E' \\t\\n\\r')) in ('', 'unknown', 'n/a') then null else {c} end"
P1_SQL = f"""
with recursive r as (
  select distinct family_id as name, {_NAMED.format(c='family_id')} as f, {_NAMED.format(c='split_group_id')} as g, {_NAMED.format(c='contract_id')} as c
  from generation_evidence),
w as (select *, regexp_replace(regexp_replace(trim(regexp_replace(lower(f), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')),
  '^(?:(?:{_MARKS}) )+', ''), '(?: (?:{_MARKS}))+$', '') as bare from r),
k as (select name, 'f:' || nullif(case when bare like '% %' then replace(bare, ' ', '')
  else coalesce(nullif(regexp_replace(case when starts_with(bare, 'openapi') then bare else regexp_replace(bare, '^(?:{_MARKS})+', '') end, '(?:{_MARKS})+$', ''), ''), bare) end, '') as f, 'g:' || g as g, 'c:' || c as c from w),
edge as (select f as a, g as b from k union select f, c from k union select g, c from k),
link as (select a, b from edge where a is not null and b is not null union select b, a from edge where a is not null and b is not null),
reach(root, ent) as (select distinct f, f from k where f is not null union select root, link.b from reach join link on link.a = reach.ent),
same as (select distinct root, ent from reach where starts_with(ent, 'f:')),
names as (select distinct name, f from k where f is not null)
select x.name as family_id_a, y.name as family_id_b from names x join same on same.root = x.f join names y on y.f = same.ent where x.name < y.name
"""

_CAT = "replace(replace(lower(trim({c}, E' \\t\\n\\r')), '-', ''), '_', '')"
_STRATS = ("compatibility_label", "root_object_profile", "mutation", "policy_pack")
_ONCE = "select record_no, " + ", ".join(f"min({_CAT.format(c=c)}) as {c}" for c in _STRATS) + " from generation_evidence group by record_no"
_LONG = " union all ".join([*(f"select '{c}' as field, {c} as cat from once" for c in _STRATS), "select 'compatibility_label|root_object_profile', compatibility_label || '|' || root_object_profile from once"])
P2_SQL = f"""
with once as ({_ONCE}), n as (select field, cat, count(*) as have from ({_LONG}) where cat is not null group by 1, 2)
select distinct request_no, category from sample_targets t left join n on n.field = t.strat_field and n.cat = {_CAT.format(c='t.category')}
where coalesce(have, 0) < round(target_share * sample_rows, 6) or coalesce(have, 0) < min_rows
"""

P2_REPORT_SQL = f"""
with once as ({_ONCE}), n as (select field, cat, count(*) as have from ({_LONG}) where cat is not null group by 1, 2),
t as (select request_no, category, target_share, coalesce(have, 0) as available, round(target_share * sample_rows, 6) as quota, coalesce(min_rows, 0)::double as least from sample_targets t left join n on n.field = t.strat_field and n.cat = {_CAT.format(c='t.category')}),
g as (select *, greatest(quota, least) as floor_at, greatest(quota - least, 0) as above, sum(greatest(quota, least) - quota) over w as over_, sum(greatest(quota - least, 0)) over w as room from t window w as (partition by request_no)),
x as (select *, round(case when room > 0 then floor_at - above * least(over_ / room, 1) else floor_at end, 6) as exact from g),
y as (select *, floor(exact) as whole, round(sum(exact) over w) - sum(floor(exact)) over w as spare, row_number() over (partition by request_no order by round(exact - floor(exact), 6) desc, category) as place from x window w as (partition by request_no)),
z as (select *, (whole + (place <= spare)::int)::bigint as want from y),
d as (select *, least(want, available) as taken from z)
select request_no, category, target_share, round(taken / nullif(sum(taken) over (partition by request_no), 0), 6) as actual_share, available, want, taken, greatest(greatest(ceil(quota), least) - available, want - taken, 0)::bigint as deficit from d
"""

_FP = "regexp_replace(regexp_replace(lower(pair_fingerprint), '\\s', '', 'g'), '^[a-z][a-z0-9_-]*[:=]', '')"
P3_SQL = f"""
with e as (select record_no, max(coalesce(lower(trim(dataset_role, E' \\t\\n\\r')), 'standard')) as role, min(nullif({_FP}, '')) as fp from generation_evidence group by record_no),
p as (select distinct record_no, policy_pack, list_concat(list_concat(features[1:24], features[49:59]), features[63:76]) as v from prepared_records where len(features) = 76 and policy_pack is not null),
h as (select p.*, e.role from p join e using (record_no))
select least(a.record_no, b.record_no) as record_no_a, greatest(a.record_no, b.record_no) as record_no_b from e a join e b on a.fp = b.fp where a.role = 'challenge' and b.role = 'standard'
union
select least(a.record_no, b.record_no), greatest(a.record_no, b.record_no) from h a join h b on a.policy_pack = b.policy_pack
where a.role = 'challenge' and b.role = 'standard' and list_sum(list_transform(list_zip(a.v, b.v), lambda x: case when x[1] = x[2] then 0 else 1 end)) <= 1
"""

P3_REPORT_SQL = f"""
with found as ({P3_SQL}), rec as (select record_no, max(coalesce(lower(trim(dataset_role, E' \\t\\n\\r')), 'standard')) as dataset_role, min(source) as source, min(nullif({_FP}, '')) as fp from generation_evidence group by record_no),
prints as (select fp from rec where fp is not null group by fp having bool_or(dataset_role = 'challenge') and bool_or(dataset_role = 'standard')),
hit as (select record_no, count(*) as pairs from (select record_no_a as record_no from found union all select record_no_b from found) group by 1)
select dataset_role, source, count(*) as n_records, count(pairs) as n_overlapping,
  count(*) filter (fp in (select fp from prints) and dataset_role in ('challenge', 'standard')) as n_same_fingerprint, coalesce(sum(pairs), 0)::bigint as n_pairs
from rec left join hit using (record_no) group by 1, 2
"""



def _folded(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _content(x: str, depth: int = 6) -> str:
    """A JSON value without what formatting may change, to ``depth`` levels."""
    if depth == 0:
        return f"({x})::varchar"
    k, m = f"k{depth}", f"e{depth}"
    maps = f"from_json({x}, '\"MAP(VARCHAR,JSON)\"')"
    members = f"list_sort(list_transform(map_entries({maps}), lambda {k}: {_folded(f'{k}.key')} || ':' || {_content(f'{k}.value', depth - 1)}))"
    items = f"list_transform(from_json({x}, '[\"JSON\"]'), lambda {m}: {_content(m, depth - 1)})"
    joined = lambda v: f"coalesce(list_aggregate({v}, 'string_agg', ','), '')"
    return (
        f"case json_type({x}) when 'OBJECT' then '{{' || {joined(members)} || '}}' when 'ARRAY' then '[' || {joined(items)} || ']' when 'VARCHAR' then 's' || {_folded(f'({x})->>{chr(39)}${chr(39)}')} "
        f"when 'DOUBLE' then 'n' || ({x})::double::varchar when 'BIGINT' then 'n' || ({x})::double::varchar when 'UBIGINT' then 'n' || ({x})::double::varchar else ({x})::varchar end"
    )


_ANY = lambda c: f"case when json_valid({c}) then 'j' || {_content(c + '::json')} else 't' || {_folded(c)} end"
_P4 = f"""with p as (select pair_no, min(struct_pack(a := contract_id, b := policy_pack, c := base_schema, d := candidate_schema)) as x from generated_pairs where pair_no is not null group by 1),
f as (select pair_no, {_ANY('x.a')} as a, {_ANY('x.b')} as b, {_ANY('x.c')} as c, {_ANY('x.d')} as d from p),
g as (select pair_no, min(pair_no) over w as kept, count(*) over w as n_copies from f window w as (partition by a, b, c, d))"""
P4_SQL = _P4 + " select kept as kept_pair_no, pair_no as copy_pair_no from g where pair_no <> kept"
P4_GROUPS_SQL = _P4 + " select kept as kept_pair_no, n_copies from g where pair_no = kept"

_FACT = "select '{}' as fact, {} as value"
P1_CHECK_SQL = " union all ".join([_FACT.format("records", "count(distinct record_no)") + " from generation_evidence", *(_FACT.format(f, "0") for f in ("split_families", "split_groups", "split_contracts", "without_split"))])
P7_CHECK_SQL = " union all ".join([_FACT.format("documents", "count(*)") + " from documents where length(text) > 0", *(_FACT.format(f, "0") for f in ("lost_tokens", "over_capacity", "cut_without_need"))])
P8_CHECK_SQL = " union all ".join([_FACT.format("targets", "count(distinct source)") + " from mix_targets", *(_FACT.format(f, "0") for f in ("over_repeats", "over_budget", "more_than_a_document_left"))])

P6_SQL = """
with once as (select vec_id, min(coordinates) as coordinates from feature_vectors group by vec_id),
v as (select vec_id, u.coord_index as i, sum(u.coord_value) as x from (select vec_id, unnest(coordinates) as u from once) group by 1, 2),
n as (select vec_id, sqrt(sum(x * x)) as norm from v group by 1 having sum(x * x) > 0),
c as (select a.vec_id as a, b.vec_id as b, sum(a.x * b.x) as dot from v a join v b using (i) where a.vec_id <> b.vec_id group by 1, 2),
s as (select c.a, c.b, dot / (p.norm * q.norm) as cosine from c join n p on p.vec_id = c.a join n q on q.vec_id = c.b),
t as (select a, b, cosine, row_number() over (partition by a order by round(cosine, 6) desc, b) as k from s where cosine >= 0.97)
select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from t where k <= 5 and cosine >= 0.98 - 1e-6
"""


P6_NEAREST_SQL = """
with once as (select vec_id, min(coordinates) as coordinates from feature_vectors group by vec_id),
v as (select vec_id, u.coord_index as i, sum(u.coord_value) as x from (select vec_id, unnest(coordinates) as u from once) group by 1, 2),
n as (select vec_id, sqrt(sum(x * x)) as norm from v group by 1 having sum(x * x) > 0),
c as (select a.vec_id as a, b.vec_id as b, sum(a.x * b.x) as dot from v a join v b using (i) where a.vec_id <> b.vec_id and a.vec_id % 50 = 0 group by 1, 2),
s as (select p.vec_id as a, q.vec_id as b, coalesce(dot, 0) / (p.norm * q.norm) as cosine from n p join n q on p.vec_id <> q.vec_id and p.vec_id % 50 = 0 left join c on c.a = p.vec_id and c.b = q.vec_id),
t as (select a, b, cosine, row_number() over (partition by a order by round(cosine, 6) desc, b) as k from s)
select a as vec_id, b as other_id, round(cosine, 4) as cosine, k::int as rank from t where k <= 5
"""


def _evidence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "generation_evidence")
    named = lambda c: F.when(splits.names_something(F.col(c)), F.col(c)).alias(f"{c}_key")
    return e.select("record_no", "family_id", splits.family_key(F.col("family_id")).alias("family_key"), named("split_group_id"), named("contract_id"), F.lower(F.trim("compatibility_label")).alias("label"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["family_key", "split_group_id_key", "contract_id_key"]
    e = _evidence_keys(spark, sf_dir)
    config = table(spark, sf_dir, "split_configs").filter(F.col("config_no") == SPLIT_CONFIG).first()
    groups = splits.record_components(e, "record_no", keys, "label")
    return splits.assign_splits(cut(groups, "p1-grouped"), "record_no", "label", (config["train_ratio"], config["validation_ratio"], config["test_ratio"]), str(config["seed"]))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.with_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "tokens")


def _capacity(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, "container_specs").filter(F.col("container_class") == name).first()["capacity_tokens"]


def _packed(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    capacity = _capacity(spark, sf_dir, name)
    return packing.pack(cut(packing.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "p7-sizes"), "doc_id", capacity), capacity


def _by_source(e: DataFrame) -> DataFrame:
    """Each record once, with its role and source."""
    return e.groupBy("record_no").agg(F.max(overlap.role_key(F.col("dataset_role"))).alias("dataset_role"), F.min("source").alias("source"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"))


def register(r: Registry) -> None:
    @r.add("p1_found", P1_SQL)
    def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = splits.same_component_names(_evidence_keys(spark, sf_dir), "family_id", ["family_key", "split_group_id_key", "contract_id_key"])
        return pairs.toDF("family_id_a", "family_id_b")

    @r.add("p1_assignment")
    def p1_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _assigned(spark, sf_dir).select("record_no", "split")

    @r.add("p1_check", P1_CHECK_SQL)
    def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What must hold of the assignment: every record in one split, no family, group or contract in two."""
        placed = cut(_assigned(spark, sf_dir).select("record_no", "split"), "p1-placed")
        rows = _evidence_keys(spark, sf_dir).join(placed, "record_no", "left")
        told = [placed.agg(F.countDistinct("record_no").alias("value")).select(F.lit("records").alias("fact"), "value"), rows.agg(F.count(F.when(F.col("split").isNull(), 1)).alias("value")).select(F.lit("without_split").alias("fact"), "value")]
        for name, key in (("split_families", "family_key"), ("split_groups", "split_group_id_key"), ("split_contracts", "contract_id_key")):
            two = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
            told.append(two.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("fact"), "value"))
        return reduce(DataFrame.unionByName, told)

    @r.add("p1_split_report")
    def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return splits.split_report(_assigned(spark, sf_dir))

    @r.add("p2_found", P2_SQL)
    def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quota_sample.shortfalls(quota_sample.sample(table(spark, sf_dir, "generation_evidence"), "record_no", table(spark, sf_dir, "sample_targets"))[1])

    @r.add("p2_sample")
    def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quota_sample.sample(table(spark, sf_dir, "generation_evidence"), "record_no", table(spark, sf_dir, "sample_targets"))[0]

    @r.add("p2_report", P2_REPORT_SQL)
    def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quota_sample.sample(table(spark, sf_dir, "generation_evidence"), "record_no", table(spark, sf_dir, "sample_targets"))[1]

    @r.add("p3_found", P3_SQL)
    def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = overlap.contract_overlaps(table(spark, sf_dir, "generation_evidence"), table(spark, sf_dir, "prepared_records"))
        return found.select("record_no_a", "record_no_b").distinct()

    @r.add("p3_report", P3_REPORT_SQL)
    def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "generation_evidence")
        found = cut(overlap.contract_overlaps(e, table(spark, sf_dir, "prepared_records")), "p3-found")
        sides = found.select(F.explode(F.array("record_no_a", "record_no_b")).alias("record_no"), F.when(F.col("record_no_a") == F.col("challenge_no"), F.col("record_no_b")).otherwise(F.col("record_no_a")).alias("standard_no"), "challenge_no", "kind")
        hits = sides.groupBy("record_no").agg(F.max(F.col("kind") == "fingerprint").alias("same"), F.countDistinct("challenge_no", "standard_no").alias("pairs"))
        return _by_source(e).join(hits, "record_no", "left").groupBy("dataset_role", "source").agg(
            F.count(F.lit(1)).alias("n_records"), F.count("pairs").alias("n_overlapping"), F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("n_same_fingerprint"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs")
        )

    @r.add("p3_fractions")
    def p3_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "generation_evidence")
        shares = overlap.contract_fractions(e, table(spark, sf_dir, "prepared_records"))
        return shares.join(_by_source(e), "record_no").groupBy("dataset_role", "source").agg(
            F.count(F.lit(1)).alias("n_records"), F.round(F.avg("print_overlap"), 6).alias("print_overlap"), F.round(F.avg("feature_overlap"), 6).alias("feature_overlap"), F.sum(F.when(F.col("feature_overlap") >= 0.5, 1).otherwise(0)).alias("n_half_shared")
        )

    @r.add("p4_found", P4_SQL)
    def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = format_dedup.format_duplicates(table(spark, sf_dir, "generated_pairs"), "pair_no", PAIR_FIELDS)
        return groups.filter("pair_no <> kept").select(F.col("kept").alias("kept_pair_no"), F.col("pair_no").alias("copy_pair_no"))

    @r.add("p4_groups", P4_GROUPS_SQL)
    def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        groups = format_dedup.format_duplicates(table(spark, sf_dir, "generated_pairs"), "pair_no", PAIR_FIELDS)
        return groups.filter("pair_no = kept").select(F.col("kept").alias("kept_pair_no"), "n_copies")

    @r.add("p6_found", P6_SQL)
    def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn_forest.similar_pairs(table(spark, sf_dir, "feature_vectors"), "vec_id", "coordinates", 0.98, 5, COORDINATES).toDF("vec_id_a", "vec_id_b")

    @r.add("p6_nearest", P6_NEAREST_SQL)
    def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn_forest.nearest(table(spark, sf_dir, "feature_vectors"), "vec_id", "coordinates", 5, queries=F.col("vec_id") % 50 == 0, certain=0.9, places=COORDINATES).withColumn("cosine", F.round("cosine", 4))

    @r.add("p7_found")
    def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packing.oversized(_packed(spark, sf_dir, "window-short")[0], "doc_id")

    @r.add("p7_packed")
    def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _packed(spark, sf_dir, "window-short")[0]

    @r.add("p7_fill")
    def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packing.fill_report(*_packed(spark, sf_dir, "window-long"))

    @r.add("p7_check", P7_CHECK_SQL)
    def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What must hold of the packing: every token in one container, none over its capacity, no cut without need."""
        capacity = _capacity(spark, sf_dir, "window-short")
        sizes = cut(packing.sized(table(spark, sf_dir, "documents"), "doc_id", "text"), "p7-sizes")
        boxes = cut(packing.pack(sizes, "doc_id", capacity), "p7-boxes")
        per = boxes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
        docs = sizes.filter("n_tokens > 0").join(per, "doc_id", "left")
        wide = boxes.groupBy("container").agg(F.sum("n_tokens").alias("n")).filter(F.col("n") > capacity)
        facts = docs.agg(F.count("n").alias("documents"), F.sum(F.abs(F.col("n_tokens") - F.coalesce("n", F.lit(0)))).alias("lost_tokens"), F.count(F.when((F.col("pieces") > 1) & (F.col("n_tokens") <= capacity), 1)).alias("cut_without_need"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("long").alias("value")) for n in ("documents", "lost_tokens", "cut_without_need")])).alias("x")
        return facts.select(each).select("x.*").unionByName(wide.agg(F.count(F.lit(1)).alias("value")).select(F.lit("over_capacity").alias("fact"), "value"))

    @r.add("p8_check", P8_CHECK_SQL)
    def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What must hold of the mixture: caps and budget kept, and no room left for the next document in the queue."""
        sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
        mixed = cut(mixing.mix(sized, "doc_id", "source", targets), "p8-mixed")
        most = targets.agg(F.max("budget_tokens").alias("budget"), F.max("max_repeats").alias("cap")).first()
        longest = sized.agg(F.max("n_tokens")).first()[0]
        total = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"))
        used = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(mixing._targets(targets).select("source", "max_repeats"), "source").filter("n > max_repeats")
        reported = mixing.share_report(mixed, sized, "source", targets).agg(F.count(F.lit(1)).alias("value")).select(F.lit("targets").alias("fact"), "value")
        facts = total.select(F.greatest(F.col("t") - most["budget"], F.lit(0)).alias("over_budget"), F.greatest(F.lit(most["budget"] - longest) - F.col("t"), F.lit(0)).alias("more_than_a_document_left"))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("long").alias("value")) for n in facts.columns])).alias("x")
        return facts.select(each).select("x.*").unionByName(reported).unionByName(used.agg(F.count(F.lit(1)).alias("value")).select(F.lit("over_repeats").alias("fact"), "value"))

    @r.add("p8_found")
    def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
        return mixing.short_sources(mixing.share_report(mixing.mix(sized, "doc_id", "source", targets), sized, "source", targets))

    @r.add("p8_mixture")
    def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mixing.mix(_sized(spark, sf_dir), "doc_id", "source", table(spark, sf_dir, "mix_targets"))

    @r.add("p8_shares")
    def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
        sized, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
        return mixing.share_report(mixing.mix(sized, "doc_id", "source", targets), sized, "source", targets)

    @r.add("p9_found")
    def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _classified(spark, sf_dir).select("doc_id", "subject_area")

    @r.add("p9_composition")
    def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
        return _classified(spark, sf_dir).join(docs, "doc_id").groupBy("subject_area").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"))
