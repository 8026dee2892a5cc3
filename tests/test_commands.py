"""Commands composed of operators: generation, refeaturing, admission, removal audit, serving, gates."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill import runtime
from driftmill.operators import admission, candidates, models, policy
from driftmill.plans import commands

SCHEMA = json.dumps({"type": "object", "properties": {"a": {"type": "string", "enum": ["x", "y"]}, "b": {"type": "integer"}}})


def packs(spark):
    return policy.resolve(spark, {"p": {}, "q": {"ENUM_VALUE_ADDED": "IGNORE"}})


def test_generate_and_refeature(spark):
    schemas = spark.createDataFrame([("u1", SCHEMA), ("u2", SCHEMA), ("u3", None), ("u4", "[]")], "unique_id string, json_schema string")
    made = commands.generate(schemas, packs(spark), ["BACKWARD"], None, 0.0, 1).cache()
    assert {r["unique_id"] for r in made.collect()} == {"u1"} and made.filter("label_source <> 'heuristic'").count() == 0
    label = {(r["kind"], r["policy_pack"]): r["compatibility_label"] for r in made.collect()}
    assert label["enum_value_added", "p"] == "warning" and label["enum_value_added", "q"] == "safe" and label["field_removed", "p"] == "breaking"
    some = commands.generate(schemas, packs(spark), ["BACKWARD"], None, 0.0, 1, kinds=("enum_value_added", "field_removed"), allowed=spark.createDataFrame([("u1", "add-type-preserving-enum-value-0"), ("u2", "x")], "unique_id string, variant string"))
    assert {(r["kind"], r["policy_pack"]) for r in some.collect()} == {("enum_value_added", "p"), ("enum_value_added", "q")}
    one = made.first()["pair_fingerprint"]
    told = commands.generate(schemas, packs(spark), ["BACKWARD"], spark.createDataFrame([(one, "PASS")], "pair_fingerprint string, outcome string"), 0.0, 1)
    assert [r["compatibility_label"] for r in told.filter("label_source = 'recorded'").collect()] == ["safe"]
    assert commands.generate(schemas, packs(spark), ["BACKWARD"], None, 0.0, 1, per_stratum=1).count() < made.count()
    rows = made.select(F.concat_ws(":", "unique_id", "kind", "variant", "policy_pack").alias("record_id"), F.col("unique_id").alias("family_id"), "kind", "variant", "policy_pack", F.col("features").alias("old"))
    marked = made.select(F.concat_ws(":", "unique_id", "kind", "variant", "policy_pack").alias("record_id"), F.col("unique_id").alias("family_id"), "kind", "variant", "policy_pack", "mode", "pair_fingerprint", F.lit("recorded").alias("oracle_hash"))
    assert commands.refeature(marked, schemas, packs(spark), "recorded").count() == made.count()
    with pytest.raises(ValueError):
        commands.refeature(marked, schemas, packs(spark), "other")
    with pytest.raises(Exception, match="another pair"):
        commands.refeature(marked.withColumn("pair_fingerprint", F.lit("0")), schemas, packs(spark), "recorded").collect()
    numbered = made.withColumn("seed_no", F.lit(1))
    kept, report = commands.retained(numbered, "seed_no", ["p", "q"], 1)
    assert kept.groupBy("policy_pack", "kind", "compatibility_label").count().filter("count > 1").count() == 0
    assert {r["decision"]: r["n"] for r in report.collect()} == {"retained": kept.count(), "over quota": made.count() - kept.count()}
    again = commands.refeature(rows, schemas, packs(spark))
    assert again.count() == made.count() and again.filter("old <> features").count() == 0
    with pytest.raises(Exception, match="no candidate"):
        commands.refeature(rows.withColumn("variant", F.lit("gone")), schemas, packs(spark)).collect()


def test_generate_drops_repeats_before_packs_and_modes(spark):
    """A schema in another layout is the same; nothing is written aside, and no row is moved once packs and modes multiply it."""
    laid_out = '{ "properties": {"b": {"type": "integer"}, "a": {"enum": ["x", "y"], "type": "string"}}, "type": "object" }'
    schemas = spark.createDataFrame([("u2", SCHEMA), ("u1", laid_out), ("u3", SCHEMA.replace('"b"', '"c"'))], "unique_id string, json_schema string")
    before = list(runtime.OPEN_CUTS)
    made = commands.generate(schemas, packs(spark), ["BACKWARD", "FULL"], None, 0.0, 1)
    rows = made.collect()
    assert runtime.OPEN_CUTS == before and "Join Inner" not in made._jdf.queryExecution().optimizedPlan().toString()
    n = len(candidates.candidates(SCHEMA))
    assert len({x for _, _, x in candidates.candidates(SCHEMA)}) == n and {r["unique_id"] for r in rows} == {"u1", "u3"}
    assert len(rows) == len({r["pair_fingerprint"] for r in rows}) == 2 * 2 * 2 * n
    allowed = spark.createDataFrame([("u2", "remove-first-root-property"), ("u2", "optional-array-field"), ("u1", "optional-array-field"), ("u3", "x")], "unique_id string, variant string")
    some = commands.generate(schemas, packs(spark), ["BACKWARD"], None, 0.0, 1, allowed=allowed).collect()
    assert {(r["unique_id"], r["variant"]) for r in some} == {("u2", "remove-first-root-property"), ("u1", "optional-array-field")} and len(some) == 4


def test_refeature_parses_a_candidate_once(spark):
    """Records are joined with what was measured of their candidate, not each parsed again."""
    schemas = spark.createDataFrame([("u1", SCHEMA), ("u1", SCHEMA)], "unique_id string, json_schema string")
    records = spark.createDataFrame([(f"{p}{i}", "u1", "field_removed", "remove-first-root-property", p) for p in "pq" for i in range(3)], "record_id string, family_id string, kind string, variant string, policy_pack string")
    again = commands.refeature(records, schemas, packs(spark))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter,.*family_id", plan).start() < plan.index("MapInArrow")
    rows = again.collect()
    assert sorted(r["record_id"] for r in rows) == sorted(r["record_id"] for r in records.collect())
    assert len({(r["policy_pack"], tuple(r["features"])) for r in rows}) == 2


def test_refeature_sends_no_candidates_to_the_driver(spark, tmp_path):
    """The planner takes the measured candidates of a file for few; they are joined by a shuffle all the same."""
    spark.createDataFrame([("u1", SCHEMA)], "unique_id string, json_schema string").write.parquet(str(tmp_path / "schemas"))
    records = spark.createDataFrame([("r", "u1", "field_removed", "remove-first-root-property", "p")], "record_id string, family_id string, kind string, variant string, policy_pack string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        again = commands.refeature(records, spark.read.parquet(str(tmp_path / "schemas")), packs(spark))
        plan = again._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [family_id" in plan and "BroadcastHashJoin [family_id" not in plan
        assert again.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_refeature_multiplies_by_packs_after_the_join(spark):
    """A record with several packs is moved once and stands for one under each; one without any is an error."""
    schemas = spark.createDataFrame([("u1", SCHEMA)], "unique_id string, json_schema string")
    one = spark.createDataFrame([(v, "u1", k, v, ["p", "q"]) for k, v, _ in candidates.candidates(SCHEMA)], "record_id string, family_id string, kind string, variant string, policy_pack array<string>")
    again = commands.refeature(one, schemas, packs(spark))
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < re.search(r"Join LeftOuter,.*family_id", plan).start()
    each = commands.refeature(one.withColumn("policy_pack", F.explode("policy_pack")), schemas, packs(spark))
    listed = lambda df: sorted((r["record_id"], r["policy_pack"], tuple(r["features"])) for r in df.collect())
    assert listed(again) == listed(each) and len(listed(again)) == 2 * one.count()
    with pytest.raises(Exception, match="unknown policy pack"):
        commands.refeature(one.withColumn("policy_pack", F.array().cast("array<string>")), schemas, packs(spark)).collect()


def test_admission():
    good = [SCHEMA, '{"type": ["string", "null"]}', '{"type": "object", "x-any": 1, "minProperties": 2.0, "patternProperties": {"^a": true}}']
    wrong = {'{"type": "string", "minLength": -1}': "$.minLength", '{"type": "number", "multipleOf": 0}': "$.multipleOf", '{"type": "string", "pattern": "("}': "$.pattern", '{"type": "object", "required": ["a", "a"]}': "$.required", '{"type": "object", "allOf": []}': "$.allOf", '{"type": "object", "properties": {"a": 3}}': "$.properties.a"}
    assert {t: admission.admission_error(t) for t in wrong} == {t: f"INVALID_SCHEMA: {at}" for t, at in wrong.items()}
    assert all(admission.admission_error(t) is None for t in good)
    bad = {"{": "INVALID_SCHEMA: $", "{}": "UNSUPPORTED_SCHEMA: $", '{"type": "text"}': "INVALID_SCHEMA: $", '{"type": "object", "additionalProperties": {}}': "UNSUPPORTED_SCHEMA: $", '{"type": "array", "items": {"$ref": "#"}}': "UNSUPPORTED_SCHEMA: $.items"}
    assert {t: admission.admission_error(t) for t in bad} == bad and admission.admission_error(None) == "INVALID_SCHEMA: $"


def test_removal_audit(spark):
    runs = spark.createDataFrame([("root-optional-removal", "p", 1, "FIELD_REMOVED removed"), ("root-required-removal", "p", 1, "REQUIRED_FIELD_ADDED removed"), ("nested-optional-removal", "p", 2, "")], "case_id string, policy_pack string, exit_code int, stdout string")
    assert {r["case_id"]: r["passed"] for r in commands.audit_forward_removals(runs).collect()} == {"root-optional-removal": True, "root-required-removal": False, "nested-optional-removal": False}


def test_shadow_predict(spark):
    text = models.artifact(models.initial([76, 4, 3], "softmax"), np.zeros(76), np.ones(76), "v6", "three-way")
    req = spark.createDataFrame([(1, SCHEMA, SCHEMA, " P "), (2, "{}", SCHEMA, "p"), (3, SCHEMA, SCHEMA, "zz")], "id int, base_schema string, candidate_schema string, policy_pack string")
    ok, refused = commands.shadow_predict(req, ["id"], packs(spark), [("s1", text), ("s2", text)])
    assert {(r["id"], r["model_seed"]) for r in ok.collect()} == {(1, "s1"), (1, "s2")}
    assert {r["id"]: r["error"].split(":")[0] for r in refused.collect()} == {2: "UNSUPPORTED_SCHEMA", 3: "UNKNOWN_POLICY"}
    assert commands.health([("s1", text)], 1) and not commands.health([("s1", "{}")], 1)


def test_gates(spark):
    ready = spark.createDataFrame([("x", 1, False)], "fact string, value long, failed boolean")
    meta = spark.createDataFrame([("d", None)], "dataset_version string, benchmark_ready boolean")
    assert commands.promote_benchmark_ready(meta, ready).first()["benchmark_ready"]
    with pytest.raises(ValueError):
        commands.promote_benchmark_ready(meta, ready.withColumn("failed", F.lit(True)))
    with pytest.raises(ValueError):
        commands.run_experiments(meta, [], (0.7, 0.15, 0.15), [1], "g", "o", False)
    rows = admission.isolation_manifest(spark.createDataFrame([("f", '{"properties": {"r": {"$ref": "#/x"}}}'), ("g", "no")], "family_id string, schema string"), ["p", "q"])
    assert rows.count() == 16 and rows.filter("base_schema like '%$ref%'").count() == 0
