"""Readiness facts, retention against a plain fold, identity checks, component joins, projections, replays, binary runs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill.operators import audit, candidates, integrity, matrices, models, readiness, reports, retention
from driftmill.plans import commands

RECORD = "family_id string, dataset_role string, policy_pack string, mutation string, mutation_variant string, root_object_profile string, oracle_outcome string, oracle_stdout string, pair_fingerprint string, label string, mode string, oracle_hash string, policy_hash string, rec int"


def sound(spark, **changes):
    """Records of which no fact fails."""
    rows = []
    for f in range(8):
        role = "challenge" if f > 4 else "standard"
        for m in ("enum_value_added", "optional_field_added"):
            for i, p in enumerate(("a", "b", "c")):
                label = ("safe", "warning", "breaking")[(i + f) % 3]
                rows.append((f"f{f}", role, p, m, f"v{f % 2}", ("open", "closed")[f % 2], label, "FAIL", f"{f}{m}{p}", label, "B", "o", "h", len(rows)))
    df = spark.createDataFrame(rows, RECORD)
    for c, v in changes.items():
        df = df.withColumn(c, v)
    return df


def failed(df, **how):
    return {r["fact"] for r in readiness.generalization(df, "label", **how).collect() if r["failed"]}


def test_generalization(spark):
    assert failed(sound(spark)) == set()
    assert "breaking_without_decision" in failed(sound(spark, oracle_stdout=F.lit(" ")))
    assert failed(sound(spark, dataset_role=F.lit(None).cast("string"))) >= {"challenge_records", "unmeaningful_protocols", "optional_open_challenge_families"}
    assert failed(sound(spark, family_id=F.lit("f"))) >= {"leaked_families", "standard_families"}
    assert "leaked_pairs" in failed(sound(spark, pair_fingerprint=F.lit("x"))) and "leaked_pairs" not in failed(sound(spark, pair_fingerprint=F.lit("")))
    assert "family_changes" in failed(sound(spark, mutation=F.lit(None).cast("string")))
    assert failed(sound(spark, policy_pack=F.lit("a"))) >= {"complete_counterfactuals", "shortcut_risks"}
    assert failed(sound(spark, root_object_profile=F.lit(None).cast("string"))) >= {"optional_without_profile", "optional_closed_standard_families"}
    one = sound(spark, label=F.when(F.col("mutation") == "enum_value_added", "safe").otherwise(F.col("label")))
    assert failed(one) >= {"shortcut_risks", "unmeaningful_protocols"}
    told = one.filter("mutation = 'enum_value_added'").select("mutation", "mode", "policy_pack", "label", "oracle_hash", "policy_hash").distinct().withColumn("rationale", F.lit("why"))
    assert failed(one, promotions=told) == set()
    assert failed(one, promotions=told.filter("policy_pack = 'a'")) >= {"shortcut_risks"}
    assert failed(sound(spark).filter("false")) >= {"standard_families", "challenge_records", "family_changes"}


def test_training_readiness(spark):
    df = sound(spark)
    get = lambda d, three=True: {r["fact"]: r["failed"] for r in readiness.training(d, "family_id", "label", three, (0.6, 0.2, 0.2), 1).collect()}
    ok = get(df)
    assert not any(ok.values()) and {"train_records", "validation_records", "test_records", "partitions"} <= set(ok)
    assert get(df.filter("label <> 'warning'"))["warning"] and not get(df.filter("label <> 'warning'"), False)["warning"]
    few = get(df.withColumn("family_id", F.lit("f")))
    assert few["standard_groups"] and few["partitions"]
    with pytest.raises(ValueError, match="standard_groups"):
        readiness.required(readiness.training(df.filter("family_id = 'f0'"), "family_id", "label", False, (0.6, 0.2, 0.2), 1), "it")


def test_coverage_and_peers(spark):
    df = sound(spark)
    rows = {r["target"]: r for r in commands.coverage_status(df, "label", 10, 2, 2, 1, per_profile=(2, 9), gate=True).collect()}
    assert rows["records"]["met"] and rows["optional_open_standard_families"]["met"] and not rows["optional_open_challenge_families"]["met"] and not any(t.startswith("gate") for t in rows)
    assert any(r["target"] == "gate: challenge_records" for r in commands.coverage_status(df.filter("dataset_role = 'standard'"), "label", 1, 1, 0, 1, gate=True).collect())
    assert audit.peer_variant_exists(df, "enum_value_added", "v0") and not audit.peer_variant_exists(df.filter("mutation_variant = 'v0'"), "enum_value_added", "v0")
    assert {(r["variant"], r["has_peer"]) for r in audit.peer_variants(df.filter("mutation = 'optional_field_added'")).collect()} == {("root-open", True), ("root-closed", True)}
    allowed = spark.createDataFrame([("u", "v0")], "unique_id string, variant string")
    table = spark.createDataFrame([("u", "v0"), ("u", "v1"), ("w", "v0")], "unique_id string, variant string")
    assert candidates.allowed_variants(table, allowed).count() == 1


@pytest.mark.parametrize("within,limit,total,keep", [(False, 2, 9, ()), (True, 1, None, ("k0",)), (False, None, 5, ())])
def test_retention_against_a_fold(spark, within, limit, total, keep):
    rnd = random.Random(3)
    rows = [(s, f"s{s}", o, f"k{rnd.randrange(3)}", f"v{o}", p, f"p{p}", rnd.choice(["safe", "warning", "breaking", "rejected", None]), f"{rnd.randrange(60)}") for s in range(12) for o in range(6) for p in range(3)]
    kind = {(s, o): k for s, _, o, k, *_ in rows}
    rows = [(s, i, o, kind[s, o], v, p, pk, out, fp) for s, i, o, _, v, p, pk, out, fp in rows]
    want, seen, strata, outs, kinds = {}, set(), {}, {}, {}
    for s in range(12):
        if total is not None and all(outs.get(o, 0) >= total for o in ("safe", "warning", "breaking")):
            want.update({(s, r[2], r[5]): "not reached" for r in rows if r[0] == s})
            continue
        before = dict(kinds)
        for _, i, o, k, v, p, pk, out, fp in sorted((r for r in rows if r[0] == s), key=lambda r: (before.get(r[3], 0), r[2], r[5])):
            key = (i, pk, k, out, v if k in keep else None) if within else (pk, k, out)
            if out in ("rejected", None):
                want[s, o, p] = "rejected"
            elif fp in seen:
                want[s, o, p] = "duplicate"
            elif (limit is not None and strata.get(key, 0) >= limit) or (total is not None and outs.get(out, 0) >= total):
                want[s, o, p] = "over quota"
            else:
                seen.add(fp)
                strata[key], outs[out], kinds[k] = strata.get(key, 0) + 1, outs.get(out, 0) + 1, kinds.get(k, 0) + 1
                want[s, o, p] = "retained"
    df = spark.createDataFrame(rows, "seed_no long, seed_id string, ordinal int, kind string, variant string, policy_no int, policy_pack string, outcome string, fingerprint string")
    got = {(r["seed_no"], r["ordinal"], r["policy_no"]): r["decision"] for r in retention.retain(df.repartition(5), limit, total, within, keep).collect()}
    assert got == want
    assert retention.report(retention.retain(df.filter("false"), 1)).count() == 0


def test_manifest_and_provenance(spark):
    good = {c: "x" for c in integrity.REQUIRED} | {"source_url": "https://a", "source_kind": "public-version-history", "external_use": "traceability-only", "record_id": "r1", "mutation_id": "m"}
    rows = spark.createDataFrame([good], ", ".join(f"{c} string" for c in good))
    summary = {"total_transitions": 1, "mutation_id_counts": {"m": 1}, "limitations": ["l"], "preserved_source_files": ["f"], "traceability_only": {"status": "traceability-only", "accuracy_evidence": False, "clean_record_count": 1, "clean_record_ids": ["r1"], "overlap_characterization": "o", "rejection_skew": {"m": {"selected": 3, "clean": 1, "rejected": 2}}}}
    assert integrity.manifest_problems(rows).count() == 0 and integrity.summary_problems(rows, summary).count() == 0
    bad = {"total_transitions": 2, "mutation_id_counts": {"m": 2, "n": 1}, "limitations": [" "], "traceability_only": {"clean_record_ids": ["r2"]}}
    assert {r[0] for r in integrity.summary_problems(rows, bad).collect()} >= {"total_transitions does not match 1 rows", "count of m", "count of n", "a limitation is blank", "no preserved source files", "clean_record_ids and rows differ in r1", "clean_record_ids and rows differ in r2"}
    odd = rows.withColumn("source_url", F.lit("ftp://a")).union(rows.withColumn("source_kind", F.lit("manual-unrelated")))
    assert {r["problem"] for r in integrity.manifest_problems(odd).collect()} == {"a public source needs a web address", "a manual source needs a manual:// address", "repeated record_id"}
    records = spark.createDataFrame([("o", "p")] * 3, "oracle_hash string, policy_hash string")
    pairing = dict(zip(integrity.PAIRING, ("d", "o", "e", "p", "a")))
    audit_doc = {
        "format_version": "f1", "status": "COMPLETE", "identity_boundary": {"historical_v9_jar_sha256": "o", "backward_v10_jar_sha256": "e"}, "inputs": {"v9_dataset_sha256": "d", "v10_jar_sha256": "e", "policy_packs_sha256": "p"},
        "conclusion": {"behavioral_result": integrity.AUDIT_RESULT, "all_preserved_v9_outcomes_match": True, "all_preserved_v9_stdout_match": True, "negative_controls_passed": True, "identity_interchangeable": False},
        "reconstruction": {"records": 3, "historical_pair_fingerprints_verified": 3, "historical_pair_fingerprint_failures": 0},
        "preserved_v9_replay": {"invocations": 3, "outcome_matches": 3, "exact_stdout_matches": 3, "rejected": 0, "outcome_mismatches": 0, "exact_stdout_mismatches": 0, "stderr_nonempty": 0},
    }
    model, run = {"dataset_sha256": "d", "oracle_jar_sha256": "o", "policy_packs_sha256": "p"}, {"oracle_jar_sha256": "e", "policy_packs_sha256": "p"}
    check = lambda doc=audit_doc, m=model, registry=(pairing,), recs=records: integrity.dual_provenance(recs, m, run, json.dumps(doc), "a", list(registry), "f1")
    assert check()["execution_oracle_jar_sha256"] == "e"
    assert integrity.audit_problems(json.dumps({**audit_doc, "status": "x", "reconstruction": {"records": True}}), pairing, 3, "f1")[:1] == ["/status"] and integrity.audit_problems("{", pairing, 3, "f1") == ["no JSON"]
    for wrong in (lambda: check(registry=()), lambda: check(m={**model, "oracle_jar_sha256": "z"}), lambda: check(doc={**audit_doc, "status": "x"}), lambda: check(recs=records.union(spark.createDataFrame([("q", "p")], records.schema)))):
        with pytest.raises(ValueError):
            wrong()
    integrity.policy_scope("a.json", "1", "fix.json", "9")
    integrity.policy_scope("fix.json", "9", "fix.json", "9", audit_only=True)
    for args in (("fix.json", "9", "fix.json", "9"), ("b.json", "9", "fix.json", "9", True)):
        with pytest.raises(ValueError):
            integrity.policy_scope(*args)


def test_components_and_classes(spark):
    a = {"definitions": {"x": {"type": "object", "properties": {"p": {"type": "string"}, "a/b": {}}}, "y": {"type": "string"}, "z": {"title": "t"}, "w": {"properties": {"properties": {"type": "string"}}}}}
    b = {"definitions": {"x": {"type": "object", "properties": {"p": {"type": "string"}}}, "y": {"type": "integer", "enum": [1]}, "z": {"title": "u", "x-vendor-a": {"b": 1}}, "n": {}, "w": {"properties": {"properties": {"type": "string", "minimum": 1}}}}}
    df = spark.createDataFrame([(1, json.dumps(a), json.dumps(b)), (2, "no", json.dumps(b)), (3, None, "[]")], "id int, base string, candidate string")
    joined = reports.component_join(df, ["id"], "base", "candidate").cache()
    assert {(r["component"], r["status"]) for r in joined.filter("id = 1").collect()} == {("x", "changed"), ("y", "changed"), ("z", "changed"), ("w", "changed"), ("n", "added")}
    assert {r["status"] for r in joined.filter("id = 2").collect()} == {"added"} and joined.filter("id = 3").count() == 0
    got = {r["component"]: (r["decision"], r["kinds"]) for r in reports.component_changes(joined, ["id"], ("x-vendor-",)).collect()}
    assert got == {"x": ("FIELD_REMOVED", ["FIELD_REMOVED"]), "y": ("COMPOUND", ["ENUM_CHANGED", "TYPE_CHANGED"]), "z": ("METADATA_ONLY", []), "w": ("FIELD_ADDED", ["FIELD_ADDED"])}  # the last name "properties" counts
    ops = spark.createDataFrame([(1, "change", ["if", "x"])], "id int, operation string, path array<string>")
    assert candidates.classify_operations(ops, ["id"]).first()["decision"] == "UNMAPPED_SINGLE_CHANGE"


def test_projection_traces_replay(spark):
    d = spark.createDataFrame([("a", 3, False), ("b", 1, False), ("c", None, None)], "record_id string, distance int, oracle_invoked boolean")
    manifest = spark.createDataFrame([("a", '{"p": 1}', '{"p": "2"}'), ("b", "{}", "{}"), ("c", None, "{}")], "record_id string, base_schema string, candidate_schema string")
    got = reports.projection(d, manifest)
    assert {r["record_id"]: r["accepted"] for r in got.collect()} == {"a": True, "b": False, "c": False}
    assert reports.projection_summary(got).first()["outcome"] == "NON_OVERLAPPING_CANDIDATES_FOUND" and reports.projection_summary(got.filter("false")).first()["candidate_count"] == 0
    with pytest.raises(ValueError):
        reports.projection(d, manifest.limit(2))
    with pytest.raises(Exception, match="forbidden"):
        reports.projection(d.withColumn("oracle_invoked", F.lit(True))).collect()
    trace = {r["record_id"]: (r["before"], r["after"], r["distance"]) for r in reports.raw_traces(manifest, d, "$.p").collect()}
    assert trace == {"a": ("1", "2", 3), "b": (None, None, 1), "c": (None, None, None)}
    with pytest.raises(Exception, match="no diagnosis"):
        reports.raw_traces(manifest, d.limit(1), "$.p").collect()
    told = spark.createDataFrame([(1, "safe", "x"), (2, None, "y"), (3, "safe", "z")], "k int, outcome string, stdout_sha256 string")
    again = spark.createDataFrame([(1, "safe", "x", ""), (2, None, "q", "e")], "k int, outcome string, stdout_sha256 string, stderr string")
    compared, verdict = commands.audit_equivalence(told, again, "k")
    assert {r["k"]: (r["outcome_match"], r["stdout_match"], r["stderr_empty"]) for r in compared.collect()} == {1: (True, True, True), 2: (True, False, False), 3: (False, False, False)}
    assert tuple(verdict.first()) == (3, 2, 1, 2, 1, "INCOMPLETE") and commands.audit_equivalence(told.limit(1), again, "k")[1].first()["status"] == "COMPLETE"
    runs = spark.createDataFrame([(1, 0.5), (2, 0.5)], "seed int, accuracy double")
    assert {r["seed"]: r["matches"] for r in reports.against_reference(runs, spark.createDataFrame([(1, 0.5), (2, 0.6)], runs.schema), ["accuracy"]).collect()} == {1: True, 2: False}
    with pytest.raises(Exception, match="no seed"):
        reports.against_reference(runs, runs.limit(1), ["accuracy"]).collect()


def test_matched_optional_and_matrices(spark):
    schemas = spark.createDataFrame([(i, f"u{i}", '{"type": "object", "properties": {"a": {}}}') for i in range(4)] + [(9, "bad", "[]")], "family_no long, unique_id string, json_schema string")
    pre = spark.createDataFrame([("u1", "rejected"), ("u2", "safe")], "family_id string, outcome string")
    got = commands.matched_optional(schemas, ["p", "q"], ["BACKWARD"], 2, pre)
    assert {r["unique_id"] for r in got.collect()} == {"u0", "u2"} and got.count() == 2 * 2 * len(candidates.ADDED) * 2
    with pytest.raises(ValueError):
        commands.matched_optional(schemas, [], ["B"], 2)
    rng = np.random.default_rng(0)
    x, y = rng.integers(-3, 4, (5, 4)), rng.integers(-3, 4, (4, 6))
    long = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row int, col int, value double")
    assert {(r["row"], r["col"]): r["value"] for r in matrices.multiply(long(x), long(y)).collect()} == {(i, j): float(v) for (i, j), v in np.ndenumerate(x @ y)}


def test_binary_runs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"f{i % 12}", "challenge" if i % 12 > 9 else "standard", "breaking" if v[0] > 0 else "safe", [float(z) for z in v], [float(v[0] > 0)]) for i, v in enumerate(rng.standard_normal((360, 3)))]
    df = spark.createDataFrame(rows, "n int, family_id string, role string, label string, features array<double>, target array<double>")
    split = spark.createDataFrame([(f"f{i}", "train" if i < 6 else "validation" if i < 8 else "test") for i in range(10)], "family_id string, partition string")
    run = commands.train(df, split, "family_id", "n", (0.3, 0.5), epochs=400, rate=0.5)
    got = {r["partition"]: r["accuracy"] for r in run["metrics"].collect()}
    assert got["test"] > 0.85 and run["thresholds"].count() == 2 and run["model"].first()["validation_loss"] is not None
    assert {r["rule"]: r["accuracy"] for r in run["baselines"].collect()}["model"] == got["test"]
    both = commands.run_binary_experiment(df, (0.6, 0.2, 0.2), [1, 2], "family_id", "n", True, epochs=5)
    assert {(r["seed"], r["part"]) for r in both.collect()} == {(s, p) for s in ("1", "2") for p in ("test", "challenge")}
    assert all(r["tp"] + r["fp"] + r["tn"] + r["fn"] == 60 for r in both.filter("part = 'challenge'").collect())
    with pytest.raises(ValueError):
        commands.run_binary_experiment(df, (0.6, 0.2, 0.2), [1], "family_id", "n", None)
    with pytest.raises(ValueError, match="breaking"):
        commands.run_binary_experiment(df.filter("label = 'safe'"), (0.6, 0.2, 0.2), [1], "family_id", "n", True)
    three = df.withColumn("target", F.when(F.col("label") == "safe", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    told = commands.train_three_way(three, split, "family_id", "n", epochs=5)
    assert told["confusion"].count() == 9 and {r["partition"] for r in told["metrics"].collect()} == {"validation", "test"}
