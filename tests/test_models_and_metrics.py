"""Networks, optimisers, training, metrics, splits, similarity, evidence, sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill.functions import labels, vectors
from driftmill.operators import audit, evidence, external, metrics, models, scaling, similarity, splitting
from driftmill.sources import fixtures, readers, writers
from driftmill.streaming.scoring import score_stream


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_vectors_raise(spark):
    assert one(spark, vectors.dot(arr(1, 2), arr(3, 4))) == 11
    for bad in (vectors.dot(arr(1), arr(1, 2)), vectors.normalize(arr(0, 0)), vectors.get(arr(1), 1), vectors.cross_entropy(arr(0.5, 0.6), arr(1, 0))):
        with pytest.raises(Exception):
            one(spark, bad)
    assert one(spark, vectors.argmax_last(arr(3, 1, 3))) == 2
    assert one(spark, vectors.transpose(F.array(arr(1, 2), arr(3, 4)))) == [[1, 3], [2, 4]]
    assert one(spark, vectors.zeros(1, 2)) == [[0, 0]] and one(spark, vectors.sigmoid(F.lit(-800.0))) == 0


def test_labels(spark):
    assert one(spark, labels.warns(F.lit("x\nWarnings: [a]"))) and not one(spark, labels.warns(F.lit("Warnings: []")))
    assert one(spark, labels.invocation_outcome(F.lit(1), F.lit(""), F.lit("Exception in thread main"))) == "rejected"
    assert one(spark, labels.invocation_outcome(F.lit(0), F.lit("ok"), F.lit(""))) == "safe"
    assert one(spark, labels.semver_ordinal(F.lit("2.4.3"))) == 2004003
    assert one(spark, labels.rule_key(F.lit(" enum-value-added "))) == "ENUM_VALUE_ADDED"


@pytest.mark.parametrize("kind", ["sgd", "momentum", "adam"])
def test_training_lowers_the_loss(kind):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((90, 4))
    t = np.eye(3)[np.argmax(x[:, :3], 1)]
    net = models.initial([4, 12, 6, 3], "softmax")
    history = models.train(net, x, t, 600, 16, models.Optimizer(kind, 0.05 if kind != "adam" else 0.01), (x, t))
    assert history[-1][0] < history[0][0] and history[-1][1] is not None


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    for head in ("softmax", "sigmoid"):
        net = models.initial([3, 5, 2], head)
        for w in net.weights:
            w += rng.standard_normal(w.shape)
        x, t = rng.standard_normal((4, 3)), np.eye(2)[[0, 1, 1, 0]]
        g = models.gradients(net, x, t)
        w, eps = net.weights[0], 1e-6
        w[1, 2] += eps
        up = models.loss(net, x, t)
        w[1, 2] -= 2 * eps
        down = models.loss(net, x, t)
        assert abs((up - down) / (2 * eps) - g[0][1, 2]) < 1e-5


@pytest.mark.parametrize("head", ["softmax", "sigmoid"])
def test_descent_is_the_general_rule(head):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((70, 5))
    t = np.eye(3)[rng.integers(0, 3, 70)] if head == "softmax" else (x[:, :1] > 0).astype(float)
    a, b = (models.initial([5, 7, 4, t.shape[1]], head) for _ in range(2))
    told = models.train(a, x, t, 9, 16, models.Optimizer("sgd", 0.3), (x[:9], t[:9]))
    rates = models.Optimizer("momentum", 0.3, momentum=0.0)  # the same rule by the general way
    again = models.train(b, x, t, 9, 16, rates, (x[:9], t[:9]))
    assert np.allclose(told, again) and all(np.allclose(p, q) for p, q in zip([*a.weights, *a.biases], [*b.weights, *b.biases]))


def test_artifact_round_trip(spark):
    net = models.initial([2, 3, 3], "softmax")
    text = models.artifact(net, np.zeros(2), np.ones(2), "w2", "three-way")
    again, *_ = models.from_artifact(text)
    assert np.allclose(again.predict(np.ones((1, 2))), net.predict(np.ones((1, 2))))
    with pytest.raises(ValueError):
        models.from_artifact(json.dumps({**json.loads(text), "class_order": ["breaking", "warning", "safe"]}))
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, features array<double>")
    one = json.loads(models.artifact(models.initial([2, 3, 1], "sigmoid"), np.zeros(2), np.ones(2), "w2", "binary", 0.0))
    assert models.score(df, ["id"], "features", [("b", json.dumps(one))]).first()["predicted"] == "1"  # a threshold of 0 is one
    for bad in ({**one, "threshold": 2}, {**one, "kind": "three-way"}, {**one, "feature_version": "v6"}):
        with pytest.raises(ValueError):
            models.from_artifact(json.dumps(bad))
    rows = models.score(df, ["id"], "features", [("s1", text), ("s2", text)]).collect()
    assert len(rows) == 2 and abs(sum(rows[0]["probabilities"]) - 1) < 1e-9


def test_stream_scores_every_row(spark, tmp_path):
    text = models.artifact(models.initial([2, 3, 3], "softmax"), np.zeros(2), np.ones(2), "w2", "three-way")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id int, features array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, features array<double>").parquet(str(tmp_path / "in"))
    score_stream(stream, ["id"], "features", [("s", text)], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_experiment_jobs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"f{i % 10}", "standard" if i % 4 else "challenge", ["p", "q"][i % 2], "m", ["safe", "warning", "breaking"][int(v[0] > 0) * 2], [float(z) for z in v]) for i, v in enumerate(rng.standard_normal((200, 2)))]
    df = spark.createDataFrame(rows, "n int, family_id string, role string, policy_pack string, mutation string, label string, features array<double>").withColumn("target", labels.one_hot(F.col("label")))
    split = spark.createDataFrame([(f"f{i}", "train" if i < 7 else "test") for i in range(10)], "family_id string, partition string")
    got = {r["protocol"]: r for r in models.experiment(df, ["normal-family-split", "held-out-policy:p"], split, "family_id", "n", epochs=600, rate=0.1).collect()}
    assert got["normal-family-split"]["accuracy"] > 0.8 and got["held-out-policy:p"]["n_test"] == 50


def test_all_protocols(spark):
    rng = np.random.default_rng(7)
    forms = [("p", "m", "v"), ("q", "m", "w"), ("p", "enum_value_added", "a"), ("q", "enum_value_added", "b"), ("q", "n", "x")]
    rows = [(i, f"f{i // 15}", "standard" if i // 15 % 4 else "challenge", *forms[i % 5], ["safe", "breaking"][i // 5 % 2 if i % 5 < 4 else 0], [float(z) for z in rng.standard_normal(3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "n int, family_id string, role string, policy_pack string, mutation string, mutation_variant string, label string, features array<double>").withColumn("target", labels.one_hot(F.col("label")))
    plan = {p: (status, n) for p, status, n in models.protocol_plan(df, "family_id")}
    assert plan == {
        "normal-family-split": ("scored", 0), "held-out-policy:p": ("scored", 60), "held-out-policy:q": ("scored", 90), "held-out-mutation:m": ("scored", 60), "held-out-mutation:n": ("traceability_only", 30),
        "held-out-mutation:enum_value_added": ("structurally_unidentifiable", 60), "held-out-mutation-variant:enum_value_added:a": ("scored", 30), "held-out-mutation-variant:enum_value_added:b": ("scored", 30), "same-mutation-different-policy": ("scored", 120),
    }
    split = spark.createDataFrame([(f"f{i}", "train" if i % 2 else "test") for i in range(40)], "family_id string, partition string")
    scored = [p for p, (status, _) in plan.items() if status == "scored"]
    held = models.protocol_rows(df, scored, split, "family_id").filter("protocol = 'held-out-mutation-variant:enum_value_added:a' and partition = 'train'")
    assert held.filter("mutation_variant = 'a' or role <> 'standard'").count() == 0 and held.count() == 240
    got = {r["protocol"]: r["n_test"] for r in models.experiment(df, scored, split, "family_id", "n", epochs=1).collect()}
    assert set(got) == set(scored) and all(got[p] == plan[p][1] for p in scored if p != "normal-family-split")
    with pytest.raises(ValueError):
        models.protocol_rows(df, ["held-out:m"], split, "family_id")
    two = {r["protocol"]: r for r in models.binary_protocols(df, ["normal-family-split", "held-out-mutation:m"], split, "family_id", "n", epochs=1).collect()}
    assert sum(two["held-out-mutation:m"][c] for c in ("tp", "fp", "tn", "fn")) == 60
    told = spark.createDataFrame([("a", "safe", "safe"), ("a", "safe", "breaking"), ("a", "breaking", "breaking")], "protocol string, label string, predicted string")
    per = {r["class"]: r for r in models.class_metrics(told, "protocol").collect()}
    assert per["safe"]["precision"] == 1.0 and per["safe"]["recall"] == 0.5 and per["breaking"]["precision"] == 0.5 and per["warning"]["support"] == 0


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "p int, t int")
    r = metrics.classification(metrics.confusion(df, df.p, df.t)).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)
    empty = metrics.classification(metrics.confusion(df.filter("false"), df.p, df.t)).first()
    assert empty["accuracy"] == 0.0
    with pytest.raises(ValueError):
        metrics.breaking_count_rule(F.col("f"), "v2")
    with pytest.raises(Exception, match="tied"):
        metrics.bucket_rule(spark.createDataFrame([("a", 1), ("a", 0)], "b string, y int"), F.col("b"), "y").collect()


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "f array<double>")
    s = scaling.fit(df, "f", 2)
    assert s.first()["deviations"] == [1.0, 1.0] and s.first()["means"] == [2.0, 5.0]
    assert [r["scaled"] for r in scaling.transform(df, "f", s).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    with pytest.raises(Exception, match="dimension"):
        scaling.transform(spark.createDataFrame([([1.0],)], "f array<double>"), "f", s).collect()


def test_splits(spark):
    assert splitting.split_sizes(10, (0.7, 0.15, 0.15)) == [7, 1, 2] and splitting.split_sizes(3, (0.98, 0.01, 0.01)) == [1, 1, 1]
    assert sorted(splitting.lcg_order(50, 1 << 63)) == list(range(50)) and splitting.lcg_order(50, 1) != splitting.lcg_order(50, 2)
    df = spark.range(40).withColumnRenamed("id", "n")
    got = splitting.seeded_split(df, ["n"], (0.7, 0.15, 0.15), 7).groupBy("partition").count().collect()
    assert {r["partition"]: r["count"] for r in got} == {"train": 28, "validation": 6, "test": 6}
    assert [r["row_no"] for r in splitting.ranked(df.repartition(5), ["n"]).orderBy("n").collect()] == list(range(40))
    for bad in (lambda: splitting.ordered_split(df.limit(1), ["n"], 0.2), lambda: splitting.seeded_split(df.limit(2), ["n"], (0.7, 0.15, 0.15), 1), lambda: splitting.minibatches(df, ["n"], 0)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([(f"g{i % 9}", ["safe", "breaking"][i % 2], "standard") for i in range(90)], "g string, l string, r string")
    assert {r["partition"] for r in splitting.group_split(rows, "g", F.col("l"), F.col("r"), (0.6, 0.2, 0.2), 3).collect()} == set(splitting.SPLITS)
    last = spark.createDataFrame([("i", 1, "a"), ("i", 3, "c"), ("i", 2, "z"), (" ", 9, "x")], "id string, at int, content string")
    assert [tuple(r)[:3] for r in splitting.top_sample(last, "id", 5, 1, order="at").collect()] == [("i", 3, "c")]
    assert [r["content"] for r in splitting.top_sample(last, "id", 5, 1).collect()] == ["c"]


def test_nearest_and_audit(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(4)
    rows = [(i, f"f{i % 5}", "challenge" if i % 3 == 0 else "standard", [float(z) for z in rng.integers(0, 2, 76)]) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id int, family_id string, role string, features array<double>")
    sig = similarity.signatures(df, "record_id", "features", "family_id", "role")
    got = {r["record_id"]: r["distance"] for r in sig.filter("role = 'challenge'").join(similarity.nearest(sig.filter("role = 'challenge'"), sig.filter("role = 'standard'")), "key").collect()}
    from driftmill.functions.signatures import STRUCTURAL

    for i, _, role, f in rows:
        if role == "challenge":
            assert got[i] == min(sum(f[p] != g[p] for p in STRUCTURAL) for _, _, r, g in rows if r == "standard")
    summary, samples = similarity.near_duplicate_audit(df, 5)
    assert summary.first()["n_challenge"] == 14 and samples.count() == 5


def test_audit_of_each_protocol(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    from driftmill.functions.signatures import STRUCTURAL

    rng = np.random.default_rng(11)
    base = [[float(z) for z in rng.integers(0, 2, 76)] for _ in range(6)]
    rows = []
    for i in range(60):
        f = list(base[i % 6])
        f[int(rng.integers(0, 76))] = float(rng.integers(0, 2))
        own = [f"held-out-policy:{'pqr'[i % 3]}"] + ([f"held-out-mutation:{'mn'[i // 3 % 2]}"] if i % 7 else [])
        rows.append((i, f"f{i % 9}", "challenge" if i % 4 == 0 else "standard", own, f"fp{i % 20}", f))
    df = spark.createDataFrame(rows, "record_id int, family_id string, role string, own array<string>, pair_fingerprint string, features array<double>")
    summary, samples = similarity.protocol_audit(df, 2)
    got = {r["protocol"]: r for r in summary.collect()}
    assert set(got) == {p for r in rows if r[2] == "challenge" for p in r[3]}
    far = lambda a, b: sum(a[p] != b[p] for p in STRUCTURAL)
    for p, r in got.items():
        train = [x for x in rows if x[2] == "standard" and p not in x[3]]
        held = [x for x in rows if x[2] == "challenge" and p in x[3]]
        near = [min(far(x[5], t[5]) for t in train) for x in held]
        full = [any(x[5] == t[5] for t in train) for x in held]
        assert (r["n_training"], r["n_challenge"], r["n_full_match"]) == (len(train), len(held), sum(full))
        assert (r["n_structural_match"], r["n_within_one"]) == (sum(d == 0 for d in near), sum(d <= 1 for d in near))
        assert r["n_full_families"] == len({x[1] for x, y in zip(held, full) if y})
        assert r["family_id_leakage"] == bool({x[1] for x in held} & {t[1] for t in train})
        assert r["pair_fingerprint_leakage"] == bool({x[4] for x in held} & {t[4] for t in train})
    own = {r[0]: r[3] for r in rows}
    taken = samples.collect()
    assert all(r["protocol"] not in own[r["training_record_id"]] for r in taken)
    assert samples.groupBy("protocol").count().filter("count > 2").count() == 0 and len(taken) == sum(min(2, r["n_challenge"]) for r in got.values())


def test_evidence(spark):
    runs = spark.createDataFrame([(f"f{i}", "m", "B", ["p", "q", "r"][i % 3], "safe" if i else "rejected") for i in range(12)], "family_id string, mutation string, mode string, policy_pack string, outcome string")
    cell = {r["policy_pack"]: r for r in evidence.cells(runs, 3, 3, 9).collect()}
    assert cell["p"]["checks"] == 4 and cell["p"]["accepted"] == 3 and cell["q"]["invariant"]
    cross = evidence.cross_policy(runs, 3, 3, 9)
    assert cross.first()["invariant"] and evidence.promote(evidence.cells(runs, 3, 3, 9), cross).count() == 3
    hashed = runs.selectExpr("*", "'v' as mutation_variant", "'open' as profile", "'o' as oracle_hash", "'p' as policy_hash")
    with pytest.raises(ValueError, match="more than once"):
        evidence.merge_runs(hashed, hashed)
    with pytest.raises(ValueError, match="different"):
        evidence.merge_runs(hashed, hashed.withColumn("oracle_hash", F.lit("z")))
    with pytest.raises(ValueError, match="thresholds"):
        evidence.merge_runs(hashed, hashed, thresholds=({"min_policies": 3}, {"min_policies": 4}))
    fatal = spark.createDataFrame([(1, "", "Exception in thread x", "breaking"), (1, "", "no", "breaking")], "exit_code int, stdout string, stderr string, outcome string")
    assert sorted(r["outcome"] for r in evidence.reclassify_fatal(fatal).collect()) == ["breaking", "rejected"]


def test_audit_gates(spark):
    with pytest.raises(ValueError):
        audit.benchmark_ready(None)
    with pytest.raises(ValueError):
        audit.required(spark.range(0), "nothing")
    df = spark.createDataFrame([("h1",), ("h2",)], "h string")
    assert not audit.provenance_gate(df, {"h": "h1"}).first()["passed"] and audit.provenance_gate(df.limit(1), {"h": "h1"}).first()["passed"]


def test_external_gate(spark):
    schema = "record_id string, source string, family_id string, pair_fingerprint string, features array<double>, external_use string, policy_pack string"
    ext = spark.createDataFrame([("a", "new", "x", "p1", [1.0] * 76, "accuracy-bearing", "strict"), ("b", "old", "y", "p1", [2.0] * 76, "accuracy-bearing", None)], schema)
    corpus = spark.createDataFrame([("c", "old", "z", None, [3.0] * 76, "", "")], schema)
    got = {r["record_id"]: r["reasons"] for r in external.contamination(ext, corpus).collect()}
    assert got["a"] == [] and got["b"] == ["source is in the corpus", "pair occurs earlier"]
    assert external.status_counts(external.contamination(ext, corpus)).first()["n_eligible"] == 1
    late = ext.withColumn("manifest_no", F.when(F.col("record_id") == "a", 2).otherwise(1)).withColumn("source", F.lit("new"))
    assert {r["record_id"]: r["reasons"] for r in external.contamination(late, corpus).collect()} == {"a": ["pair occurs earlier"], "b": []}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c\n1,2,3\n\n4,5,6\n")
    assert [r["targets"] for r in readers.numeric_csv(spark, str(tmp_path / "n.csv"), 3, 1, header=True).collect()] == [[3.0], [6.0]]
    for bad in ("1,2\n", "1,x,3\n", "1,2,3,4\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            readers.numeric_csv(spark, str(tmp_path / "bad.csv"), 3, 1).collect()
    spark.createDataFrame([("f", "{}", "u")], "filename string, json_schema string, unique_id string").write.parquet(str(tmp_path / "s"))
    assert readers.schema_parquet(spark, str(tmp_path / "s")).count() == 1
    records = fixtures.prepared(fixtures.contract_changes(spark)).withColumn("contract_id", F.lit("c"))
    writers.prepared_json(records, str(tmp_path / "p"), "d1", "v1")
    back, meta = readers.prepared_json(spark, str(tmp_path / "p"))
    assert back.count() == 10 and meta.first()["benchmark_ready"] is None and back.filter("dataset_role = 'standard'").count() == 10
    with pytest.raises(Exception):
        writers.prepared_json(records, str(tmp_path / "p"), "d1", "v1")
    back = back.withColumn("compatibility_label", F.lit(None).cast("string"))
    assert readers.record_problems(back, 8).count() == 0 and readers.record_problems(back, 9).count() == 10
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert readers.verified_bytes(spark, str(tmp_path / "x.bin"), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad") == b"abc"
    with pytest.raises(ValueError):
        readers.verified_bytes(spark, str(tmp_path / "x.bin"), "0" * 64)
    run = {"family_id": "f", "mutation_family": "m", "compatibility_mode": "B", "policy_pack": "p", "exit_code": 0, "outcome": "safe"}
    (tmp_path / "c.json").write_text(json.dumps({"format_version": "v1", "runs": [run]}))
    assert readers.conformance_json(spark, str(tmp_path / "c.json"))[1].first()["accepted"] == 1
    assert readers.conformance_json(spark, str(tmp_path / "c.json"), ("v1", "v2"))[0].count() == 1
    with pytest.raises(Exception, match="format_version"):
        readers.conformance_json(spark, str(tmp_path / "c.json"), ("v2",))[0].collect()
    (tmp_path / "k.json").write_text(json.dumps({"packs": {"a": {"rules": {}}}}))
    assert readers.policy_json(spark, str(tmp_path / "k.json")).count() == 8
    (tmp_path / "k2.json").write_text(json.dumps({"defaultPack": "A", "packs": {"a": {"rules": {}}, "b": {}}}))
    assert {r["pack"] for r in readers.policy_json(spark, str(tmp_path / "k2.json")).filter("is_default").collect()} == {"a"}
    writers.prepared_json(records.filter("false"), str(tmp_path / "none"), "d1", "v1", True)
    assert readers.prepared_json(spark, str(tmp_path / "none"))[0].count() == 0 and readers.prepared_json(spark, str(tmp_path / "none"))[1].first()["benchmark_ready"]
    (tmp_path / "g.json").write_text(json.dumps({"records": [{"record_id": "a", "generation": {"declared_mutation": "m"}}, {"record_id": "b"}]}))
    got = {r["record_id"]: r for r in readers.prepared_json(spark, str(tmp_path / "g.json"))[0].collect()}
    g = got["a"]["generation"]
    assert g["oracle_stdout"] == "" and g["generation_seed"] == 0 and g["root_object_profile"] is None and got["b"]["generation"] is None
    (tmp_path / "m.json").write_text(json.dumps({"summary": {"total_transitions": 2}, "transitions": [{"record_id": "x"}, {"record_id": "y"}]}))
    assert [(r["manifest_no"], r["record_id"]) for r in readers.manifest_json(spark, str(tmp_path / "m.json")).collect()] == [(0, "x"), (1, "y")]
    assert readers.manifest_summary(spark, str(tmp_path / "m.json")) == {"total_transitions": 2}
