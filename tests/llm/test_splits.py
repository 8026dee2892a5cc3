"""Related records stay together; names of one component; ratios and label shares are met."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftmill.llm import splits


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, *keys in rows:
        ents = [("r", n), *((i, k) for i, k in enumerate(keys) if k is not None)]
        for e in ents[1:]:
            parent[find(e)] = find(ents[0])
        find(ents[0])
    return find


@pytest.mark.parametrize("slice_", [100_000, 20])
def test_components_against_union_find(spark, monkeypatch, slice_):
    monkeypatch.setattr(splits, "SLICE", slice_)
    rnd = random.Random(2)
    some = lambda p, n: f"{p}{rnd.randrange(n)}" if rnd.random() < 0.7 else None
    rows = [(i, "hot" if i % 3 == 0 else some("f", 90), some("g", 120), some("c", 150)) for i in range(300)]
    rows += [(1000 + i, f"chain{i}", f"link{i}", f"link{i}") for i in range(60)] + [(2000 + i, f"chain{i + 1}", f"link{i}", None) for i in range(60)]
    rows += [rows[5], (None, "hot", None, None), (5000, None, None, None)]
    df = spark.createDataFrame(rows, "n int, f string, g string, c string")
    got = {r["n"]: r["component"] for r in splits.record_components(df, "n", ["f", "g", "c"]).collect()}
    find = brute([r for r in rows if r[0] is not None])
    want, have = defaultdict(set), defaultdict(set)
    for n, c in got.items():
        if n is not None:
            want[find(("r", n))].add(n)
            have[c].add(n)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_family_key(spark):
    same = ["a.B.n1", " a_b_N1 ", "A/B/n1", "BACKWARD:a.b.n1", "full.Forward-a.b.n1", "a.b.n1_Normalized_closed", "abn1", "a . b . n1", "ABN1closed", "FULLbackwardabn1Normalised"]
    rows = [(x,) for x in [*same, "a.b.n0", "open", "unknown", " N/A ", "", None, "a.open.b.n1", "openapixn1", "openabn1"]]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(splits.family_key(F.col("x"))).collect()]
    assert set(got[: len(same)]) == {"abn1"} and got[len(same) :] == ["abn0", "open", None, None, None, None, "aopenbn1", "openapixn1", "abn1"]


@pytest.mark.parametrize("names", [1000, 2])
def test_names_of_one_component(spark, monkeypatch, names):
    monkeypatch.setattr(splits, "NAMES", names)
    rows = [("x", "x", "g1", None), ("X", "x", None, None), ("y", "y", "g1", None), ("z", "z", None, "c"), (None, None, "g1", "c"), (None, None, None, None), ("w", "w", None, None)]
    df = spark.createDataFrame(rows, "name string, f string, g string, c string")
    got = sorted(map(tuple, splits.same_component_names(df, "name", ["f", "g", "c"]).collect()))
    assert got == [("X", "x"), ("X", "y"), ("X", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    assert splits.same_component_names(df.filter("false"), "name", ["f", "g", "c"]).count() == 0


def test_few_records_are_placed_by_deviation(spark):
    rows = [(i, i // 10, "a" if i < 100 else "b") for i in range(200)]
    got = splits.assign_splits(spark.createDataFrame(rows, "n int, component long, label string"), "n", "label", (0.7, 0.15, 0.15), 5)
    n = {(r["split"], r["label"]): r["count"] for r in got.groupBy("split", "label").count().collect()}
    # no more than one group of ten away from 70, 15 and 15
    assert {n["train", "a"], n["train", "b"]} <= {70, 80} and {n.get((s, x), 0) for s in ("validation", "test") for x in "ab"} <= {10, 20}


def test_assignment(spark):
    rnd = random.Random(7)
    rows = [(i, i // 4 if i >= 400 else 0, rnd.choice(["a", "a", "b", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "n int, component long, label string")
    got = splits.assign_splits(df, "n", "label", (0.7, 0.15, 0.15), 5)
    again = splits.assign_splits(df, "n", "label", (0.7, 0.15, 0.15), 5)
    assert got.count() == 4000 and got.groupBy("component").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    share = {r["split"]: r["count"] / 4000 for r in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["test"] - 0.15) < 0.02
    assert all(r["deviation"] < 0.04 for r in splits.split_report(got).collect())
    with pytest.raises(ValueError):
        splits.assign_splits(df, "n", "label", (0.7, 0.2, 0.2), 5)
    assert splits.assign_splits(df.filter("false"), "n", "label", (0.7, 0.15, 0.15), 5).count() == 0
