"""Table comparison: missing rows, differing fields, versions, nulls, skew, empty tables, clashing names."""

import random

import numpy as np
import pytest

from driftmill.operators import compare
from driftmill.operators.compare import Bitmap, diff_summary, diff_tables

SCHEMA = "k long, a string, b int, c double, v long"


def found(df):
    return sorted((r["k"] is not None, r["k"] or 0, r["field_name"]) for r in df.collect())


def diff(spark, left, right, schema=SCHEMA):
    return diff_tables(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "v")


def test_missing_and_fields(spark):
    left = [(1, "x", 1, 1.0, 1), (2, " X ", 2, 0.0, 1), (3, None, 3, float("nan"), 1), (5, "", 1, None, 1)]
    right = [(2, "x", 2, -0.0, 9), (3, None, 4, float("nan"), 1), (4, "y", 1, 1.0, 1), (5, None, 1, None, 1)]
    assert found(diff(spark, left, right)) == [(True, 1, "missing_in_right"), (True, 3, "b"), (True, 4, "missing_in_left"), (True, 5, "a")]


def test_current_version_and_repeats(spark):
    left = [(1, "old", 1, 1.0, 1), (1, "new", 1, 1.0, 2), (1, "new", 1, 1.0, 2)]
    assert found(diff(spark, left, [(1, "NEW", 1, 1.0, 7)])) == []
    assert found(diff(spark, left, [(1, "old", 1, 1.0, 7)])) == [(True, 1, "a")]


def test_null_keys_and_empty(spark):
    rows = [(None, "x", 1, 1.0, 1)]
    assert found(diff(spark, rows, [])) == [(False, 0, "missing_in_right")]
    assert found(diff(spark, [], rows)) == [(False, 0, "missing_in_left")]
    assert found(diff(spark, rows, [(None, "y", 1, 1.0, 1)])) == [(False, 0, "a")]
    assert found(diff(spark, [], [])) == []


def test_bitmaps():
    rng = np.random.default_rng(1)
    sets = [np.zeros(0, int), np.arange(70), np.arange(1 << 16), np.array([0, 65535]), np.sort(rng.choice(1 << 16, 30_000, False)), np.sort(rng.choice(1 << 16, 500, False)), np.delete(np.arange(1 << 16), [5, 9])]
    assert [Bitmap.of(s).kind for s in sets] == ["list", "runs", "runs", "list", "bits", "list", "runs"]
    for x in sets:
        for y in sets:
            assert Bitmap.of(x).minus(Bitmap.of(y)).tolist() == np.setdiff1d(x, y).tolist()
            assert Bitmap.of(x).both(Bitmap.of(y)).tolist() == np.intersect1d(x, y).tolist()


def test_nested_fields_and_wider_types(spark):
    left = spark.createDataFrame([(1, [None, 1], 1), (2, [1, 2], 2), (3, None, 3)], "k int, a array<int>, b int")
    right = spark.createDataFrame([(1, [1, None], 1), (2, [1, 2], 2), (3, None, 4)], "k long, a array<int>, b long")
    assert found(diff_tables(left, right, "k")) == [(True, 1, "a"), (True, 3, "b")]


@pytest.mark.parametrize("container,broadcast", [(1 << 16, 500_000), (16, 500_000), (1 << 16, 1)])
def test_hot_key_and_brute_force(spark, monkeypatch, container, broadcast):
    monkeypatch.setattr(compare, "CONTAINER", container)
    monkeypatch.setattr(compare, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    row = lambda k: (k, rnd.choice(["a", "A ", "b", None, ""]), rnd.choice([1, 2, None]), rnd.choice([0.0, 1.5]), rnd.randrange(3))
    left, right = [row(rnd.choice([7, rnd.randrange(300)])) for _ in range(900)], [row(rnd.choice([7, rnd.randrange(300)])) for _ in range(900)]

    def order(r):
        return tuple((x is not None, x if x is not None else 0) for x in (r[4], r[1], r[2], r[3]))

    def current(rows):
        out = {}
        for r in rows:
            if r[0] not in out or order(r) > order(out[r[0]]):
                out[r[0]] = r
        return out

    a, b = current(left), current(right)
    fold = lambda x: x.strip().lower() if isinstance(x, str) else x
    want = [(True, k, "missing_in_right") for k in a.keys() - b.keys()] + [(True, k, "missing_in_left") for k in b.keys() - a.keys()]
    want += [(True, k, n) for k in a.keys() & b.keys() for n, i in (("a", 1), ("b", 2), ("c", 3)) if fold(a[k][i]) != fold(b[k][i])]
    got = diff(spark, left, right)
    assert found(got) == sorted(want)
    assert sum(r["n_rows"] for r in diff_summary(got).collect()) == len(want)


def test_clashing_names_and_long_text(spark):
    schema = "k long, _key string, _l string, _r string, _version string, v long"
    long = "é" * 200_000
    left = spark.createDataFrame([(1, "a", long, "x", "y", 1)], schema)
    right = spark.createDataFrame([(1, "a", long + "!", "X", "y", 2)], schema).selectExpr("*", "1 as extra")
    assert found(diff_tables(left, right, "k", "v")) == [(True, 1, "_l")]


def test_sides_of_unlike_size_under_small_partitions(spark):
    """Each side's shuffle is coalesced by its own size; a key's two rows must meet all the same."""
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    left = spark.range(20_000).selectExpr("id ^ 1 as k", "'a' as a", "id as v")
    right = spark.range(500, 8_000).selectExpr("id ^ 1 as k", "if(id = 777, 'b', 'A') as a", "id as v")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["field_name"]: r["n_rows"] for r in diff_summary(diff_tables(left, right, "k", "v")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {"missing_in_right": 12_500, "a": 1}
