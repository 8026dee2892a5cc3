"""Lookups and prefix sums against plain Python, with a key that holds most rows."""

import random

from pyspark.sql import functions as F

from driftmill.operators.skew import lookup, prefix_sum


def test_lookup_with_hot_key(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)] + [(-1, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40)], "k string, x int")
    for least in (10, 50_000):
        got = {r["i"]: r["x"] for r in lookup(left, right, ["k"], least=least).collect()}
        assert len(got) == 3001 and got[-1] is None and got[1] == 1 and got[3] == 3 and got[48] is None
    assert lookup(left, right, ["k"], "inner", least=10).count() == sum(1 for i in range(3000) if i % 3 or i % 50 < 40)

    dear = left.groupBy("i").agg(F.max("k").alias("k"))
    assert {r["i"]: r["x"] for r in lookup(dear, right, ["k"], least=10).collect()} == got


def test_prefix_sum(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.random(), rnd.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, u double, n long").withColumn("part", F.floor(F.col("u") * 16))
    got = {(r["g"], r["u"]): r["t"] for r in prefix_sum(df, ["g"], "part", [F.col("u")], "n", "t").collect()}
    for g in ("a", "b", None):
        at = 0
        for _, u, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            at += n
            assert got[(g, u)] == at
    assert prefix_sum(df.filter("false"), [], "part", [F.col("u")], "n", "t").count() == 0
