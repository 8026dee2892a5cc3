"""Cut tables, bounded broadcasts, repeatable draws."""

import pytest

from driftmill import runtime


def test_cut_and_clear(spark):
    df = runtime.cut(spark.range(5), "test")
    assert df.count() == 5 and runtime.OPEN_CUTS
    runtime.clear_cuts()
    assert not runtime.OPEN_CUTS
    with pytest.raises(Exception):
        df.count()


def test_bounded_broadcast(spark):
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(runtime.bounded_broadcast(spark.range(5), 5)) and not hint(runtime.bounded_broadcast(spark.range(6), 5))


def test_unit_hash(spark):
    df = spark.range(2000).select("id", runtime.unit_hash(1, "id").alias("u"), runtime.unit_hash(2, "id").alias("v"))
    a, b = df.collect(), df.repartition(3).orderBy("id").collect()
    assert [r["u"] for r in a] == [r["u"] for r in b] and all(0 <= r["u"] < 1 for r in a)
    assert abs(sum(r["u"] for r in a) / 2000 - 0.5) < 0.03 and sum(r["u"] == r["v"] for r in a) == 0
