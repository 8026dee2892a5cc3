"""Shares, minima, deficits, repeats, nulls, empty tables."""

from pyspark.sql import functions as F

from driftmill.llm import quota_sample

TARGETS = "request_no int, strat_field string, category string, target_share double, min_rows long, sample_rows long"


def evidence(spark):
    rows = [(i, "Safe " if i % 2 else "safe", "open") for i in range(600)] + [(600 + i, "BREAKING", None) for i in range(300)] + [(900 + i, "war-ning", "closed") for i in range(5)] + [(2000, None, "open")]
    return spark.createDataFrame(rows + rows[:100], "n long, label string, profile string")


def test_sample_and_report(spark):
    t = spark.createDataFrame([(1, "label", "safe", 0.5, 0, 400), (1, "label", "breaking", 0.4, 0, 400), (1, "label", "war_ning", 0.1, 10, 400), (2, "label|profile", "safe|open", 0.9, 1, 100), (2, "label|profile", "breaking|open", 0.1, 1, 100), (3, "label", "none", 0.0, 2, 10), (4, "nofield", "x", 1.0, 1, 10)], TARGETS)
    e = evidence(spark)
    drawn, report = quota_sample.sample(e, "n", t, 3)
    got = {(r["request_no"], r["category"]): r for r in report.collect()}
    assert got[1, "safe"]["taken"] == 200 and got[1, "breaking"]["taken"] == 160 and got[1, "war_ning"]["taken"] == 5 and got[1, "war_ning"]["deficit"] == 35
    assert got[2, "safe|open"]["taken"] == 90 and got[2, "breaking|open"]["deficit"] == 10 and got[4, "x"]["deficit"] == 10
    assert drawn.count() == drawn.distinct().count() == 200 + 160 + 5 + 90
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, quota_sample.sample(e.repartition(7), "n", t, 3)[0].collect()))
    short = {tuple(r) for r in quota_sample.shortfalls(report).collect()}
    assert short == {(1, "war_ning"), (2, "breaking|open"), (3, "none"), (4, "x")}


def test_minimum_takes_from_the_others(spark):
    t = spark.createDataFrame([(1, "label", "safe", 0.9, 0, 100), (1, "label", "breaking", 0.1, 30, 100)], TARGETS)
    got = {r["category"]: r["taken"] for r in quota_sample.sample(evidence(spark), "n", t)[1].collect()}
    assert got == {"safe": 70, "breaking": 30}


def test_too_few_accepted_are_topped_up(spark, monkeypatch):
    real = quota_sample.unit_hash
    monkeypatch.setattr(quota_sample, "unit_hash", lambda *a: F.sqrt(real(*a)))  # draws that lie too high
    t = spark.createDataFrame([(1, "label", "safe", 1.0, 0, 200)], TARGETS)
    assert quota_sample.sample(evidence(spark), "n", t)[0].count() == 200


def test_empty(spark):
    t = spark.createDataFrame([(1, "label", "safe", 1.0, 2, 10)], TARGETS)
    e = evidence(spark).filter("false")
    drawn, report = quota_sample.sample(e, "n", t)
    assert drawn.count() == 0 and report.first()["deficit"] == 10
    assert quota_sample.shortfalls(quota_sample.sample(e, "n", t.filter("false"))[1]).count() == 0
