"""Every operator takes tables with columns named as its own, rows of nulls, repeated rows and no rows at all."""

import pytest
from pyspark.sql import functions as F

from driftmill.llm import format_dedup, knn_forest, mixing, overlap, packing, quota_sample, splits, subjects


def crowded(df, *names):
    """``df`` with further columns of the given names."""
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


def test_splits(spark):
    df = spark.createDataFrame([(1, "a", "g", "l"), (1, "a", "g", "l"), (2, "a", None, None), (3, None, None, "m"), (4, None, None, None), (None, "a", None, "l"), (None, None, None, None), (5, "b", "g", "l")], "n long, f string, g string, l string")
    df = crowded(df, "_r", "_c", "_self", "entity", "label", "slice", "fan", "component", "e0", "_n", "was", "m")
    got = {r["n"]: (r["component"], r["l"]) for r in splits.record_components(df, "n", ["f", "g"], "l").collect()}
    assert len(got) == 6 and got[1][0] == got[2][0] == got[5][0] and len({got[n][0] for n in (1, 3, 4)}) == 3 and got[3][1] == "m" and got[4][1] is None
    assert splits.record_components(df.filter("false"), "n", ["f", "g"]).count() == 0
    placed = splits.assign_splits(splits.record_components(df, "n", ["f", "g"], "l"), "n", "l", (0.5, 0.25, 0.25), 1)
    assert placed.count() == 6 and {r["label"] for r in placed.collect()} == {"l", "m", "<null>"}


def test_quota_sample(spark):
    t = spark.createDataFrame([(1, "label", "a", 1.0, 2, 3), (1, "label", "b", 0.0, None, 3), (2, None, "a", 1.0, 1, 1), (3, "label", None, 1.0, 1, 1)], "request_no int, strat_field string, category string, target_share double, min_rows long, sample_rows long")
    e = crowded(spark.createDataFrame([(1, "A"), (2, "a "), (2, "a "), (None, "a"), (3, None)], "n long, label string"), "_id", "u", "rate", "want", "part", "field", "key", "available", "request_no")
    drawn, report = quota_sample.sample(e, "n", t)
    got = {(r["request_no"], r["category"]): r["deficit"] for r in report.collect()}
    assert drawn.count() == 3 and got[1, "a"] == 0 and got[2, "a"] == 1 and got[3, None] == 1


def test_overlap(spark):
    e = spark.createDataFrame([(1, "challenge", "ab"), (2, None, "AB"), (None, None, None), (3, None, None)], "record_no long, dataset_role string, pair_fingerprint string")
    p = spark.createDataFrame([(1, "p", [1.0] * 76), (2, "p", [1.0] * 75 + [2.0]), (2, "p", None), (None, None, None), (3, "q", [1.0] * 76)], "record_no long, policy_pack string, features array<double>")
    extra = ("is_left", "is_right", "fp", "rec", "chunks", "salt", "tolerance", "key", "id", "ch", "st", "v", "digest", "content")
    got = {(r["record_no_a"], r["record_no_b"], r["kind"]) for r in overlap.contract_overlaps(crowded(e, *extra), crowded(p, *extra)).collect()}
    assert got == {(1, 2, "fingerprint"), (1, 2, "features")}
    assert overlap.contract_fractions(crowded(e, *extra), crowded(p, *extra)).count() == 1
    assert overlap.contract_fractions(e.filter("false"), p).count() == 0


def test_format_duplicates(spark):
    df = crowded(spark.createDataFrame([(1, "a"), (2, "A!"), (2, "A!"), (3, None), (4, None), (None, "a"), (5, "")], "n long, t string"), "_id", "_raw", "h1", "h2", "kept", "fan", "slice", "leads", "t0", "same", "n_copies")
    assert {r["n"]: (r["kept"], r["n_copies"]) for r in format_dedup.format_duplicates(df, "n", ["t"]).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0])]
    df = crowded(spark.createDataFrame(rows, "id long, v array<double>"), "_id", "_v", "cls", "unit", "tree", "key", "pos", "level", "block", "asks", "rank", "cosine", "other")
    assert set(map(tuple, knn_forest.similar_pairs(df, "id", "v", 0.98).collect())) == {(1, 2)}
    got = {(r["id"], r["other_id"], r["rank"]) for r in knn_forest.nearest(df, "id", "v", 2, certain=0.9).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 1), (3, 1, 2)}
    assert knn_forest.nearest(df.filter("false"), "id", "v", 2).count() == 0


def test_packing_and_mixing(spark):
    names = ("_id", "_text", "n_tokens", "curve", "task", "container", "piece")
    docs = crowded(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, ""), (4, "w " * 500)], "d long, text string"), *names)
    sizes = packing.sized(docs, "d", "text").cache()
    boxes = packing.pack(crowded(sizes, "task", "container", "piece", "_id"), "d", 100).collect()
    assert {r["d"] for r in boxes} == {1, None, 4} and sum(r["n_tokens"] for r in boxes) == sizes.agg(F.sum("n_tokens")).first()[0]
    extra = ("_key", "_source", "share", "rounds", "parts", "part", "u", "finish", "stretch", "upto", "repeat", "position", "tokens")
    sized = crowded(spark.createDataFrame([(1, "S 1", 5), (1, "s_1", 5), (None, "s1", 5), (2, None, 5), (3, "s1", 0), (4, "s2", 7)], "d long, source string, n_tokens long"), *extra)
    targets = crowded(spark.createDataFrame([("s-1", 0.5, None, 20), (None, 0.5, 1, 20), ("s2", None, 2, 20), ("s3", 0.5, 2, 20)], "source string, target_share double, max_repeats int, budget_tokens long"), "_key", "tokens")
    mixed = mixing.mix(sized, "d", "source", targets).cache()
    assert mixed.count() == 3 and {r["source"] for r in mixed.collect()} == {"s-1"} and mixed.agg(F.max("position")).first()[0] == 15
    report = {r["source"]: r for r in mixing.share_report(mixed, sized, "source", targets).collect()}
    assert report["s3"]["short"] and not report["s-1"]["short"] and not report["s2"]["short"] and set(report) == {"s-1", "s2", "s3"}
    assert mixing.mix(sized, "d", "source", targets.filter("false")).count() == 0


def test_subjects(spark):
    rows = [(i, f"{w} {w}x {w}y said\n{w} {w}z" * 3, "s") for i, w in enumerate(["court", "goal"] * 20)] + [(100, None, None), (101, "court courtx", None), (101, "court courtx", None), (None, "goal goalx", "s")]
    extra = ("row", "fold", "t", "areas", "_id", "_text", "_source", "subject_area", "x", "n")
    docs = crowded(spark.createDataFrame(rows, "doc_id long, text string, source string"), *extra)
    labels = crowded(spark.createDataFrame([(i, ["law", "sport"][i % 2], "me") for i in range(20)] + [(None, "law", None), (5, None, None)], "doc_id long, subject_area string, labelled_by string"), "t", "areas", "_area", "row")
    got = subjects.classify(docs, labels).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["subject_area"])
    assert all(by[i] == {["law", "sport"][i % 2]} for i in range(40)) and by[101] == {"law"} and set(by) == {*range(40), 100, 101, None}
    assert subjects.classify(docs.limit(0).union(docs.filter("doc_id < 20")), labels).count() == 20
    with pytest.raises(ValueError):
        subjects.classify(docs.filter("false"), labels)
