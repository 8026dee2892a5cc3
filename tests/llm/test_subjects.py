"""Held-out accuracy on made-up texts with passing mentions; nulls, empty texts, missing labels."""

import random

import pytest

from driftmill.llm import subjects

VOCAB = {a: [f"{a}{w}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta")] for a in ("law", "sport", "energy", "media")}


def text(rnd, areas):
    lines = [f"The {rnd.choice(VOCAB[rnd.choice(areas)])} was kept beside the {rnd.choice(VOCAB[rnd.choice(areas)])} this week." for _ in range(rnd.randrange(6, 14))]
    other = rnd.choice([a for a in VOCAB if a not in areas])
    lines.insert(rnd.randrange(len(lines)), f"Someone likened it to a {rnd.choice(VOCAB[other])} once.")
    return "\n".join([*lines, "All rights reserved under the lawalpha footer."])


def test_lines_and_terms():
    texts = ["FährÜberfahrt_id home.Ground! ÉTÉ x", None, "", "fahr uberfahrt id home ground\nete X", "12 34", "e\u0301te\u0301"]
    found = subjects.find_lines(texts)
    assert found.doc.tolist() == [0, 0, 3, 3, 5]
    parts = [found.bucket[a:b].tolist() for a, b in zip(found.start, found.start[1:])]
    assert parts[0] == parts[2] and parts[1] == parts[3] and len(parts[0]) == 9 and len(parts[1]) == 3 and parts[4][0] in parts[1]
    subjects.PIECE, whole = 7, subjects.PIECE
    again = subjects.find_lines(texts)
    subjects.PIECE = whole
    assert again.bucket.tolist() == found.bucket.tolist() and again.start.tolist() == found.start.tolist()


def test_held_out_accuracy(spark):
    rnd = random.Random(4)
    rows, truth = [], {}
    for i in range(900):
        areas = rnd.sample(sorted(VOCAB), rnd.choice([1, 1, 1, 2]))
        truth[i] = set(areas)
        rows.append((i, text(rnd, areas), rnd.choice(["s1", "S-2", None])))
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "12345 !!", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, a) for i in range(300) for a in truth[i]] + [(99_999, "law"), (3, None)], "doc_id long, subject_area string")
    got = {}
    for r in subjects.classify(docs, labels).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    assert set(got) == {r[0] for r in rows} and all(1 <= len(v) <= 2 for v in got.values())
    held = range(300, 900)
    hit = sum(len(got[i] & truth[i]) for i in held)
    assert hit / sum(len(got[i]) for i in held) > 0.93 and hit / sum(len(truth[i]) for i in held) > 0.93
    with pytest.raises(ValueError):
        subjects.classify(docs, labels.filter("false"))


def test_copies_that_fill_a_third_of_all_rows(spark):
    rnd = random.Random(6)
    copy = text(rnd, ["sport"])
    rows = [(i, text(rnd, [rnd.choice(sorted(VOCAB))]), None) for i in range(400)] + [(1000 + i, copy, None) for i in range(200)]
    truth = {i: next(a for a in VOCAB if sum(w in t for w in VOCAB[a]) > 2) for i, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, truth[i]) for i in [*range(150), *range(1000, 1010)]], "doc_id long, subject_area string")
    got = {}
    for r in subjects.classify(docs, labels).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject_area"])
    assert all(got[i] == {"sport"} for i in range(1000, 1200))
    assert sum(truth[i] in got[i] for i in range(150, 400)) > 0.95 * 250
