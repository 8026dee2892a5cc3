"""Chunks are local and shared, pairs are complete against brute force, nulls and odd rows are no candidates."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftmill.llm import overlap


def test_chunks_cover_and_survive_an_insertion():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 5000)
    b = np.concatenate([a[:2500], [7, 7, 7], a[2500:]])
    s, d, n = overlap.chunk(np.concatenate([a, b]), np.array([5000, 0, 5003]), 8, 16)
    assert n[s == 0].sum() == 5000 and n[s == 2].sum() == 5003 and not (s == 1).any()
    shared = set(d[s == 0]) & set(d[s == 2])
    assert n[(s == 0) & np.isin(d, list(shared))].sum() > 4800
    assert overlap.chunk(np.zeros(0), np.zeros(0, int), 8, 16)[0].size == 0


def test_fractions(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text, False), (2, text[:1500] + text[::-1][:1500], True), (3, text, True), (4, None, True), (5, "", True)]
    df = spark.createDataFrame(rows, "id int, text string, ev boolean")
    c = overlap.text_chunks(df, "id", F.col("text")).join(df.select("id", "ev"), "id")
    got = {r["id"]: r["overlap"] for r in overlap.overlap_fractions(c, "id", F.col("ev"), ~F.col("ev")).collect()}
    assert got[3] == 1.0 and 0.4 < got[2] < 0.6 and got[4] is None and got[5] is None and len(got) == 4


def brute(evidence, prepared):
    role, prints = {}, {}
    for n, r, f in evidence:
        role[n] = (r or "standard").strip().lower()
        prints[n] = "".join(f.lower().split()).removeprefix("sha256:") if f and f.strip() else None
    full = {n: (p, [f[i] for i in overlap.PLACES]) for n, p, f in prepared if f is not None and len(f) == 76 and p is not None and None not in f}
    out = set()
    for c in role:
        for s in role:
            if role[c] == "challenge" and role[s] == "standard":
                same = prints[c] is not None and prints[c] == prints[s]
                near = c in full and s in full and full[c][0] == full[s][0] and sum(x != y for x, y in zip(full[c][1], full[s][1])) <= 1
                if same or near:
                    out.add((min(c, s), max(c, s)))
    return out


def test_pairs_against_brute_force(spark):
    rnd = random.Random(11)
    base = [[float(rnd.choice([0, 0, 0, 1, 5])) for _ in range(76)] for _ in range(12)]
    evidence, prepared = [], []
    for n in range(240):
        f = rnd.choice([None, " ", *(f"{i:064x}" for i in range(30))])
        if f and f.strip() and rnd.random() < 0.4:
            f = rnd.choice(["SHA256:" + f.upper(), " " + f, f[:8] + " " + f[8:]])
        evidence.append((n, rnd.choice([None, "standard", "Standard ", "challenge", "CHALLENGE"]), f))
        v = list(base[0 if n % 3 == 0 else rnd.randrange(12)])  # one row holds a third
        for _ in range(rnd.choice([0, 1, 1, 2])):
            v[rnd.randrange(76)] += 1.0
        if rnd.random() < 0.3:
            v = [-0.0 if x == 0 else x for x in v]
        prepared.append((n, rnd.choice(["p", "q", None]) if n % 7 == 0 else "p", v[:59] if n % 20 == 1 else v))
    prepared += [prepared[3], (900, "p", base[0]), (5, "p", None)]
    evidence += [evidence[9], (None, "challenge", "ab")]
    e = spark.createDataFrame(evidence, "record_no long, dataset_role string, pair_fingerprint string")
    p = spark.createDataFrame(prepared, "record_no long, policy_pack string, features array<double>")
    want = brute([x for x in evidence if x[0] is not None], prepared)
    for limit in (200_000, 1):
        overlap.BROADCAST_ROWS = limit
        got = {(r["record_no_a"], r["record_no_b"]) for r in overlap.contract_overlaps(e, p).collect()}
        assert got == want
    overlap.BROADCAST_ROWS = 200_000
    shares = {r["record_no"]: r for r in overlap.contract_fractions(e, p).collect()}
    roles = {n: (r or "standard").strip().lower() for n, r, _ in evidence if n is not None}
    assert set(shares) == {n for n, r in roles.items() if r == "challenge"}
    same = {n: f.lower().replace(" ", "").removeprefix("sha256:") for n, _, f in evidence if n is not None and f and f.strip()}
    known = {same[n] for n in same if roles[n] == "standard"}
    for n, r in shares.items():
        assert (r["print_overlap"] is None) == (n not in same) and (n not in same or (same[n] in known) <= (r["print_overlap"] == 1.0))
        assert r["feature_overlap"] is None or 0 <= r["feature_overlap"] <= 1
    assert overlap.contract_overlaps(e.filter("false"), p).count() == 0
    assert overlap.contract_overlaps(e, p.filter("false")).filter("kind = 'features'").count() == 0
