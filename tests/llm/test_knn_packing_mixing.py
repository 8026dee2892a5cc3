"""Nearest vectors against brute force; packing keeps every token; mixing meets its weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmill.llm import knn_forest, mixing, packing, tokens


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((120, 16))
    rows = [(int(i), [float(x) for x in (centres[i % 120] + 0.05 * rng.standard_normal(16)) * 10.0 ** rng.integers(-3, 4)]) for i in range(600)]
    rows += [(700, [0.0] * 16), (701, None), (702, []), (703, [float("nan")] + [1.0] * 15), rows[4]]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    good = {i: np.array(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    u = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i])[:5]:
            if s[i, j] >= 0.98:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    got = set(map(tuple, knn_forest.similar_pairs(df, "id", "v", 0.98).collect()))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert knn_forest.similar_pairs(df.filter("false"), "id", "v", 0.98).count() == 0


def test_similar_pairs_of_a_crowd_are_exact(spark, monkeypatch):
    monkeypatch.setattr(knn_forest, "CELL_ROWS", 150)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(24) + 0.1 * rng.standard_normal((2000, 24)), rng.standard_normal((400, 24))])
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(s)) for j in np.argsort(-np.round(s[i], 6), kind="stable")[:5] if s[i, j] >= 0.98}
    assert len(want) > 3000 and set(map(tuple, knn_forest.similar_pairs(df, "id", "v", 0.98).collect())) == want


def test_profiles_and_ascent():
    rng = np.random.default_rng(2)
    tree, key = np.repeat([0, 1], 300), np.concatenate([np.sort(rng.integers(0, 1 << knn_forest.BITS, 300)) for _ in range(2)])
    key[10:20] = key[10]
    got = knn_forest.depth_profile(tree, key, 5)
    shared = np.array([[knn_forest.BITS - int(a ^ b).bit_length() if t == u else -1 for b, u in zip(key, tree)] for a, t in zip(key, tree)])
    np.fill_diagonal(shared, -1)
    for i in range(600):
        deep = np.sort(shared[i])[::-1]
        assert [(int(got[i]) >> (6 * j)) & 63 for j in range(5)] == [deep[2**j - 1] for j in range(5)]
    both = got.reshape(2, 300).T
    level = knn_forest.ascend(both, 12, 5)
    for i in range(300):
        size = lambda d: sum(2 ** int(np.log2(n)) if n else 0 for n in (min(int((shared[r] >= d).sum()), 16) for r in (i, 300 + i)))
        assert size(level[i]) >= 12 or level[i] == 0
        assert size(level[i] + 1) < 12 or level[i] == knn_forest.BITS


def test_forest_finds_close_neighbours_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(knn_forest, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((150, 24))
    x = np.concatenate([c + 0.05 * rng.standard_normal((6, 24)) for c in centres])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(u)], "cls long, unit array<float>")
    got = {(r["cls"], r["other"]) for r in knn_forest.forest_neighbours(classes, 5).collect()}
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) > 0.97 * len(want)


def test_same_direction_and_queries(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(9)] + [(20, [2.0, 4.0, 6.0]), (21, [3.0, -1.0, 0.5]), (22, [3.01, -1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = set(map(tuple, knn_forest.similar_pairs(df, "id", "v", 0.98, k=2).collect()))
    assert (0, 1) in got and (0, 20) in got and (1, 20) in got and (21, 22) in got and (7, 8) not in got
    near = knn_forest.nearest(df, "id", "v", 2, queries=F.col("id") == 21).collect()
    assert near[0]["other_id"] == 22 and {r["id"] for r in near} == {21}


def test_queries_without_close_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn_forest, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 24))
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in knn_forest.nearest(df, "id", "v", 3, queries=F.col("id") % 50 == 0, certain=0.9).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other_id"]))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 400, 50):
        s = u @ u[i]
        s[i] = -2
        assert [o for _, o in sorted(got[i])] == np.argsort(-s)[:3].tolist()


def test_sparse_vectors(spark):
    rows = [(1, [(3, 1.5), (1, None), (None, 2.0), (9, 7.0)]), (2, [(3, 1.0), (3, 0.5), (1, 0.0)]), (3, []), (4, None), (5, [(1, 2.0), (3, 0.02)]), (6, [(1, -4.0)]), (7, [(1, 40.0)])]
    df = spark.createDataFrame(rows, "id long, c array<struct<coord_index:int,coord_value:double>>")
    got = sorted(map(tuple, knn_forest.similar_pairs(df, "id", "c", 0.98, places=[3, 1]).collect()))
    assert got == [(1, 2), (5, 7)]


def test_hilbert_is_a_curve():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(64))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def docs(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(i % 90))) for i in range(400)] + [(900, "long " * 3000), (901, None), (902, ""), (None, "a b c"), (903, "same text"), (903, "same text"), (904, "😀\udfff"[:1] + "ü" * 50)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("least,most", [(256, 1 << 28), (5, 1 << 28), (256, 5000)])
def test_packing(spark, monkeypatch, least, most):
    monkeypatch.setattr(packing, "LEAST_BOXES", least)
    monkeypatch.setattr(packing, "TASK_TOKENS", most)
    sizes = packing.sized(docs(spark), "doc_id", "text").cache()
    for capacity in (64, 512):
        boxes = packing.pack(sizes, "doc_id", capacity).cache()
        packed = boxes.collect()
        assert sum(r["n_tokens"] for r in packed) == sizes.agg(F.sum("n_tokens")).first()[0]
        used = {}
        for r in packed:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity and sum(used.values()) / (len(used) * capacity) > 0.9
        size = {r["doc_id"]: r["n_tokens"] for r in sizes.collect()}
        assert all(size[r["doc_id"]] > capacity or (r["piece"], r["start_token"]) == (0, 0) for r in packed)
        big = {r["doc_id"] for r in packing.oversized(boxes, "doc_id").collect()}
        assert big == {d for d, n in size.items() if n > capacity}
    assert packing.pack(sizes.filter("false"), "doc_id", 10).count() == 0
    assert packing.fill_report(packing.pack(sizes.filter("false"), "doc_id", 10), 10).first()["n_containers"] == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, "doc_id", 0)


def test_token_counts_are_exact():
    text = "A contract's text, with numbers 12345 and ünïcode — twice.\n\n  Indented"
    e = tokens.encoder(tokens.VOCABULARY)
    assert tokens.count(tokens.VOCABULARY, text) == len(e.encode_ordinary(text)) and e.decode(e.encode_ordinary(text)) == text
    assert tokens.count(tokens.VOCABULARY, None) == tokens.count(tokens.VOCABULARY, "") == 0


@pytest.mark.parametrize("rows", [50_000, 300])
def test_mixing(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "PART_ROWS", rows)
    monkeypatch.setattr(mixing, "STRETCH_ROWS", rows)
    rows = [(i, "Big_Source", 10) for i in range(5000)] + [(10_000 + i, "small-source ", 10) for i in range(20)] + [(20_000 + i, "mid", 10) for i in range(1000)] + [(1, None, 5), (2, "other", 5), (3, "mid", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big-source", 0.5, 1, 10_000), ("small source", 0.2, 4, 10_000), ("mid", 0.3, 1, 10_000), ("absent", 0.0001, 9, 10_000)], "source string, target_share double, max_repeats int, budget_tokens long")
    m = mixing.mix(sized, "doc_id", "source", targets, 1).cache()
    total = m.agg(F.sum("n_tokens")).first()[0]
    assert 9_990 <= total <= 10_000
    got = {r["source"]: r for r in mixing.share_report(m, sized, "source", targets).collect()}
    assert got["small source"]["taken"] == 800 and got["small source"]["deficit_tokens"] == 1200 and got["small source"]["repeats"] == 4
    assert abs(got["big-source"]["taken"] / got["mid"]["taken"] - 5 / 3) < 0.02
    assert m.groupBy("doc_id", "source").count().filter("count > 4").count() == 0
    assert {r[0] for r in mixing.short_sources(mixing.share_report(m, sized, "source", targets)).collect()} == {"small source", "absent"}
    assert mixing.mix(sized.filter("false"), "doc_id", "source", targets).count() == 0
    ordered = m.orderBy("position").collect()
    assert [r["virtual_finish"] for r in ordered] == sorted(r["virtual_finish"] for r in ordered)
    assert np.cumsum([r["n_tokens"] for r in ordered]).tolist() == [r["position"] for r in ordered]


def test_mixing_against_a_queue(spark):
    rows = [(i, f"s{i % 3}", 1 + i * 7 % 50) for i in range(300)] + [(1000, "s0", 4000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for budget in (50, 2000, 9000, 10**6):
        targets = spark.createDataFrame([("s0", 0.5, 1, budget), ("s1", 0.3, 3, budget), ("s2", 0.4, 2, budget)], "source string, target_share double, max_repeats int, budget_tokens long")
        u = spark.createDataFrame([(r, d) for r in (1, 2, 3) for d, *_ in rows], "repeat int, doc long").withColumn("u", mixing.unit_hash(4, F.col("repeat"), F.col("doc")))
        draw = {(r["repeat"], r["doc"]): r["u"] for r in u.collect()}
        queue = []
        for s, w, most in (("s0", 0.5, 1), ("s1", 0.3, 3), ("s2", 0.4, 2)):
            given = 0
            for rep in range(1, most + 1):
                for _, d, n in sorted((draw[rep, d], d, n) for d, x, n in rows if x == s):
                    given += n
                    queue.append((given / w, s, rep, d, n))
        queue.sort()
        upto = np.cumsum([q[4] for q in queue])
        want = [(int(t), d, s, rep, n) for t, (_, s, rep, d, n) in zip(upto, queue) if t <= budget]
        got = [tuple(r)[:5] for r in mixing.mix(sized, "doc_id", "source", targets, 4).orderBy("position").collect()]
        assert got == want
