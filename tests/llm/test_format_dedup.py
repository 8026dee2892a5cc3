"""Hashes and the two-pointer comparison agree with a parsed canonical form; groups are whole."""

import json
import random
import re
from decimal import Decimal
from fractions import Fraction

import pytest

from driftmill.llm import fold_hash, format_dedup


class Pairs(list):
    pass


def canon(text):
    """A plain canonical form, built the slow way."""
    fold = lambda x: "".join(c.lower() for c in x if c.isalnum())

    def walk(v):
        if isinstance(v, Pairs):
            return ("o", tuple(sorted((fold(k), walk(w)) for k, w in v)))
        if isinstance(v, list):
            return ("a", tuple(walk(x) for x in v))
        if isinstance(v, str):
            return ("s", fold(v))
        return ("w", str(v)) if v is None or isinstance(v, bool) else ("n", str(Fraction(v)))

    if text is None:
        return None
    for t in (text, re.sub(r",(\s*[}\]])", r"\1", text)):
        try:
            return walk(json.loads(t, object_pairs_hook=Pairs, parse_float=Decimal))
        except ValueError:
            continue
    return ("t", fold(text))


TEXTS = [
    '{"a":1}', '{"A" : 1.0}', '{"a":1,}', '{"a":1,"b":2}', '{"b":2,"a_-":1}', "[1,2]", "[2,1]", "[1,2,]", '{"a":[{"x":null},{"y":"Hi \\u00e9\\n!"}]}', '{"a":[{"x":null},{"y":"hi é"}]}',
    '{"a":[{"y":"hi é"},{"x":null}]}', "abc", "ABC ", '"abc"', '{"a":1', '{"a":1]', "", None, " ", "--", "[]", "{}", "[[]]", "[{}]", "1", "1.00", "-0", "0", "true", '{"a":"b\\"c"}', '{"a":"bc"}',
    '{"a" "b"}', "[1 2]", '{"a":{"b":{"c":[1,[2,[3]]]}}}', '{"a":{"b":{"c":[1,[2,[3.0]]]}}}', '{"a":1,"a":1}', '"\\\\"', '{"1":1}', "100", "1e2", '{"a":"\\u0041"}', '{"a":"a"}', ":", ",", '"a" "b"', "ß", "ẞ", "Ünit", "ünit",
    "[" * 300 + "]" * 300, "[" * 301 + "]" * 301, "01", "1.", '{"a":tru}', '{"k": "\\ud835\\udc00"}', "}{", "][", '{"a":1}}',
]


@pytest.mark.parametrize("piece", [1 << 17, 1, 40])
def test_hash_equals_canonical_form(monkeypatch, piece):
    monkeypatch.setattr(fold_hash, "PIECE", piece)
    one, two = fold_hash.hash_texts(TEXTS)
    forms = [canon(t) for t in TEXTS]
    for i in range(len(TEXTS)):
        for j in range(i):
            same = one[i] == one[j] and two[i] == two[j]
            assert same == (forms[i] == forms[j]), (TEXTS[i], TEXTS[j])
            assert format_dedup.same_content(TEXTS[i], TEXTS[j]) == (forms[i] == forms[j]), (TEXTS[i], TEXTS[j])


def spelled(rnd, v):
    """The same content in another layout."""
    gap = rnd.choice(["", " ", "\n\t"])
    if isinstance(v, dict):
        items = list(v.items())
        rnd.shuffle(items)
        return "{" + gap + ("," + gap).join(f"{spelled(rnd, k)}{gap}:{gap}{spelled(rnd, w)}" for k, w in items) + ("," if items and rnd.random() < 0.3 else "") + "}"
    if isinstance(v, list):
        return "[" + ("," + gap).join(spelled(rnd, x) for x in v) + gap + "]"
    if isinstance(v, str):
        t = "".join(c.upper() if rnd.random() < 0.3 else c for c in v) + rnd.choice(["", ".", " "])
        return json.dumps(t, ensure_ascii=rnd.random() < 0.5)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return rnd.choice([str(v), f"{v}.0" if isinstance(v, int) else str(v) + "0"])
    return json.dumps(v)


def document(rnd, depth=0):
    kind = rnd.randrange(6 if depth < 3 else 3)
    if kind == 3:
        return [document(rnd, depth + 1) for _ in range(rnd.randrange(3))]
    if kind >= 4:
        return {f"name{rnd.randrange(9)}": document(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [rnd.randrange(5), rnd.choice(["red", "grün", "x y"]), rnd.choice([None, True, 0.5])][kind]


@pytest.mark.parametrize("slice_,broadcast", [(15, 500_000), (20_000, 1)])
def test_groups_against_canonical_form(spark, monkeypatch, slice_, broadcast):
    monkeypatch.setattr(format_dedup, "SLICE", slice_)
    monkeypatch.setattr(format_dedup, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(5)
    docs = [document(rnd) for _ in range(40)]
    rows = []
    for n in range(300):
        d = docs[0 if n % 3 == 0 else rnd.randrange(40)]
        rows.append((n, rnd.choice(["ct-1", "CT 1", "ct_1 "]), spelled(rnd, d), rnd.choice([None, "x"]) if n % 5 == 0 else "x"))
    rows += [rows[0], rows[7], (None, "a", "b", "c"), (500, None, None, None), (501, None, None, None), (502, "", "", ""), (503, "é" * 300_000, "[]", "x"), (504, "É" * 300_000, "[ ]", "x")]
    first = {}
    for n, *texts in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(tuple(map(canon, texts)), n)
    want = {n: first[tuple(map(canon, t))] for n, *t in rows if n is not None}
    df = spark.createDataFrame(rows, "n long, kept string, t0 string, h1 string")
    fields = ["kept", "t0", "h1"]
    got = format_dedup.format_duplicates(df, "n", fields).collect()
    assert {r["n"]: r["kept"] for r in got} == want and len(got) == len(want)
    assert all(r["n_copies"] == list(want.values()).count(r["kept"]) for r in got)
    assert format_dedup.format_duplicates(df.filter("false"), "n", fields).count() == 0


def test_escapes_are_read_in_place():
    same = format_dedup.same_folded
    assert same("a\\u00e9 \\n\\\"B", "A\u00c9b", escaped=True) and same("\\ud835\\udc00x", "\U0001d400X", escaped=True)
    assert not same("\\ud835x", "dx", escaped=True) and same("\\ud835x", "X", escaped=True) and same("\\u12", "u12", escaped=True)
    assert same("xx ab-", "A.B!", 2, 6, 0, 4) and not same("ab", "abc") and same("", " .")


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    real = format_dedup._hashed
    monkeypatch.setattr(format_dedup, "_hashed", lambda *a: real(*a).selectExpr("_id", "_raw", "0L as h1", "0L as h2"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "c"), (5, "B"), (6, "d")], "n long, t string")
    got = {r["n"]: r["kept"] for r in format_dedup.format_duplicates(df, "n", ["t"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6}
