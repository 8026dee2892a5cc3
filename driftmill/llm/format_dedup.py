"""Duplicates hidden by formatting: fold hashes find them, a two-pointer comparison confirms them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmill.llm.fold_hash import hash_texts, literal
from driftmill.llm.overlap import mix
from driftmill.operators.skew import lookup
from driftmill.runtime import bounded_broadcast, cut, spread

#: Keys of copies that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Members of a group that are confirmed in one task; a larger group is cut into slices of this size.
SLICE = 20_000
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)
SOFT = frozenset("nrtbf")  # escapes of blanks and control characters
HEX = frozenset("0123456789abcdefABCDEF")
BASE, PRIME = 0x2545F491, (1 << 61) - 1


def _unit(text: str, i: int, end: int) -> int:
    """The code unit of a \\uXXXX escape that begins at ``i``, -1 where there is none."""
    return int(text[i + 2 : i + 6], 16) if i + 6 <= end and text[i] == "\\" and text[i + 1] == "u" and all(c in HEX for c in text[i + 2 : i + 6]) else -1


def _next(text: str, i: int, end: int, escaped: bool) -> tuple[str, int]:
    """The next letter or digit at or behind ``i`` and the place behind it, "" at the end. Escapes are read in place."""
    while i < end:
        c = text[i]
        if escaped and c == "\\" and i + 1 < end:
            unit, at = _unit(text, i, end), i + 2
            if unit < 0:
                c = "" if text[i + 1] in SOFT else text[i + 1]
            else:
                at = i + 6
                if 0xD800 <= unit < 0xDC00:
                    low = _unit(text, at, end)
                    if 0xDC00 <= low < 0xE000:
                        unit, at = 0x10000 + ((unit - 0xD800) << 10) + low - 0xDC00, at + 6
                c = chr(unit)
            i = at
        else:
            i += 1
        if c.isalnum():
            return c, i
    return "", end


def same_folded(a: str, b: str, i: int = 0, n: int | None = None, j: int = 0, m: int | None = None, escaped: bool = False) -> bool:
    """Two pointers walk a[i:n] and b[j:m], each skipping what is neither letter nor digit; nothing is copied."""
    n, m = len(a) if n is None else n, len(b) if m is None else m
    while True:
        x, i = _next(a, i, n, escaped)
        y, j = _next(b, j, m, escaped)
        if x != y and x.lower() != y.lower():
            return False
        if not x:
            return True


@lru_cache(1 << 16)
def _name_hash(written: str) -> int:
    """Polynomial hash of a member's name as it is written, by the letters and digits in it: members are put in its order."""
    h, i = 0, 0
    while True:
        c, i = _next(written, i, len(written), True)
        if not c:
            return h
        for x in c.lower():
            h = (h * BASE + ord(x) + 1) % PRIME


def _scan(text: str) -> tuple[list[tuple[int, int]], list[int]] | None:
    """Spans of the JSON tokens without commas, and for each opening bracket the token that closes it; None for what is
    no JSON, stray commas forgiven."""
    spans: list[tuple[int, int]] = []
    closed: list[int] = []
    stack: list[int] = []
    # what the open container waits for: "e" element, "," comma or end, "k" name, ":" colon, "v" value
    waits = ["e"]
    at = 0
    for m in TOKEN.finditer(text):
        if text[at : m.start()].strip(" \t\r\n"):
            return None
        at = m.end()
        c = text[m.start()]
        now = waits[-1]
        if c == ",":
            if now in ":v" or not stack:
                return None
            waits[-1] = "k" if text[spans[stack[-1]][0]] == "{" else "e"
            continue
        if c == ":":
            if now != ":":
                return None
            waits[-1] = "v"
        elif c in "}]":
            if not stack or now in ":v" or text[spans[stack[-1]][0]] != ("{" if c == "}" else "["):
                return None
            closed[stack.pop()] = len(spans)
            waits.pop()
        elif now == "k":
            if c != '"' or len(m[0]) < 2:
                return None
            waits[-1] = ":"
        elif now in "ev":
            waits[-1] = ","
            if c in "{[":
                stack.append(len(spans))
                waits.append("k" if c == "{" else "e")
            elif c != '"' and literal(m[0]) is None:
                return None
        else:
            return None
        spans.append(m.span())
        closed.append(len(spans) - 1)
    return None if stack or text[at:].strip(" \t\r\n") or not spans else (spans, closed)


def same_content(a: str | None, b: str | None) -> bool:
    """Whether two texts differ in formatting only: as JSON where both are, as plain text otherwise."""
    if a is None or b is None:
        return a is b
    if a == b:
        return True
    x, y = _scan(a), _scan(b)
    if x is None or y is None:
        return x is y and same_folded(a, b)
    (sa, ca), (sb, cb) = x, y

    def members(text: str, spans: list, closed: list, at: int) -> list[tuple[int, int]]:
        found, i = [], at + 1
        while i < closed[at]:
            found.append((_name_hash(text[spans[i][0] + 1 : spans[i][1] - 1]), i))
            i = closed[i + 2] + 1
        return sorted(found)

    def texts(i: int, j: int) -> bool:
        (p, q), (r, t) = sa[i], sb[j]
        return (q - p == t - r and a[p:q] == b[r:t]) or same_folded(a, b, p + 1, q - 1, r + 1, t - 1, True)

    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        p, q = a[sa[i][0]], b[sb[j][0]]
        if p != q and (p in '{["' or q in '{["'):
            return False
        if p == "{":
            left, right = members(a, sa, ca, i), members(b, sb, cb, j)
            if len(left) != len(right) or not all(x == y and texts(s, t) for (x, s), (y, t) in zip(left, right)):
                return False
            todo.extend((s + 2, t + 2) for (_, s), (_, t) in zip(left, right))
        elif p == "[":
            s, t = i + 1, j + 1
            while s < ca[i] and t < cb[j]:
                todo.append((s, t))
                s, t = ca[s] + 1, cb[t] + 1
            if s != ca[i] or t != cb[j]:
                return False
        elif p == '"':
            if not texts(i, j):
                return False
        elif literal(a[sa[i][0] : sa[i][1]]) != literal(b[sb[j][0] : sb[j][1]]):
            return False
    return True


def _hashed(texts: DataFrame, fields: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for i in range(fields):
                x, y = hash_texts(b.column(f"t{i}").to_pylist())
                one, two = mix(one + x + np.uint64(i)), mix(two + y + np.uint64(31 * i))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_raw"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["_id", "_raw", "h1", "h2"])

    kind = texts.schema["_id"].dataType.simpleString()
    return spread(texts).mapInArrow(run, f"_id {kind}, _raw bigint, h1 bigint, h2 bigint")


def format_duplicates(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, kept, n_copies): every distinct key with the smallest key of its group and the size of the group.

    Rows are copies if every field has the same content once letter case, blanks, punctuation, stray commas and the
    order of object members are left aside; numbers compare by value, arrays in order. One pass hashes the texts
    (128 bits); only keys and hashes are shuffled and counted. Rows of groups with more than one key are then read
    again, one for each key, sorted behind their group's first row and confirmed by a two-pointer comparison of the texts as
    they are written; large groups are cut into slices that each get the first row. Rows that fail it (a hash collision)
    form groups of their own.

    Nulls: a null field equals a null field and nothing else; rows with a null key are left out. An empty text equals
    one of punctuation only. Rows repeated under one key count once (the smallest content hash of the key stands for
    it). An empty table gives an empty result.
    """
    written = [F.col(f).cast("string") for f in fields]
    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_id"), *[c.alias(f"t{i}") for i, c in enumerate(written)], F.xxhash64(*[x for c in written for x in (c.isNull(), c)]).alias("_raw"))
    seen = _hashed(texts, len(fields))
    once = cut(seen.groupBy("_id").agg(F.min(F.struct("h1", "h2", "_raw")).alias("h")).select("_id", "h.h1", "h.h2", "h._raw"), "p4-hashes")
    groups = once.groupBy("h1", "h2").agg(F.min("_id").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = cut(lookup(once, groups, ["h1", "h2"], "inner").select("_id", "_raw", "kept", F.ceil(F.col("n") / SLICE).cast("int").alias("fan")), "p4-copies")
    texts = _texts_of(texts, copies)
    links, rest = None, copies
    while True:
        checked = cut(_confirmed(texts, rest, len(fields)), "p4-checked")
        good = checked.filter("same").select("_id", "kept")
        links = good if links is None else links.unionByName(good)
        failed = checked.filter("not same").select("_id", F.col("kept").alias("_of"))
        if failed.isEmpty():
            break
        again = failed.groupBy("_of").agg(F.min("_id").alias("kept"), F.count(F.lit(1)).alias("n"))
        rest = cut(lookup(failed, again, ["_of"], "inner").select("_id", "kept", F.ceil(F.col("n") / SLICE).cast("int").alias("fan")), "p4-rest")
    placed = cut(once.select("_id").join(links, "_id", "left").select("_id", F.coalesce("kept", F.col("_id")).alias("kept")), "p4-placed")
    sizes = placed.groupBy("kept").agg(F.count(F.lit(1)).alias("n_copies"))
    return lookup(placed, sizes, ["kept"]).select(F.col("_id").alias(key), F.col("kept").alias("kept"), "n_copies")


def _texts_of(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """(_id, t0, ...): one row for each key of ``copies``, that whose raw digest was chosen. Only these rows are moved, after
    repeated ones are combined where they are read."""
    ids = bounded_broadcast(copies.select("_id", "_raw"), BROADCAST_ROWS)
    rows = texts.join(ids, ["_id", "_raw"], "left_semi")
    columns = [c for c in rows.columns if c not in ("_id", "_raw")]
    return rows.groupBy("_id").agg(F.min(F.struct(*columns)).alias("t")).select("_id", *[F.col(f"t.{c}").alias(c) for c in columns])


def _confirmed(texts: DataFrame, groups: DataFrame, fields: int) -> DataFrame:
    """(_id, kept, same) for the rows of ``groups`` (_id, kept, fan) that do not lead their group. ``texts`` has one row for
    each key, so a slice is compared with one row and no more than that is held."""
    own = groups.select("_id", "kept", F.pmod(F.xxhash64("_id"), F.col("fan")).cast("int").alias("slice"), F.lit(False).alias("leads")).filter("_id <> kept")
    first = groups.filter("_id = kept").select("_id", "kept", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"), F.lit(True).alias("leads"))
    rows = own.unionByName(first).join(texts, "_id").repartition("kept", "slice").sortWithinPartitions("kept", "slice", F.desc("leads"), "_id")
    kind = texts.schema["_id"].dataType
    out = T.StructType([T.StructField("_id", kind), T.StructField("kept", kind), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: list = []
        for b in batches:
            keys, kept, leads = (b.column(c).to_pylist() for c in ("_id", "kept", "leads"))
            cols = [b.column(f"t{i}") for i in range(fields)]
            k_out, r_out, s_out = [], [], []
            for r in range(b.num_rows):
                row = [c[r].as_py() for c in cols]
                if leads[r]:
                    lead = row
                    continue
                k_out.append(keys[r])
                r_out.append(kept[r])
                s_out.append(all(same_content(x, y) for x, y in zip(lead, row)))
            yield pa.RecordBatch.from_arrays([pa.array(k_out, b.column("_id").type), pa.array(r_out, b.column("kept").type), pa.array(s_out, pa.bool_())], names=["_id", "kept", "same"])

    return rows.mapInArrow(run, out)
