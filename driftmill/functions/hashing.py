"""Hashes, ranks, fingerprints and canonical JSON."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_STRAY = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[,}\]])', re.S)


def fnv1a(text: pd.Series, seed: int) -> pd.Series:
    """FNV-1a of UTF-8 bytes from basis xor seed, as unsigned decimal text. All texts of a batch advance together, a byte
    at a time, the longest first; a text that has ended takes no further part."""
    raw = [None if t is None else t.encode() for t in text]
    size = np.array([-1 if r is None else len(r) for r in raw])
    order = np.argsort(-size, kind="stable")
    joined = np.frombuffer(b"".join(r for r in raw if r), np.uint8)
    begin = np.concatenate([[0], np.cumsum(np.maximum(size, 0))[:-1]]).astype(np.int64)[order] if len(raw) else np.zeros(0, np.int64)
    left = size[order]
    h = np.full(len(raw), np.uint64((seed ^ FNV_BASIS) & ((1 << 64) - 1)))
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-left, -i))  # texts of more than i bytes
        h[:n] = (h[:n] ^ joined[begin[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), object)
    out[order] = [str(x) for x in h.tolist()]
    out[size < 0] = None
    return pd.Series(out, index=text.index, dtype=object)


def fnv_rank(text: Column, seed: int = 0) -> Column:
    """decimal(20,0): 64-bit ranks compare unsigned. Null gives null."""

    @F.pandas_udf("string")
    def rank(s: pd.Series) -> pd.Series:
        return fnv1a(s.where(s.notna(), None).astype(object), seed)

    return rank(text).cast("decimal(20,0)")


def hash_fraction(text: Column, namespace: str, seed: int) -> Column:
    """The first 8 bytes of SHA-256('<namespace>:<seed>:<text>') as a share of 2^64 - 1; stays in the JVM."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{namespace}:{seed}:"), text), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float((1 << 64) - 1))


def is_reserved(family: Column, ratio: float, namespace: str = "challenge-v1", seed: int = 0) -> Column:
    """Whether a family is held for the challenge set; a ratio of 0 holds none. ``namespace`` is that of the corpus."""
    return F.lit(False) if ratio <= 0 else hash_fraction(family, namespace, seed) < ratio


def loads(text: str | None) -> object:
    """JSON as written; commas that end nothing are forgiven. ValueError for anything else."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text)
    except ValueError:
        pass
    before = None
    while before != text:
        before, text = text, _STRAY.sub(lambda m: m[1] or "", text)
    return json.loads(text)


def canonical(value: object) -> str:
    """Sorted member names, arrays in order, no blanks; integers and floats stay apart."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: Column) -> Column:
    """Null where the text is no JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return canonical(loads(t))
            except (ValueError, RecursionError):
                return None

        return s.map(one)

    return run(text)


def pair_fingerprint(base: Column, candidate: Column, policy: Column, mode: Column, oracle: Column) -> Column:
    """SHA-256 of five labelled lines; base and candidate are canonical JSON."""
    lines = [F.concat(F.lit(f"{name}="), c) for name, c in (("base", base), ("candidate", candidate), ("policy", policy), ("mode", mode), ("oracle", oracle))]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def is_sha256(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")
