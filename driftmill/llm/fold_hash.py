"""Hashes of texts, and of JSON as parsed, that see neither formatting nor the order of object members.

Bytes (code points, where a batch holds any that are not ASCII) stream through a lookup table that gives 0 for
what is skipped and the folded letter or digit for the rest, straight into prefix sums of a polynomial; a string's
hash is a difference of two prefix sums. No canonical text is built.
"""

from __future__ import annotations

import hashlib
import sys
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import numpy as np

from driftmill.llm.overlap import mix

U = np.uint64
#: Two independent lanes of (odd base, key), so that a hash has 128 bits.
LANES = ((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), (0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5))
#: Code points hashed at once; a longer single text is hashed on its own.
PIECE = 1 << 17
TEXT, STRING, NUMBER, WORD, OBJECT, ARRAY, NULL = range(1, 8)
WORDS = {"true", "false", "null"}


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point -> folded code point, or 0 where it is neither letter nor digit."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low[0]) if len(low) == 1 else c
    return out


@lru_cache(1)
def ascii_table() -> np.ndarray:
    return np.array([ord(chr(c).lower()) if chr(c).isalnum() else 0 for c in range(128)], np.uint32)


@lru_cache(200_000)
def literal(token: str) -> tuple[int, int] | None:
    """Hash of a JSON number by its value, or of true, false or null; None for anything else."""
    if token.lower() in WORDS:
        name = token.lower()
    elif token[:1] not in "-0123456789" or not token[-1:].isdigit() or "_" in token:
        return None
    else:
        digits = token.lstrip("-")
        if len(digits) > 1 and digits[0] == "0" and digits[1] not in ".eE":
            return None
        try:
            d = Decimal(token)
        except InvalidOperation:
            return None
        sign, figures, exponent = d.as_tuple()
        text = "".join(map(str, figures)).lstrip("0")
        bare = text.rstrip("0")
        name = f"{'-' if sign else ''}{bare}e{exponent + len(text) - len(bare)}" if bare else "0"
    h = hashlib.blake2b(name.encode(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes for each text, equal for texts that differ in formatting only."""
    out = (np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64))
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > PIECE:
            _piece(texts, at, i, out)
            at, size = i, 0
        size += n
    if len(texts) > at:
        _piece(texts, at, len(texts), out)
    return out


def _piece(texts: list[str | None], lo: int, hi: int, out: tuple[np.ndarray, np.ndarray]) -> None:
    part = texts[lo:hi]
    n = hi - lo
    whole = "".join(t or "" for t in part)
    lens = np.array([len(t or "") for t in part], np.int64)
    absent = np.array([t is None for t in part])
    if not whole:
        for lane, (_, key) in enumerate(LANES):
            out[lane][lo:hi] = mix(np.where(absent, U(key ^ NULL), U(key ^ TEXT)).astype(np.uint64))
        return
    if whole.isascii():
        cp = np.frombuffer(whole.encode(), np.uint8)
        fold = ascii_table()
    else:
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        fold = fold_table()
    first = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(n), lens)
    m = len(cp)
    idx = np.arange(m)
    start = np.zeros(m, bool)
    start[first[:-1][lens > 0]] = True

    # escapes: a character is escaped if an odd run of backslashes stands before it in the same text
    back = cp == 92
    if back.any():
        plain = np.maximum.accumulate(np.where(~back, idx, np.where(start, idx - 1, -1)))
        run = np.zeros(m, np.int64)
        run[1:] = np.where(back[:-1] & ~start[1:], idx[:-1] - plain[:-1], 0)
        escaped = (run & 1) == 1
    else:
        escaped = back
    quote = (cp == 34) & ~escaped
    seen = np.cumsum(quote)
    base = np.concatenate([[0], seen])[first[:-1]]
    odd = ((seen - base[doc]) & 1) == 1
    inside = odd & ~quote
    bad = np.zeros(n, bool)
    total = np.concatenate([[0], seen])
    bad |= ((total[first[1:]] - total[first[:-1]]) & 1) == 1

    # what the characters of a text and of a JSON string fold to
    raw = fold[cp]
    sym = np.where(inside, raw, 0).astype(np.uint32)
    if back.any():
        esc = inside & escaped
        sym[inside & back & ~escaped] = 0
        sym[esc & np.isin(cp, [110, 114, 116, 98, 102])] = 0
        for i in np.flatnonzero(esc & (cp == 117)):
            stop = first[doc[i] + 1]
            hexa = whole[i + 1 : i + 5]
            if i + 5 > stop or not all(c in "0123456789abcdefABCDEF" for c in hexa):
                continue
            code = int(hexa, 16)
            sym[i : i + 5] = 0
            if 0xD800 <= code < 0xDC00 and whole[i + 5 : i + 7] == "\\u" and i + 11 <= stop:
                try:
                    low = int(whole[i + 7 : i + 11], 16)
                except ValueError:
                    low = 0
                if 0xDC00 <= low < 0xE000:
                    sym[i] = fold_table()[0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)]
                continue
            if not 0xD800 <= code < 0xE000:
                sym[i] = fold_table()[code]

    # tokens outside strings
    outside = ~odd & ~quote
    opener = outside & ((cp == 123) | (cp == 91))
    closer = outside & ((cp == 125) | (cp == 93))
    colon, comma = outside & (cp == 58), outside & (cp == 44)
    blank = outside & ((cp == 32) | (cp == 9) | (cp == 10) | (cp == 13))
    word = outside & ~(opener | closer | colon | comma | blank)
    first_of_word = word & (start | ~np.concatenate([[False], word[:-1]]))
    nested = opener.astype(np.int64) - closer
    after = np.cumsum(nested)
    depth = after - np.concatenate([[0], after])[first[:-1]][doc]
    open_quote = quote & odd
    token = np.flatnonzero(open_quote | opener | colon | comma | first_of_word)
    close_at = np.flatnonzero(closer)
    bad[doc[close_at[depth[close_at] < 0]]] = True
    ended = np.concatenate([[0], after])
    bad |= ended[first[1:]] != ended[first[:-1]]

    # each bracket must be closed by its like
    pair_at = np.flatnonzero(opener | closer)
    if len(pair_at):
        level = depth[pair_at] + closer[pair_at]
        order = np.argsort(level, kind="stable")
        p, lv = pair_at[order], level[order]
        nxt = np.concatenate([p[1:], [-1]])
        is_open = opener[p]
        ok = ~is_open | ((nxt >= 0) & (np.concatenate([lv[1:], [-9]]) == lv) & closer[nxt] & (doc[nxt] == doc[p]) & (cp[nxt] == cp[p] + 2))
        bad[doc[p[~ok]]] = True

    kind = np.zeros(len(token), np.int8)  # 1 string, 2 word, 3 container, 4 colon, 5 comma
    kind[open_quote[token]] = 1
    kind[first_of_word[token]] = 2
    kind[opener[token]] = 3
    kind[colon[token]] = 4
    kind[comma[token]] = 5
    tdoc = doc[token]
    tlevel = depth[token] - (kind == 3)

    words = np.flatnonzero(kind == 2)
    lit = np.zeros((2, len(token)), np.uint64)
    if len(words):
        w_end = np.flatnonzero(word & np.concatenate([~word[1:] | start[1:], [True]]))
        for j, s, e in zip(words, token[words], w_end):
            h = literal(whole[s : e + 1])
            if h is None:
                bad[tdoc[j]] = True
            else:
                lit[0, j], lit[1, j] = h

    # the sequence of each container: sorted by level, its own opener first
    own = np.flatnonzero(kind == 3)
    seq_tok = np.concatenate([np.arange(len(token)), own])
    seq_level = np.concatenate([tlevel, tlevel[own] + 1])
    seq_head = np.concatenate([np.zeros(len(token), bool), np.ones(len(own), bool)])
    order = np.lexsort((~seq_head, token[seq_tok], seq_level)) if len(seq_tok) else np.zeros(0, np.int64)
    seq_tok, seq_level, seq_head = seq_tok[order], seq_level[order], seq_head[order]
    ns = len(seq_tok)
    skind = np.where(seq_head, 0, kind[seq_tok])
    sdoc = tdoc[seq_tok]
    # texts are containers of level 0
    heads = seq_head | ((seq_level == 0) & (np.concatenate([[-1], sdoc[:-1]]) != sdoc))
    root_head = heads & ~seq_head
    pos = np.arange(ns)
    head_of = np.maximum.accumulate(np.where(heads, pos, 0)) if ns else pos
    in_object = np.where(seq_head[head_of] if ns else False, cp[token[seq_tok[head_of]]] == 123 if ns else False, False)
    at_root = ~seq_head[head_of] if ns else np.zeros(0, bool)
    child = (skind >= 1) & (skind <= 3)
    prev_kind = np.concatenate([[0], skind[:-1]])
    prev_kind = np.where(heads & ~root_head, 0, np.where(root_head, 0, prev_kind))
    next_kind = np.concatenate([skind[1:], [0]])
    next_same = np.concatenate([~heads[1:], [False]])
    next_kind = np.where(next_same, next_kind, 0)
    is_colon = skind == 4
    wrong = (is_colon & ~(in_object & (prev_kind == 1) & (next_kind >= 1) & (next_kind <= 3)))
    is_key = child & (next_kind == 4) & in_object
    is_value = child & (prev_kind == 4) & in_object
    wrong |= child & in_object & ~is_key & ~is_value
    wrong |= is_key & is_value
    wrong |= child & (prev_kind >= 1) & (prev_kind <= 3)
    wrong |= at_root & ((skind == 4) | (skind == 5))
    bad[sdoc[wrong]] = True
    element = child & ~in_object
    roots = np.bincount(sdoc[child & at_root], minlength=n) if ns else np.zeros(n, int)
    bad |= roots != 1
    # places of array elements
    count = np.cumsum(element)
    before = np.concatenate([[0], count])
    place = count - before[head_of] - 1 if ns else count

    strings = np.flatnonzero(kind == 1)
    q_end = np.flatnonzero(quote & ~odd)
    usable = len(q_end) and len(strings)
    if usable:
        # the k-th opening quote of a text is closed by its k-th closing one; texts with an odd number are bad anyway
        nxt = np.searchsorted(q_end, token[strings])
        s_end = np.where(nxt < len(q_end), q_end[np.minimum(nxt, len(q_end) - 1)], token[strings])
    else:
        s_end = token[strings]

    depth_max = int(seq_level.max()) if ns else 0
    level_bounds = np.searchsorted(seq_level, np.arange(depth_max + 2)) if ns else np.zeros(2, int)
    keep, keep_raw = sym != 0, raw != 0
    rank, rank_raw = np.concatenate([[0], np.cumsum(keep)]), np.concatenate([[0], np.cumsum(keep_raw)])
    for lane, (odd_base, key) in enumerate(LANES):
        power, inverse = _powers(odd_base, int(rank_raw[-1]) + 1), _powers(pow(odd_base, -1, 1 << 64), int(rank_raw[-1]) + 1)
        sums = np.concatenate([[U(0)], np.cumsum(np.where(keep, sym.astype(np.uint64) * power[rank[:-1]], U(0)), dtype=np.uint64)])
        value = np.zeros(len(token), np.uint64)
        a, b = token[strings], s_end
        value[strings] = mix((sums[b] - sums[a]) * inverse[rank[a]] + (rank[b] - rank[a]).astype(np.uint64) * U(key) + U(STRING))
        value[words] = mix(lit[lane, words] + U(WORD))
        for level in range(depth_max, 0, -1):
            x, y = level_bounds[level], level_bounds[level + 1]
            if x == y:
                continue
            tk, hd = seq_tok[x:y], heads[x:y]
            v = value[tk]
            part_of = np.zeros(y - x, np.uint64)
            e = element[x:y]
            part_of[e] = mix(v[e] + U(key)) * mix(place[x:y][e].astype(np.uint64) + U(ARRAY))
            val = np.flatnonzero(is_value[x:y] & (pos[x:y] >= 2))
            val = val[val >= 2]
            part_of[val] = mix(mix(v[val - 2] + U(OBJECT)) * U(odd_base) + v[val])
            begin = np.flatnonzero(hd)
            got = np.add.reduceat(part_of, begin)
            heads_tok = tk[begin]
            is_obj = cp[token[heads_tok]] == 123
            many = np.add.reduceat((e | is_value[x:y]).astype(np.uint64), begin)
            value[heads_tok] = mix(got + many * U(key) + np.where(is_obj, U(OBJECT), U(ARRAY)))
        result = np.zeros(n, np.uint64)
        root = child & at_root
        result[sdoc[root]] = mix(value[seq_tok[root]] ^ U(key))
        raw_sums = np.concatenate([[U(0)], np.cumsum(np.where(keep_raw, raw.astype(np.uint64) * power[rank_raw[:-1]], U(0)), dtype=np.uint64)])
        lo_, hi_ = first[:-1], first[1:]
        as_text = mix((raw_sums[hi_] - raw_sums[lo_]) * inverse[rank_raw[lo_]] + (rank_raw[hi_] - rank_raw[lo_]).astype(np.uint64) * U(key) + U(TEXT))
        empty = mix(np.array([key ^ TEXT], np.uint64))[0]
        as_text = np.where(rank_raw[hi_] == rank_raw[lo_], empty, as_text)
        result = np.where(bad, as_text, result)
        out[lane][lo:hi] = np.where(absent, mix(np.array([key ^ NULL], np.uint64))[0], result)
