"""Subject areas of each document: a classifier chain over term, source and structure features, decoded by beam search."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.llm.overlap import mix
from driftmill.runtime import cut, parallelism, spread

BUCKETS = 1 << 16  # of hashed words and word pairs
#: Labelled documents the classifier is fitted on at most; more are thinned by a hash of their id.
MAX_LABELLED = 5000
FOLDS = 3
BEAM = 8
#: Scores from which a line speaks for its best area; the chain learns what the share of such lines is worth at each.
SURE = (1.0, 2.0, 4.0)
#: Cells of the dense part of the term matrix; rarer terms are kept sparse.
DENSE = 1 << 24
#: Characters whose terms are found at once; a longer single text is taken alone.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
SKIP = 1  # value of a combining mark: it neither ends a word nor belongs to it


class Alphabet:
    """Code point -> folded letter (lower case, no accent), 0 where a word ends. Filled as characters are met."""

    def __init__(self) -> None:
        self.fold = np.zeros(sys.maxunicode + 1, np.uint32)
        self.upper, self.known = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
        self.learn(np.arange(128))

    def learn(self, points: np.ndarray) -> None:
        for c in points.tolist():
            ch = chr(c)
            plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()
            if unicodedata.combining(ch):
                self.fold[c] = SKIP
            elif ch.isalpha():
                self.fold[c] = ord(plain[0]) if plain else ord(ch.lower()[0])
            self.upper[c], self.known[c] = ch.isupper(), True

    def meet(self, cp: np.ndarray) -> None:
        if cp.dtype != np.uint8:
            new = ~self.known[cp]
            if new.any():
                self.learn(np.unique(cp[new]))


@lru_cache(1)
def alphabet() -> Alphabet:
    return Alphabet()


@dataclass
class Lines:
    """The different terms of each line or sentence: those of line i are bucket[start[i]:start[i + 1]]."""

    doc: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    structure: np.ndarray  # (documents, STRUCTURE)

    def of(self, d: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.doc, [d, d + 1])
        return self.bucket[self.start[lo] : self.start[hi]]


def find_lines(texts: list[str | None]) -> Lines:
    """Words are runs of letters without accents in lower case; names in camel case fall into words. A line ends at a
    line break or at a blank behind a full stop, exclamation or question mark. Terms are words and pairs of neighbours."""
    docs, starts, buckets, shapes, total = [], [], [], [], 0
    at, size = 0, 0
    for i in range(len(texts) + 1):
        n = len(texts[i] or "") if i < len(texts) else 0
        if i == len(texts) or (i > at and size + n > PIECE):
            if i > at:
                d, s, b, shape = _find(texts[at:i])
                docs.append(d + at)
                starts.append(s + total)
                buckets.append(b)
                shapes.append(shape)
                total += len(b)
            at, size = i, 0
        size += n
    empty = np.zeros(0, np.int64)
    return Lines(np.concatenate([empty, *docs]), np.append(np.concatenate([empty, *starts]), total), np.concatenate([empty, *buckets]), np.concatenate([np.zeros((0, STRUCTURE)), *shapes]))


#: Lines that begin with a mark of headings, lists, tables or code; digits; capitals; length; lines.
MARKS = ("#", "-*+\u2022", "|", "{}[]\"<")
STRUCTURE = len(MARKS) + 4


def _structure(cp: np.ndarray, ends: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """(documents, STRUCTURE): shares of the lines that begin with each kind of mark, of digits and of capitals, and the
    logarithms of length and lines. ``ends``: place behind the break that closes each text."""
    size = np.diff(np.concatenate([[0], ends]))
    of_doc = lambda at: np.bincount(np.searchsorted(ends, at, "right"), minlength=len(ends))
    starts = np.concatenate([[0], np.flatnonzero(cp[:-1] == 10) + 1])
    first, lines = cp[starts], np.maximum(of_doc(starts), 1)
    marked = [of_doc(starts[np.isin(first, [ord(c) for c in m])]) / lines for m in MARKS]
    return np.stack([*marked, of_doc(np.flatnonzero((cp >= 48) & (cp <= 57))) / size, of_doc(np.flatnonzero(upper)) / size, np.log1p(size), np.log1p(lines)], 1)


def _distinct(key: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; sorting beats the hashed np.unique here several times over."""
    key.sort()
    return key[np.diff(key, prepend=-1) != 0]


def _find(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    whole = "".join((t or "") + "\n" for t in texts)
    ends = np.cumsum([len(t or "") + 1 for t in texts])  # behind the break of each text
    cp = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    abc = alphabet()
    abc.meet(cp)
    value = abc.fold[cp]
    letter, upper = value > 0, abc.upper[cp]
    shape = _structure(cp, ends, upper)
    before = np.concatenate([[False], letter[:-1]])
    hump = upper & before & ~np.concatenate([[False], upper[:-1]])
    first = letter & (~before | hump)
    word = np.flatnonzero(first)
    if not len(word):
        return none, none, none, shape
    counted = value > SKIP
    rank = np.concatenate([[0], np.cumsum(counted)])
    power, inverse = _powers(int(rank[-1]) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(counted, value.astype(np.uint64) * power[rank[:-1]], np.uint64(0)), dtype=np.uint64)])
    stop = np.concatenate([word[1:], [len(cp)]])  # what lies between two words adds nothing
    gap = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    stop = np.minimum(stop, gap[np.searchsorted(gap, word, "right")])
    hashed = mix((sums[stop] - sums[word]) * inverse[rank[word]] + (rank[stop] - rank[word]).astype(np.uint64))
    space = (cp == 32) | (cp == 9) | (cp == 13)
    mark = (cp == 46) | (cp == 33) | (cp == 63)
    ends_line = (cp == 10) | (space & np.concatenate([[False], mark[:-1]]))
    line = np.cumsum(ends_line)[word]
    pair = line[1:] == line[:-1]
    both = mix(hashed[:-1][pair] * np.uint64(3) + hashed[1:][pair])
    key = np.concatenate([line, line[1:][pair]]).astype(np.int64) << 16
    key |= (np.concatenate([hashed, both]) >> np.uint64(48)).astype(np.int64)
    key = _distinct(key)
    of = key >> 16
    new = np.flatnonzero(np.diff(of, prepend=-1))
    at = word[np.searchsorted(line, of[new])]
    return np.searchsorted(ends, at, "right"), new, key & (BUCKETS - 1), shape


@lru_cache(2)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(base))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _grown(1 << max(PIECE.bit_length() - 1, n.bit_length()))


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each bucket occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            found = find_lines(b.column("_text").to_pylist())
            n += b.num_rows
            each = _distinct((np.repeat(found.doc, np.diff(found.start)) << 16) | found.bucket)
            seen += np.bincount(each & (BUCKETS - 1), minlength=BUCKETS)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(seen[hit], n))], names=["bucket", "n"])

    rows = spread(docs.select(F.col(text).alias("_text"))).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # no more rows than buckets
    df, total = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, total


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(shape: tuple[int, ...]):
    m, v = np.zeros(shape, np.float32), np.zeros(shape, np.float32)

    def step(g: np.ndarray, t: int, rate: float) -> np.ndarray:
        m[:] = 0.9 * m + 0.1 * g
        v[:] = 0.99 * v + 0.01 * g * g
        return rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    return step


def fit_terms(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 90, decay: float = 1e-4) -> np.ndarray:
    """(BUCKETS, areas) weights of one logistic regression per area over sparse (bucket, value) rows.

    Terms of many documents are columns of a dense matrix of bounded size, all others stay sparse."""
    n, areas = y.shape
    rows = np.repeat(np.arange(n), [len(i) for i, _ in docs])
    cols, vals = np.concatenate([i for i, _ in docs]), np.concatenate([v for _, v in docs]).astype(np.float32)
    held = np.bincount(cols, minlength=BUCKETS)
    often = held[cols] > 1  # a term of one labelled document teaches nothing about others
    rows, cols, vals = rows[often], cols[often], vals[often]
    weights = np.zeros((BUCKETS, areas), np.float32)
    if not len(rows):
        return weights
    common = np.argsort(-held, kind="stable")[: max(1, DENSE // max(n, 1))]
    common = common[held[common] > max(1, n // 24)]
    seat = np.full(BUCKETS, -1)
    seat[common] = np.arange(len(common))
    at = seat[cols]
    dense = np.zeros((n, len(common)), np.float32)
    dense[rows[at >= 0], at[at >= 0]] = vals[at >= 0]
    rows, cols, vals = rows[at < 0], cols[at < 0], vals[at < 0]
    used, ci = np.unique(cols, return_inverse=True)
    order = np.argsort(ci, kind="stable")
    r_at, c_at = np.flatnonzero(np.diff(rows, prepend=-1)), np.flatnonzero(np.diff(ci[order], prepend=-1))
    v_row, v_col, r_col, heads = vals[:, None], vals[order][:, None], rows[order], rows[r_at]
    w, u, b = np.zeros((len(used), areas), np.float32), np.zeros((len(common), areas), np.float32), np.full(areas, -2.0, np.float32)
    step_w, step_u, step_b, target = _adam(w.shape), _adam(u.shape), _adam(b.shape), y.astype(np.float32)
    for t in range(1, steps + 1):
        z = dense @ u + b
        if len(rows):
            z[heads] += np.add.reduceat(w[ci] * v_row, r_at)
        g = _squash(z) - target
        if len(rows):
            w -= step_w(np.add.reduceat(g[r_col] * v_col, c_at) / n + decay * w, t, 0.5)
        u -= step_u(dense.T @ g / n + decay * u, t, 0.5)
        b -= step_b(g.mean(0), t, 0.1)
    weights[used], weights[common] = w, u
    return weights


def _weighted(bucket: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.log1p(n) * idf[bucket]
    bucket, v = bucket[v > 0], v[v > 0]
    return bucket, (v / (np.linalg.norm(v) or 1)).astype(np.float32)


def doc_terms(lines: Lines, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document and in how many of its lines each occurs."""
    terms = np.sort(lines.of(d))
    first = np.flatnonzero(np.diff(terms, prepend=-1))
    return terms[first], np.diff(np.append(first, len(terms)))


EVIDENCE = len(SURE) + 3


def evidence(lines: Lines, n: int, scaled: np.ndarray) -> np.ndarray:
    """(documents, areas, EVIDENCE): of each area the share of the lines that speak for it at each score of SURE, its
    share of the summed scores, the logarithms of its lines and of lines at all.

    ``scaled`` is weight times idf. A passing mention or a footer is one line; what a text is about fills many.
    """
    areas = scaled.shape[1]
    out = np.zeros((n, areas, EVIDENCE))
    if len(lines.doc):
        z = np.add.reduceat(scaled[lines.bucket], lines.start[:-1], axis=0)
        top = z.argmax(1)
        score = z[np.arange(len(z)), top]
        for i, least in enumerate(SURE):
            sure = score > least
            count = np.bincount(lines.doc[sure] * areas + top[sure], minlength=n * areas).reshape(n, areas)
            out[:, :, i] = count / np.maximum(count.sum(1, keepdims=True), 1)
            if i == 0:
                out[:, :, -2] = np.log1p(count)
        at = np.flatnonzero(np.diff(lines.doc, prepend=-1))
        weight = np.zeros((n, areas))
        weight[lines.doc[at]] = np.add.reduceat(np.maximum(z, 0), at, axis=0)
        total = weight.sum(1, keepdims=True)
        out[:, :, len(SURE)] = weight / np.where(total > 0, total, 1)
        out[:, :, -1] = np.log1p(np.bincount(lines.doc, minlength=n))[:, None]
    return out


def link_features(ev: np.ndarray, structure: np.ndarray, source: np.ndarray) -> np.ndarray:
    """(documents, areas, features) of the chain's links, without the areas decided before: term evidence for the area
    and how it stands among the others, log odds of the area in the document's source, structure of the text."""
    n, k, _ = ev.shape
    share = ev[:, :, : len(SURE) + 1].mean(2)
    order = np.argsort(-share, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None, :].repeat(n, 0), 1)
    ranked = np.concatenate([np.take_along_axis(share, order, 1), np.zeros((n, 3))], 1)[:, :3, None]
    others = np.where(rank == 0, ranked[:, 1], ranked[:, 0])
    say = lambda x: np.log(x + 0.02)
    own = [np.ones((n, k)), share, *ev.transpose(2, 0, 1), others, share - ranked[:, 2], say(share) - say(ranked[:, 0]), say(share) - say(ranked[:, 2]), rank == 0, rank == 1, source]
    return np.concatenate([np.stack(own, 2), np.broadcast_to(structure[:, None, :], (n, k, structure.shape[1]))], 2)


def _newton(x: np.ndarray, t: np.ndarray, ridge: np.ndarray, centre: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression with a quadratic penalty around ``centre``, by Newton steps until they end."""
    w = centre.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - t @ z + 0.5 * (ridge * (v - centre) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = _squash(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - t) + ridge * (w - centre))
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        before, now = now, loss(w)
        if before - now < 1e-7 * (1 + abs(now)):
            break
    return w


@dataclass
class Chain:
    """Links in the order of ``order``: each decides one area from the features and from the areas decided before."""

    order: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray  # (areas, features): of each link's own features
    count: np.ndarray  # (areas, 2): of the number of areas decided for so far, and of none so far
    before: np.ndarray  # (areas, areas): of each area decided for before
    scale: float = 1.0  # of the scores, fitted on documents the links were not fitted on
    shift: float = 0.0

    def base(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std * self.weights[None]).sum(2)


def fit_links(x: np.ndarray, y: np.ndarray, own: float = 20.0) -> Chain:
    """Links over (documents, areas, features), the commonest area first, true labels as the areas decided before.

    One regression over all areas is the centre; each link then has weights of its own, drawn to the centre with the
    force ``own``, and one for every area before it, drawn to zero: how areas go together.
    """
    n, k, width = x.shape
    order = np.argsort(-y.sum(0), kind="stable")
    mean, std = x.reshape(-1, width).mean(0), x.reshape(-1, width).std(0)
    mean[0], std = 0.0, np.where(std > 1e-9, std, 1.0)
    z = (x - mean) / std
    done = np.zeros((n, k, k))  # link, area: decided for before the link
    for i, j in enumerate(order):
        done[:, j, order[:i]] = y[:, order[:i]]
    count = np.stack([done.sum(2), done.sum(2) == 0], 2)
    full = np.concatenate([z, count], 2)
    ridge = np.full(width + 2, 1.0)
    centre = _newton(full.reshape(-1, width + 2), y.reshape(-1), ridge, np.zeros(width + 2))
    weights = np.zeros((k, width + 2 + k))
    for j in range(k):
        weights[j] = _newton(np.concatenate([full[:, j], done[:, j]], 1), y[:, j], np.full(width + 2 + k, own), np.concatenate([centre, np.zeros(k)]))
    return Chain(order, mean, std, weights[:, :width], weights[:, width : width + 2], weights[:, width + 2 :])


def link_scores(chain: Chain, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of all links with the labels ``y`` as the areas decided before."""
    z = chain.base(x)
    for i, j in enumerate(chain.order):
        on = y[:, chain.order[:i]]
        z[:, j] += chain.count[j, 0] * on.sum(1) + chain.count[j, 1] * (on.sum(1) == 0) + on @ chain.before[j, chain.order[:i]]
    return z


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """The links, and their calibration on the scores of documents the links of the other folds have not seen."""
    held = np.zeros(y.shape)
    for f in range(FOLDS):
        test = fold == f
        if test.any() and not test.all():
            held[test] = link_scores(fit_links(x[~test], y[~test]), x[test], y[test])
    chain = fit_links(x, y)
    score = held.reshape(-1, 1)
    fitted = _newton(np.concatenate([score, np.ones_like(score)], 1), y.reshape(-1), np.array([1.0, 1.0]), np.array([1.0, 0.0]))
    chain.scale, chain.shift = max(float(fitted[0]), 0.05), float(fitted[1])
    return chain


def source_odds(y: np.ndarray, sources: list[str], prior: np.ndarray) -> dict[str, np.ndarray]:
    """Log odds of each area in a source against its odds in all, drawn to 0 where the source has few labels."""
    table: dict[str, np.ndarray] = {}
    of: dict[str, list[int]] = {}
    for i, s in enumerate(sources):
        of.setdefault(s, []).append(i)
    for s, at in of.items():
        rate = (y[at].sum(0) + 5 * prior) / (len(at) + 5)
        table[s] = np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))
    return table


def odds_of(table: dict[str, np.ndarray], sources: list[str | None], k: int) -> np.ndarray:
    none = np.zeros(k)
    return np.array([table.get(s or "", none) for s in sources]).reshape(len(sources), k)


def decode(chain: Chain, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, areas) decisions and probabilities: for each document the likeliest combination of one to ``most``
    areas, by beam search along the chain (all documents of a batch at once)."""
    n, k = x.shape[:2]
    base = chain.base(x)
    logp = np.full((n, BEAM), -np.inf)
    logp[:, 0] = 0
    on, prob = np.zeros((n, BEAM, k), bool), np.zeros((n, BEAM, k), np.float32)
    for j in chain.order:
        number = on.sum(2)
        z = base[:, j, None] + chain.count[j, 0] * number + chain.count[j, 1] * (number == 0) + on @ chain.before[j]
        p = _squash(chain.scale * z + chain.shift)
        off, yes = logp + np.log(1 - p + 1e-12), np.where(number < most, logp + np.log(p + 1e-12), -np.inf)
        every = np.concatenate([off, yes], 1)
        keep = np.argsort(-every, axis=1, kind="stable")[:, :BEAM]
        logp = np.take_along_axis(every, keep, 1)
        on, prob = np.take_along_axis(on, keep[:, :, None] % BEAM, 1), np.take_along_axis(prob, keep[:, :, None] % BEAM, 1)
        on[:, :, j], prob[:, :, j] = keep >= BEAM, np.take_along_axis(p, keep % BEAM, 1)
    some = on.any(2) & np.isfinite(logp)
    best = np.where(some, logp, -np.inf).argmax(1)
    rows = np.arange(n)
    areas, sure = on[rows, best], prob[rows, best]
    none = ~some.any(1)
    first = base[none].argmax(1)
    areas[none] = np.arange(k)[None, :] == first[:, None]
    sure[none] = _squash(chain.scale * base[none] + chain.shift)
    return areas, sure


@dataclass
class Model:
    """What a task needs: bounded by buckets, areas and sources with labels."""

    areas: list[str]
    scaled: np.ndarray  # (BUCKETS, areas)
    sources: dict[str, np.ndarray]
    chain: Chain

    def features(self, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
        lines = find_lines(texts)
        return link_features(evidence(lines, len(texts), self.scaled), lines.structure, odds_of(self.sources, sources, len(self.areas)))


def source_key(s: str | None) -> str | None:
    return re.sub(r"[-_\s]+", "-", s.strip().lower()) if s else None


def _terms_of(labelled: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(row, buckets, counts) of the labelled documents, found on the executors: no text goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_lines(b.column("t").to_pylist())
            terms = [doc_terms(found, d) for d in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([i.astype(np.uint16).tobytes() for i, _ in terms], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in terms], pa.binary())], names=["row", "bucket", "n"])

    rows = labelled.select("row", "t").mapInArrow(run, "row int, bucket binary, n binary").orderBy("row").collect()
    return [(r["row"], np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32)) for r in rows]


def _features_of(labelled: DataFrame, scaled: list[np.ndarray], odds: list[dict[str, np.ndarray]]) -> np.ndarray:
    """(documents, areas, features) of the labelled documents, each under the weights and odds of its own fold."""
    k = scaled[0].shape[1]
    held = labelled.sparkSession.sparkContext.broadcast(([w.astype(np.float16) for w in scaled], odds))  # FOLDS x BUCKETS x areas

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, table = held.value
        weights = [w.astype(np.float32) for w in weights]
        for b in batches:
            texts, sources, fold = b.column("t").to_pylist(), b.column("s").to_pylist(), b.column("fold").to_numpy()
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                x = Model([""] * k, weights[f], table[f], None).features([texts[i] for i in at], [source_key(sources[i]) for i in at])
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at)), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], names=["row", "x"])

    rows = labelled.mapInArrow(run, "row int, x binary").orderBy("row").collect()
    held.destroy()
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), k, -1)


def fit(labelled: DataFrame, idf: np.ndarray) -> Model:
    """The model from (row int, areas array<string>, fold int, s string, t string), rows numbered from 0.

    Terms are cross-fitted: a document's evidence for the chain comes from weights, and its source's odds from labels,
    of the other folds.
    """
    facts = labelled.select("row", "areas", "fold", "s").orderBy("row").collect()  # at most MAX_LABELLED rows
    areas = sorted({a for r in facts for a in r["areas"]})
    y = np.array([[a in r["areas"] for a in areas] for r in facts], float)
    fold, sources = np.array([r["fold"] for r in facts]), [source_key(r["s"]) or "" for r in facts]
    prior = (y.sum(0) + 0.5) / (len(y) + 1)
    rows = [_weighted(i, n, idf) for _, i, n in _terms_of(labelled)]

    def part(at: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        if not len(at):
            return np.zeros((BUCKETS, len(areas)), np.float32), {}
        return (fit_terms([rows[i] for i in at], y[at]) * idf[:, None]).astype(np.float32), source_odds(y[at], [sources[i] for i in at], prior)

    parts = [part(np.flatnonzero(fold != f)) for f in range(FOLDS)]
    chain = fit_chain(_features_of(labelled, [w for w, _ in parts], [o for _, o in parts]), y, fold)
    scaled, odds = part(np.arange(len(y)))
    return Model(areas, scaled, odds, chain)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", area: str = "subject_area", max_labelled: int = MAX_LABELLED, most: int = 2) -> DataFrame:
    """(doc_id, subject_area, probability): one to ``most`` areas for every document.

    Terms are weighed by their frequency in all documents. The classifier is fitted on the labelled documents (at
    most ``max_labelled``, a documented bound on a fitting sample); their texts are read on the executors, the driver
    gets their terms and features. Every document, labelled or not, is then read in full and decoded. Areas are those
    that occur in ``labels``. Labels whose document is missing are not used; a document with contradicting labels
    teaches all of them. A text without words gets the commonest area. Null ids are kept. Raises ValueError where
    there are no usable labels; an empty ``docs`` has none.
    """
    named = labels.filter(F.col(area).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(area).alias("_area")).distinct()
    per_doc = named.groupBy("_id").agg(F.sort_array(F.collect_set("_area")).alias("areas"))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"), F.col(source).alias("s"))
    # ids first: only the sample's texts are moved
    few = per_doc.join(texts.select("_id"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    number = F.row_number().over(Window.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("t"))) - 1  # at most max_labelled rows
    sample = F.broadcast(few).join(texts, "_id").withColumn("row", number).filter(F.col("row") < max_labelled)
    labelled = cut(sample.select(F.col("row").cast("int").alias("row"), "areas", F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(FOLDS)).cast("int").alias("fold"), "s", "t"), "p9-labelled")
    if labelled.isEmpty():
        raise ValueError("no labelled documents")
    df, total = document_frequencies(docs, text)
    # no term is cut off, however common: a text that fills a third of all rows would lose every word
    idf = np.where(df > 0, np.log((total + 1) / (1 + df)), 0.0)
    labelled = labelled.repartition(parallelism(docs.sparkSession), "row")
    model = fit(labelled, idf)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x areas floats and a table by labelled source
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array(model.areas, object)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                texts = b.column("_text").to_pylist()
                areas, sure = decode(model.chain, model.features(texts, [source_key(s) for s in b.column("_source").to_pylist()]), most)
                bare = np.array([not t or not any(c.isalpha() for c in t[:200]) and not any(c.isalpha() for c in t) for t in texts], bool)
                areas[bare], sure[bare] = np.arange(len(names)) == model.chain.order[0], 0.0
                at, which = np.nonzero(areas)
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at)), pa.array(names[which], pa.string()), pa.array(np.round(sure[at, which].astype(np.float64), 6))], names=["_id", "subject_area", "probability"])

    rows_in = spread(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(source).alias("_source")))
    return rows_in.mapInArrow(run, f"_id {kind}, subject_area string, probability double").withColumnRenamed("_id", doc_id)
