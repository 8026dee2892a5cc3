"""Same or near-same records across splits, by content-defined chunks of the normalised records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmill.operators.skew import lookup
from driftmill.runtime import bounded_broadcast, cut, spread

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Feature places that hold policy slots, and the width of a full feature row. Fixed values.
POLICY_SLOTS = (*range(24, 48), *range(59, 62))
WIDTH = 76
#: Record numbers or class keys that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
PLACES = tuple(i for i in range(WIDTH) if i not in POLICY_SLOTS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk(symbols: np.ndarray, lengths: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, digest, length) of the content-defined chunks of consecutive segments of 64-bit symbols.

    A rolling hash of the last ``window`` symbols is taken at each place. A chunk ends at each place whose hash is
    greater than those of the ``reach`` places before and behind it, so whether it ends there depends on nothing
    further away than window + reach, and no chunk but a segment's last is shorter than reach + 1. Digests are
    polynomial hashes of the chunk's symbols and do not depend on where the chunk stands.
    """
    n, m = len(symbols), len(lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if m else np.zeros(0, np.int64)
    seg = np.repeat(np.arange(m), lengths)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(n) - starts[seg]
    s = mix(symbols.astype(np.uint64) + np.uint64(1))
    rolling = s.copy()
    for d in range(1, window):
        power = np.uint64(pow(int(BASE), d, 1 << 64))
        rolling[d:] += np.where(place[d:] >= d, s[:-d] * power, np.uint64(0))
    rolling = mix(rolling)
    ends = np.ones(n, bool)
    for d in range(1, reach + 1):
        same = seg[d:] == seg[:-d]
        ends[d:] &= ~same | (rolling[d:] > rolling[:-d])
        ends[:-d] &= same & (rolling[:-d] > rolling[d:])  # a place nearer than reach to its segment's end ends nothing
        ends[n - d:] = False
    last = starts[lengths > 0] + lengths[lengths > 0] - 1
    ends[last] = True
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE, np.uint64)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(s * powers, dtype=np.uint64)])
    stop = np.flatnonzero(ends)
    begin = np.concatenate([[0], stop[:-1] + 1])
    size = stop - begin + 1
    digest = mix((total[stop + 1] - total[begin]) * inverse[begin] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return seg[stop], digest.view(np.int64), size


def fingerprint_key(col: Column) -> Column:
    """Letter case, blanks and an algorithm prefix do not tell fingerprints apart; an empty one is none."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col), r"\s+", ""), r"^[a-z][a-z0-9_-]*[:=]", "")
    return F.when(bare != "", bare)


def role_key(col: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), F.lit("standard"))


def _chunked(df: DataFrame, id_col: str, kind: str, window: int, reach: int, segments: int) -> DataFrame:
    """(id, chunks array<struct<digest, size>>, spread): spread is the most chunks that one segment has."""
    out = f"{id_col} {df.schema[id_col].dataType.simpleString()}, chunks array<struct<digest:bigint,size:bigint>>, widest int"
    named = pa.struct([("digest", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            if kind == "text":
                texts = [(t or "").encode() for t in b.column("content").to_pylist()]
                lengths = np.array([len(t) for t in texts])
                symbols, per = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), 1
            else:
                col = b.column("content")
                flat = np.asarray(col.flatten(), np.float64) + 0.0  # no negative zero
                width = len(flat) // rows
                matrix = flat.view(np.uint64).reshape(rows, width)
                key = b.column("salt").to_numpy(zero_copy_only=False).view(np.uint64)
                symbols = mix(matrix ^ mix(np.arange(width, dtype=np.uint64) + np.uint64(7))[None, :]) ^ key[:, None]
                bounds = np.linspace(0, width, segments + 1).astype(int)
                lengths, per, symbols = np.tile(np.diff(bounds), rows), segments, symbols.ravel()
            seg, digest, size = chunk(symbols, lengths, window, reach)
            row = seg // per
            count = np.bincount(row, minlength=rows)
            widest = np.zeros(rows, np.int32)
            if len(seg):
                np.maximum.at(widest, row, np.bincount(seg, minlength=rows * per)[seg].astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            chunks = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(digest), pa.array(size.astype(np.int64))], fields=list(named)))
            yield pa.RecordBatch.from_arrays([b.column(id_col), chunks, pa.array(widest)], names=[id_col, "chunks", "widest"])

    return df.mapInArrow(run, out)


def text_chunks(df: DataFrame, id_col: str, text: Column, window: int = 8, reach: int = 7) -> DataFrame:
    """Chunks of the whole text's bytes. Null and empty texts have none."""
    return _chunked(spread(df.select(id_col, text.alias("content"))), id_col, "text", window, reach, 1)


def vector_chunks(df: DataFrame, id_col: str, values: Column, salt: Column, window: int = 2, reach: int = 4, segments: int = 3) -> DataFrame:
    """Chunks of equally long value rows. Symbols carry their place and ``salt``; rows are cut in fixed segments
    first, so a value that differs can change the chunks of no segment but its own."""
    return _chunked(spread(df.select(id_col, values.alias("content"), salt.alias("salt"))), id_col, "vector", window, reach, segments)


def sharing_pairs(listed: DataFrame, id_col: str = "id") -> DataFrame:
    """(left_id, right_id, overlap): rows of both sides that can share all but ``tolerance`` of their chunks.

    listed: id, chunks, is_left, is_right, tolerance. Two such rows share one among the tolerance + 1 chunks that are
    rarest in the whole table (any order would do; the rarest keep frequent chunks, and with them quadratic groups, out
    of the join). A chunk the other side lacks counts against the tolerance before anything is joined, so rows with too
    many of them go no further. ``overlap`` is the shared chunks' length over the left row's length. A row that stands
    on both sides is paired with itself.
    """
    length = F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["size"])
    each = listed.select(F.col(id_col).alias("id"), "is_left", "is_right", "tolerance", F.size("chunks").alias("k"), length.alias("length"), F.explode("chunks").alias("c")).select("id", "is_left", "is_right", "tolerance", "k", "length", "c.digest", "c.size")
    seen = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("is_left").alias("l"), F.max("is_right").alias("r")).filter("l and r").select("digest", "n")
    met = lookup(each, seen, ["digest"], "inner").groupBy("id", "is_left", "is_right", "tolerance", "k", "length").agg(F.array_sort(F.collect_list(F.struct("n", "digest", "size"))).alias("all"))
    met = met.withColumn("spare", F.col("tolerance") - (F.col("k") - F.size("all"))).filter("spare >= 0")
    met = cut(met.select("id", "is_left", "is_right", "spare", "length", "all"), "p3-met")
    rare = met.select("id", "is_left", "is_right", F.explode(F.slice("all", 1, F.col("spare") + 1)).alias("c")).select("id", "is_left", "is_right", "c.digest")
    a = rare.filter("is_left").select("digest", F.col("id").alias("left_id"))
    b = rare.filter("is_right").select("digest", F.col("id").alias("right_id"))
    pairs = cut(a.join(b, "digest").select("left_id", "right_id").distinct(), "p3-pairs")
    held = met.select("id", "length", F.explode("all").alias("c")).select("id", "length", "c.digest", "c.size")
    left = held.select(F.col("id").alias("left_id"), "length", "digest", "size")
    right = held.select(F.col("id").alias("right_id"), "digest").distinct()
    shared = pairs.join(left, "left_id").join(right, ["right_id", "digest"])
    return shared.groupBy("left_id", "right_id").agg(F.round(F.sum("size") / F.max("length"), 6).alias("overlap"))


def overlap_fractions(chunked: DataFrame, id_col: str, evaluation: Column, training: Column) -> DataFrame:
    """(id, n_chars, overlap): the share of each evaluation row's length in chunks that occur in training rows."""
    listed = chunked.select(id_col, "chunks", evaluation.alias("is_eval"), training.alias("is_train"))
    each = listed.select(id_col, "is_eval", "is_train", F.explode_outer("chunks").alias("c")).select(id_col, "is_eval", "is_train", "c.digest", "c.size")
    known = each.filter("is_train").select("digest").distinct().withColumn("known", F.lit(1))
    hit = lookup(each.filter("is_eval"), known, ["digest"])
    total = F.coalesce(F.sum("size"), F.lit(0))
    return hit.groupBy(id_col).agg(total.alias("length"), F.round(F.coalesce(F.sum(F.col("size") * F.coalesce("known", F.lit(0))), F.lit(0)) / F.when(total > 0, total), 6).alias("overlap"))


def _classes(chunked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): records with the same chunks are one class, named by its least record number.

    chunked: record_no, is_left, is_right, tolerance, salt, chunks.
    """
    keyed = chunked.withColumn("key", F.xxhash64("salt", F.transform("chunks", lambda c: c["digest"])))
    keyed = cut(keyed.select("record_no", "is_left", "is_right", "tolerance", "chunks", "key"), "p3-keyed")
    classes = keyed.groupBy("key").agg(F.min("record_no").alias("id"), F.max("is_left").alias("is_left"), F.max("is_right").alias("is_right"), F.max("tolerance").alias("tolerance"), F.min("chunks").alias("chunks"))
    return classes, keyed.select("record_no", "is_left", "is_right", "key")


def _member_pairs(chunked: DataFrame, least: float) -> DataFrame:
    """(ch, st, overlap) of the records whose classes share enough chunks."""
    classes, members = _classes(chunked)
    classes = cut(classes, "p3-classes")
    pairs = sharing_pairs(classes.drop("key")).filter(F.col("overlap") >= least)
    # the class of a record is found again by its key: only classes in a pair are looked up
    named = classes.select("key", "id")
    left = pairs.join(named.withColumnRenamed("id", "left_id"), "left_id").withColumnRenamed("key", "lk")
    both = left.join(named.withColumnRenamed("id", "right_id"), "right_id").withColumnRenamed("key", "rk").select("lk", "rk", "overlap")
    both = cut(both, "p3-matched")
    used = bounded_broadcast(both.select(F.explode(F.array("lk", "rk")).alias("key")).distinct(), BROADCAST_ROWS)
    few = cut(members.join(used, "key", "left_semi").distinct(), "p3-members")
    c = few.filter("is_left").select(F.col("key").alias("lk"), F.col("record_no").alias("ch"))
    s = few.filter("is_right").select(F.col("key").alias("rk"), F.col("record_no").alias("st"))
    return both.join(c, "lk").join(s, "rk").filter("ch <> st").select("ch", "st", "overlap")


def _needed(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``df`` whose record_no occurs in ``pairs``."""
    ids = pairs.select(F.explode(F.array("ch", "st")).alias("record_no")).distinct()
    return df.join(bounded_broadcast(ids, BROADCAST_ROWS), "record_no", "left_semi")


def _sided(evidence: DataFrame) -> DataFrame:
    """(record_no, is_left, is_right, fp) of the challenge (left) and standard (right) records."""
    role = role_key(F.col("dataset_role"))
    rows = evidence.filter(F.col("record_no").isNotNull() & role.isin("challenge", "standard"))
    return rows.select("record_no", (role == "challenge").alias("is_left"), (role == "standard").alias("is_right"), fingerprint_key(F.col("pair_fingerprint")).alias("fp"))


def _print_chunks(sided: DataFrame) -> DataFrame:
    prints = sided.filter("fp is not null").withColumn("rec", F.struct("record_no", "is_left", "is_right"))
    return text_chunks(prints, "rec", F.col("fp"), window=8, reach=20).select("rec.*", F.lit(0).alias("tolerance"), F.lit(0).cast("long").alias("salt"), "chunks")


def _structural(prepared: DataFrame) -> DataFrame:
    """(record_no, policy_pack, v): the structural values of full feature rows, without negative zeros."""
    full = prepared.filter((F.size("features") == WIDTH) & F.col("policy_pack").isNotNull() & ~F.exists("features", lambda x: x.isNull()))
    places = F.array(*[F.when(F.col("features")[i] == 0, F.lit(0.0)).otherwise(F.col("features")[i]) for i in PLACES])
    return full.select("record_no", "policy_pack", places.alias("v"))


def _feature_chunks(held: DataFrame, sided: DataFrame) -> DataFrame:
    marked = held.withColumn("salt", F.xxhash64("policy_pack")).withColumn("rec", F.struct("record_no", "salt"))
    cut_up = vector_chunks(marked, "rec", F.col("v"), F.col("salt")).select("rec.*", "chunks", F.col("widest").alias("tolerance"))
    flags = sided.groupBy("record_no").agg(F.max("is_left").alias("is_left"), F.max("is_right").alias("is_right"))
    return cut_up.join(flags, "record_no")


def contract_fractions(evidence: DataFrame, prepared: DataFrame) -> DataFrame:
    """(record_no, print_overlap, feature_overlap) of the challenge records: the share of the length of the fingerprint,
    and of the structural values (under the same policy pack), in chunks that occur in standard records. Null where there
    is nothing to compare; rows repeated under one number count together."""
    sided = _sided(evidence)
    prints = overlap_fractions(cut(_print_chunks(sided), "p3-print-chunks"), "record_no", F.col("is_left"), F.col("is_right"))
    rows = overlap_fractions(cut(_feature_chunks(_structural(prepared), sided), "p3-row-chunks"), "record_no", F.col("is_left"), F.col("is_right"))
    left = sided.filter("is_left").select("record_no").distinct()
    return left.join(prints.select("record_no", F.col("overlap").alias("print_overlap")), "record_no", "left").join(rows.select("record_no", F.col("overlap").alias("feature_overlap")), "record_no", "left")


def contract_overlaps(evidence: DataFrame, prepared: DataFrame) -> DataFrame:
    """(record_no_a, record_no_b, kind, overlap, challenge_no) of challenge and standard records, the same or almost.

    kind ``fingerprint``: equal fingerprints. kind ``features``: same policy pack, full feature rows, structural
    places that differ in at most one. Both come from chunks: of the fingerprint without its spelling, and of the
    structural values. Records are chunked where they are read; records with equal chunks are one class while chunks are
    joined; what is found is then compared in full, on the few records concerned. Null fingerprints match nothing,
    feature rows of another width are no candidates, negative zero is zero, rows repeated under one number count once;
    a null role means standard, other roles take no part.
    """
    sided = _sided(evidence)
    # (i) fingerprints
    chunks = _print_chunks(sided)
    found = cut(_member_pairs(chunks, 1.0), "p3-prints")
    text = cut(_needed(sided.select("record_no", "fp"), found).distinct(), "p3-texts")
    by_print = found.join(text.select(F.col("record_no").alias("ch"), F.col("fp").alias("fl")), "ch").join(text.select(F.col("record_no").alias("st"), F.col("fp").alias("fr")), "st").filter("fl = fr")
    by_print = by_print.select("ch", "st", F.lit("fingerprint").alias("kind"), "overlap")
    # (ii) structural features
    held = _structural(prepared)
    found = cut(_member_pairs(_feature_chunks(held, sided), 0.0), "p3-rows")
    values = cut(_needed(held, found).distinct(), "p3-values")
    near = found.join(values.select(F.col("record_no").alias("ch"), F.col("policy_pack").alias("pl"), F.col("v").alias("vl")), "ch").join(values.select(F.col("record_no").alias("st"), F.col("policy_pack").alias("pr"), F.col("v").alias("vr")), "st")
    apart = F.aggregate(F.zip_with("vl", "vr", lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda a, b: a + b)
    near = near.filter((F.col("pl") == F.col("pr")) & (apart <= 1)).select("ch", "st", F.lit("features").alias("kind"), "overlap")
    return by_print.unionByName(near).distinct().select(F.least("ch", "st").alias("record_no_a"), F.greatest("ch", "st").alias("record_no_b"), "kind", "overlap", F.col("ch").alias("challenge_no"))
