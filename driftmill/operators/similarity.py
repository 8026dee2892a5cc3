"""Nearest feature rows by the number of places that differ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.functions.signatures import signature_key, structural
from driftmill.runtime import Cut, cut, spread

#: Query signatures sent to the tasks at once: 20,000 rows of 49 doubles are 8 MB whatever the data's size.
BLOCK = 20_000
KINDS = ("held-out-policy", "held-out-mutation", "held-out-mutation-variant")


def signatures(df: DataFrame, id_col: str, features: str, *keep: str) -> DataFrame:
    """(id, keep, key, sig): structural signatures of full rows."""
    return df.select(id_col, *keep, structural(F.col(features)).alias("sig")).filter("sig is not null").withColumn("key", signature_key(F.col("sig")))


class Places:
    """Query rows as ones at (place, value), so the places two rows agree in are one product of matrices. Exact: the
    products are whole numbers no greater than the number of places."""

    def __init__(self, q: np.ndarray):
        self.width = q.shape[1]
        self.values = [np.unique(q[:, p]) for p in range(self.width)]
        self.start = np.concatenate([[0], np.cumsum([len(v) for v in self.values])])
        self.q = self.ones(q)

    def ones(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.start[-1]), np.float32)
        for p, known in enumerate(self.values):  # a value no query has agrees with none
            at = np.minimum(np.searchsorted(known, x[:, p]), len(known) - 1)
            hit = known[at] == x[:, p]
            out[np.flatnonzero(hit), self.start[p] + at[hit]] = 1
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(queries, rows): the places in which they differ."""
        return self.width - (self.q @ self.ones(x).T).astype(np.int16)


def _smallest_first(x: np.ndarray) -> np.ndarray:
    """The order of rows by their values, place by place."""
    return np.lexsort(x.T[::-1])


class Best:
    """The nearest row seen for each question, the smaller row among equals."""

    def __init__(self, n: int, width: int):
        self.least, self.rows = np.full(n, width + 1, np.int32), np.full((n, width), np.inf)

    def offer(self, d: np.ndarray, pick: np.ndarray, rows: np.ndarray) -> None:
        """``d`` and ``pick``: of each question the distance to, and the place of, its nearest among ``rows``."""
        nearer = d < self.least
        tied = np.flatnonzero((d == self.least) & (d <= rows.shape[1]))
        if len(tied):
            a, b = rows[pick[tied]], self.rows[tied]
            first = (a != b).argmax(1)
            i = np.arange(len(tied))
            nearer[tied] = a[i, first] < b[i, first]
        self.least[nearer], self.rows[nearer] = d[nearer], rows[pick[nearer]]

    def found(self) -> np.ndarray:
        return np.flatnonzero(self.least <= self.rows.shape[1])


def _closest(places: Places, x: np.ndarray) -> np.ndarray:
    """Of each query the nearest row of ``x`` as distance << 32 | place: the least is the nearest, then the first."""
    best = np.full(len(places.q), (places.width + 1) << 32, np.int64)
    for lo in range(0, len(x), CHUNK):
        d = places.distances(x[lo : lo + CHUNK])
        at = d.argmin(1)
        best = np.minimum(best, (d[np.arange(len(d)), at].astype(np.int64) << 32) | (lo + at))
    return best


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


#: Base rows that are compared at once with a block of queries, and cells of the ones of a block at most.
CHUNK, CELLS = 512, 1 << 27


def _blocks(asked: DataFrame) -> Iterator[list]:
    """The rows of ``asked`` in blocks of about BLOCK rows, by a hash of their key."""
    blocks = max(1, -(-asked.count() // BLOCK))
    for i in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).collect()
        while part:  # many different values make wide ones: such a block is compared in pieces
            q = np.array([r["sig"] for r in part], np.float64)
            wide = sum(len(np.unique(q[:, p])) for p in range(q.shape[1]))
            take = len(part) if wide * len(part) <= CELLS else max(1, min(len(part) // 2, 4096))
            yield part[:take]
            part = part[take:]


def nearest_allowed(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(key, protocol, distance, nearest_key, nearest_sig) for every distinct (key, protocol) of ``queries``: ``nearest``
    among the base signatures whose ``barred`` does not hold the protocol. base: sig, barred (array of protocols), each
    signature once. Pairs without an allowed signature are missing.

    Distances are taken once for each distinct signature, whatever the number of its protocols.
    """
    spark = queries.sparkSession
    held_q, held_b = Cut(queries.groupBy("key").agg(F.first("sig").alias("sig"), F.collect_set("protocol").alias("protocols")), "allowed-q"), Cut(spread(base.select("sig", "barred")), "allowed-b")
    asked, known = held_q.df, held_b.df
    best = None
    for part in _blocks(asked):
        names = sorted({p for r in part for p in r["protocols"]})
        pairs = [(j, p) for j, r in enumerate(part) for p in r["protocols"]]
        held = spark.sparkContext.broadcast((np.array([r["sig"] for r in part], np.float64), [r["key"] for r in part], names, np.array([j for j, _ in pairs]), np.array([names.index(p) for _, p in pairs])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, keys, names, of, protocol = held.value
            places, best = Places(q), Best(len(of), q.shape[1])
            number = {p: i for i, p in enumerate(names)}
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.asarray(b.column("sig").flatten(), np.float64).reshape(b.num_rows, -1)
                order = _smallest_first(x)
                x, barred_of = x[order], b.column("barred").take(pa.array(order)).to_pylist()
                bars = np.zeros((len(x), len(names)), bool)
                for i, barred in enumerate(barred_of):
                    bars[i, [number[p] for p in barred if p in number]] = True
                none = (q.shape[1] + 1) << 32
                here = np.full(len(of), none, np.int64)
                for lo in range(0, len(x), CHUNK):
                    d, bar = places.distances(x[lo : lo + CHUNK]), bars[lo : lo + CHUNK]
                    at = d.argmin(1)
                    near = ((d[np.arange(len(d)), at].astype(np.int64) << 32) | (lo + at))[of]
                    barred = bar[at[of], protocol]  # where the nearest of all is barred, the others are looked at again
                    near[barred] = none
                    for p in np.unique(protocol[barred]):
                        ask, rows = np.flatnonzero(barred & (protocol == p)), np.flatnonzero(~bar[:, p])
                        if len(rows):
                            some = d[of[ask]][:, rows]
                            first = some.argmin(1)
                            near[ask] = (some[np.arange(len(ask)), first].astype(np.int64) << 32) | (lo + rows[first])
                    here = np.minimum(here, near)
                best.offer((here >> 32).astype(np.int32), here & 0xFFFFFFFF, x)
            hit = best.found()
            yield pa.RecordBatch.from_arrays([pa.array([keys[of[j]] for j in hit], pa.string()), pa.array([names[protocol[j]] for j in hit], pa.string()), pa.array(best.least[hit]), _lists(best.rows[hit])], names=["key", "protocol", "distance", "nearest_sig"])

        found = known.mapInArrow(run, "key string, protocol string, distance int, nearest_sig array<double>").groupBy("key", "protocol").agg(F.min(F.struct("distance", "nearest_sig")).alias("x"))
        found = cut(found.select("key", "protocol", "x.distance", "x.nearest_sig"), "allowed-part")
        best = found if best is None else best.unionByName(found)
    held_q.drop()
    held_b.drop()
    if best is None:
        best = spark.createDataFrame([], "key string, protocol string, distance int, nearest_sig array<double>")
    return best.withColumn("nearest_key", signature_key(F.col("nearest_sig")))


def nearest(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(key, distance, nearest_key, nearest_sig) for every distinct signature of ``queries``: the least number of
    differing places to any signature of ``base``; among equals the signature that is smaller, place by place.

    Queries go to the tasks in blocks of bounded size, and every task compares them with its own part of the distinct
    base signatures; only each task's best is merged. An empty side gives an empty result.
    """
    spark = queries.sparkSession
    held_q, held_b = Cut(queries.select("key", "sig").groupBy("key").agg(F.first("sig").alias("sig")), "nearest-q"), Cut(spread(base.select("sig").distinct()), "nearest-b")
    asked, known = held_q.df, held_b.df
    best = None
    for part in _blocks(asked):
        keys = [r["key"] for r in part]
        matrix = spark.sparkContext.broadcast(np.array([r["sig"] for r in part], np.float64))

        def run(batches: Iterator[pa.RecordBatch], matrix=matrix, keys=keys) -> Iterator[pa.RecordBatch]:
            q = matrix.value
            places, best = Places(q), Best(len(q), q.shape[1])
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.asarray(b.column("sig").flatten(), np.float64).reshape(b.num_rows, -1)
                x = x[_smallest_first(x)]
                here = _closest(places, x)
                best.offer((here >> 32).astype(np.int32), here & 0xFFFFFFFF, x)
            hit = best.found()
            yield pa.RecordBatch.from_arrays([pa.array([keys[j] for j in hit], pa.string()), pa.array(best.least[hit]), _lists(best.rows[hit])], names=["key", "distance", "nearest_sig"])

        found = known.mapInArrow(run, "key string, distance int, nearest_sig array<double>").groupBy("key").agg(F.min(F.struct("distance", "nearest_sig")).alias("x"))
        found = cut(found.select("key", "x.distance", "x.nearest_sig"), "nearest-part")
        best = found if best is None else best.unionByName(found)
    held_q.drop()
    held_b.drop()
    if best is None:
        best = spark.createDataFrame([], "key string, distance int, nearest_sig array<double>")
    return best.withColumn("nearest_key", signature_key(F.col("nearest_sig")))


def nearest_listing(queries: DataFrame, base: DataFrame, query_id: str, base_id: str, limit: int) -> DataFrame:
    """(query_id, base_id, distance): all base rows with the nearest signature, the first ``limit`` ids of each query."""
    n = nearest(queries, base)
    asked = queries.select(F.col(query_id).alias("query_id"), "key").join(n, "key")
    rows = asked.join(base.select(F.col(base_id).alias("base_id"), F.col("key").alias("nearest_key")), "nearest_key")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("base_id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= limit).select("query_id", "base_id", "distance")


def distance_histogram(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(distance, n_records, n_families) over the query rows (with family_id)."""
    n = nearest(queries, base).select("key", "distance")
    return queries.join(n, "key").groupBy("distance").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("family_id").alias("n_families"))


def near_duplicate_audit(records: DataFrame, max_samples: int) -> tuple[DataFrame, DataFrame]:
    """(summary, samples) of challenge against standard records. records: record_id, family_id, role, features.

    summary: one row of counts. samples: the first ``max_samples`` challenge records, exact matches first, then by
    distance and id.
    """
    full = signature_key(F.transform("features", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    sig = cut(signatures(records.withColumn("full_key", full), "record_id", "features", "family_id", "role", "full_key"), "audit")
    ch, st = sig.filter("role = 'challenge'"), sig.filter("role = 'standard'")
    near = nearest(ch, st).select("key", "distance", "nearest_key")
    same_full = st.select("full_key").distinct().withColumn("exact_full", F.lit(True))
    first = st.groupBy(F.col("key").alias("nearest_key")).agg(F.min(F.struct("record_id", "family_id")).alias("near"))
    rows = ch.join(near, "key").join(same_full, "full_key", "left").join(first, "nearest_key").select(
        F.col("record_id").alias("challenge_record_id"), F.col("family_id").alias("challenge_family_id"), F.col("near.record_id").alias("training_record_id"), F.col("near.family_id").alias("training_family_id"),
        F.coalesce("exact_full", F.lit(False)).alias("exact_model_feature_match"), (F.col("distance") == 0).alias("exact_policy_free_structural_match"), F.col("distance").alias("structural_coordinate_distance"),
    )
    rows = cut(rows, "audit-rows")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    summary = rows.agg(
        F.count(F.lit(1)).alias("n_challenge"), one(F.col("exact_model_feature_match")).alias("n_full_match"), one(F.col("exact_policy_free_structural_match")).alias("n_structural_match"), one(F.col("structural_coordinate_distance") <= 1).alias("n_within_one"),
        F.countDistinct(F.when(F.col("exact_policy_free_structural_match"), F.col("challenge_family_id"))).alias("n_structural_families"),
    )
    order = [F.desc("exact_model_feature_match"), F.desc("exact_policy_free_structural_match"), "structural_coordinate_distance", "challenge_record_id", "training_record_id"]
    return summary, rows.orderBy(*order).limit(max_samples)


def _kept(rows: DataFrame, key: str) -> DataFrame:
    """(key, have): for each kind of protocol and each protocol of the kind ('' for none) the first record of the key;
    bounded by the policies, changes and variants of a key."""
    own = F.transform(F.array(*[F.lit(k) for k in KINDS]), lambda k: F.struct(k.alias("kind"), F.coalesce(F.get(F.filter("own", lambda p: F.substring_index(p, ":", 1) == k), F.lit(0)), F.lit("")).alias("protocol")))
    firsts = rows.select(key, "record_id", "family_id", F.explode(own).alias("o")).groupBy(key, "o").agg(F.min(F.struct("record_id", "family_id")).alias("near"))
    return firsts.groupBy(key).agg(F.collect_list(F.struct("o.kind", "o.protocol", "near")).alias("have"))


def _first(have: str) -> Column:
    """The first record that ``protocol`` keeps, null where it keeps none."""
    kind = F.substring_index("protocol", ":", 1)
    return F.array_min(F.transform(F.filter(have, lambda h: (h["kind"] == kind) & (h["protocol"] != F.col("protocol"))), lambda h: h["near"]))


def protocol_audit(records: DataFrame, max_samples: int) -> tuple[DataFrame, DataFrame]:
    """(summary, samples) for each policy, change and variant held out: its challenge records against the standard records
    it keeps for training. records: record_id, family_id, role, features, own (the protocols that hold a record out), and
    pair_fingerprint.

    summary: a row for each protocol with challenge records and training. samples: up to ``max_samples`` of each protocol,
    exact matches first, then by distance and id; the training record is the first with the same features, else the first
    with the nearest structural signature.
    """
    full = signature_key(F.transform("features", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    sig = cut(signatures(records.withColumn("full_key", full), "record_id", "features", "family_id", "role", "full_key", "own", "pair_fingerprint"), "audit")
    st = sig.filter("role = 'standard'")
    ch = sig.filter("role = 'challenge'").withColumn("protocol", F.explode("own")).drop("own")
    by_key = cut(_kept(st, "key").withColumnRenamed("key", "nearest_key"), "audit-keys")
    by_full = _kept(st, "full_key").withColumnRenamed("have", "have_full")
    alone = lambda h: (h["protocol"] != "") & (F.size(F.filter("have", lambda o: o["kind"] == h["kind"])) == 1)
    barred = by_key.select(F.col("nearest_key").alias("key"), F.transform(F.filter("have", alone), lambda h: h["protocol"]).alias("barred"))
    base = st.groupBy("key").agg(F.first("sig").alias("sig")).join(barred, "key")
    near = nearest_allowed(ch.select("key", "sig", "protocol"), base).select("key", "protocol", "distance", "nearest_key")
    rows = ch.join(near, ["key", "protocol"]).join(by_full, "full_key", "left").join(by_key, "nearest_key").withColumn("same", _first("have_full")).withColumn("near", F.coalesce("same", _first("have")))
    rows = rows.select(
        "protocol", F.col("record_id").alias("challenge_record_id"), F.col("family_id").alias("challenge_family_id"), F.col("near.record_id").alias("training_record_id"), F.col("near.family_id").alias("training_family_id"),
        F.col("same").isNotNull().alias("exact_model_feature_match"), (F.col("distance") == 0).alias("exact_policy_free_structural_match"), F.col("distance").alias("structural_coordinate_distance"),
    )
    rows = cut(rows, "audit-rows")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    match, form = F.col("exact_model_feature_match"), F.col("exact_policy_free_structural_match")
    summary = rows.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n_challenge"), one(match).alias("n_full_match"), F.countDistinct(F.when(match, F.col("challenge_family_id"))).alias("n_full_families"),
        one(form).alias("n_structural_match"), F.countDistinct(F.when(form, F.col("challenge_family_id"))).alias("n_structural_families"), one(F.col("structural_coordinate_distance") <= 1).alias("n_within_one"),
    )
    held = st.select(F.explode("own").alias("protocol")).groupBy("protocol").count()
    summary = summary.join(held, "protocol", "left").crossJoin(st.agg(F.count(F.lit(1)).alias("n"))).withColumn("n_training", F.col("n") - F.coalesce("count", F.lit(0))).drop("n", "count")
    for name in ("family_id", "pair_fingerprint"):  # does a value of the challenge stand in the training kept?
        values = _kept(st.filter(F.col(name).isNotNull() & (F.col(name) != "")).withColumn("value", F.col(name)), "value")
        leaks = ch.select("protocol", F.col(name).alias("value")).distinct().join(values, "value").filter(_first("have").isNotNull()).select("protocol", F.lit(True).alias(f"{name}_leakage")).distinct()
        summary = summary.join(leaks, "protocol", "left").withColumn(f"{name}_leakage", F.coalesce(f"{name}_leakage", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("protocol").orderBy(F.desc("exact_model_feature_match"), F.desc("exact_policy_free_structural_match"), "structural_coordinate_distance", "challenge_record_id", "training_record_id"))
    return summary, rows.withColumn("_r", rank).filter(F.col("_r") <= max_samples).drop("_r")
