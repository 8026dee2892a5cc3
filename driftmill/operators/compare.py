"""Differences between two copies of a table, by shared key ordinals and compressed presence bitmaps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftmill.runtime import bounded_broadcast, cut

#: Ordinals of one bitmap container, and members up to which a list is smaller than its bits.
CONTAINER = 1 << 16
SPARSE = CONTAINER // 16
#: Keys of differing rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Outer blanks: what Unicode calls white space. Fixed values.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"


@dataclass
class Bitmap:
    """The ordinals of one container that a side holds, as runs, as a sorted list or as bits, whichever is smallest."""

    kind: str
    data: np.ndarray

    @classmethod
    def of(cls, members: np.ndarray) -> Bitmap:
        """``members``: sorted ordinals below CONTAINER, each once."""
        first = np.flatnonzero(np.diff(members, prepend=-2) != 1)
        if len(members) and 2 * len(first) <= min(len(members), SPARSE):
            last = np.append(first[1:], len(members)) - 1
            return cls("runs", np.stack([members[first], members[last]]).astype(np.uint16))
        if len(members) <= SPARSE:
            return cls("list", members.astype(np.uint16))
        return cls("bits", np.packbits(np.isin(np.arange(CONTAINER), members, assume_unique=True), bitorder="little"))

    def bits(self) -> np.ndarray:
        if self.kind == "bits":
            return self.data
        on = np.zeros(CONTAINER, bool)
        if self.kind == "list":
            on[self.data] = True
        else:
            step = np.zeros(CONTAINER + 1, np.int32)
            step[self.data[0]] += 1
            np.add.at(step, self.data[1].astype(np.int64) + 1, -1)
            on = np.cumsum(step[:-1]) > 0
        return np.packbits(on, bitorder="little")

    def minus(self, other: Bitmap) -> np.ndarray:
        """AND-NOT: the ordinals here that ``other`` lacks."""
        if self.kind == other.kind and np.array_equal(self.data, other.data):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.unpackbits(self.bits() & ~other.bits(), bitorder="little"))

    def both(self, other: Bitmap) -> np.ndarray:
        """AND: the ordinals of both."""
        return np.flatnonzero(np.unpackbits(self.bits() & other.bits(), bitorder="little"))


def _folded(col: Column, kind: T.DataType) -> Column:
    """What is compared: text without letter case and outer blanks; nested values as they are."""
    return F.lower(F.btrim(col, F.lit(BLANKS))) if isinstance(kind, T.StringType) else col


def _digests(fields: list[T.StructField]) -> list[Column]:
    """Two 64-bit hashes of the folded fields. They may tell equal values apart (what they part is compared again),
    never the reverse but by chance; a null is told from any value."""
    parts: list[Column] = []
    for f in fields:
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType))
        parts += [F.col(f.name).isNull(), F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) if nested else _folded(F.col(f.name), f.dataType)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"d{seed}") for seed in (1, 2)]


def _aligned(left: DataFrame, right: DataFrame, key: str, version: str | None, fields: list[str]) -> tuple[DataFrame, DataFrame, list[T.StructField]]:
    """Both sides as (_key, _version, f0, f1, ...) in the types Spark's union finds for them."""
    names = ["_key", *(["_version"] if version else []), *(f"f{i}" for i in range(len(fields)))]
    sides = [df.select(key, *([version] if version else []), *fields).toDF(*names) for df in (left, right)]
    wide = sides[0].limit(0).union(sides[1].limit(0)).schema
    a, b = (s.select(*[F.col(f.name).cast(f.dataType) for f in wide]) for s in sides)
    return a, b, [f for f in wide if f.name.startswith("f")]


def _slim(side: DataFrame, fields: list[T.StructField], right: bool) -> DataFrame:
    """(_key, right, d1, d2, unsure): digests of the current row of each key. ``unsure`` where rows of the greatest
    version disagree."""
    at = ["_version"] if "_version" in side.columns else []
    slim = side.select("_key", *at, *_digests(fields))
    current = slim.groupBy("_key").agg(F.max(F.struct(*at, "d1", "d2")).alias("hi"), F.max(F.struct(*at, F.bitwise_not("d1").alias("d"))).alias("lo"))
    return current.select("_key", F.lit(right).alias("right"), "hi.d1", "hi.d2", (F.col("hi.d1") != F.bitwise_not("lo.d")).alias("unsure"))


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a key begins."""
    return rows.column("place").to_numpy() == 1


def diff_tables(
    left: DataFrame,
    right: DataFrame,
    key: str,
    version: str | None = None,
    fields: list[str] | None = None,
    missing_in_left: str = "missing_in_left",
    missing_in_right: str = "missing_in_right",
) -> DataFrame:
    """(key, field_name): rows that one side lacks, and the fields that differ where both sides have the row.

    Each side is reduced on the map side to the digests of its current rows (the greatest ``version``; among equal
    versions the greatest content), so a key with a third of all rows costs no more than any other and whole rows
    are not shuffled. The keys of both sides, sorted together in hash partitions, are the shared dictionary: a key's
    ordinal is its partition and its place in it. Each side has a compressed presence bitmap for every container of
    65,536 ordinals; AND-NOT gives the rows the other side lacks, AND the ordinals at which the two columns of
    digests are compared. Only rows whose digests differ are read again and compared field by field.

    Nulls: a null key is a key like any other; a null field equals only null. NaN equals NaN, negative zero zero. Text
    is compared without letter case and outer blanks. Repeated rows count once. Columns that only one side has are not
    compared. Empty tables give every row of the other side as missing. Fields must be of types Spark can order.
    """
    fields = fields or [c for c in left.columns if c not in (key, version) and c in right.columns]
    a, b, kinds = _aligned(left, right, key, version, fields)
    kind = a.schema["_key"].dataType
    sides = _slim(a, kinds, False).unionByName(_slim(b, kinds, True))
    # a window, unlike repartition, demands that a key's rows share a task: Spark keeps the union's two shuffles where both
    # are by key, and the adaptive plan then cuts them apart each in its own way unless an operator needs the key whole
    dictionary = sides.withColumn("place", F.row_number().over(Window.partitionBy("_key").orderBy("right")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > 2 * CONTAINER:  # two rows at most have one key: a container is full
                whole = pa.Table.from_batches(held).combine_chunks()
                done = int(np.flatnonzero(_starts(whole))[CONTAINER])
                yield container(whole.slice(0, done))
                held, size = whole.slice(done).to_batches(), whole.num_rows - done
        if size:
            whole = pa.Table.from_batches(held).combine_chunks()
            first = np.flatnonzero(_starts(whole))[::CONTAINER]
            for lo, hi in zip(first, [*first[1:], whole.num_rows]):
                yield container(whole.slice(int(lo), int(hi - lo)))

    def container(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("_key").combine_chunks()
        starts = _starts(rows)
        ordinal, names = np.cumsum(starts) - 1, keys.take(pa.array(np.flatnonzero(starts)))
        on_right = rows.column("right").to_numpy()
        here = [np.flatnonzero(~on_right), np.flatnonzero(on_right)]
        l, r = (Bitmap.of(ordinal[at]) for at in here)  # noqa: E741
        common = l.both(r)
        at_l, at_r = (at[np.searchsorted(ordinal[at], common)] for at in here)
        d1, d2, unsure = (rows.column(c).to_numpy() for c in ("d1", "d2", "unsure"))
        apart = (d1[at_l] != d1[at_r]) | (d2[at_l] != d2[at_r]) | unsure[at_l] | unsure[at_r]
        found = [(r.minus(l), missing_in_left), (l.minus(r), missing_in_right), (common[apart], None)]
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(np.concatenate([o for o, _ in found]))), pa.array([n for o, n in found for _ in o], pa.string())], names=["_key", "field_name"]
        )

    out = T.StructType([T.StructField("_key", kind), T.StructField("field_name", T.StringType())])
    known = cut(dictionary.mapInArrow(scan, out), "p5-known")
    named = known.filter("field_name is not null")
    few = bounded_broadcast(known.filter("field_name is null").select(F.col("_key").alias("_at")), BROADCAST_ROWS)

    def current(side: DataFrame, name: str) -> DataFrame:
        rows = side.join(few, side["_key"].eqNullSafe(few["_at"]), "left_semi")
        return rows.groupBy("_key").agg(F.max(F.struct(*[c for c in rows.columns if c != "_key"])).alias(name)).withColumnRenamed("_key", f"_key{name}")

    x, y = current(a, "_l"), current(b, "_r")
    differs = [F.when(~_folded(F.col(f"_l.{f.name}"), f.dataType).eqNullSafe(_folded(F.col(f"_r.{f.name}"), f.dataType)), F.lit(name)) for f, name in zip(kinds, fields)]
    pairs = x.join(y, x["_key_l"].eqNullSafe(y["_key_r"]))
    compared = pairs.select(F.col("_key_l").alias("_key"), F.explode(F.array_compact(F.array(*differs or [F.lit(None).cast("string")]))).alias("field_name"))
    return named.unionByName(compared).withColumnRenamed("_key", key)


def diff_summary(diff: DataFrame) -> DataFrame:
    """Rows per kind of difference."""
    return diff.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_rows"))
