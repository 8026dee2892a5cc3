"""Most similar vectors for every vector: a forest of sorted hash strings, completed by exact comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmill.llm.overlap import mix
from driftmill.operators.skew import lookup
from driftmill.runtime import cut, parallelism, spread

#: The trees carry vectors in half precision; a cosine of two of them is off by less than this.
HALF_ERROR = 2e-3
#: Queries that go against all rows at once; 4096 x 49 floats are 0.8 MB whatever the data's size.
QUERY_BLOCK = 4096
BITS = 62  # of a tree's hash string; it stays a non-negative long
#: Places of a sorted array that are scanned at once.
BLOCK = 8192
#: Vectors of a cell that are held at once; fuller cells are dealt in parts. At most MAX_CELLS pivots go to the tasks.
CELL_ROWS = 2000
MAX_CELLS = 1024


def planes(seed: int, trees: int, dims: int) -> np.ndarray:
    """The hyperplanes of all trees, the same in every task."""
    return np.random.default_rng(seed).standard_normal((trees * BITS, dims))


def matrix(column: pa.Array, places: np.ndarray | None, index: str, value: str) -> np.ndarray:
    """One row per vector, NaN where it has no direction for certain.

    Dense columns are arrays of numbers of one length. Sparse ones are arrays of structs (``index``, ``value``): places
    not listed are 0, of places listed twice the values add up, entries of other places or with a null are left aside.
    """
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if places is None:
        width = int(sizes.max(initial=0))
        if not (sizes == width).all():
            raise ValueError("vectors of different lengths")
        return np.asarray(flat.fill_null(float("nan")), np.float64).reshape(n, width)
    out = np.zeros((n, len(places)))
    at, x = flat.field(index), flat.field(value)
    ok = (at.is_valid().to_numpy(zero_copy_only=False)) & (x.is_valid().to_numpy(zero_copy_only=False)) & (flat.is_valid().to_numpy(zero_copy_only=False))
    i = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    col = np.searchsorted(places, i)
    ok &= places[np.minimum(col, len(places) - 1)] == i
    row = np.repeat(np.arange(n), sizes)
    np.add.at(out, (row[ok], col[ok]), x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)[ok])
    return out


def unit_classes(vectors: DataFrame, id_col: str, vector: str, places: list[int] | None = None, index: str = "coord_index", value: str = "coord_value") -> tuple[DataFrame, DataFrame]:
    """(classes, members): vectors of the same direction are one class, named by its smallest id.

    Members: (id, cls). Null vectors, vectors with a null, NaN or infinite value and zero vectors have no direction.
    An id with repeated rows counts once. With ``places`` the vectors are sparse (see ``matrix``).
    """
    at = None if places is None else np.array(sorted(places), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(vector), at, index, value)
            with np.errstate(all="ignore"):
                big = np.max(np.abs(x), axis=1, initial=0.0)
                scaled = x / big[:, None]  # neither tiny nor huge vectors lose their direction
                u = scaled / np.sqrt((scaled * scaled).sum(1))[:, None]
            ok = np.isfinite(u).all(1) & (big > 0)
            u = np.ascontiguousarray(u[ok].astype(np.float32) + np.float32(0))
            bits = u.view(np.uint32).astype(np.uint64)
            seat = mix(np.arange(1, u.shape[1] + 1, dtype=np.uint64))
            h1, h2 = mix(bits + seat).sum(1, dtype=np.uint64), mix(bits ^ (seat * np.uint64(5))).sum(1, dtype=np.uint64)
            units = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * u.shape[1], pa.int32()), pa.array(u.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(id_col).filter(pa.array(ok)), units, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=[id_col, "unit", "h1", "h2"])

    kind = vectors.schema[id_col].dataType.simpleString()
    usable = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(id_col, vector)
    found = cut(spread(usable).mapInArrow(run, f"{id_col} {kind}, unit array<float>, h1 bigint, h2 bigint"), "p6-found")
    once = found.groupBy(id_col).agg(F.min(F.struct("h1", "h2")).alias("h")).select(id_col, "h.h1", "h.h2")
    firsts = once.groupBy("h1", "h2").agg(F.min(id_col).alias("cls"))
    members = cut(lookup(once, firsts, ["h1", "h2"]).select(id_col, "cls"), "p6-members")
    lead = firsts.select(F.col("cls").alias(id_col), F.col("h1").alias("l1"), F.col("h2").alias("l2"))
    rows = found.join(lead, id_col).filter("h1 = l1 and h2 = l2").select(F.col(id_col).alias("cls"), "unit")
    classes = cut(rows.groupBy("cls").agg(F.first("unit").alias("unit")), "p6-classes")  # repeated rows of a leading id
    return classes, members


def depth_profile(tree: np.ndarray, key: np.ndarray, steps: int) -> np.ndarray:
    """For each row of a sorted array the greatest depths at which at least 1, 2, 4, ... (``steps`` powers) other rows share
    its prefix, 6 bits each, 63 where there is none."""
    n = len(key)
    depth = np.full((steps, n), 63, np.int64)
    for d in range(BITS, -1, -1):
        node = key >> (BITS - d)
        first = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(tree, prepend=-1) != 0))
        size = np.diff(np.append(first, n))
        others = np.repeat(size - 1, size)
        open_ = False
        for j in range(steps):
            new = (depth[j] == 63) & (others >= 1 << j)
            depth[j][new] = d
            open_ |= bool((depth[j] == 63).any())
        if not open_:
            break
    return (depth << (6 * np.arange(steps))[:, None]).sum(0)


def ascend(profiles: np.ndarray, candidates: int, steps: int) -> np.ndarray:
    """The depth at which each vector's ascent ends: all trees (columns) go up one bit at a time together, until the
    nodes they stand in hold ``candidates`` others in all. A node's size counts as the power of two below it."""
    n = len(profiles)
    level, open_ = np.zeros(n, np.int16), np.ones(n, bool)
    depth = (profiles[:, :, None] >> (6 * np.arange(steps))) & 63
    depth = np.where(depth == 63, -1, depth).reshape(n, -1)
    gain = np.tile([1, *(1 << j for j in range(steps - 1))], profiles.shape[1])
    for d in range(BITS, 0, -1):
        enough = open_ & ((depth >= d) @ gain >= candidates)
        level[enough] = d
        open_ &= ~enough
        if not open_.any():
            break
    return level


def forest_neighbours(classes: DataFrame, k: int, trees: int = 10, candidates: int = 64, seed: int = 7, queries: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(cls, other, cosine, rank): up to k most similar classes of each class (or of those in ``queries``).

    Each tree writes a vector as a string of 62 random-hyperplane bits; all strings of a tree lie in one globally
    range-partitioned sorted array. A vector's longest prefix matches in all trees are known from the sizes of the
    nodes it stands in; from there all trees ascend together, a bit at a time, until their nodes hold ``candidates``
    other vectors. Within each tree the vector is then compared with the rows that share its prefix of that length, at
    most ``candidates`` / 2 of them on each side. Arrays are scanned in blocks of positions; a block holds the rows next
    to its edges too, so no range boundary hides a row.

    Only strings and places are sorted; vectors travel to the blocks once for each tree, in half precision, and the
    k + 5 best of a tree are kept; cosines and ranks are then taken in full. ``least`` drops pairs that are less similar.

    What is found are lower bounds: a crowd of more than ``candidates`` loses neighbours. ``complete_pairs`` and
    ``complete`` find the rest.
    """
    spark, kind = classes.sparkSession, classes.schema["cls"].dataType.simpleString()
    if queries is None:
        marked = classes.withColumn("asks", F.lit(True))
    else:
        marked = classes.join(queries.select("cls").distinct().withColumn("asks", F.lit(True)), "cls", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    keep = k + 5  # half precision decides who is kept, full precision who is nearest
    reach = max(1, candidates // 2)
    steps = max(1, candidates.bit_length())

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = None
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("unit")
            width = len(col.flatten()) // b.num_rows
            x = np.asarray(col.flatten(), np.float32).reshape(b.num_rows, width)
            if normal is None:
                normal = planes(seed, trees, width).T.astype(np.float32)
            bits = (x @ normal > 0).reshape(b.num_rows, trees, BITS)
            keys = (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(2)
            tie = (x[:, 0].astype(np.float64) * (1 << 30)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * trees, pa.int32()), pa.array(keys.ravel())), pa.array(tie)], names=["cls", "keys", "tie"])

    strings = spread(classes.select("cls", "unit")).mapInArrow(hashes, f"cls {kind}, keys array<bigint>, tie bigint")
    placed = strings.select("cls", "tie", F.posexplode("keys").alias("tree", "key"))
    # equal strings are told apart by a coordinate, so a crowd can be cut anywhere and stays in local order
    arrays = placed.repartitionByRange("tree", "key", "tie", "cls").sortWithinPartitions("tree", "key", "tie", "cls").select("cls", "tree", "key", F.spark_partition_id().alias("range"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            profile = depth_profile(t.column("tree").to_numpy(), t.column("key").to_numpy(), steps)
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array(np.arange(before, before + len(profile))), pa.array(profile)], names=[*t.column_names, "local", "profile"])

        for b in batches:  # a node cut by the end of a block looks smaller: the ascent goes on a little further
            held.append(b)
            size += b.num_rows
            if size >= 200_000:
                yield out()
                held, size, before = [], 0, before + size
        if size:
            yield out()

    sorted_ = cut(arrays.mapInArrow(places, f"cls {kind}, tree int, key bigint, range int, local bigint, profile bigint"), "p6-arrays")
    sizes = sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    seats = sorted_.join(F.broadcast(offsets), "range").select("cls", F.struct("tree", "key", (F.col("before") + F.col("local")).alias("pos"), "profile").alias("s"))
    known = marked.join(seats.groupBy("cls").agg(F.sort_array(F.collect_list("s")).alias("seats")), "cls")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                n = b.num_rows
                seat = b.column("seats").flatten()
                tree, key, pos, profile = (seat.field(c).to_numpy() for c in ("tree", "key", "pos", "profile"))
                level = np.repeat(ascend(profile.reshape(n, trees), candidates, steps), trees)
                asks = np.repeat(b.column("asks").to_numpy(zero_copy_only=False), trees)
                x = np.asarray(b.column("unit").flatten(), np.float16).reshape(n, -1)
                wide = x.shape[1] * 2
                row, block = np.arange(n * trees), pos // BLOCK
                left, right = np.flatnonzero((pos % BLOCK < reach) & (block > 0)), np.flatnonzero(pos % BLOCK >= BLOCK - reach)
                row = np.concatenate([row, left, right])
                block = np.concatenate([block, block[left] - 1, block[right] + 1])
                own = np.arange(len(row)) < n * trees  # rows of the blocks beside are only looked at
                for i in range(0, len(row), 20_000):
                    r = row[i : i + 20_000]
                    half = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.arange(len(r) + 1) * wide).astype(np.int32)), pa.py_buffer(x[r // trees].tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[i : i + 20_000]), pa.array(pos[r]), pa.array(tree[r].astype(np.int8)), pa.array(key[r]), pa.array(np.where(own[i : i + 20_000] & asks[r], level[r], -1).astype(np.int8)), b.column("cls").take(pa.array(r // trees)), half],
                        names=["block", "pos", "tree", "key", "level", "cls", "half"],
                    )

    dealt = known.mapInArrow(deal, f"block bigint, pos bigint, tree tinyint, key bigint, level tinyint, cls {kind}, half binary")
    blocks = dealt.repartition("block").sortWithinPartitions("block", "pos")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = np.flatnonzero(np.diff(b.column("block").to_numpy(), prepend=-1)) if b.num_rows else np.zeros(0, int)
            for lo, hi in zip(at, [*at[1:], b.num_rows]):
                part = b.slice(int(lo), int(hi - lo))
                if held and held[-1].column("block")[0] != part.column("block")[0]:
                    yield from search(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(part)
        if held:
            yield from search(pa.Table.from_batches(held).combine_chunks())

    def search(block: pa.Table) -> Iterator[pa.RecordBatch]:
        n = block.num_rows
        ids = block.column("cls").combine_chunks()
        tree, key, level = (block.column(c).to_numpy() for c in ("tree", "key", "level"))
        x = np.frombuffer(b"".join(block.column("half").to_pylist()), np.float16).astype(np.float32).reshape(n, -1)
        best = np.full((n, keep), -2.0, np.float32)
        who = np.full((n, keep), -1, np.int64)

        def offer(rows: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> None:
            better = cosine > best[rows, keep - 1]
            if not better.any():
                return
            rows, other, cosine = rows[better], other[better], cosine[better]
            b, w = best[rows], who[rows]
            at = (b >= cosine[:, None]).sum(1)
            col = np.arange(keep)[None, :]
            source = np.where(col <= at[:, None], col, col - 1)
            take = np.arange(len(rows))[:, None]
            hit = col == at[:, None]
            best[rows] = np.where(hit, cosine[:, None], b[take, source])
            who[rows] = np.where(hit, other[:, None], w[take, source])

        for side in (1, -1):
            at = np.flatnonzero(level >= 0)
            for step in range(1, reach + 1):
                to = at + side * step
                inside = (to >= 0) & (to < n)
                at, to = at[inside], to[inside]
                drop = BITS - level[at].astype(np.int64)
                same = (tree[at] == tree[to]) & (key[at] >> drop == key[to] >> drop)
                at, to = at[same], to[same]
                if not len(at):
                    break
                cosine = np.einsum("ij,ij->i", x[at], x[to])
                near = np.ones(len(at), bool) if least is None else cosine >= least - HALF_ERROR
                offer(at[near], to[near], cosine[near])
        r, c = np.nonzero(who >= 0)
        if len(r):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), ids.take(pa.array(who[r, c])), pa.array(best[r, c])], names=["cls", "other", "cosine"])

    found = blocks.mapInArrow(scan, f"cls {kind}, other {kind}, cosine float")
    merged = found.groupBy("cls", "other").agg(F.max("cosine").alias("cosine"))
    rough = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "other"))
    best_of = merged.withColumn("rough", rough).filter(F.col("rough") <= keep).select("cls", "other")
    return _ranked(best_of, classes, k, least, F.desc("cosine"))


def _ranked(pairs: DataFrame, classes: DataFrame, k: int, least: float | None, *order: Column) -> DataFrame:
    """``pairs`` (cls, other and more) with cosines and ranks in full precision, up to k of each class."""
    unit = classes.select("cls", "unit")
    both = pairs.join(unit, "cls").join(unit.select(F.col("cls").alias("other"), F.col("unit").alias("unit_o")), "other")
    cosine = F.aggregate(F.zip_with("unit", "unit_o", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = both.select(*pairs.columns, cosine.alias("cosine"))
    if least is not None:
        exact = exact.filter(F.col("cosine") >= least - 1e-6)
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(*order, "other"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k)


def complete_pairs(classes: DataFrame, near: DataFrame, k: int, least: float) -> DataFrame:
    """(cls, other, cosine, rank): ``near``, the forest's lists, completed to exactly the up to k most similar classes of
    each class with a cosine of ``least`` or more; among cosines that agree in 6 decimals the smaller id comes first.

    Every vector lives in the cell of the pivot it is most similar to. Where q is at home at p and v at c, q and v can
    only be within a distance d if (p - c) q <= d |p - c|: a vector is compared with all vectors of every cell for which
    that holds. d is the distance at ``least``, or that of the k-th neighbour in ``near`` where that is smaller.
    """
    spark, kind = classes.sparkSession, classes.schema["cls"].dataType.simpleString()
    cells = min(MAX_CELLS, max(1, classes.count() // CELL_ROWS))
    picked = classes.orderBy(F.xxhash64(F.lit("pivot"), "cls"), "cls").limit(cells).collect()
    if not picked:
        return near.select("cls", "other", "cosine", "rank")
    held = spark.sparkContext.broadcast(np.array([r["unit"] for r in picked], np.float32))
    kth = near.filter(F.col("rank") == k).select("cls", F.col("cosine").alias("kth"))
    asked = classes.join(kth, "cls", "left").select("cls", "unit", F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least)).alias("bound"))

    def similar(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.asarray(b.column("unit").flatten(), np.float32).reshape(b.num_rows, -1)
        s = x @ held.value.T
        return s, s.argmax(1)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(similar(b)[1].astype(np.int32))], names=[*b.schema.names, "home"])

    homes = cut(spread(asked).mapInArrow(settle, f"cls {kind}, unit array<float>, bound double, home int"), "p6-homes")
    counts = np.zeros(len(picked), np.int64)
    for r in homes.groupBy("home").count().collect():  # no more rows than pivots
        counts[r["home"]] = r["count"]
    parts = -(-counts // CELL_ROWS)
    first = np.cumsum(parts) - parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value.astype(np.float64)
        apart = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 0)).astype(np.float32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                s, _ = similar(b)
                home = b.column("home").to_numpy()
                d = np.sqrt(np.maximum(2 - 2 * b.column("bound").to_numpy(), 0)) + 1e-3
                visits = s[np.arange(len(s)), home][:, None] - s <= d[:, None] * apart[home] + 1e-5
                row, cell = np.nonzero(visits & (counts > 0))
                again = np.repeat(np.arange(len(row)), parts[cell])
                part = np.arange(len(again)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                seat = b.column("seat").to_numpy() % parts[home]
                at = np.concatenate([np.arange(len(s)), row[again]])
                block = np.concatenate([first[home] + seat, first[cell[again]] + part])
                asks = np.arange(len(at)) >= len(s)
                for i in range(0, len(at), 20_000):
                    t = pa.array(at[i : i + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 20_000]), pa.array(asks[i : i + 20_000]), b.column("cls").take(t), b.column("unit").take(t)], names=["block", "asks", "cls", "unit"])

    seats = homes.withColumn("seat", F.pmod(F.xxhash64(F.lit("seat"), "cls"), F.lit(1 << 40)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * parallelism(spark))
    dealt = spread(seats).mapInArrow(deal, f"block bigint, asks boolean, cls {kind}, unit array<float>")
    blocks = dealt.repartition(tasks, "block").sortWithinPartitions("block", "asks")  # those who live there come first
    keep = k + 11  # single precision decides who is kept; so many more cosines may agree in 6 decimals

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, rows = -1, [], []
        for b in batches:
            if not b.num_rows:
                continue
            block, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            x = np.asarray(b.column("unit").flatten(), np.float32).reshape(b.num_rows, -1)
            new = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(asks.astype(np.int8), prepend=-1) != 0))
            for lo, hi in zip(new, np.append(new[1:], b.num_rows)):
                if block[lo] != here:
                    here, names, rows = block[lo], [], []
                if not asks[lo]:
                    names.append(b.column("cls").slice(lo, hi - lo))
                    rows.append(x[lo:hi])
                    continue
                if len(rows) != 1:
                    names, rows = [pa.concat_arrays(names)] if names else [], [np.concatenate(rows)] if rows else []
                for i in range(lo, hi, 2000) if rows else ():
                    q = b.column("cls").slice(i, min(2000, hi - i))
                    s = x[i : i + len(q)] @ rows[0].T
                    some = np.flatnonzero(s.max(1) >= least - 1e-5)
                    s = s[some]
                    top = np.argpartition(-s, keep, axis=1)[:, : keep + 1] if s.shape[1] > keep + 1 else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    s = np.take_along_axis(s, top, 1)
                    r, c = np.nonzero(s >= least - 1e-5)
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(some[r])), names[0].take(pa.array(top[r, c])), pa.array(s[r, c].astype(np.float64))], names=["cls", "other", "cosine"])

    found = blocks.mapInArrow(compare, f"cls {kind}, other {kind}, cosine double").filter("cls <> other")
    rough = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "other"))
    rest = found.withColumn("rough", rough).filter(F.col("rough") <= keep).select("cls", "other")
    return _ranked(near.select("cls", "other").union(rest).distinct(), classes, k, least, F.desc(F.round("cosine", 6)))


def similar_pairs(vectors: DataFrame, id_col: str, vector: str, least: float, k: int = 5, places: list[int] | None = None, **forest: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: cosine at least ``least``, and one is among the k most similar of the other.

    Among cosines that agree in 6 decimals the smaller id comes first; vectors of the same direction have a cosine of 1.
    Zero, empty and null vectors have no neighbours; an id with repeated rows counts once.
    """
    vectors, id_col, vector = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), "_id", "_v"
    classes, members = unit_classes(vectors, id_col, vector, places)
    near = cut(forest_neighbours(classes, k, least=least, **forest), "p6-near")
    near = cut(complete_pairs(classes, near, k, least), "p6-complete")
    scored = near.select("cls", "other", F.col("cosine").alias("exact"))
    # the first k + 1 members of a class are enough for any list of k; they are found without ranking the class
    sizes = _heads(members, id_col, k + 1)
    lists = scored.join(sizes.select(F.col("cls").alias("other"), F.col("heads").alias("heads_o")), "other").groupBy("cls").agg(F.collect_list(F.struct((-F.round("exact", 6)).alias("d"), F.col("heads_o").alias("m"))).alias("others"))
    known = sizes.join(lists, "cls", "left")
    spread_out = lookup(members, known, ["cls"])
    entry = lambda d, m: F.struct(d.alias("d"), m.alias("m"))
    own = F.transform(F.filter("heads", lambda m: m != F.col(id_col)), lambda m: entry(F.lit(-1.0), m))
    rest = F.flatten(F.transform(F.coalesce("others", F.array().cast(lists.schema["others"].dataType)), lambda o: F.transform(o["m"], lambda m: entry(o["d"], m))))
    top = F.transform(F.slice(F.array_sort(F.concat(own, rest)), 1, k), lambda x: x["m"])
    pairs = spread_out.select(F.col(id_col).alias("a"), F.explode(top).alias("b"))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def _heads(members: DataFrame, id_col: str, k: int) -> DataFrame:
    """(cls, heads): the k smallest ids of each class, reduced in 64 parts first so no class is ranked in one task."""
    part = F.pmod(F.xxhash64(id_col), F.lit(64))
    inner = Window.partitionBy("cls", "part").orderBy(id_col)
    few = members.withColumn("part", part).withColumn("r", F.row_number().over(inner)).filter(F.col("r") <= k)
    return few.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(id_col)), 1, k).alias("heads"))


def complete(classes: DataFrame, asked: DataFrame, found: DataFrame, k: int, certain: float) -> DataFrame:
    """``found`` with the exact answer for the asked classes whose k-th similarity lies below ``certain``.

    A forest finds what is close; where a vector has no close ones, prefixes say nothing about who is nearest. Such
    queries go against all rows, in blocks of bounded size, each task keeping the k best of its part.
    """
    kth = found.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).filter((F.col("n") >= k) & (F.col("least") >= certain))
    open_ = cut(asked.select("cls").distinct().join(kth, "cls", "left_anti").join(classes, "cls"), "p6-open")
    done = found.join(kth.select("cls"), "cls", "left_semi").select("cls", "other", "cosine", "rank")
    spark, kind = classes.sparkSession, classes.schema["cls"].dataType.simpleString()
    parts = max(1, -(-open_.count() // QUERY_BLOCK))
    for i in range(parts):
        block = open_.filter(F.pmod(F.xxhash64("cls"), F.lit(parts)) == i).collect()  # about QUERY_BLOCK rows
        if not block:
            continue
        held = spark.sparkContext.broadcast((np.array([r["cls"] for r in block]), np.array([r["unit"] for r in block], np.float32)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best, who = np.full((len(q), k), -2.0, np.float32), np.full((len(q), k), -1, np.int64)
            for whole in batches:
                for lo in range(0, whole.num_rows, 2000):
                    b = whole.slice(lo, 2000)
                    ids = b.column("cls").to_numpy()
                    s = q @ np.asarray(b.column("unit").flatten(), np.float32).reshape(b.num_rows, -1).T
                    s[names[:, None] == ids[None, :]] = -2
                    both = np.concatenate([best, s], 1)
                    top = np.argpartition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.argsort(-both, axis=1)
                    who = np.take_along_axis(np.concatenate([who, np.broadcast_to(ids, s.shape)], 1), top, 1)
                    best = np.take_along_axis(both, top, 1)
            r, c = np.nonzero(best > -2)
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(who[r, c]), pa.array(best[r, c].astype(np.float64))], names=["cls", "other", "cosine"])

        near = classes.mapInArrow(scan, f"cls {kind}, other {kind}, cosine double")
        rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("cosine"), "other"))
        done = done.unionByName(cut(near.withColumn("rank", rank).filter(F.col("rank") <= k), "p6-exact"))
    return done


def nearest(vectors: DataFrame, id_col: str, vector: str, k: int = 5, queries: Column | None = None, certain: float | None = None, places: list[int] | None = None, **forest: int) -> DataFrame:
    """(id, other_id, cosine, rank): the k most similar other vectors of every vector, or of those where ``queries`` holds.

    ``certain`` (with integer ids) sends vectors with a lower k-th similarity against all rows, in blocks of queries;
    without it the lists are the forest's, which misses neighbours that are far (see README for its recall).
    """
    wanted = None if queries is None else vectors.filter(queries).select(F.col(id_col).alias("_id")).distinct()
    classes, members = unit_classes(vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v")), "_id", "_v", places)
    asked, name, id_col = members if wanted is None else members.join(wanted, "_id", "left_semi"), id_col, "_id"
    near = cut(forest_neighbours(classes, k, queries=None if queries is None else asked, **forest), "p6-near")
    if certain is not None:
        near = complete(classes, asked, near, k, certain)
    heads = _heads(members, id_col, k + 1)
    lists = near.join(heads.select(F.col("cls").alias("other"), F.col("heads").alias("m")), "other").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("other").alias("o"), "m"))).alias("others"))
    known = heads.join(lists, "cls", "left")
    rows = lookup(asked, known, ["cls"])
    entry = lambda c, m: F.struct(m.alias("id"), c.alias("cosine"))
    own = F.transform(F.filter("heads", lambda m: m != F.col(id_col)), lambda m: entry(F.lit(1.0), m))
    rest = F.flatten(F.transform(F.coalesce("others", F.array().cast(lists.schema["others"].dataType)), lambda o: F.transform(o["m"], lambda m: entry(-o["d"], m))))
    return rows.select(id_col, F.posexplode(F.slice(F.concat(own, rest), 1, k)).alias("rank", "x")).select(F.col(id_col).alias(name), F.col("x.id").alias("other_id"), F.round("x.cosine", 6).alias("cosine"), (F.col("rank") + 1).alias("rank"))
