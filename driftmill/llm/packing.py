"""Filling fixed-capacity containers: a space-filling curve orders the documents, neighbours share containers."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmill.llm.tokens import VOCABULARY, count
from driftmill.runtime import parallelism, spread

DIMS, ORDER = 4, 12  # dimensions of the curve and bits of each; the key has 48 bits
BUCKETS = 4096  # of the hashed document vectors
WORD = re.compile(r"\w+")
#: Containers a packing task should fill at least: its last, part-filled ones weigh little against that.
LEAST_BOXES = 256
#: Tokens of a packing task at most (about), whatever the cluster: the bound of its open containers and of its time.
TASK_TOKENS = 1 << 28


def directions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def project(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Unit term-count vectors, hashed to BUCKETS and projected to DIMS; the zero vector for texts without words."""
    out = np.zeros((len(texts), DIMS), np.float32)
    seen: dict[str, int] = {}
    for r, t in enumerate(texts):
        if not t:
            continue
        counts: dict[int, int] = {}
        for w in WORD.findall(t.lower()):
            b = seen.get(w)
            if b is None:
                if len(seen) > 200_000:
                    seen.clear()
                b = seen[w] = crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            counts[b] = counts.get(b, 0) + 1
        if counts:
            v = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
            out[r] = (v / np.linalg.norm(v)) @ table[np.fromiter(counts.keys(), np.int64, len(counts))]
    return out


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve position of each row of non-negative integers below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(projected: np.ndarray) -> np.ndarray:
    """Projections of unit vectors are about standard normal: a squashed grid of them is filled evenly."""
    grid = (1 / (1 + np.exp(-1.7 * projected.astype(np.float64)))) * (1 << ORDER)
    return hilbert(np.clip(grid.astype(np.int64), 0, (1 << ORDER) - 1), ORDER)


def sized(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, curve): one pass over the texts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = directions(seed)
        for b in batches:
            texts = b.column("_text").to_pylist()
            n = np.fromiter((count(vocabulary, t) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n), pa.array(curve_keys(project(texts, table)))], names=["_id", "n_tokens", "curve"])

    rows = spread(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")))
    return rows.mapInArrow(run, f"_id {kind}, n_tokens bigint, curve bigint").withColumnRenamed("_id", doc_id)


def oversized(packed: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id) of the packed documents that no container holds whole: those that had to be cut."""
    return packed.filter("piece > 0").select(doc_id).distinct()


def pack(sizes: DataFrame, doc_id: str, capacity: int) -> DataFrame:
    """(container, doc_id, piece, start_token, n_tokens): every token of every document in one container.

    Documents are range-sorted by their place on the curve; each task packs one stretch of it, of 256 containers at
    least and about 2**28 tokens at most. A document of more than ``capacity`` tokens is cut into whole containers and a
    rest that is packed like any document; no other is cut. A document goes to the container with the least room
    that still holds it, of those with equal room to the one opened last, which is nearest on the curve; without such a
    one a new container is opened. No container is closed before the end of the stretch. Documents without tokens
    get no container. A null id is kept; rows repeated under one id are packed as often as they occur. Containers are
    named <task>-<number>. ``sizes`` is read twice: cut it first.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = int(max(1, min(parallelism(sizes.sparkSession), total // (LEAST_BOXES * capacity)), -(-total // TASK_TOKENS)))
    kind = sizes.schema[doc_id].dataType.simpleString()
    items = sizes.filter("n_tokens > 0").select(F.col(doc_id).alias("_id"), "n_tokens", "curve")
    placed = items.repartitionByRange(tasks, "curve", "_id").sortWithinPartitions("curve", "_id").withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rooms: list[int] = []  # sorted, without repeats: fewer than capacity
        open_: dict[int, list[int]] = {}  # room -> its containers, the latest last
        made = 0
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            ids = b.column("_id").to_pylist()
            for d, n, task in zip(ids, b.column("n_tokens").to_pylist(), b.column("task").to_pylist()):
                piece = start = 0
                while n - start > 0:
                    size = min(capacity, n - start)
                    i = bisect_left(rooms, size)
                    if size < capacity and i < len(rooms):
                        room = rooms[i]
                        box = open_[room].pop()
                        if not open_[room]:
                            del open_[room], rooms[i]
                    else:
                        made += 1
                        room, box = capacity, made
                    if room > size:
                        if room - size not in open_:
                            open_[room - size] = []
                            insort(rooms, room - size)
                        open_[room - size].append(box)
                    for col, x in zip(out, (f"{task}-{box}", d, piece, start, size)):
                        col.append(x)
                    piece += 1
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], b.column("_id").type), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["container", "_id", "piece", "start_token", "n_tokens"])

    return placed.mapInArrow(run, f"container string, _id {kind}, piece int, start_token bigint, n_tokens bigint").withColumnRenamed("_id", doc_id)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of the capacity that is used."""
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return boxes.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.round(F.sum("used") / F.when(F.count(F.lit(1)) > 0, F.count(F.lit(1)) * capacity), 4).alias("fill"))
