"""Centroid clustering on integer vectors by lookup tables.

Components are integers, and few different ones occur. In each round a task
tabulates the squared difference of every occurring value of each dimension to
every centroid, and distances are sums of entries taken from these tables. All
numbers are exact, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kindred.llm.lattice import LONG_MAX, SUMS, exact_sum, limbs, longs, on_grid, pack, small_parts, total_by_slot, unpack
from kindred.session import written

SCALE = 1024
_RANGE = 1 << 16  # values of a dimension within such a range are looked up by their place in it


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Nearest of ``k`` centroids for each vector of ``dims`` finite components.

    Components are floor(1024 * value). The first centroids are the vectors with
    the smallest SHA-256 of ``seed:key``, and of the vector where keys repeat;
    with fewer vectors there are fewer. Each round assigns every vector to the
    nearest (ties: the smaller number) and moves centroids to the floor of the
    mean of theirs; one without vectors stays. Returns ``key``, ``cluster``,
    ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` for each vector after one more assignment.

    Null vectors and those of another size or with null or non-finite entries are
    left out; a null key is an empty text in the hash; repeated rows are vectors
    of their own. Distances and inertias that exceed a long are null. An empty
    table gives an empty one; other columns are ignored.
    """
    table = written(_on_grid(vectors, key, column, dims), "centroids")
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), F.col("x")]
    starts = table.orderBy(*order).select("x").limit(k).collect()
    centroids = unpack(pa.array([bytes(r["x"]) for r in starts], pa.binary()), dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(table, centroids)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    kind = vectors.schema[key].dataType
    placed = written(_assigned(table, centroids, StructType([StructField("key", kind)]).add("cluster", "integer").add("distance", "long")), "centroids-placed")
    sums = placed.groupBy("cluster").agg(_exact_sum("distance").alias("sum")).collect()  # as many rows as centroids
    by_cluster = {r["cluster"]: r["sum"] for r in sums}
    total = None if None in by_cluster.values() else sum(by_cluster.values())
    own = longs(by_cluster.get(i) for i in range(len(names))).to_pylist()
    entries = F.array(*(F.struct(F.lit(i).cast("long").alias("inertia"), F.lit(n).alias("sha")) for i, n in zip(own, names, strict=True)))
    entries = entries.cast("array<struct<inertia:long,sha:string>>")
    mine = F.get(entries, F.col("cluster"))
    return placed.select(
        F.col("key").alias(key), "cluster", "distance", mine["inertia"].alias("cluster_inertia"),
        F.lit(longs([total])[0].as_py()).cast("long").alias("inertia"), mine["sha"].alias("centroid_sha256"),
    )


def _exact_sum(column: str) -> Column:
    """Exact sum; null if an entry is."""
    return F.when(F.count(column) == F.count("*"), F.sum(F.col(column).cast("decimal(38,0)")))


def _on_grid(vectors: DataFrame, key: str, column: str, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, cells = on_grid(batch[column], SCALE, dims)
            yield pa.record_batch([batch[key].take(pa.array(rows)), pack(sizes, cells)], ["key", "x"])

    return vectors.select(key, column).mapInArrow(run, StructType([StructField("key", vectors.schema[key].dataType), StructField("x", BinaryType())]))


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), object)
        for batch in small_parts(batches, width=dims):
            x = unpack(batch["x"], dims)
            near, _ = nearest(x, centroids)
            for c in np.unique(near):
                mine = x[near == c]
                total[c] += np.array([*exact_sum(mine), len(mine)], object)
        yield limbs(np.arange(k * (dims + 1)), total.ravel())

    found = total_by_slot(table.select("x").mapInArrow(sums, SUMS))
    total = [[found.get(c * (dims + 1) + j, 0) for j in range(dims + 1)] for c in range(k)]
    moved = [[s // t[-1] for s in t[:-1]] if t[-1] else c for t, c in zip(total, centroids.tolist(), strict=True)]
    big = any(abs(x) >= 2**62 for c in moved for x in c)
    return np.array(moved, object if big else np.int64)


def _assigned(table: DataFrame, centroids: np.ndarray, schema: StructType) -> DataFrame:
    dims = centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, width=dims):
            near, distance = nearest(unpack(batch["x"], dims), centroids)
            yield pa.record_batch([batch["key"], pa.array(near, pa.int32()), longs(distance) if distance.dtype == object else pa.array(distance)], schema.names)

    return table.mapInArrow(place, schema)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if x.shape[1] * reach**2 > LONG_MAX:
        x, centroids = x.astype(object), centroids.astype(object)
    distance = np.zeros((len(x), len(centroids)), x.dtype)
    for j in range(x.shape[1]):
        values, code = _occurring(x[:, j])
        table = (values[:, None] - centroids[None, :, j]) ** 2
        distance += table[code]
    near = np.argmin(distance, axis=1)
    return near, distance[np.arange(len(x)), near]


def _occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values that occur, place of each entry among them)."""
    if column.dtype != object and len(column):
        low = column.min()
        span = int(column.max() - low) + 1
        if span <= _RANGE:
            there = np.zeros(span, bool)
            there[column - low] = True
            place = np.cumsum(there) - 1
            return np.flatnonzero(there) + low, place[column - low]
    return np.unique(column, return_inverse=True)
