"""Inverted-file search: vectors are grouped in cells, queries probe a few of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kindred.functions.vectors import l2_norm
from kindred.operators.joins import by_blocks
from kindred.operators.position import sample_exact
from kindred.operators.topk import DENSE_BLOCK, DIGITS, as_matrix, rank_items, score_block
from kindred.session import forget, written

MIN_PER_CELL = 39  # fixed value: with fewer vectors per cell an exact search is advised
CENTROID_BYTES = 512 << 20  # what a task may hold of centroids
BOUNDS = ("radius", "low", "high", "off")
_SLACK = 1e-9  # what rounding may take from a bound
_PAIRS = 4_000_000  # pairs of query and cell that are bounded at once


def use_cells(n_vectors: int, n_cells: int) -> bool:
    """Whether a collection is large enough for cells to pay; an advice, nothing depends on it."""
    return n_vectors >= n_cells * MIN_PER_CELL


def train_cells(vectors: DataFrame, n_cells: int, seed: int = 42, sample: int | None = None) -> DataFrame:
    """(cell_id, centroid) from spherical k-means on all vectors, or on an exact sample of the size given."""
    usable = vectors.filter(l2_norm(F.col("embedding")) > 0)
    if sample is not None:
        usable = sample_exact(usable, "item_id", sample, seed)
    points = written(usable.select(F.col("embedding").cast("array<double>").alias("x")), "points")
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points.select(array_to_vector("x").alias("features")))
    forget(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell_id int, centroid array<double>")


def _centroids(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    size = cells.agg(F.sum(8 * F.size("centroid"))).first()[0] or 0
    if size > CENTROID_BYTES:
        raise ValueError(f"{size} bytes of centroids do not fit a task; train fewer cells")
    table = cells.select("cell_id", "centroid").orderBy("cell_id").toArrow().combine_chunks()
    return (
        table.column("cell_id").to_numpy(),
        as_matrix(table.column("centroid").combine_chunks()),
    )


def assign_cells(vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Add the cell whose centroid has the largest inner product with the vector."""
    ids, centroids = _centroids(cells)
    schema = StructType([*vectors.schema.fields, StructField("cell_id", IntegerType())])
    column = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest = np.argmax(as_matrix(batch.column(column)) @ centroids.T, axis=1)
                chosen = pa.array(ids[nearest].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, chosen], [*batch.schema.names, "cell_id"])

    return vectors.mapInArrow(run, schema)


def best_products(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """(item_id, cell_id, own, best): inner products of each vector with its cell's centroid, and with the best one."""
    ids, centroids = _centroids(cells)
    place = {int(c): i for i, c in enumerate(ids)}
    out = StructType([assigned.schema["item_id"], StructField("cell_id", IntegerType()), StructField("own", DoubleType()), StructField("best", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                products = as_matrix(batch.column(2)) @ centroids.T
                mine = np.array([place[c] for c in batch.column(1).to_pylist()])
                own = products[np.arange(len(products)), mine]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own), pa.array(products.max(axis=1))], out.names)

    return assigned.select("item_id", F.col("cell_id").cast("int"), "embedding").mapInArrow(run, out)


def measured(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with bounds of the vectors that lie in them, for ``topk_bounded``.

    ``radius`` is the largest distance from the centroid, ``low`` and ``high`` the
    reach along its direction, ``off`` the largest distance from that line. One
    pass over the vectors; cells without any have null bounds.
    """
    ids, centroids = _centroids(cells)
    place = {int(c): i for i, c in enumerate(ids)}
    unit = _directions(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cell = as_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            mine = np.array([place[c] for c in cell.tolist()])
            radius = np.linalg.norm(vectors - centroids[mine], axis=1)
            along = (vectors * unit[mine]).sum(axis=1)
            off = np.sqrt(np.maximum((vectors * vectors).sum(axis=1) - along * along, 0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, (radius, along, off))], ["cell_id", "radius", "along", "off"])

    found = assigned.select("embedding", F.col("cell_id").cast("int")).mapInArrow(run, "cell_id int, radius double, along double, off double")
    bounds = found.groupBy("cell_id").agg(
        F.max("radius").alias("radius"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("off").alias("off")
    )
    return written(cells.join(bounds, "cell_id", "left"), "cells")


def _directions(centroids: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    return np.divide(centroids, norms, out=np.zeros_like(centroids), where=norms > 0)


@dataclass(frozen=True)
class CellBounds:
    """Centroids of the cells that hold vectors, and how far these lie from them."""

    ids: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray  # a column for each of ``BOUNDS``

    @classmethod
    def collect(cls, cells: DataFrame) -> CellBounds:
        held = cells.filter(F.col("radius").isNotNull())
        ids, centroids = _centroids(held)
        table = held.select(*BOUNDS).orderBy("cell_id").toPandas().to_numpy(np.float64)
        return cls(ids, centroids, table)

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell, a score that no vector of the cell exceeds."""
        radius, low, high, off = self.bounds.T
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        ball = queries @ self.centroids.T + size * radius
        along = queries @ _directions(self.centroids).T
        line = np.maximum(along * low, along * high) + np.sqrt(np.maximum(size * size - along * along, 0)) * off
        least = np.minimum(ball, line)
        return least + _SLACK * (1 + np.abs(least))

    def probes(self, queries: np.ndarray, wanted: Callable[[np.ndarray, slice], np.ndarray]) -> dict[int, np.ndarray]:
        """Rows of the queries that ``wanted`` (some queries x cells) sends to each cell."""
        found: dict[int, list[np.ndarray]] = {}
        step = max(1, _PAIRS // max(1, len(self.ids)))
        for at in range(0, len(queries), step):
            rows = slice(at, at + step)
            chosen = wanted(queries[rows], rows)
            for c in np.flatnonzero(chosen.any(axis=0)):
                found.setdefault(int(self.ids[c]), []).append((at + np.flatnonzero(chosen[:, c])).astype(np.int32))
        return {c: np.concatenate(rows) for c, rows in found.items()}

    def nearest(self, queries: np.ndarray, n: int) -> np.ndarray:
        """Whether a cell is among the ``n`` whose centroids score best."""
        best = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :n]
        chosen = np.zeros((len(queries), len(self.ids)), bool)
        np.put_along_axis(chosen, best, True, axis=1)
        return chosen


def topk_bounded(
    queries: DataFrame,
    assigned: DataFrame,
    cells: DataFrame,
    k: int,
    n_probe: int = 1,
    below: float | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank): the same answers as an exact search, from as few cells as bounds allow.

    Each query first reads its ``n_probe`` nearest cells; the score of its k-th
    answer then rules out all cells whose vectors cannot reach it, and the others
    are read as well. ``cells`` comes from ``measured``. ``assigned`` may be any
    part of the vectors that were measured. How much is left out depends on how
    well the vectors fall into cells; no answer does.
    """
    known = CellBounds.collect(cells)

    def one_pass(block: DataFrame) -> DataFrame:
        if encode:
            block = written(encode(block), "encoded")
        near = lambda _, matrix: known.probes(matrix, lambda q, _: known.nearest(q, n_probe))
        first = written(rank_items(score_block(block, assigned, k, below, near), k), "probed")
        # One number for each query of a block.
        reached = {r["query_id"]: r["score"] for r in first.filter(F.col("rank") == k).collect()}

        def further(ids: pa.Array, matrix: np.ndarray) -> dict[int, np.ndarray]:
            least = np.array([reached.get(i, -np.inf) for i in ids.to_pylist()])[:, None] - 0.5 * 10.0**-DIGITS
            return known.probes(matrix, lambda q, rows: (known.upper(q) >= least[rows]) & ~known.nearest(q, n_probe))

        rest = score_block(block, assigned, k, below, further)
        return rank_items(first.drop("rank").unionByName(rest), k)

    return by_blocks(queries, "query_id", DENSE_BLOCK, one_pass)


def topk_cells(
    queries: DataFrame,
    assigned: DataFrame,
    cells: DataFrame,
    k: int,
    n_probe: int = 1,
    below: float | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank) from the ``n_probe`` nearest cells of each query.

    The search reads only probed cells, which is partition pruning when
    ``assigned`` was written partitioned by cell. A crowded cell is spread over
    as many tasks as its files have splits.
    """
    cell_ids, centroids = _centroids(cells)
    probed = min(n_probe, len(cell_ids))

    def probes(_: pa.Array, matrix: np.ndarray) -> dict[int, np.ndarray]:
        nearest = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probed]
        return {int(cell_ids[c]): np.flatnonzero((nearest == c).any(axis=1)) for c in np.unique(nearest)}

    def one_pass(block: DataFrame) -> DataFrame:
        return rank_items(score_block(encode(block) if encode else block, assigned, k, below, probes), k)

    return by_blocks(queries, "query_id", DENSE_BLOCK, one_pass)
