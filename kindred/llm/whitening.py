"""Embedding whitening with eigenvectors refined from single precision.

The covariance of the distinct vectors is summed by the tasks. Its eigenvectors
are found in float32 and corrected by Ogita and Aishima's iteration, which needs
matrix products only and doubles the correct digits each time; vectors whose
eigenvalues lie too close for a correction are turned within their cluster by a
small eigenproblem of the shifted matrix. Nothing larger than a square matrix of
the dimension reaches the driver or a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from kindred.llm.lattice import LONG_MAX, SUMS, exact_sum, limbs, longs, on_grid, pack, small_parts, total_by_slot, unpack
from kindred.session import written

SCALE = 256
PATIENCE = 3  # corrections in a row that are not half of the least before them


@dataclass(frozen=True)
class Whitening:
    """Mean, components and eigenvalues of a fit list of ``n`` vectors."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a component a column
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors on each component, over the root of its eigenvalue; 0 where that is 0."""
        root = np.sqrt(self.values)
        return np.divide(_centred(x, self.n, self.sums) @ self.vectors, root, out=np.zeros((len(x), len(root))), where=root > 0)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sum over dimensions of (n * x - S)^2; null where it does not fit a long."""
        reach = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if len(self.sums) * reach**2 <= LONG_MAX:
            return pa.array((((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)), pa.int64())
        rough = (self.n * x.astype(np.float64) - np.array(self.sums, np.float64)) ** 2
        exact = lambda row: sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True))
        return longs(exact(row) if near <= 1.01 * LONG_MAX else LONG_MAX + 1 for row, near in zip(x, rough.sum(axis=1), strict=True))


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each usable row projected on the first components of the distinct vectors.

    Returns ``key``, ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``, one row for
    each row and component. Components are taken from floor(256 * value).

    Null vectors and those with null or non-finite entries are left out; null and
    repeated keys stay, and repeated vectors count once in the fit. Vectors shorter
    than the longest count as filled with zeros. A component without any variance
    has eigenvalue 0: ``whitened`` and ``explained`` are 0 there, and it takes no
    part in ``identity_error``. ``deviation`` is null where it exceeds a long. An
    empty table gives an empty one; other columns are ignored.
    """
    placed = written(_on_grid(vectors, key, column), "whitening")
    shortest, dims = (x or 0 for x in placed.agg(F.min("dims"), F.max("dims")).first())
    model = fit(placed.select("x").distinct(), shortest, dims, components)
    schema = StructType([
        StructField(key, placed.schema["key"].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in small_parts(batches, width=dims):
            x = unpack(batch["x"], dims)
            row = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [
                    batch["key"].take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), model.n)),
                    model.deviations(x).take(pa.array(row)), pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(row), model.identity_error)),
                ],
                names=schema.names,
            )

    return placed.select("key", "x").mapInArrow(project, schema)


def _on_grid(vectors: DataFrame, key: str, column: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, cells = on_grid(batch[column], SCALE)
            yield pa.record_batch([batch[key].take(pa.array(rows)), pack(sizes, cells), pa.array(sizes, pa.int32())], ["key", "x", "dims"])

    fields = [StructField("key", vectors.schema[key].dataType), StructField("x", BinaryType()), StructField("dims", IntegerType())]
    return vectors.select(key, column).mapInArrow(run, StructType(fields))


def fit(distinct: DataFrame, shortest: int, dims: int, components: int) -> Whitening:
    """Whitening fitted to the packed vectors ``x`` of ``distinct``, each of which counts once.

    Their sizes lie between ``shortest`` and ``dims``; those that differ only by
    zeros at their end are one. Three passes over a written table: sums, products
    of centred vectors, and the covariance of what the whitening makes of them.
    """
    table = written(distinct if shortest == dims else _filled(distinct, dims).distinct(), "whitening-fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for batch in small_parts(batches, width=dims):
            x = unpack(batch["x"], dims)
            total = [a + b for a, b in zip(total, [*exact_sum(x), len(x)], strict=True)]
        yield limbs(np.arange(dims + 1), total)

    found = total_by_slot(table.mapInArrow(sums, SUMS))
    n, total = found.get(dims, 0), [found.get(j, 0) for j in range(dims)]
    if not n or not dims:
        return Whitening(n, total, np.zeros((dims, 0)), np.zeros(0), np.zeros(0))
    covariance = _covariance(table, dims, dims, lambda x: _centred(x, n, total)) / n
    values, basis = eigen(covariance)
    trace = float(np.trace(covariance))
    least = dims * np.finfo(float).eps * trace
    k = min(components, dims)
    values = np.where(values[:k] > least, values[:k], 0.0)
    explained = values / trace if trace > 0 else np.zeros(k)
    model = Whitening(n, total, np.ascontiguousarray(basis[:, :k]), values, explained)
    real = np.flatnonzero(values > 0)
    made = _covariance(table, dims, k, model.project)[np.ix_(real, real)] / n
    error = float(np.abs(made - np.eye(len(real))).max(initial=0))
    return Whitening(n, total, model.vectors, values, explained, error)


def _filled(distinct: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, width=dims):
            x = unpack(batch["x"], dims)
            yield pa.record_batch([pack(np.full(len(x), dims), x.ravel())], ["x"])

    return distinct.mapInArrow(run, "x binary")


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x.astype(np.float64) - np.array([s / n for s in sums])


def _covariance(table: DataFrame, dims: int, k: int, centred) -> np.ndarray:  # noqa: ANN001
    """Sum of the outer products of ``centred`` vectors, of which there are ``k`` entries each.

    A task gives out its k rows of sums; those of one number are added in one group, whose size is the number of tasks.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in small_parts(batches, width=dims):
            y = centred(unpack(batch["x"], dims))
            total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(k)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "entries"])

    def add(tables: pa.Table) -> pa.Table:
        lines = np.array(tables["entries"].to_pylist())
        return pa.table({"line": tables["line"][:1], "entries": pa.array([lines[np.lexsort(lines.T)].sum(axis=0)], pa.list_(pa.float64()))})

    form = "line long, entries array<double>"
    rows = table.mapInArrow(products, form).groupBy("line").applyInArrow(add, form).collect()
    made = np.zeros((k, k))
    for r in rows:
        made[r["line"]] = r["entries"]
    return (made + made.T) / 2


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest down, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Starts from float32 eigenvectors. They are corrected in double precision and
    then in the longest that numpy has, each until corrections do not shrink any
    more: they may grow for a round when a cluster falls apart. What is left of
    them cannot bend the angles, which a last step makes right.
    """
    size = float(np.abs(matrix).max(initial=0))
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    basis = np.linalg.eigh((matrix / size).astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        a, basis, least, idle = (matrix / size).astype(kind), basis.astype(kind), np.inf, 0
        while idle < PATIENCE and least > np.finfo(kind).eps:
            basis, values, change = refine(a, basis)
            idle = 0 if change < least / 2 else idle + 1
            least = min(least, change)
    for _ in range(2):
        basis = basis + basis @ (np.eye(len(a)) - basis.T @ basis) / 2
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), basis[:, order].astype(np.float64)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors ``x``: (better ones, eigenvalues, size of the correction).

    Where two eigenvalues differ by less than what is known about them, the
    correction keeps the two vectors at right angles only; the sub-solve of their
    cluster has turned them to eigenvectors before.
    """
    x, values, near = _turned(a, x)
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    values = np.diagonal(s) / (1 - np.diagonal(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max())


def _turned(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors turned to eigenvectors within each cluster of eigenvalues, the eigenvalues, and the width of "near".

    A cluster is a chain of eigenvalues each within that width of the next. Its
    sub-solve is of ``a`` less the cluster's mean, so that small differences are
    not drowned by a large common part.
    """
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    values = np.diagonal(s) / (1 - np.diagonal(r))
    near = 2 * float(np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    order = np.argsort(values, kind="stable")
    for cluster in np.split(order, np.flatnonzero(np.diff(values[order]) > near) + 1):
        if len(cluster) > 1:
            part = x[:, cluster]
            shifted = part.T @ (a @ part - values[cluster].mean() * part)
            turn = np.linalg.eigh(((shifted + shifted.T) / 2).astype(np.float64))[1]
            x = x.copy()
            x[:, cluster] = part @ turn.astype(x.dtype)
    return x, values, near
