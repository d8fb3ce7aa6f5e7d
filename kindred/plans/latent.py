"""An encoder fitted to the corpus: leading right singular vectors of its TF-IDF matrix.

Randomized subspace iteration: a random basis of the term space is multiplied by
A'A, A having a row for each item, until it holds the directions in which items
differ most. The postings are stored once with numbers for terms, as bytes; each
product is one pass over these. A task sums the rows it has into a matrix of terms
by directions; only these sums are shuffled, by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from kindred.operators.terms import packed_weights
from kindred.plans.model import Model, TermOptions
from kindred.session import SPLIT_BYTES, forget, written

MATRIX_BYTES = 256 << 20  # terms by directions, in doubles, held by the driver and each task
OVERSAMPLE = 16  # directions beyond those wanted
#: Options of the postings that rounds read: Spark's reader holds a row group of them.
CODED = {"parquet.block.size": SPLIT_BYTES}
_CHUNK = 100_000  # postings multiplied at once
_ROWS, _DENSE = 128, 25_000  # items, and postings of theirs, that are made a dense matrix


def _entries(batch: pa.RecordBatch, terms: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row edges, columns, weights) of some rows at a time; every term is known."""
    lists = batch["terms"]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    column = pc.index_in(lists.flatten().cast(terms.type), value_set=terms).to_numpy()
    weight = batch["weights"].flatten().to_numpy()
    low = 0
    while low < len(lists):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + _CHUNK, "right")) - 1)
        span = slice(offsets[low], offsets[high])
        yield low, offsets[low : high + 1] - offsets[low], column[span], weight[span]
        low = high


def _runs(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of some rows at a time: ``_ROWS``, or fewer with ``_DENSE`` postings together."""
    low = 0
    while low < len(edges) - 1:
        high = min(low + _ROWS, max(low + 1, int(np.searchsorted(edges, edges[low] + _DENSE, "right")) - 1), len(edges) - 1)
        yield low, high
        low = high


def _sums(rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` between neighbouring edges, of which some may be equal."""
    out = np.zeros((len(begin) - 1, rows.shape[1]))
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(rows, begin[some], axis=0)
    return out


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Numbers between neighbouring edges as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows that ``_binary`` made, and their edges."""
    size, column = np.dtype(kind).itemsize, column.cast(pa.binary())
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return np.frombuffer(values.tobytes(), kind), (edges - edges[0]) // size


def _coded(known) -> Callable:  # noqa: ANN001
    """Places of the terms among the known ones, and weights, of each row as bytes, which every round then reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, edges, column, weight in _entries(batch, known.value):
                yield pa.record_batch([_binary(column.astype(np.int32), edges), _binary(np.ascontiguousarray(weight), edges)], ["slots", "weights"])

    return run


def _gram(basis) -> Callable:  # noqa: ANN001
    """Sums over a task's items of A'A times the basis, a row for each term that occurs.

    A few items at a time are a dense matrix of the terms that they have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = basis.value
        total, met = np.zeros(directions.shape), np.zeros(len(directions), bool)
        place = np.zeros(len(directions), np.int64)
        for batch in filter(len, batches):
            slots, edges = _numbers(batch.column(0), np.int32)
            weights, _ = _numbers(batch.column(1), np.float64)
            for low, high in _runs(edges):
                span = slice(edges[low], edges[high])
                occurs = np.zeros(len(directions), bool)
                occurs[slots[span]] = True
                here = np.flatnonzero(occurs)
                place[here] = np.arange(len(here))
                matrix = np.zeros((high - low, len(here)))
                matrix[np.repeat(np.arange(high - low), np.diff(edges[low : high + 1])), place[slots[span]]] = weights[span]
                total[here] += matrix.T @ (matrix @ directions[here])
                met[here] = True
        slots = np.flatnonzero(met)
        for a in range(0, len(slots), 4096):
            some = slots[a : a + 4096]
            columns = [pa.array(np.ascontiguousarray(c)) for c in total[some].T]
            yield pa.record_batch([pa.array(some), *columns], ["slot", *(f"c{j}" for j in range(len(columns)))])

    return run


def _project(known, loadings) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, edges, column, weight in _entries(batch, known.value):
                place = _sums(loadings.value[column] * weight[:, None], edges)
                length = np.linalg.norm(place, axis=1, keepdims=True)
                unit = np.divide(place, length, out=np.zeros_like(place), where=length > 0).astype(np.float32)
                ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * unit.shape[1])
                vectors = pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))
                yield pa.record_batch([batch.column(0).slice(low, len(unit)), vectors], [batch.schema.names[0], "embedding"])

    return run


@dataclass(frozen=True)
class LatentSpace:
    """(key, embedding) of texts by their TF-IDF weights, projected on the fitted directions; an ``Encoder``.

    Vectors have unit length; a text without a known term has the zero vector.
    ``strengths`` are the sums of squared projections of the fitted items, falling.
    """

    components: DataFrame  # (term, idf, loadings), a row for each term
    strengths: tuple[float, ...]
    options: TermOptions

    def matrix(self) -> tuple[pa.Array, np.ndarray]:
        """Terms and their loadings; ``fit_latent`` has bounded them by ``MATRIX_BYTES``."""
        found = self.components.select("term", "loadings").toArrow()
        terms, loadings = (found[c].combine_chunks() for c in ("term", "loadings"))
        return terms.cast(pa.string()), loadings.flatten().to_numpy().reshape(len(terms), len(self.strengths))

    def __call__(self, docs: DataFrame, key: str, text_col: str, parts: int | None = None) -> DataFrame:
        """Texts are shuffled by key, into ``parts`` if they are given."""
        o = self.options
        context = docs.sparkSession.sparkContext
        known, loadings = map(context.broadcast, self.matrix())
        out = StructType([docs.schema[key], StructField("embedding", ArrayType(FloatType()))])
        then = (_project(known, loadings), out)
        found = packed_weights(docs, self.components, key, text_col, o.ngram_min, o.ngram_max, False, o.max_features, parts, then)
        zero = F.array_repeat(F.lit(0.0).cast("float"), len(self.strengths))
        return docs.select(key).join(found, key, "left").select(key, F.coalesce("embedding", zero).alias("embedding"))


def fit_latent(model: Model, dim: int = 64, rounds: int = 12, tolerance: float = 1e-4, seed: int = 7) -> LatentSpace:
    """The ``dim`` leading directions of the items of a model that was fitted with terms.

    Ends when a round adds less than ``tolerance`` to the sum of strengths, or after
    ``rounds``. The vocabulary times the directions may take ``MATRIX_BYTES``; more
    is refused. A vocabulary smaller than ``dim`` gives as many directions as it has terms.
    """
    vocab = model.vocab.select("term", "idf")
    most = MATRIX_BYTES // (8 * (dim + OVERSAMPLE))
    listed = vocab.limit(most + 1).orderBy("term").toArrow()
    n = listed.num_rows
    if not 0 < n <= most:
        raise ValueError(f"a vocabulary of 1 to {most} terms is needed for {dim} directions")
    spark = vocab.sparkSession
    terms = listed["term"].combine_chunks().cast(pa.string())
    known = spark.sparkContext.broadcast(terms)
    coded = written(model.packed.select("terms", "weights").mapInArrow(_coded(known), "slots binary, weights binary"), "coded", **CODED)
    width = min(dim + OVERSAMPLE, n)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    names = [f"c{j}" for j in range(width)]
    schema = "slot bigint, " + ", ".join(f"{c} double" for c in names)
    reached = 0.0
    for left in reversed(range(rounds)):
        sent = spark.sparkContext.broadcast(basis)
        partial = coded.mapInArrow(_gram(sent), schema)
        # a row for each term, which the bound above covers
        summed = partial.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        sent.destroy()
        image = np.zeros((n, width))
        image[summed["slot"].to_numpy()] = np.stack([summed[c].to_numpy() for c in names], 1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        falling = np.argsort(-values, kind="stable")[: min(dim, n)]
        total = float(values[falling].sum())
        if left == 0 or total - reached <= tolerance * total:
            break
        reached, basis = total, np.linalg.qr(image)[0]
    forget(coded)
    loadings = basis @ turn[:, falling]
    peak = loadings[np.abs(loadings).argmax(0), np.arange(len(falling))]
    loadings = loadings * np.where(peak < 0, -1.0, 1.0)
    rows = pa.table({"term": listed["term"], "idf": listed["idf"], "loadings": pa.array(list(loadings), pa.list_(pa.float64()))})
    return LatentSpace(spark.createDataFrame(rows), tuple(np.maximum(values[falling], 0).tolist()), model.terms)


def save_latent(space: LatentSpace, path: str) -> None:
    spark = space.components.sparkSession
    space.components.coalesce(1).write.mode("overwrite").parquet(f"{path}/components")
    strengths = spark.createDataFrame([(i, s) for i, s in enumerate(space.strengths)], "component int, strength double")
    strengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/strengths")


def load_latent(spark: SparkSession, path: str, options: TermOptions = TermOptions()) -> LatentSpace:
    """What ``save_latent`` wrote; ``options`` are those of the model it was fitted to."""
    strengths = spark.read.parquet(f"{path}/strengths").orderBy("component").collect()
    return LatentSpace(spark.read.parquet(f"{path}/components"), tuple(r["strength"] for r in strengths), options)
