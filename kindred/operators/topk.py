"""Top-k similarity search for tables of queries.

Scores are rounded to six digits before ranking and ties go to the smaller
item id, so that answers do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kindred.operators.joins import by_blocks
from kindred.session import written

SELF_SCORE = 0.9999  # fixed value: at this score and above an item is the query itself
DIGITS = 6
_UNITS = 10**DIGITS

# Queries per block; the bytes of a block are checked when it is collected.
SPARSE_BLOCK = 2_000
DENSE_BLOCK = 4_096

_CELL_BUDGET = 4_000_000  # scores held at once in a task: 32 MB
_BLOCK_BYTES = 1 << 30  # what a block of queries may take in a task


ONE_TASK_ROWS = 10_000_000  # rows that may meet in the last task of a global top-n


def top_rows(df: DataFrame, order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows in ``order``.

    Each task of a global limit sends up to n rows to a single one. Where that
    adds up, rows are first cut to n in each of ``salts`` groups.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks * n > ONE_TASK_ROWS:
        group = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
        df = df.withColumn("_group", group).withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_group", "_rank")
    return df.orderBy(*order).limit(n)


def rank_items(scored: DataFrame, k: int) -> DataFrame:
    """The k best items per query with their rank, from 1.

    Spark keeps k rows per query in each task before it shuffles.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def without_self(ranked: DataFrame, n: int) -> DataFrame:
    """Drop near-identical items from ranked answers, then keep n and rank anew."""
    return rank_items(ranked.drop("rank").filter(F.col("score") < SELF_SCORE), n)


def topk_sparse(
    query_terms: Callable[[DataFrame], DataFrame],
    queries: DataFrame,
    packed: DataFrame,
    k: int,
    below: float | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank) by inner product of term weights.

    ``query_terms`` turns a block of ``queries`` into (query_id, term, weight).
    ``packed`` is (item_id, terms, weights), all terms of an item in one row.
    Items are scored where they lie, as matrix products of a few items with the
    terms of the block; a batch gives out k rows per query, never all of its
    pairs, and only those are shuffled. Items without a term of the query are no
    answers. ``below`` drops scores from that value on before ranking.
    """

    return by_blocks(queries, "query_id", SPARSE_BLOCK, lambda block: score_sparse(query_terms(block), packed, k, below))


def score_sparse(wanted: DataFrame, packed: DataFrame, k: int, below: float | None = None) -> DataFrame:
    """``topk_sparse`` of one block of queries, given as ``wanted`` (query_id, term, weight)."""
    schema = StructType(
        [
            StructField("query_id", wanted.schema["query_id"].dataType),
            StructField("item_id", packed.schema["item_id"].dataType),
            StructField("score", DoubleType()),
        ]
    )
    table = wanted.select("query_id", "term", "weight").toArrow().combine_chunks()
    if table.nbytes > _BLOCK_BYTES:
        raise ValueError(f"a block of queries takes {table.nbytes} bytes; use fewer queries a block")
    if not table.num_rows:
        return rank_items(packed.sparkSession.createDataFrame([], schema), k)
    query, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    where = (query.indices.to_numpy(), term.indices.to_numpy(), table.column("weight").to_numpy())
    scorer = _sparse_scorer(query.dictionary, term.dictionary, where, k, below)
    return rank_items(packed.select("item_id", "terms", "weights").mapInArrow(scorer, schema), k)


def _sparse_scorer(ids: pa.Array, terms: pa.Array, where: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, below: float | None):
    """A ``mapInArrow`` function: k best items per query for every few items.

    The block's weights are one matrix, made in slices of its queries so that a
    slice stays within ``_CELL_BUDGET`` whatever the vocabulary.
    """
    query, term, weight = where
    order = np.argsort(query, kind="stable")
    query, term, weight = query[order], term[order], weight[order]
    wide = max(1, 8 * _CELL_BUDGET // len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered = batch.take(pc.sort_indices(batch.column(0)))
            lists = ordered.column(1)
            place = pc.index_in(lists.flatten(), value_set=terms)
            item = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            value = ordered.column(2).flatten().to_numpy(zero_copy_only=False)
            known = pc.is_valid(place).to_numpy(zero_copy_only=False)
            place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[known]
            item, value = item[known], value[known]
            step = max(1, _CELL_BUDGET // len(terms))
            for first in range(0, len(lists), step):
                a, b = np.searchsorted(item, (first, first + step))
                if a == b:
                    continue
                vectors = np.zeros((min(step, len(lists) - first), len(terms)))
                vectors[item[a:b] - first, place[a:b]] = value[a:b]
                for low in range(0, len(ids), wide):
                    c, d = np.searchsorted(query, (low, low + wide))
                    matrix = np.zeros((min(wide, len(ids) - low), len(terms)))
                    matrix[query[c:d] - low, term[c:d]] = weight[c:d]
                    for q, i, score in _best_of_batch(np.arange(len(matrix)), matrix, vectors, k, below, shared=True):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(q + low)), ordered.column(0).take(pa.array(i + first)), pa.array(score)],
                            ["query_id", "item_id", "score"],
                        )

    return run


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    widths = pc.list_value_length(column)
    if column.null_count or pc.min(widths) != pc.max(widths):
        raise ValueError("vectors must be present and of one width")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _best_of_batch(
    query_rows: np.ndarray, matrix: np.ndarray, vectors: np.ndarray, k: int, below: float | None, shared: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, item row, score) of the k best items per query in one batch.

    Items come sorted by id. With ``shared`` a score of nothing is no answer. Score and position form one integer key, so ties
    are resolved exactly and no order within the batch is left open.
    """
    n = len(vectors)
    keep = min(k, n)
    step = max(1, _CELL_BUDGET // n)
    for start in range(0, len(query_rows), step):
        rows = query_rows[start : start + step]
        product = matrix[rows] @ vectors.T
        units = np.rint(product * _UNITS).astype(np.int64)
        key = units * n + np.arange(n - 1, -1, -1)
        barred = np.zeros(units.shape, bool) if below is None else units >= round(below * _UNITS)
        if shared:
            barred |= product <= 0
        key[barred] = np.iinfo(np.int64).min
        best = np.argpartition(~key, keep - 1, axis=1)[:, :keep]
        score = np.take_along_axis(units, best, axis=1)
        query = np.repeat(rows, keep)
        item, score = best.ravel(), score.ravel()
        open_ = ~np.take_along_axis(barred, best, axis=1).ravel()
        query, item, score = query[open_], item[open_], score[open_]
        yield query, item, score / _UNITS


def _scorer(ids: pa.Array, matrix: np.ndarray, k: int, below: float | None, probes: dict[int, np.ndarray] | None):
    """A ``mapInArrow`` function: k best items per query for each batch of vectors."""
    everyone = np.arange(len(ids))

    def answers(batch: pa.RecordBatch, query_rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ordered = batch.take(pc.sort_indices(batch.column(0)))
        vectors = as_matrix(ordered.column(1))
        for query, item, score in _best_of_batch(query_rows, matrix, vectors, k, below):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query)), ordered.column(0).take(pa.array(item)), pa.array(score)],
                ["query_id", "item_id", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if probes is None:
                yield from answers(batch, everyone)
                continue
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                if cell in probes:
                    yield from answers(batch.take(pa.array(np.flatnonzero(cells == cell))), probes[cell])

    return run


def score_block(
    block: DataFrame,
    vectors: DataFrame,
    k: int,
    below: float | None = None,
    probes: Callable[[pa.Array, np.ndarray], dict[int, np.ndarray]] | None = None,
) -> DataFrame:
    """Score one block of query vectors against every batch of item vectors.

    The block, whose size the caller has checked, travels with the task; item
    vectors are not moved. Matrix products replace pairs of rows: a batch
    gives out k rows per query, never all of its pairs.
    """
    table = block.select("query_id", "embedding").toArrow().combine_chunks()
    if table.nbytes > _BLOCK_BYTES:
        raise ValueError(f"a block of {table.num_rows} queries takes {table.nbytes} bytes; use fewer queries a block")
    fields = {f.name: f.dataType for f in vectors.schema.fields}
    schema = StructType(
        [
            StructField("query_id", block.schema["query_id"].dataType),
            StructField("item_id", fields["item_id"]),
            StructField("score", DoubleType()),
        ]
    )
    if not table.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    ids = table.column("query_id").combine_chunks()
    matrix = as_matrix(table.column("embedding").combine_chunks())
    columns = ["item_id", "embedding"]
    cells = None
    if probes is not None:
        columns.append("cell_id")
        cells = probes(ids, matrix)
        vectors = vectors.filter(F.col("cell_id").isin(*[int(c) for c in cells]))
    return vectors.select(*columns).mapInArrow(_scorer(ids, matrix, k, below, cells), schema)


def topk_dense(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    below: float | None = None,
    encode: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank) by inner product, compared exactly.

    ``vectors`` is (item_id, embedding). ``queries`` is (query_id, embedding),
    or anything that ``encode`` turns into that. One small block of queries is
    compared with all vectors where they lie; more of them go through ``topk_boxes``,
    which gives the same answers.
    """
    if queries.limit(DENSE_BLOCK + 1).count() <= DENSE_BLOCK:
        return rank_items(score_block(encode(queries) if encode else queries, vectors, k, below), k)
    from kindred.operators.boxes import topk_boxes  # which takes its scores from here

    return topk_boxes(written(encode(queries), "encoded") if encode else queries, vectors, k, below)
