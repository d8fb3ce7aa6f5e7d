"""Exact top-k search for very many queries: vectors are stored by cells, and boxes rule most of them out.

A tree of splits, grown on a bounded sample, deals all vectors to cells; the sample decides on
nothing but the order of storage. Inside a task, the vectors of a cell are halved on until few are
left. The distance of a query from the box around some vectors bounds its scores with them, and a
query is scored only where that bound reaches the k-th score it is known to have.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kindred.operators.topk import DENSE_BLOCK, DIGITS, _best_of_batch, as_matrix, rank_items
from kindred.session import SPLIT_BYTES, fresh_path, written

BLOCK_BYTES = 32 << 20  # of a block's query vectors, which go to every task
SAMPLE_BYTES = 32 << 20  # of the vectors that the tree is grown on
MOST_CELLS = 4_096
CELL_ROWS = 8_192  # vectors that a cell should hold
DRAWN = 32  # vectors of the sample for each cell
LEAF_ROWS = 512  # vectors that are scored together
_AT_ONCE = 65_536  # distances worked out at once, where they are few
_QUERIES = 2_048  # that are scored with a leaf at once
_UNIT = 10.0**-DIGITS


class Tree(NamedTuple):
    """Splits of space; a child is the number of a split, or of a cell as its complement."""

    column: np.ndarray
    value: np.ndarray
    children: np.ndarray  # up to the value, and above it
    sizes: np.ndarray  # rows of the sample in each cell

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        at = np.full(len(vectors), 0 if len(self.column) else -1)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            node = at[open_]
            above = vectors[open_, self.column[node]] > self.value[node]
            at[open_] = self.children[node, above.astype(int)]
            open_ = open_[at[open_] >= 0]
        return ~at


def _halves(x: np.ndarray) -> tuple[float, np.ndarray]:
    """(value, rows above it) that parts numbers which are not all the same, by their median if that leaves some above."""
    value = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
    if not (x > value).any():
        value = x[x < value].max()
    return value, x > value


def grow(sample: np.ndarray, cells: int) -> Tree:
    """Halves the widest column of the largest part until there are ``cells``, or all rows of each part are the same."""
    parts, splits, owner = [np.arange(len(sample))], [], [None]
    done: list[tuple[np.ndarray, tuple[int, int] | None]] = []
    while parts and len(parts) + len(done) < cells:
        n = max(range(len(parts)), key=lambda i: len(parts[i]))
        rows, above = parts.pop(n), owner.pop(n)
        spread = np.ptp(sample[rows], axis=0) if len(rows) > 1 else np.zeros(1)
        column = int(spread.argmax())
        if not 0 < spread[column] < np.inf:
            done.append((rows, above))
            continue
        value, right = _halves(sample[rows, column])
        if above is not None:
            splits[above[0]][2 + above[1]] = len(splits)
        for side, some in enumerate((rows[~right], rows[right])):
            parts.append(some)
            owner.append((len(splits), side))
        splits.append([column, value, 0, 0])
    done += zip(parts, owner)
    for part, (_, above) in enumerate(done):
        if above is not None:
            splits[above[0]][2 + above[1]] = ~part
    # cells are numbered from side to side, so neighbours in number lie together
    order, left = [], [0 if splits else ~0]
    while left:
        node = left.pop()
        if node < 0:
            order.append(~node)
        else:
            left += [splits[node][3], splits[node][2]]
    number = {part: cell for cell, part in enumerate(order)}
    children = np.array([[c if c >= 0 else ~number[~c] for c in s[2:]] for s in splits], int).reshape(-1, 2)
    column, value = (np.array([s[i] for s in splits], kind) for i, kind in ((0, int), (1, float)))
    return Tree(column, value, children, np.array([len(done[part][0]) for part in order]))


def _stored(vectors: DataFrame) -> tuple[Tree, DataFrame, int]:
    """(tree, vectors with their cell in its order, width); a crowded cell is dealt to several tasks."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(1, width or 1)
    cells = min(MOST_CELLS, -(-n // CELL_ROWS), max(1, SAMPLE_BYTES // (8 * width * DRAWN)))
    step = max(1, n // (DRAWN * max(1, cells)))
    drawn = vectors.filter(F.pmod(F.xxhash64("item_id"), F.lit(step)) == 0).limit(2 * DRAWN * cells).select("embedding").toArrow().combine_chunks()
    sample = as_matrix(drawn["embedding"].combine_chunks()) if drawn.num_rows else np.zeros((0, width))
    tree = grow(sample, cells)
    tasks = np.maximum(1, np.rint(tree.sizes * len(tree.sizes) / max(1, len(sample)))).astype(np.int32)
    schema = StructType([vectors.schema["item_id"], vectors.schema["embedding"], StructField("cell_id", IntegerType()), StructField("tasks", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = tree.cells(as_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(tasks[cell])], schema.names)

    parts = max(-(-n * (4 * width + 24) // SPLIT_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = vectors.select("item_id", "embedding").mapInArrow(run, schema)
    placed = placed.repartition(parts, "cell_id", F.pmod(F.xxhash64("item_id"), "tasks")).sortWithinPartitions("cell_id")
    return tree, written(placed.drop("tasks"), "placed"), width


def _reached(columns: np.ndarray, rows: np.ndarray, room: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Those ``rows`` whose squared distance from a box is not above ``room``."""
    order = np.argsort(high - low)
    at = 0
    while at < len(order) and len(rows):
        some = order[at : at + max(1, _AT_ONCE // len(rows))]
        place = columns[some[:, None], rows]
        gap = np.maximum(np.maximum(low[some, None] - place, place - high[some, None]), 0)
        room = room - np.einsum("ij,ij->j", gap, gap)
        near = ~(room < 0)
        rows, room = rows[near], room[near]
        at += len(some)
    return rows


class _Block:
    """A block of queries against the vectors of a cell; ``least`` is the score that each query must reach."""

    def __init__(self, columns: np.ndarray, least: np.ndarray, k: int, below: float | None) -> None:
        self.columns, self.least, self.k, self.below = columns, least.copy(), k, below
        self.squares = np.einsum("ij,ij->j", columns, columns)

    def _scored(self, rows: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(rows), _QUERIES):
            some = rows[a : a + _QUERIES]
            for query, item, score in _best_of_batch(np.arange(len(some)), self.columns[:, some].T, vectors, self.k, self.below):
                query = some[query]
                # one unit less: the same product may be rounded otherwise in a matrix of another shape
                kept = score >= self.least[query] - 1.5 * _UNIT
                query, item, score = query[kept], item[kept], score[kept]
                if not len(query):
                    continue
                first = np.flatnonzero(np.diff(query, prepend=-1))
                worst, full = np.minimum.reduceat(score, first), np.diff(np.append(first, len(query))) == self.k
                self.least[query[first[full]]] = np.maximum(self.least[query[first[full]]], worst[full])
                yield query, item, score

    def _open(self, rows: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        longest = np.einsum("ij,ij->i", vectors, vectors).max()
        room = self.squares[rows] + longest
        room += 1e-9 * (1 + room) - 2 * (self.least[rows] - 2 * _UNIT)
        return _reached(self.columns, rows, room, low, high)

    def search(self, rows: np.ndarray, vectors: np.ndarray, near: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, item, score) of ``rows`` with vectors in the order of their ids.

        With ``near`` a query goes to one leaf; else to all that may hold a score of ``least``.
        """
        leaf = max(LEAF_ROWS, 2 * self.k)
        left = [(rows, np.arange(len(vectors)))]
        while left:
            rows, items = left.pop()
            part = vectors[items]
            low, high = part.min(axis=0), part.max(axis=0)
            finite = np.isfinite(high - low).all()
            if finite and not near:
                rows = self._open(rows, part, low, high)
            if not len(rows):
                continue
            column = int((high - low).argmax())
            if finite and high[column] == low[column]:
                items = items[: self.k]  # copies: ties go to the smaller id
            elif finite and len(items) > leaf:
                value, above = _halves(part[:, column])
                right = self.columns[column, rows] > value
                left.append((rows[right] if near else rows, items[above]))
                left.append((rows[~right] if near else rows, items[~above]))
                continue
            for query, item, score in self._scored(rows, vectors[items]):
                yield query, items[item], score


def _searcher(ids: pa.Array, columns: np.ndarray, least: np.ndarray, k: int, below: float | None, home: np.ndarray | None) -> Callable:
    """A ``mapInArrow`` function: answers of a block of queries; with ``home``, their cells, from one leaf of it."""
    everyone = np.arange(len(ids))
    order = everyone if home is None else np.argsort(home, kind="stable")
    sorted_home = None if home is None else home[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(columns, least, k, below)
        for batch in batches:
            ordered = batch.take(pc.sort_indices(batch.column(0)))
            cells = ordered.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                rows = everyone if home is None else order[slice(*np.searchsorted(sorted_home, (cell, cell + 1)))]
                if not len(rows):
                    continue
                some = np.flatnonzero(cells == cell)
                vectors = as_matrix(ordered.column(1).take(pa.array(some)))
                for query, item, score in block.search(rows, vectors, home is not None):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(query)), ordered.column(0).take(pa.array(some[item])), pa.array(score)],
                        ["query_id", "item_id", "score"],
                    )

    return run


def _blocks(counts: dict[int, int], most: int) -> list[tuple[Column, Column]]:
    """Conditions on queries, by cell and id, that make blocks of about ``most``, and on the vectors of the same cells."""
    found, first, last, held = [], None, None, 0
    cell = F.col("cell_id")
    for c in sorted(counts):
        if first is not None and held + counts[c] > most:
            found.append((cell.between(first, last), cell.between(first, last)))
            first = None
        if counts[c] > most:
            pieces = math.ceil(1.25 * counts[c] / most)
            found += [((cell == c) & (F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == i), cell == c) for i in range(pieces)]
            continue
        first, last, held = (c, c, counts[c]) if first is None else (first, c, held + counts[c])
    return found if first is None else [*found, (cell.between(first, last), cell.between(first, last))]


def topk_boxes(queries: DataFrame, vectors: DataFrame, k: int, below: float | None = None) -> DataFrame:
    """(query_id, item_id, score, rank) by inner product, compared exactly, for more queries than a small block.

    ``vectors`` (item_id, embedding) are stored by cell, and ``queries`` with theirs. A block of
    ``BLOCK_BYTES`` of queries from neighbouring cells makes two passes: each query is scored in one leaf of its
    cell, and then wherever boxes do not rule out the k-th score it has. How much they rule out
    depends on how close the answers are; no answer does. Blocks run one after the other.
    Repeated ids and ties are as in ``topk_dense``; empty tables give no answers.
    """
    spark = vectors.sparkSession
    tree, stored, width = _stored(vectors)
    schema = StructType([queries.schema["query_id"], vectors.schema["item_id"], StructField("score", DoubleType())])
    with_cell = StructType([queries.schema["query_id"], queries.schema["embedding"], StructField("cell_id", IntegerType())])

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = tree.cells(as_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], with_cell.names)

    asked = written(queries.select("query_id", "embedding").mapInArrow(celled, with_cell), "asked")

    def one_pass(block: DataFrame, near_by: Column) -> DataFrame:
        table = block.toArrow().combine_chunks()
        ids, home = table["query_id"].combine_chunks(), table["cell_id"].to_numpy()
        columns = np.ascontiguousarray(as_matrix(table["embedding"].combine_chunks()).T)
        least = np.full(len(ids), -np.inf)
        near = rank_items(stored.filter(near_by).mapInArrow(_searcher(ids, columns, least, k, below, home), schema), k)
        reached = near.filter(F.col("rank") == k).select("query_id", "score").toArrow().combine_chunks()
        if reached.num_rows:
            place = pc.index_in(ids, value_set=reached["query_id"].combine_chunks())
            least[pc.is_valid(place).to_numpy(zero_copy_only=False)] = reached["score"].to_numpy()[place.drop_null().to_numpy()]
        return rank_items(stored.mapInArrow(_searcher(ids, columns, least, k, below, None), schema), k)

    counts = {r["cell_id"]: r["count"] for r in asked.groupBy("cell_id").count().collect()}  # a row for each cell
    path = fresh_path(spark, "answers")
    rank_items(spark.createDataFrame([], schema), k).write.parquet(path)
    for mine, near_by in _blocks(counts, max(DENSE_BLOCK, BLOCK_BYTES // (8 * width))):
        block = asked.filter(mine)
        if not block.isEmpty():
            one_pass(block, near_by).write.mode("append").parquet(path)
    # rows of one query may be in several blocks where its id is repeated
    return rank_items(spark.read.schema(schema).parquet(path), k)
