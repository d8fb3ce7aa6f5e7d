"""Records of delimited files whose quoted fields may hold newlines, read in many tasks.

Whether a line starts inside a quoted field depends on all lines before it. Each
line maps the two states (outside, inside) to the state after it, and such maps
compose. A first pass reduces every block of a file to one map; a running
composition over blocks, a row each, gives the state at each block's start. In a
second pass each block puts its own lines together. Only records that run over
the edge of a block, at most one for each edge, are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators.joins import BROADCAST_ROWS
from kindred.operators.terms import cuts

_PLACE = "file string, block bigint, row bigint"
_RUN_BYTES = 2 << 20  # of lines that are put together at once; what is made of them holds several copies
_NEWLINE = pa.scalar("\n", pa.large_string())


def _ends_inside(value: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a field is still open after a line that starts outside, and after one that starts inside."""
    d = re.escape(delimiter)
    body = r'[^"]*+(?:""[^"]*+)*+'
    closed = rf'(?:"{body}"[^{d}]*+{d}|[^"{d}][^{d}]*+{d}|{d})*+'
    plain = ~value.contains('"')
    outside = ~plain & value.rlike(rf'\A{closed}"{body}\z')
    inside = plain | value.rlike(rf'\A{body}(?:\z|"[^{d}]*+{d}{closed}"{body}\z)')
    return outside, inside


def _after(outside: np.ndarray, inside: np.ndarray, start: int) -> np.ndarray:
    """State after each line, if the first one starts in ``start``."""
    swaps = np.cumsum(outside & ~inside)
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    known = fixed >= 0
    at = np.maximum(fixed, 0)
    return np.where(known, outside[at] + swaps - swaps[at], start + swaps) % 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Neighbouring rows of one block, with lines of about ``_RUN_BYTES`` where there are lines."""
    file, block = batch["file"], batch["block"]
    if not len(file):
        return
    change = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
    edges = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), len(file)]
    for low, high in zip(edges, edges[1:], strict=False):
        place, run = (file[low].as_py(), block[low].as_py()), batch.slice(low, high - low)
        size = pc.binary_length(run["value"]).to_numpy() if "value" in batch.schema.names else np.zeros(len(run), np.int64)
        for a, b in cuts(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), _RUN_BYTES):
            yield place, run.slice(a, b - a)


def _flags(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(run[c].to_numpy(zero_copy_only=False) for c in ("outside", "inside"))


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after each block by its state before, and whether a record begins in it though it starts inside."""

    def row(place: tuple[str, int], ends: list[int], begins: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"file": place[0], "block": place[1], "from_outside": ends[0], "from_inside": ends[1], "begins": begins}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.int32()), ("from_inside", pa.int32()), ("begins", pa.bool_())]),
        )

    place, ends, begins = None, [0, 1], False
    for batch in batches:
        for here, run in _runs(batch):
            if here != place:
                if place is not None:
                    yield row(place, ends, begins)
                place, ends, begins = here, [0, 1], False
            else:
                begins |= ends[1] == 0  # the run starts outside
            maps = _flags(run)
            after = [_after(*maps, start) for start in ends]
            begins |= bool((after[1][:-1] == 0).any())
            ends = [int(a[-1]) for a in after]
    if place is not None:
        yield row(place, ends, begins)


_PIECES = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("value", pa.large_string()),
     ("origin", pa.int64()), ("begun", pa.bool_()), ("closed", pa.bool_()), ("head", pa.bool_())]
)


class _Block:
    """Lines of one block on their way to records."""

    def __init__(self, place: tuple[str, int], state: int | None, origin: int | None):
        if state is None:
            raise RuntimeError(f"{place[0]} was split differently in two passes; read it again")
        self.file, self.number = place
        self.state, self.origin = state, origin
        self.first = True  # no record of the block has been given out
        self.open: list[str] = []
        self.begun, self.row = state == 0, None

    def pieces(self, rows: list[int], values: pa.Array, begun: list[bool], closed: bool) -> pa.RecordBatch:
        n = len(rows)
        head = [self.first and self.number == 0 and begun[0], *[False] * (n - 1)]
        self.first = False
        return pa.record_batch(
            [pa.array([self.file] * n, pa.string()), pa.array([self.number] * n, pa.int64()), pa.array(rows, pa.int64()), values.cast(pa.large_string()),
             pa.array([self.number if b else self.origin for b in begun], pa.int64()), pa.array(begun), pa.array([closed] * n), pa.array(head)],
            schema=_PIECES,
        )

    def take(self, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        after = _after(*_flags(run), self.state)
        values, rows = run["value"].cast(pa.large_string()), run["row"].to_numpy()
        if not self.open:
            self.begun, self.row = self.state == 0, int(rows[0])
        self.state = int(after[-1])
        ends = np.flatnonzero(after == 0)
        last = int(ends[-1]) + 1 if len(ends) else 0
        if last:
            begin = np.concatenate([[0], ends[:-1] + 1])
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(begin, last), pa.int64()), values[:last]), _NEWLINE)
            if self.open:
                joined = pa.concat_arrays([pa.array(["\n".join([*self.open, joined[0].as_py()])], pa.large_string()), joined[1:]])
                self.open = []
            yield self.pieces([self.row, *rows[begin[1:]].tolist()], joined, [self.begun, *[True] * (len(begin) - 1)], True)
            if last < len(rows):
                self.begun, self.row = True, int(rows[last])
        self.open += values[last:].to_pylist()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self.pieces([self.row], pa.array(["\n".join(self.open)], pa.large_string()), [self.begun], False)


def _together(whole: bool) -> Callable:
    """Records that lie in one block, or the pieces of all others."""

    def chosen(pieces: pa.RecordBatch) -> pa.RecordBatch:
        inside = pc.and_(pieces["begun"], pieces["closed"])
        return pieces.filter(inside if whole else pc.invert(inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        for batch in batches:
            for here, lines in _runs(batch):
                if here != place:
                    if block is not None:
                        yield from map(chosen, block.rest())
                    place, block = here, _Block(here, lines["start"][0].as_py(), lines["origin"][0].as_py())
                yield from map(chosen, block.take(lines))
        if block is not None:
            yield from map(chosen, block.rest())

    return run


def _most_blocks(spark: SparkSession, text: DataFrame) -> int:
    """Blocks that a scan can have at most: Spark makes none smaller than its cost of opening a file."""
    size = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = min(int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()), int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    return len(text.inputFiles()) + size // max(1, least)


def _block_starts(lines: DataFrame) -> DataFrame:
    """(file, block, start, origin): the state at each block's start, and the block in which a record open there began."""
    maps = lines.select("file", "block", "outside", "inside").mapInArrow(
        _block_maps, "file string, block bigint, from_outside int, from_inside int, begins boolean"
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_outside") > F.col("from_inside")).cast("int")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("state"), F.col("swaps")))
    start = F.coalesce(F.col("fixed.state"), F.lit(0)) + F.col("swaps") - swap - F.coalesce(F.col("fixed.swaps"), F.lit(0))
    begins = F.when((F.col("start") == 0) | F.col("begins"), F.col("block"))
    return (
        maps.withColumn("swaps", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
        .withColumn("start", F.pmod(start, F.lit(2)).cast("int"))
        .select("file", "block", "start", F.last(begins, ignorenulls=True).over(before).alias("origin"))
    )


def read_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    r"""(file, block, row, value, head): one row for each record of the files at ``path``.

    A field is quoted if the quote is its first character; doubled quotes inside
    stand for one. ``value`` is the record as it stands in the file, with the newlines of its
    quoted fields; ``\n`` or ``\r\n`` ends it. A field that is never closed runs to the
    end of its file, without the newline that ends the file. (file, block, row) follows the order of the file; ``head`` marks the first record of each file.

    The table of blocks has a row for each block, which the driver lists anyway to plan
    the scan; if there may be more than ``BROADCAST_ROWS`` of them, lines are shuffled by block instead.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    outside, inside = _ends_inside(F.col("value"), delimiter)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
        outside.alias("outside"),
        inside.alias("inside"),
    )
    starts = _block_starts(lines)
    if _most_blocks(spark, text) <= BROADCAST_ROWS:
        known = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        known = lines.join(starts.hint("merge"), ["file", "block"], "left").repartition("file", "block")
        known = known.sortWithinPartitions("file", "block", "row")
    schema = f"{_PLACE}, value string, origin bigint, begun boolean, closed boolean, head boolean"
    whole = known.mapInArrow(_together(True), schema).select("file", "block", "row", "value", "head")
    pieces = known.mapInArrow(_together(False), schema).groupBy("file", F.col("origin").alias("block"))
    over_edges = pieces.agg(
        F.min_by("row", F.col("block")).alias("row"),
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "value")))["value"], "\n").alias("value"),
        F.bool_or("head").alias("head"),
    ).select("file", "block", "row", "value", "head")
    ended = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return whole.unionByName(over_edges).withColumn("value", ended)
