"""Vectors on an integer grid: exact values, packed rows, exact sums.

Most values fit 16 bits, and all of them are exact whatever their size: what
does not fit 64 bits becomes Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
_WIDTHS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}
_BIG = 0  # tag of rows whose numbers are written as decimal text
_LIMB = 32
SUMS = "slot long, limb int, total long"


def on_grid(column: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that count, their sizes, floor(``scale`` times each component), row by row).

    ``scale`` is a power of two. A row counts if its list is there, holds no null
    and only finite numbers, and, where ``width`` is given, exactly so many.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    real = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    held = np.maximum(size, 0)
    ends = np.concatenate(([0], np.cumsum(held)))
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(real))))
    good = (size >= 0) & (odd[ends[1:]] == odd[ends[:-1]])
    if width is not None:
        good &= size == width
    real = real[np.repeat(good, held)]
    if np.abs(real).max(initial=0) < 2.0**52 / scale:
        cells = np.floor(scale * real).astype(np.int64)
    else:
        cells = np.empty(len(real), object)
        cells[:] = [math.floor(scale * x) if abs(x) < 2.0**52 else int(x) * scale for x in real.tolist()]
    return np.flatnonzero(good), size[good], cells


def pack(sizes: np.ndarray, cells: np.ndarray) -> pa.Array:
    """One binary value for each vector; equal vectors, and only those, have equal ones."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if cells.dtype == object:
        return pa.array([_packed(cells[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    reach = np.where(cells < 0, ~cells, cells)
    most = np.zeros(len(sizes), np.int64)
    if len(cells):
        most[sizes > 0] = np.maximum.reduceat(reach, ends[:-1][sizes > 0])
    width = np.select([most < 1 << 15, most < 1 << 31], [2, 4], 8)
    places = np.concatenate(([0], np.cumsum(1 + width * sizes)))
    data = np.zeros(places[-1], np.uint8)
    for w, size in set(zip(width.tolist(), sizes.tolist(), strict=True)):
        rows = np.flatnonzero((width == w) & (sizes == size))
        body = cells[ends[rows][:, None] + np.arange(size)].astype(_WIDTHS[w]).reshape(len(rows), size)
        data[places[rows]] = w
        data[places[rows][:, None] + 1 + np.arange(w * size)] = np.ascontiguousarray(body).view(np.uint8).reshape(len(rows), w * size)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _packed(numbers: list[int]) -> bytes:
    most = max((x if x >= 0 else ~x for x in numbers), default=0)
    for width, kind in _WIDTHS.items():
        if most < 1 << 8 * width - 1:
            return bytes([width]) + np.array(numbers, kind).tobytes()
    return bytes([_BIG]) + ",".join(map(str, numbers)).encode()


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    """Matrix of packed vectors; short ones are filled with zeros, numbers over 64 bits are Python's."""
    values = column.to_pylist()
    if values and len({(v[0], len(v)) for v in values}) == 1 and values[0][0] in _WIDTHS:
        kind = _WIDTHS[values[0][0]]
        rows = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)[:, 1:]
        rows = np.ascontiguousarray(rows).view(kind).astype(np.int64).reshape(len(values), -1)
        return np.pad(rows, ((0, 0), (0, dims - rows.shape[1]))) if rows.shape[1] < dims else rows
    out = np.zeros((len(values), dims), object if any(v[0] == _BIG for v in values) else np.int64)
    for row, v in zip(out, values, strict=True):
        numbers = np.frombuffer(v[1:], _WIDTHS[v[0]]) if v[0] in _WIDTHS else [int(x) for x in v[1:].decode().split(",")]
        row[: len(numbers)] = numbers
    return out


def limbs(slots: np.ndarray, totals: Iterable) -> pa.RecordBatch:
    """Rows (slot, limb, total) of exact numbers, in digits that sums of 2**31 rows cannot overflow."""
    rows = []
    for slot, total in zip(slots, totals, strict=True):
        limb, rest = 0, int(total)
        while not -(1 << _LIMB - 1) <= rest < 1 << _LIMB - 1:
            rows.append((slot, limb, rest & (1 << _LIMB) - 1))
            limb, rest = limb + 1, rest >> _LIMB
        rows.append((slot, limb, rest))
    slot, limb, total = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(slot, pa.int64()), pa.array(limb, pa.int32()), pa.array(total, pa.int64())], ["slot", "limb", "total"])


def total_by_slot(parts: DataFrame) -> dict[int, int]:
    """Exact sums of ``limbs`` rows of all tasks; as many entries as there are slots."""
    sums: dict[int, int] = {}
    for r in parts.groupBy("slot", "limb").agg(F.sum("total").alias("total")).collect():
        sums[r["slot"]] = sums.get(r["slot"], 0) + (r["total"] << _LIMB * r["limb"])
    return sums


def exact_sum(matrix: np.ndarray) -> list[int]:
    """Sums of the columns, as Python integers."""
    if matrix.dtype == object or np.abs(matrix).max(initial=0) >= 2**31:
        return [sum(map(int, c)) for c in matrix.T]
    return [int(x) for x in matrix.sum(axis=0)]


def longs(values: Iterable[int | None]) -> pa.Array:
    """Long values, null where one is missing or does not fit."""
    return pa.array([int(v) if v is not None and abs(v) <= LONG_MAX else None for v in values], pa.int64())


def small_parts(batches: Iterator[pa.RecordBatch], cells: int = 1 << 20, width: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``cells`` numbers."""
    step = max(1, cells // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
