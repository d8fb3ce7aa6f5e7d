"""Joins of a large table with a table that is usually, but not provably, small."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import fresh_path, written

BROADCAST_ROWS = 1_000_000  # narrow rows, a few dozen bytes each


HOT_KEYS = 1024  # keys that are joined by broadcast: all with a hundredth of the rows are among them


def frequent_keys(big: DataFrame, on: str, most: int = HOT_KEYS) -> DataFrame:
    """(on) at most ``most`` keys, the most frequent ones by a sketch that tasks fill and merge.

    The sketch tracks 64 times as many keys and is off by at most 3.5 / (64 * most) of all rows.
    """
    found = big.filter(F.col(on).isNotNull()).agg(F.expr(f"approx_top_k(`{on}`, {most}, {64 * most})").alias("found"))
    return found.select(F.explode(F.col("found")["item"]).alias(on))


def lookup_join(big: DataFrame, small: DataFrame, on: str, row_bound: int | None, how: str = "inner") -> DataFrame:
    """Join ``big`` to the keyed table ``small`` without a hot spot.

    ``small`` has one row per key; ``how`` is ``inner`` or ``left``. Up to ``BROADCAST_ROWS``
    rows, as promised by ``row_bound``, ``small`` is broadcast and ``big`` does not move.
    Beyond that the most frequent keys of ``big`` are found first: their rows stay where they
    are and get the few matches by broadcast, and only the others are shuffled. A null key
    matches nothing and is not shuffled either.
    """
    if row_bound is not None and row_bound <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    # Written, as both sides have to split the keys in the same way.
    hot = written(frequent_keys(big, on), "hot-keys")
    taken = F.broadcast(small.join(F.broadcast(hot), on, "left_semi"))
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    near = F.col("_hot") | F.col(on).isNull()
    stays = marked.filter(near).drop("_hot").join(taken, on, how)
    moves = marked.filter(~F.coalesce(near, F.lit(False))).drop("_hot").join(small, on, how)
    return stays.unionByName(moves)


def row_bound(df: DataFrame, limit: int = BROADCAST_ROWS) -> int | None:
    """Row count of ``df`` if it is at most ``limit``, else None."""
    rows = df.limit(limit + 1).count()
    return rows if rows <= limit else None


def by_blocks(
    queries: DataFrame, key: str, block_rows: int, one_pass: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Answer a query table of any size in blocks small enough to broadcast.

    One block is one lazy plan. More blocks run one after the other, each
    appending its answers to a table, so that memory holds a single block.
    """
    if queries.limit(block_rows + 1).count() <= block_rows:
        return one_pass(queries)
    blocks = math.ceil(1.25 * queries.count() / block_rows)
    path = fresh_path(queries.sparkSession, "answers")
    number = F.pmod(F.xxhash64(key), F.lit(blocks))
    for block in range(blocks):
        answers = one_pass(queries.filter(number == block))
        answers.write.mode("append").parquet(path)
    return queries.sparkSession.read.schema(answers.schema).parquet(path)
