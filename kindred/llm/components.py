"""Connected components of a graph that exists only as a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import written


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (columns ``a`` and ``b``).

    Returns ``node`` and ``component`` for every node with an edge to another
    one. Alternates the two star operations: each node links its larger, then
    its smaller neighbours to the smallest node it knows, until the edges are
    stars. Neighbourhoods are only ever reduced to their minimum and joined
    again, so a node with very many edges is never gathered. Edges with a null
    end and loops are ignored; direction and repetition of edges do not matter;
    an empty table gives an empty table.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(_proper(edges), "edges")
    state = _fingerprint(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = _proper(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(_proper(small.unionByName(least.withColumnRenamed("m", "b"))), "edges")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _proper(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    """Two numbers that stay the same only if the set of edges does."""
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
