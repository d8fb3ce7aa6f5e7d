"""Inverted index: postings by term in blocks, the largest weights first.

A search for a few queries reads the lists of the terms that can still bring an
item among the best, and completes what they find from the items' own postings.
The long lists of common terms, whose weights together stay below the score of
the k-th answer, are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.joins import by_blocks, lookup_join, row_bound
from kindred.operators.topk import DIGITS, rank_items, score_sparse
from kindred.session import pushing_lists, written

BLOCK = 1024  # postings in a row of the index
GROUP = 16 * BLOCK  # postings that are sorted by weight together
INDEX_BLOCK = 200  # queries that are answered at once
LOOKUP_KEYS = 10_000  # keys that are handed to the files in lists; more of them are joined
LIST_KEYS = 256  # keys in one list; readers of files test a list one value inside the other, so a long one overflows their stack
HEAD_ANSWERS = 4  # answers tried in the first step, for each answer wanted
_ROUNDING = 0.5 * 10.0**-DIGITS + 1e-9


@dataclass(frozen=True)
class TermIndex:
    """``blocks`` (term, part, number, top, items, weights) and ``tops`` (term, postings, top)."""

    blocks: DataFrame
    tops: DataFrame


def build_index(packed: DataFrame, path: str) -> TermIndex:
    """Write the index of ``packed`` (item_id, terms, weights) to a folder, in the order of terms.

    The postings of a term are dealt into parts of about ``GROUP`` by the hash of
    the item, so that no list, however long, meets in one task; each part is
    sorted by weight and cut into blocks.
    """
    entries = packed.select("item_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))
    parts = written(entries.groupBy("term").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), "index-parts")
    dealt = lookup_join(entries, parts, "term", row_bound(parts))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"))
    lists = dealt.groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("weight", "item_id")), asc=False).alias("e"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("e") / BLOCK).cast("int") - 1)
    cut = lists.select("term", "part", F.posexplode(F.transform(starts, lambda i: F.slice("e", i * BLOCK + 1, BLOCK))).alias("number", "e"))
    blocks = cut.select("term", "part", "number", F.col("e")[0]["weight"].alias("top"), F.col("e.item_id").alias("items"), F.col("e.weight").alias("weights"))
    place = ["term", "part", "number"]
    blocks.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = packed.sparkSession.read.parquet(f"{path}/blocks")
    tops = blocks.groupBy("term").agg(F.sum(F.size("items")).alias("postings"), F.max("top").alias("top"))
    tops.write.mode("overwrite").parquet(f"{path}/tops")
    return load_index(packed.sparkSession, path)


def load_index(spark, path: str) -> TermIndex:  # noqa: ANN001
    return TermIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/tops"))


def among(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` with one of the ``keys``; a few keys reach the files, which are ordered by them."""
    few = [r[0] for r in keys.select(column).distinct().limit(LOOKUP_KEYS + 1).collect()]
    if len(few) <= LOOKUP_KEYS:
        lists = [F.col(column).isin(few[i : i + LIST_KEYS]) for i in range(0, max(len(few), 1), LIST_KEYS)]
        while len(lists) > 1:  # in pairs, so that the condition is no deeper than it has to be
            lists = [reduce(or_, lists[i : i + 2]) for i in range(0, len(lists), 2)]
        return table.filter(lists[0])
    return table.join(keys.select(column).distinct(), column, "left_semi")


def essential(wanted: DataFrame, least: DataFrame) -> DataFrame:
    """Terms that can bring an item to its query's ``least`` score: ``wanted`` with ``least`` and ``slack``.

    By rising bounds, terms are left out as long as all of them together stay
    below it; ``slack`` is what those left out may add to a score.
    """
    rising = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = wanted.join(least, "query_id", "left").withColumn("total", F.sum("bound").over(rising))
    needed = F.col("least").isNull() | (F.col("total") >= F.col("least"))
    slack = F.coalesce(F.max(F.when(~needed, F.col("total"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    return ranked.withColumn("needed", needed).withColumn("slack", slack).filter("needed").drop("needed", "total")


def _found(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, item_id, score): sums over the given terms of each query."""
    lists = blocks.join(F.broadcast(terms) if row_bound(terms) is not None else terms, "term")
    each = lists.select("query_id", "weight", F.inline(F.arrays_zip(F.col("items").alias("item_id"), F.col("weights").alias("w"))))
    return each.groupBy("query_id", "item_id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))


def _complete(found: DataFrame, packed: DataFrame, wanted: DataFrame, k: int, below: float | None) -> DataFrame:
    """The k best of some items for each query, scored over all terms of the query where the items lie.

    An item found for one query is scored for all of the block: each score is whole, so more items do no harm.
    """
    with pushing_lists(packed.sparkSession, LIST_KEYS):
        items = written(found.select("item_id").distinct(), "items")
        return written(score_sparse(wanted, among(packed, "item_id", items), k, below), "scored")


def topk_index(
    query_terms: Callable[[DataFrame], DataFrame],
    queries: DataFrame,
    index: TermIndex,
    packed: DataFrame,
    k: int,
    below: float | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank): the answers of ``topk_sparse``, from the lists that matter.

    First the heads of the lists give items that are scored in full; the k-th of
    these is a score to reach. ``packed`` may hold part of the items that were
    indexed. Meant for a few queries; a large table of them is cheaper to score
    where the items lie.
    """
    spark = packed.sparkSession

    def one_pass(block: DataFrame) -> DataFrame:
        asked = written(query_terms(block).select("query_id", "term", "weight"), "asked")
        tops = among(index.tops, "term", asked)
        wanted = written(asked.join(tops, "term").withColumn("bound", F.col("weight") * F.col("top")), "wanted")
        with pushing_lists(spark, LIST_KEYS):
            heads = among(index.blocks.filter("part = 0 AND number = 0"), "term", wanted)
            tried = written(rank_items(_found(heads, wanted.select("query_id", "term", "weight")), HEAD_ANSWERS * k), "heads")
        first = _complete(tried, packed, wanted, k, below)
        least = first.filter(F.col("rank") == k).select("query_id", (F.col("score") - _ROUNDING).alias("least"))
        terms = written(essential(wanted, least).select("query_id", "term", "weight", "least", "slack"), "essential")
        with pushing_lists(spark, LIST_KEYS):
            sums = _found(among(index.blocks, "term", terms), terms.select("query_id", "term", "weight"))
            limits = F.broadcast(terms.groupBy("query_id").agg(F.first("least").alias("least"), F.first("slack").alias("slack")))  # a row for each query of the block
            reach = F.col("least").isNull() | (F.col("score") + F.col("slack") >= F.col("least"))
        return _complete(sums.join(limits, "query_id").filter(reach), packed, wanted, k, below)

    return by_blocks(queries, "query_id", INDEX_BLOCK, one_pass)


