"""Recommendations for a table of query texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import clean_text, strip
from kindred.operators.cells import topk_bounded
from kindred.operators.joins import BROADCAST_ROWS, row_bound
from kindred.operators.postings import INDEX_BLOCK, topk_index
from kindred.operators.topk import SELF_SCORE, rank_items, topk_dense, topk_sparse, without_self
from kindred.plans.model import Model

OVERFETCH = 4  # fixed value: answers fetched per answer wanted, before a source filter
METHODS = ("tfidf", "semantic")
MODES = ("parity", "exact")


def query_text(c: Column) -> Column:
    """Cleaned query without the lemma step, or the raw text if cleaning empties it."""
    cleaned = clean_text(c, drop_stopwords=True, lemmas=None)
    return F.when(F.trim(cleaned) == "", c).otherwise(cleaned)


def ready_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text, query_text) for queries that are not blank."""
    asked = queries.filter(F.length(strip(F.col("text"))) > 0)
    return asked.select("query_id", "text", query_text(F.col("text")).alias("query_text"))


def with_metadata(ranked: DataFrame, metadata: DataFrame, n_queries: int | None, k: int, method: str) -> DataFrame:
    """Answers with item columns, score and method.

    Answers number at most queries times k. If that is small they are
    broadcast, and the metadata, as large as the corpus, is only scanned.
    """
    small = n_queries is not None and n_queries * k <= BROADCAST_ROWS
    answers = F.broadcast(ranked) if small else ranked
    return metadata.join(answers, "item_id").select(
        "query_id",
        F.col("rank").cast("int").alias("rank"),
        *metadata.columns,
        F.col("score").alias("similarity_score"),
        F.lit(method).alias("method"),
    )


def nearest(
    queries: DataFrame,
    model: Model,
    method: str,
    k: int,
    below: float | None = None,
    source: str | None = None,
    n_probe: int | None = None,
) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest items by one method.

    ``n_probe`` asks for the search in cells: so many are read first, and then
    those that may still hold a better answer. A few queries of method ``tfidf``
    go through the model's inverted index if it has one. ``source`` restricts the items
    that are compared.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    ready = ready_queries(queries)
    items = model.packed if method == "tfidf" else model.vectors
    if items is None:
        raise ValueError(f"this model was fitted without the tables of method {method}")
    if source is not None:
        wanted = model.metadata.filter(F.col("source") == source).select("item_id")
        items = items.join(wanted, "item_id", "left_semi")
    if method == "tfidf" and model.index is not None and row_bound(ready.select("query_id"), INDEX_BLOCK) is not None:
        return topk_index(lambda block: model.query_terms(block, "query_text"), ready, model.index, items, k, below)
    if method == "tfidf":
        return topk_sparse(lambda block: model.query_terms(block, "query_text"), ready, items, k, below)

    def encode(block: DataFrame) -> DataFrame:
        return model.query_vectors(block, "text")

    if n_probe is None:
        return topk_dense(ready, items, k, below, encode)
    if model.cells is None:
        raise ValueError("this model has no cells; fit it with n_cells or leave n_probe out")
    return topk_bounded(ready, items, model.cells, k, n_probe, below, encode)


def similar_items(queries: DataFrame, model: Model, method: str, top_n: int = 10, n_probe: int | None = None) -> DataFrame:
    """The n nearest items of each query but for near-identical ones.

    One more than n is ranked before near-identical items go, so a query that
    is itself in the corpus still gets n answers.
    """
    ranked = without_self(nearest(queries, model, method, top_n + 1, n_probe=n_probe), top_n)
    return with_metadata(ranked, model.metadata, row_bound(queries.select("query_id")), top_n, method)


def recommend(
    queries: DataFrame,
    model: Model,
    method: str = "tfidf",
    source: str | None = None,
    top_n: int = 8,
    mode: str = "parity",
    n_probe: int | None = None,
) -> DataFrame:
    """Top-n items per query text.

    In mode ``parity`` 4n items are fetched and the source filter comes after,
    so fewer than n may be left. Mode ``exact`` filters before ranking.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    bound = row_bound(queries.select("query_id"))
    if mode == "exact":
        ranked = nearest(queries, model, method, top_n, SELF_SCORE, source, n_probe)
        return with_metadata(ranked, model.metadata, bound, top_n, method)
    fetch = OVERFETCH * top_n
    fetched = without_self(nearest(queries, model, method, fetch + 1, n_probe=n_probe), fetch)
    found = with_metadata(fetched, model.metadata, bound, fetch, method)
    if source is not None:
        found = found.filter(F.col("source") == source)
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def compare_methods(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sets of answers side by side by rank, with counts and the overlap per query."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "rank", "item_id", "similarity_score", F.lit(name).alias("side"))

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(column)))

    # Both tables are scored once: what they share is counted in the rows of their union.
    both = side(left, "left").unionByName(side(right, "right"))
    shared = F.count("*").over(Window.partitionBy("query_id", "item_id")) > 1
    pairs = both.withColumn("shared", shared).groupBy("query_id", "rank").agg(
        *(of(name, column).alias(f"{name}_{short}") for name in ("left", "right") for column, short in (("item_id", "item"), ("similarity_score", "score"))),
        F.count_if((F.col("side") == "left") & F.col("shared")).alias("shared"),
    )
    per_query = Window.partitionBy("query_id")
    return (
        pairs.withColumn("left_count", F.count("left_item").over(per_query))
        .withColumn("right_count", F.count("right_item").over(per_query))
        .withColumn("overlap", F.sum("shared").over(per_query))
        .drop("shared")
    )


def result_cards(answers: DataFrame, labels: Mapping[str, str], default_label: str = "other") -> DataFrame:
    """Display columns of answers: preview, short authors, formatted score, source label."""
    label = F.lit(default_label)
    for name, shown in labels.items():
        label = F.when(F.col("source") == name, shown).otherwise(label)
    text = F.coalesce("text", F.lit(""))
    return answers.select(
        "query_id",
        "rank",
        label.alias("label"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.substring(F.coalesce("authors", F.lit("Unknown")), 1, 80).alias("authors"),
        F.coalesce("category", F.lit("-")).alias("category"),
        # format_number rounds the exact binary value, format_string its decimal form
        F.replace(F.format_number(F.coalesce("similarity_score", F.lit(0.0)), 4), F.lit(","), F.lit("")).alias("score"),
        F.upper(F.coalesce("source", F.lit("unknown"))).alias("source_tag"),
        F.when(F.length(text) > 280, F.concat(F.substring(text, 1, 280), F.lit("..."))).otherwise(text).alias("preview"),
    )
