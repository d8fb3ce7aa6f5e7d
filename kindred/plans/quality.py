"""Corpus metrics, model metrics and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean_text
from kindred.functions.vectors import l2_norm
from kindred.plans.prepare import MIN_LENGTH
from kindred.sources.files import ITEM_COLUMNS

MAX_NULL_PCT = 10.0  # fixed value: a higher share of null cleaned texts is a warning


def count_by_source(items: DataFrame) -> DataFrame:
    """Rows per source, most frequent first."""
    return items.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, nulls, row_count) for every column, from one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.explode(entries).alias("e"), "_rows").select(
        "e.column_name", "e.nulls", F.col("_rows").alias("row_count")
    )


def peek(df: DataFrame, key: str, text_col: str, rows: int = 2, chars: int = 200) -> DataFrame:
    """The first rows by key, with the start of a text."""
    return df.orderBy(key).limit(rows).withColumn(text_col, F.substring(text_col, 1, chars))


def corpus_metrics(items: DataFrame, sources: tuple[str, ...], min_length: int = MIN_LENGTH) -> DataFrame:
    """Counts, mean cleaned length, null share and dropped rows, in one pass over raw items."""
    length = F.length(clean_text(F.col("text")))
    kept = F.col("_length") >= min_length
    return items.select("source", length.alias("_length")).agg(
        F.count_if(kept).alias("total_docs"),
        *[F.count_if(kept & (F.col("source") == s)).alias(f"{s}_count") for s in sources],
        F.avg(F.when(kept, F.col("_length"))).alias("avg_clean_text_len"),
        (F.avg(F.when(kept, F.col("_length").isNull().cast("int"))) * 100).alias("null_text_pct"),
        F.count_if(~kept).alias("rows_dropped"),
    )


def preprocess_summary(processed: DataFrame, clean_col: str = "text_clean") -> DataFrame:
    """Rows and mean cleaned length per source, and for the whole as source ``all``; a null source stays null."""
    return processed.select("source", F.length(clean_col).alias("_length")).rollup("source").agg(
        F.count("*").alias("n"), F.avg("_length").alias("avg_clean_text_len"), F.grouping("source").alias("_whole")
    ).select(F.when(F.col("_whole") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "avg_clean_text_len")


def sparse_metrics(vocab: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Vocabulary size, shape and sparsity of the document-term matrix."""
    size = vocab.agg(F.count("*").alias("n")).scalar()
    rows = docs.agg(F.count("*").alias("n")).scalar()
    return postings.agg(F.count("*").alias("nnz")).select(
        size.alias("vocab_size"),
        rows.alias("matrix_rows"),
        size.alias("matrix_cols"),
        "nnz",
        (1.0 - F.col("nnz") / (rows * size)).alias("sparsity"),
    )


def dense_metrics(vectors: DataFrame) -> DataFrame:
    """Width, count and mean length of vectors."""
    return vectors.agg(
        F.max(F.size("embedding")).alias("embedding_dim"),
        F.count("*").alias("embedding_count"),
        F.avg(l2_norm(F.col("embedding"))).alias("embedding_norm_mean"),
    )


def cell_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cell_id").agg(F.count("*").alias("n"))


def quality_checks(raw: DataFrame, processed: DataFrame, clean_col: str = "text_clean") -> DataFrame:
    """(check_name, value, passed): columns present, rows present, null share low."""
    missing_raw = len(set(ITEM_COLUMNS) - set(raw.columns))
    missing_clean = int(clean_col not in processed.columns)
    null_pct = (
        F.lit(100.0) if missing_clean else F.coalesce(F.avg(F.col(clean_col).isNull().cast("int")) * 100, F.lit(0.0))
    )

    def check(name: str, value: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("value"), passed.alias("passed"))

    rows = F.col("rows")
    before = raw.agg(F.count("*").alias("rows")).select(
        F.array(
            check("raw_missing_columns", F.lit(missing_raw), F.lit(missing_raw == 0)),
            check("raw_rows", rows, rows > 0),
        ).alias("checks")
    )
    after = processed.agg(F.count("*").alias("rows"), null_pct.alias("null_pct")).select(
        F.array(
            check("clean_column_missing", F.lit(missing_clean), F.lit(missing_clean == 0)),
            check("processed_rows", rows, rows > 0),
            check("null_clean_pct", F.col("null_pct"), F.col("null_pct") <= MAX_NULL_PCT),
        ).alias("checks")
    )
    return before.union(after).select(F.explode("checks").alias("c")).select("c.check_name", "c.value", "c.passed")


def model_parity(items: DataFrame, postings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Whether every item has a vector and postings, or is counted as having no known term."""
    n_items = items.agg(F.count("*").alias("n")).scalar()
    n_vectors = vectors.agg(F.count("*").alias("n")).scalar()
    # a left-over item is one whose terms are all outside the vocabulary
    per_item = items.select("item_id").join(
        postings.select("item_id").distinct().withColumn("_has", F.lit(1)), "item_id", "left"
    )
    return per_item.agg(
        F.count("_has").alias("items_with_terms"),
        F.count_if(F.col("_has").isNull()).alias("items_without_terms"),
    ).select(
        n_items.alias("items"),
        n_vectors.alias("vectors"),
        "items_with_terms",
        "items_without_terms",
        ((n_items == n_vectors) & (n_items == F.col("items_with_terms") + F.col("items_without_terms"))).alias("passed"),
    )
