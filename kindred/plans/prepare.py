"""Cleaning of item tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import clean_text, normalize_words, strip, truncate_words
from kindred.operators.lemma import lemma_column, lemmatize

MIN_LENGTH = 50  # fixed value: default of the length filter on cleaned text
MAX_LENGTH = 1000  # fixed value: length of cleaned text where it is to be cut


def clean_items(
    items: DataFrame,
    text_col: str = "text",
    clean_col: str = "text_clean",
    drop_stopwords: bool = True,
    lemmas: Mapping[str, str] | DataFrame | None = None,
    max_len: int | None = None,
) -> DataFrame:
    """Add the cleaned text. ``lemmas`` is a small mapping or a (word, lemma) table.

    Whole texts are cleaned; ``max_len`` cuts what comes out. A lemma table goes to the tasks, and no text
    is moved. With one that is too large for that, each distinct text is cleaned once, and rows find it by the digest of theirs.

    The text is passed on as the one element of an array. A filter on a plain
    computed column moves below it, past any exchange to the scan, and would
    clean every text a second time; it does not move below ``explode``.
    """
    if not isinstance(lemmas, DataFrame):
        cleaned = clean_text(F.col(text_col), drop_stopwords, lemmas, max_len)
        return items.select("*", F.explode(F.array(cleaned)).alias(clean_col))
    replace = lemma_column(lemmas)
    if replace is not None:
        words = items.select("*", replace(normalize_words(F.col(text_col), drop_stopwords)).alias("_words"))
        text = F.col("_words") if max_len is None else truncate_words(F.col("_words"), max_len)
        return words.select(*items.columns, F.explode(F.array(F.trim(text))).alias(clean_col))
    digest = F.sha2(F.coalesce(text_col, F.lit("")), 256)
    texts = items.select(digest.alias("_digest"), text_col).dropDuplicates(["_digest"])
    words = texts.select("_digest", normalize_words(F.col(text_col), drop_stopwords).alias(clean_col))
    cleaned = lemmatize(words, "_digest", clean_col, lemmas)
    text = F.col(clean_col) if max_len is None else truncate_words(F.col(clean_col), max_len)
    return items.withColumn("_digest", digest).join(cleaned.withColumn(clean_col, F.trim(text)), "_digest").drop("_digest")


def preprocess(items: DataFrame, min_length: int = MIN_LENGTH, clean_col: str = "text_clean", **options) -> DataFrame:
    """Cleaned items whose cleaned text has at least ``min_length`` characters."""
    return clean_items(items, clean_col=clean_col, **options).filter(F.length(clean_col) >= min_length)


def usable(items: DataFrame, text_col: str = "text_clean") -> DataFrame:
    """Items with a text that is neither null nor blank."""
    return items.dropna(subset=[text_col]).filter(F.length(strip(F.col(text_col))) > 0)
