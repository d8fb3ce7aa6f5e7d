"""Dictionary lemmas for whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.joins import lookup_join, row_bound
from kindred.operators.terms import cuts

_SLICE_BYTES = 4 << 20  # of texts whose words are looked up at once


def changing(lemmas: DataFrame) -> DataFrame:
    """(word, lemma) without the entries that change nothing."""
    return lemmas.filter(F.col("word") != F.col("lemma")).select("word", "lemma")


def _replaced(words: pa.Array, lemmas: pa.Array) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.string())]
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for low, high in cuts(np.concatenate([[0], np.cumsum(size)]), _SLICE_BYTES):
            split = pc.split_pattern(pc.fill_null(texts[low:high], ""), " ")
            word = split.flatten()
            found = pc.coalesce(lemmas.take(pc.index_in(word, value_set=words)), word)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")
            out.append(pc.if_else(pc.is_valid(texts[low:high]), joined, pa.scalar(None, pa.string())))
        return pa.concat_arrays(out)

    return run


def lemma_column(lemmas: DataFrame) -> Callable[[Column], Column] | None:
    """A function that replaces the words of a text, parted by spaces, by their lemmas; none if there are too many of these to send to the tasks."""
    known = changing(lemmas)
    if row_bound(known) is None:
        return None
    table = known.toArrow().combine_chunks()
    words, found = (pa.array(table[c].to_pylist(), pa.string()) for c in ("word", "lemma"))

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        return _replaced(words, found)(texts)

    return replace


def lemmatize(docs: DataFrame, key: str, text_col: str, lemmas: DataFrame) -> DataFrame:
    """(key, text_col) with each word replaced by its lemma, if it has one; null texts are left out.

    ``lemmas`` is (word, lemma), one row per word; entries that change nothing
    are left out. As long as they fit the tasks, texts stay where they are. Otherwise words are
    joined, and those of one document stay in one task from the shuffle on its key to the re-assembly.
    """
    replace = lemma_column(lemmas)
    if replace is not None:
        return docs.filter(F.col(text_col).isNotNull()).select(key, replace(F.col(text_col)).alias(text_col))
    words = (
        docs.select(key, F.col(text_col).alias("_text"))
        .repartition(key)
        .select(key, F.posexplode(F.split("_text", " ")).alias("_at", "word"))
    )
    found = lookup_join(words, changing(lemmas), "word", None, how="left")
    in_order = F.sort_array(F.collect_list(F.struct("_at", F.coalesce("lemma", "word").alias("word"))))
    return found.groupBy(key).agg(F.array_join(in_order["word"], " ").alias(text_col))
