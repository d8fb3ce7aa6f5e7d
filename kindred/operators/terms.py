"""Terms, document frequencies, vocabulary and TF-IDF weights as tables.

Terms are counted in Arrow batches: a task gives out a row for each text, or sums over
some thousand texts, and never a row for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.functions.accents import fold_accents
from kindred.operators.joins import BROADCAST_ROWS, lookup_join
from kindred.operators.topk import top_rows

_WORD = r"[\p{L}\p{N}_]{2,}"
PIECE_BYTES = 16 << 20  # of texts whose terms meet in one task, whatever the size of the table
_SLICE_BYTES = 4 << 20  # of texts that are counted at once; a longer text is counted alone


def tokens(c: Column, plain: bool = False) -> Column:
    """Words of two or more word characters.

    ``plain`` says the text is already lower-case ASCII words with single
    spaces, as ``clean_text`` leaves it.
    """
    if plain:
        return F.filter(F.split(c, " "), lambda w: F.length(w) > 1)
    return F.regexp_extract_all(F.lower(fold_accents(c)), F.lit(_WORD), 0)


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by a space."""
    count = F.size(words)

    def runs(n: int) -> Column:
        if n == 1:
            return words
        number = F.greatest(count - (n - 1), F.lit(0))
        shorter = F.slice(runs(n - 1), F.lit(1), number)
        return F.zip_with(shorter, F.slice(words, F.lit(n), number), lambda a, b: F.concat(a, F.lit(" "), b))

    parts = [runs(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pieces(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, pieces of ``PIECE_BYTES`` of texts) of a stored table."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return rows, -(-size // PIECE_BYTES)


def gather(docs: DataFrame, key: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Key and text, hash-partitioned by key, into ``parts`` if they are given.

    Everything counted per document afterwards (terms, norms, scores, vectors)
    finds its rows in one task already and needs no further shuffle.
    """
    return docs.select(key, text_col).repartition(*([] if parts is None else [parts]), key)


def _words(docs: DataFrame, key: str | None, text_col: str, plain: bool, parts: int | None = None) -> DataFrame:
    """(key, _texts): words of the texts of each key, parted by spaces; without ``key`` each text is one of its own."""
    text = F.col(text_col) if plain else F.array_join(tokens(F.col(text_col)), " ")
    if key is None:
        return docs.select(F.array(text).alias("_texts"))
    # texts are moved, not the many more terms; words that meet come from one text
    return gather(docs, key, text_col, parts).select(key, text.alias("_text")).groupBy(key).agg(F.collect_list("_text").alias("_texts"))


def cuts(before: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of ``most`` bytes together, or a single larger one; ``before`` has the bytes before each row, and all of them."""
    low = 0
    while low < len(before) - 1:
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, "right")) - 1)
        yield low, high
        low = high


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with texts of about ``_SLICE_BYTES``."""
    lists = batch.column(batch.num_columns - 1)
    bytes_before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    for low, high in cuts(bytes_before[ends], _SLICE_BYTES):
        yield batch.slice(low, high - low)


def _occurrences(lists: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number of the term) of every run of ``low`` to ``high`` words, and the terms."""
    texts = lists.flatten()
    split = pc.split_pattern(texts, " ")
    words = split.flatten()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    text = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    long = pc.greater(pc.utf8_length(words), 1)
    words, text = words.filter(long), text[long.to_numpy(zero_copy_only=False)]
    found = words.dictionary_encode()
    vocabulary_, word = found.dictionary, found.indices.to_numpy().astype(np.int64)
    names, run, rows, numbers, terms, shift = vocabulary_, word, [], [], [], 0
    for n in range(1, high + 1):
        if n > 1:  # runs of n - 1 words and the word after them, where that is in the same text
            here = text[: max(len(text) - n + 1, 0)]
            pairs, dense = np.unique(run[: len(here)] * len(vocabulary_) + word[n - 1 :], return_inverse=True)
            names = pc.binary_join_element_wise(names.take(pa.array(pairs // max(len(vocabulary_), 1))), vocabulary_.take(pa.array(pairs % max(len(vocabulary_), 1))), " ")
            run = dense.reshape(-1)
        within = text[: len(run)] == text[n - 1 :]
        if n >= low:
            rows.append(row[text[: len(run)][within]])
            numbers.append(run[within] + shift)
            terms.append(names)
            shift += len(names)
    return np.concatenate(rows), np.concatenate(numbers), pa.concat_arrays(terms)


def _known_only(number: np.ndarray, terms: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which occurrences are of a known term, and the places of theirs among the known ones."""
    place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()[number]
    return place >= 0, place[place >= 0]


def _counted(low: int, high: int, known: pa.Array | None = None) -> Callable:
    """A ``mapInArrow`` function: (key, terms, counts) from (key, texts), terms in their order; of known terms only if they are given, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                row, number, terms = _occurrences(some.column(1), low, high)
                if known is None:
                    order = pc.sort_indices(terms).to_numpy()
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    terms, number = terms.take(pa.array(order)), rank[number]
                else:
                    kept, number = _known_only(number, terms, known)
                    row, terms = row[kept], known
                if not len(row):
                    continue
                pairs, count = np.unique(row * len(terms) + number, return_counts=True)
                holds, first = np.unique(pairs // len(terms), return_index=True)
                ends = pa.array(np.append(first, len(pairs)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(pairs % len(terms))), pa.array(count, pa.int64())))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(holds)), *lists], [batch.schema.names[0], "terms", "counts"])

    return run


def _tallied(low: int, high: int) -> Callable:
    """A ``mapInArrow`` function: (term, df, cf) over some texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                row, number, terms = _occurrences(some.column(0), low, high)
                cf = np.bincount(number, minlength=len(terms))
                pairs = np.sort(row * max(len(terms), 1) + number)  # faster than np.unique, which hashes
                df = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % max(len(terms), 1), minlength=len(terms))
                met = np.flatnonzero(cf)  # a run of words over two texts is none
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(met)), pa.array(df[met]), pa.array(cf[met])], ["term", "df", "cf"])

    return run


def _kind(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def packed_counts(
    docs: DataFrame, key: str, text_col: str, low: int = 1, high: int = 2, plain: bool = True, parts: int | None = None
) -> DataFrame:
    """(key, terms, counts): the terms of each key in one row; keys without a term are left out.

    Texts are shuffled by key, into ``parts`` if they are given, and counted where they arrive.
    """
    texts = _words(docs, key, text_col, plain, parts)
    return texts.mapInArrow(_counted(low, high), f"{_kind(docs, key)}, terms array<string>, counts array<bigint>")


def term_counts(docs: DataFrame, key: str, text_col: str, low: int = 1, high: int = 2, plain: bool = True) -> DataFrame:
    """(key, term, tf). Texts are shuffled by key, not the many more terms."""
    packed = packed_counts(docs, key, text_col, low, high, plain)
    return packed.select(key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))))


def term_statistics(docs: DataFrame, text_col: str, low: int = 1, high: int = 2, plain: bool = True) -> DataFrame:
    """(term, df, cf): documents with the term, and its occurrences.

    Nothing is grouped by document: tasks sum over some texts at a time, and
    only these sums, combined again on the map side, are shuffled.
    """
    sums = _words(docs, None, text_col, plain).mapInArrow(_tallied(low, high), "term string, df bigint, cf bigint")
    return sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(
    statistics: DataFrame,
    n_docs: int,
    max_features: int | None = 10_000,
    min_df: int = 2,
    max_df: float = 0.95,
) -> DataFrame:
    """(term, df, cf, idf) for the most frequent terms within the df bounds."""
    kept = statistics.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        kept = top_rows(kept, [F.desc("cf"), F.asc("term")], max_features)
    idf = F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0
    return kept.select("term", "df", "cf", idf.alias("idf"))


def _weighed(known: pa.Array, idf: np.ndarray) -> Callable:
    """A ``mapInArrow`` function: (key, terms, weights) from (key, terms, counts), of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, size = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            place = pc.index_in(terms, value_set=known)
            keep = pc.is_valid(place).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)[keep]
            raw = (np.log(batch.column(2).flatten().to_numpy(zero_copy_only=False)[keep]) + 1) * idf[place.drop_null().to_numpy(zero_copy_only=False)]
            norm = np.sqrt(np.bincount(row, raw * raw, len(size)))
            held = np.bincount(row, minlength=len(size))
            some = np.flatnonzero(held)
            ends = pa.array(np.concatenate([[0], np.cumsum(held[some])]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, x) for x in (terms.filter(pa.array(keep)), pa.array(raw / norm[row])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *lists], [batch.schema.names[0], "terms", "weights"])

    return run


def _known(vocab: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Terms in their order, and idf; at most ``BROADCAST_ROWS``, as they go to every task."""
    table = vocab.select("term", "idf").limit(BROADCAST_ROWS + 1).toArrow().combine_chunks()
    if table.num_rows > BROADCAST_ROWS:
        raise ValueError(f"the vocabulary has more than {BROADCAST_ROWS} terms; set max_features")
    table = table.sort_by("term")
    return pa.array(table["term"].to_pylist(), pa.string()), table["idf"].to_numpy()


def weigh(counts: DataFrame, vocab: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, terms, weights) from (key, terms, counts): log-scaled counts times idf, unit length.

    Terms outside the vocabulary vanish, and so do keys left without a term.
    Nothing is shuffled; the vocabulary, at most ``BROADCAST_ROWS`` terms, goes to the tasks.
    """
    return counts.select(key, "terms", "counts").mapInArrow(_weighed(*_known(vocab)), f"{_kind(counts, key)}, terms array<string>, weights array<double>")


def packed_weights(
    docs: DataFrame,
    vocab: DataFrame,
    key: str,
    text_col: str,
    low: int = 1,
    high: int = 2,
    plain: bool = True,
    max_features: int | None = 10_000,
    parts: int | None = None,
    then: tuple[Callable, StructType] | None = None,
) -> DataFrame:
    """(key, terms, weights): log-scaled tf times idf, unit length per key, all terms of a key in one row.

    Terms outside the vocabulary vanish, and so do keys left without a term. A vocabulary
    of up to ``BROADCAST_ROWS`` terms, as ``max_features`` promises, goes to the tasks that
    count, and other terms are not even given out; a larger one is joined. Rows then lie in the
    ``parts`` of their key, if these are given. ``then`` is a further ``mapInArrow`` function on these rows, and
    what it gives; it runs in the same Python worker where one counts.
    """
    if max_features is not None and max_features <= BROADCAST_ROWS:
        known, idf = _known(vocab)
        count, weight = _counted(low, high, known), _weighed(known, idf)
        further, schema = then or (None, f"{_kind(docs, key)}, terms array<string>, weights array<double>")
        return _words(docs, key, text_col, plain, parts).mapInArrow(
            lambda batches: further(weight(count(batches))) if further else weight(count(batches)), schema
        )
    known = lookup_join(term_counts(docs, key, text_col, low, high, plain), vocab.select("term", "idf"), "term", max_features)
    weighted = known.withColumn("raw", (F.log("tf") + 1.0) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    entries = F.sort_array(F.collect_list(F.struct("term", (F.col("raw") / F.col("_norm")).alias("weight"))))
    packed = weighted.withColumn("_norm", norm).groupBy(key).agg(entries.alias("e"))
    packed = packed.select(key, F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))
    return packed if then is None else packed.mapInArrow(*then)


def unpacked(packed: DataFrame, key: str) -> DataFrame:
    """(key, term, weight), a row for each term."""
    return packed.select(key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("weights").alias("weight"))))


def tfidf_weights(
    docs: DataFrame,
    vocab: DataFrame,
    key: str,
    text_col: str,
    low: int = 1,
    high: int = 2,
    plain: bool = True,
    max_features: int | None = 10_000,
) -> DataFrame:
    """(key, term, weight): ``packed_weights`` with a row for each term."""
    return unpacked(packed_weights(docs, vocab, key, text_col, low, high, plain, max_features), key)
