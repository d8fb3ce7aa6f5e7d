"""A saved model that grows: batches of items are appended, versions name the batches that count.

A batch is tokenised and encoded once, when it comes. Its folder holds counts,
not weights, as these change with every batch; a version holds the vocabulary
of the summed statistics. A version exists once its manifest does, which is
created in one step, so readers see all of an append or nothing of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.encode import hashed_vectors
from kindred.operators.joins import row_bound
from kindred.operators.terms import packed_counts, pieces, term_statistics, vocabulary, weigh
from kindred.plans.model import Encoder, Model, TermOptions, item_vectors
from kindred.plans.prepare import usable
from kindred.session import TEXTS, dropping_shuffles, in_pieces, written
from kindred.sources.files import ITEM_COLUMNS

_END = "end"  # last line of a whole manifest


@dataclass(frozen=True)
class Version:
    """Number of a version, and the documents of each of its batches."""

    number: int
    batches: dict[str, int]


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str, number: int) -> Version | None:
    at, store = _files(spark, f"{path}/versions/{number:08d}/manifest")
    if not store.exists(at):
        return None
    stream = store.open(at)
    lines = bytes(stream.readAllBytes()).decode().split("\n")
    stream.close()
    if lines[-1] != _END:
        return None
    return Version(number, {name: int(docs) for docs, name in (line.split("\t", 1) for line in lines[:-1])})


def current_version(spark: SparkSession, path: str) -> Version:
    """The newest whole version; number 0 without batches if there is none."""
    at, store = _files(spark, f"{path.rstrip('/')}/versions")
    found = [int(f.getPath().getName()) for f in store.listStatus(at)] if store.exists(at) else []
    for number in sorted(found, reverse=True):
        version = _manifest(spark, path.rstrip("/"), number)
        if version is not None:
            return version
    return Version(0, {})


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the current one, unless another writer has made one of this number."""
    at, store = _files(spark, f"{path}/versions/{version.number:08d}/manifest")
    lines = [*(f"{docs}\t{name}" for name, docs in version.batches.items()), _END]
    stream = store.create(at, False)  # fails if the file is there
    stream.write(bytearray("\n".join(lines).encode()))
    stream.close()


def _next_number(spark: SparkSession, path: str, before: Version) -> int:
    """The number after ``before`` that no manifest has, not even one whose writer died on the way."""
    number = before.number + 1
    while True:
        at, store = _files(spark, f"{path}/versions/{number:08d}/manifest")
        if not store.exists(at):
            return number
        number += 1


def merged_vocabulary(tables: list[DataFrame], sizes: list[int], terms: TermOptions) -> DataFrame:
    """The vocabulary of the summed statistics of batches of so many documents.

    Only terms that may be in it are shuffled. The most frequent terms of the largest batch that keep the
    df bounds whatever the others hold are enough to fill it, so none with fewer occurrences than the last of them gets in;
    and a term with as many has its share of them in some batch.
    """
    n_docs, every = sum(sizes), reduce(DataFrame.unionByName, tables)
    floor = _least_occurrences(*max(zip(tables, sizes, strict=True), key=lambda x: x[1]), n_docs, terms)
    likely = every.filter(F.col("cf") * len(tables) >= floor).select("term")
    if len(tables) > 1 and floor > len(tables) and row_bound(likely) is not None:
        every = every.join(F.broadcast(likely.distinct()), "term", "left_semi")
    merged = every if len(tables) == 1 else every.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return vocabulary(merged, n_docs, terms.max_features, terms.min_df, terms.max_df)


def _least_occurrences(table: DataFrame, size: int, n_docs: int, terms: TermOptions) -> int:
    """Occurrences that a term of the vocabulary of ``n_docs`` documents has at least, by one batch of ``size``; 0 if that tells nothing."""
    if terms.max_features is None:
        return 0
    sure = table.filter((F.col("df") >= terms.min_df) & (F.col("df") + (n_docs - size) <= terms.max_df * n_docs))
    first = sure.select("cf").orderBy(F.desc("cf")).limit(terms.max_features).agg(F.count("*").alias("n"), F.min("cf").alias("least")).first()
    return first["least"] if first["n"] == terms.max_features and first["n"] else 0


def append_batch(
    path: str,
    batch: str,
    items: DataFrame,
    text_col: str = "text_clean",
    terms: TermOptions = TermOptions(),
    encoder: Encoder | None = hashed_vectors,
    metadata: DataFrame | None = None,
) -> Version:
    """Add cleaned items to the model in ``path`` under the name ``batch``; the new version.

    A name that the current version has already is not added again, and what a
    failed attempt left is overwritten, so an append may be repeated. Items have
    ids that no other batch has. All batches are written with the same ``terms``
    and ``encoder``. One writer at a time: of two, one gets an error and may
    repeat. Null and blank texts count for nothing; an empty batch is a batch.
    """
    if not batch or any(c in batch for c in "/\n\t"):
        raise ValueError("a batch is named by one line without slashes and tabs")
    spark, path = items.sparkSession, path.rstrip("/")
    before = current_version(spark, path)
    if batch in before.batches:
        return before
    own = f"{path}/batches/{batch}"
    (items if metadata is None else metadata).select(*ITEM_COLUMNS).write.mode("overwrite").options(**TEXTS).parquet(f"{own}/metadata")
    docs = written(usable(items.select("item_id", text_col), text_col), "cleaned", **TEXTS)
    n_docs, parts = pieces(docs, text_col)
    statistics = term_statistics(docs, text_col, terms.ngram_min, terms.ngram_max, terms.plain)
    counts = packed_counts(docs, "item_id", text_col, terms.ngram_min, terms.ngram_max, terms.plain)
    with in_pieces(spark, parts), dropping_shuffles(spark):
        statistics.write.mode("overwrite").options(**TEXTS).parquet(f"{own}/statistics")
        counts.write.mode("overwrite").options(**TEXTS).parquet(f"{own}/counts")
    if encoder is not None:
        item_vectors(docs, text_col, encoder).write.mode("overwrite").parquet(f"{own}/vectors")
    after = Version(_next_number(spark, path, before), {**before.batches, batch: n_docs})
    tables = [spark.read.parquet(f"{path}/batches/{name}/statistics") for name in after.batches]
    with in_pieces(spark, pieces(reduce(DataFrame.unionByName, tables), "term")[1]), dropping_shuffles(spark):
        vocab = merged_vocabulary(tables, list(after.batches.values()), terms)
        vocab.write.mode("overwrite").parquet(f"{path}/versions/{after.number:08d}/vocab")
    _publish(spark, path, after)
    return after


def load_version(
    spark: SparkSession, path: str, number: int | None = None, terms: TermOptions = TermOptions(), encoder: Encoder | None = hashed_vectors
) -> Model:
    """The model of a version, the current one unless a number is given. Older versions stay readable."""
    path = path.rstrip("/")
    version = current_version(spark, path) if number is None else _manifest(spark, path, number)
    if version is None or not version.batches:
        raise ValueError(f"there is no version {number or ''} in {path}")
    of = lambda table: spark.read.parquet(*(f"{path}/batches/{name}/{table}" for name in version.batches))
    vocab = spark.read.parquet(f"{path}/versions/{version.number:08d}/vocab")
    return Model(
        metadata=of("metadata"), vocab=vocab, packed=weigh(of("counts"), vocab), vectors=None if encoder is None else of("vectors"), terms=terms, encoder=encoder
    )
