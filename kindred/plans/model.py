"""Model tables: metadata, vocabulary, postings, vectors, cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.cells import assign_cells, measured, train_cells
from kindred.operators.encode import hashed_vectors
from kindred.operators.joins import BROADCAST_ROWS
from kindred.operators.postings import TermIndex, build_index, load_index
from kindred.operators.terms import packed_weights, pieces, term_statistics, tfidf_weights, unpacked, vocabulary
from kindred.plans.prepare import usable
from kindred.session import TEXTS, fresh_path, in_pieces, written
from kindred.sources.buckets import read_bucketed, write_bucketed
from kindred.sources.files import ITEM_COLUMNS


# (table, key column, text column) to (key, embedding)
Encoder = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class TermOptions:
    max_features: int | None = 10_000
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int = 2
    max_df: float = 0.95
    plain: bool = True  # text is cleaned: lower-case ASCII words


@dataclass(frozen=True)
class Model:
    """Tables a query needs; any of them may still be an unevaluated plan."""

    metadata: DataFrame
    docs: DataFrame | None = None
    vocab: DataFrame | None = None
    packed: DataFrame | None = None  # (item_id, terms, weights), one row per item
    vectors: DataFrame | None = None
    cells: DataFrame | None = None
    index: TermIndex | None = None  # postings by term, for searches with few queries
    terms: TermOptions = TermOptions()
    encoder: Encoder | None = hashed_vectors
    buckets: int | None = None  # of which the rows of ``packed``, a plan, lie together

    @property
    def postings(self) -> DataFrame | None:
        """(item_id, term, weight), a row per term."""
        if self.packed is None:
            return None
        return unpacked(self.packed, "item_id")

    def query_terms(self, queries: DataFrame, text_col: str = "text") -> DataFrame:
        """(query_id, term, weight) of new texts in the fitted vocabulary."""
        t = self.terms
        # raw text may come here when cleaning leaves nothing, so tokens are general
        return tfidf_weights(
            queries, self.vocab, "query_id", text_col, t.ngram_min, t.ngram_max, False, t.max_features
        )

    def query_vectors(self, queries: DataFrame, text_col: str = "text") -> DataFrame:
        """(query_id, embedding) of new texts by the encoder of the items."""
        if self.encoder is hashed_vectors:
            return hashed_vectors(queries, "query_id", text_col, plain=False)
        return self.encoder(queries, "query_id", text_col)


def item_vectors(docs: DataFrame, text_col: str = "text_clean", encoder: Encoder = hashed_vectors) -> DataFrame:
    """(item_id, embedding) of a table of cleaned texts that is stored.

    The hashing encoder sums in as many parts as the size of the table asks for, so that no task holds more of a larger one.
    """
    if encoder is not hashed_vectors:
        return encoder(docs, "item_id", text_col)
    parts = max(pieces(docs, text_col)[1], docs.sparkSession.sparkContext.defaultParallelism)
    return hashed_vectors(docs, "item_id", text_col, parts=parts)


def fit_packed(
    docs: DataFrame, key: str = "item_id", text_col: str = "text_clean", terms: TermOptions = TermOptions(), buckets: int | None = None
):
    """(vocabulary, packed postings) of a table of cleaned texts that is stored.

    The corpus is read three times: for its size, for the statistics, and for postings in the
    vocabulary they give. ``fit_model`` stores the cleaned texts before. The size says how many
    tasks terms are summed in, so that none holds more of a larger corpus. Postings lie in so many ``buckets`` of the key if these are given.
    """
    spark = docs.sparkSession
    n_docs, parts = pieces(docs, text_col)
    statistics = term_statistics(docs, text_col, terms.ngram_min, terms.ngram_max, terms.plain)
    with in_pieces(spark, parts):
        vocab = written(vocabulary(statistics, n_docs, terms.max_features, terms.min_df, terms.max_df), "vocab")
    if buckets is not None:
        parts = buckets * max(1, -(-parts // buckets))  # so a part is of one bucket
    elif parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        parts = None  # Spark may take fewer
    return vocab, packed_weights(
        docs, vocab, key, text_col, terms.ngram_min, terms.ngram_max, terms.plain, terms.max_features, parts
    )


def fit_terms(docs: DataFrame, key: str = "item_id", text_col: str = "text_clean", terms: TermOptions = TermOptions()):
    """(vocabulary, postings): ``fit_packed`` with a row for each item and term."""
    vocab, packed = fit_packed(docs, key, text_col, terms)
    return vocab, unpacked(packed, key)


def fit_model(
    items: DataFrame,
    text_col: str = "text_clean",
    terms: TermOptions | None = TermOptions(),
    vectors: DataFrame | None = None,
    encoder: Encoder | None = hashed_vectors,
    n_cells: int | None = None,
    metadata: DataFrame | None = None,
    index: bool = False,
    buckets: int | None = None,
) -> Model:
    """Fit the model tables to cleaned items; null and blank texts count for nothing.

    Cleaned texts and the postings of each item are written once, and every
    search reads those back. ``encoder`` makes vectors of items and queries,
    by feature hashing unless it is given; vectors that exist already are taken
    from ``vectors`` (item_id, embedding). No item is encoded twice: vectors
    are written, too. ``terms`` or ``encoder`` of None leaves that part out.
    Cells are trained if ``n_cells`` is given. With ``index`` postings are also
    written by term, and those of items in the order of items. ``metadata`` may be a table of raw items: answers pick the fitted ones.
    With ``buckets``, for a model that is to be saved in so many, postings are a plan that places them by bucket:
    ``save_model`` writes them once, and searches go to the saved model.
    """
    docs = written(usable(items.select("item_id", text_col), text_col), "cleaned", **TEXTS)
    model = Model(metadata=(items if metadata is None else metadata).select(*ITEM_COLUMNS), docs=docs, encoder=encoder)
    if terms is not None:
        placed = None if index or (terms.max_features or BROADCAST_ROWS + 1) > BROADCAST_ROWS else buckets
        vocab, packed = fit_packed(docs, "item_id", text_col, terms, placed)
        if placed is None:
            packed = written(packed, "postings")
        if index:  # stored before, as the bounds of ranges take a pass of their own
            packed = written(packed.repartitionByRange("item_id").sortWithinPartitions("item_id"), "postings")
        by_term = build_index(packed, fresh_path(items.sparkSession, "index")) if index else None
        model = replace(model, vocab=vocab, packed=packed, index=by_term, terms=terms, buckets=placed)
    if vectors is None:
        if encoder is None:
            return model
        vectors = written(item_vectors(docs, text_col, encoder), "vectors")
    if n_cells is not None:
        cells = train_cells(vectors, n_cells)
        vectors = written(assign_cells(vectors, cells), "vectors")
        return replace(model, vectors=vectors, cells=measured(vectors, cells))
    return replace(model, vectors=vectors)


def save_model(model: Model, path: str, cell_files: int = 16, buckets: int | None = None) -> None:
    """Write the model tables.

    An item's postings are one row, so a later search needs no shuffle to find
    them together; vectors are partitioned by cell where there are cells.
    A cell is written by up to ``cell_files`` tasks, so a crowded one is no
    hot spot, and its files stay small enough to be read in parallel.

    With ``buckets`` metadata, postings and vectors without cells are stored in so many
    buckets of the item: joins of answers with metadata, and of items with those of one
    source, then find their rows in place. A bucket is read by one task.
    """
    path = path.rstrip("/")
    if buckets is not None:
        if model.index is not None or model.cells is not None:
            raise ValueError("a model with an index or cells has an order of its own; leave buckets out")
        for name, table in (("metadata", model.metadata), ("postings", model.packed), ("vectors", model.vectors)):
            if table is not None:
                write_bucketed(table, f"{path}/{name}", "item_id", buckets, placed=name == "postings" and model.buckets == buckets)
        if model.vocab is not None:
            model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        return
    model.metadata.write.mode("overwrite").parquet(f"{path}/metadata")
    if model.vocab is not None:
        model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        ordered = model.packed if model.index is None else model.packed.repartitionByRange("item_id").sortWithinPartitions("item_id")
        ordered.write.mode("overwrite").parquet(f"{path}/postings")
    if model.index is not None:
        build_index(model.packed, f"{path}/index")
    if model.vectors is None:
        return
    if model.cells is None:
        model.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        return
    model.cells.write.mode("overwrite").parquet(f"{path}/cells")
    model.vectors.repartition("cell_id", F.pmod(F.xxhash64("item_id"), F.lit(cell_files))).write.mode(
        "overwrite"
    ).option("maxRecordsPerFile", 1_000_000).partitionBy("cell_id").parquet(f"{path}/vectors")


def load_model(
    spark: SparkSession,
    path: str,
    with_cells: bool = False,
    terms: TermOptions | None = TermOptions(),
    encoder: Encoder | None = hashed_vectors,
    with_index: bool = False,
    buckets: int | None = None,
) -> Model:
    """The tables written by ``save_model``, read from their files.

    ``terms`` or ``encoder`` of None leaves that part out. Queries are encoded
    by ``encoder``, which has to be the one the model was fitted with, and
    ``buckets`` is the number it was saved with.
    """
    path = path.rstrip("/")

    def items(name: str) -> DataFrame:
        if buckets is None:
            return spark.read.parquet(f"{path}/{name}")
        return read_bucketed(spark, f"{path}/{name}", "item_id", buckets)

    model = Model(metadata=items("metadata"), encoder=encoder)
    if terms is not None:
        model = replace(model, vocab=spark.read.parquet(f"{path}/vocab"), packed=items("postings"), terms=terms)
        model = replace(model, index=load_index(spark, f"{path}/index") if with_index else None)
    if encoder is None:
        return model
    cells = spark.read.parquet(f"{path}/cells") if with_cells else None
    return replace(model, vectors=items("vectors"), cells=cells)
