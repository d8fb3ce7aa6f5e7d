"""One query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.catalog import inputs
from kindred.catalog.inputs import ALLOWED, BOOK_SAMPLE, PAPER_SAMPLE
from kindred.functions import text as T
from kindred.functions.accents import fold_accents
from kindred.functions.vectors import l2_normalize
from kindred.operators.cells import assign_cells, best_products, measured, topk_bounded, topk_cells, train_cells
from kindred.operators.lemma import lemmatize
from kindred.operators.position import dense_index, first_rows, sample_exact
from kindred.operators.terms import ngrams, pieces, term_counts, term_statistics, tokens
from kindred.operators.topk import topk_dense, without_self
from kindred.plans import ingest, quality
from kindred.plans.latent import fit_latent
from kindred.plans.model import fit_model, fit_terms, item_vectors, load_model, save_model
from kindred.plans.prepare import MAX_LENGTH, preprocess, usable
from kindred.plans.recommend import compare_methods, query_text, recommend, result_cards, similar_items
from kindred.plans.versions import append_batch, load_version
from kindred.session import TEXTS, fresh_path, written
from kindred.sources.files import read_csv, write_csv
from kindred.sources.lines import missing_to_null, parse_ndjson, parse_tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CELLS = 20  # cells in the inverted-file queries
BUCKETS = 16  # of saved models
LATENT = 16  # directions of the fitted encoder
LEMMAS = {"thees": "thee", "ndthe": "nd", "ble": "bl", "les": "le", "des": "de", "and": "et", "heed": "hee"}
LABELS = {"document": "Document", "page": "Web page"}


def register(query: Query) -> Query:
    QUERIES[query.__name__.removesuffix("_query")] = query
    return query


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge_items(inputs.document_items(spark, sf_dir), inputs.page_items(spark, sf_dir))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess(inputs.document_items(spark, sf_dir))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "documents").select("doc_id", "text")


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(clean_documents(spark, sf_dir).select("item_id", "text_clean"), "cleaned", **TEXTS)


# --- sources -----------------------------------------------------------------


@register
def parse_tsv_lines(spark, sf_dir):
    return parse_tsv(inputs.part_lines(spark, sf_dir))


@register
def na_tokens_to_null(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part")
    field = (
        F.when(F.pmod("p_partkey", F.lit(5)) == 0, "N/A")
        .when(F.pmod("p_partkey", F.lit(7)) == 0, "")
        .when(F.pmod("p_partkey", F.lit(11)) == 0, "null")
        .otherwise(F.col("p_name"))
    )
    return part.select("p_partkey", missing_to_null(field).alias("name"))


@register
def parse_ndjson_lines(spark, sf_dir):
    return parse_ndjson(inputs.paper_lines(spark, sf_dir), keep=["doc_id"])


@register
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "items-csv")
    write_csv(corpus(spark, sf_dir), path)
    return read_csv(spark, path)


@register
def metadata_table(spark, sf_dir):
    return ingest.metadata_table(corpus(spark, sf_dir), ["source", "item_id"]).drop("text")


@register
def model_tables_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "model")
    save_model(fit_model(clean_documents(spark, sf_dir)), path)
    model = load_model(spark, path)
    return (
        model.postings.groupBy("item_id")
        .agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("total_weight"))
        .join(model.metadata.select("item_id", "category"), "item_id")
        .join(model.vectors.select("item_id", F.size("embedding").alias("dim")), "item_id")
    )


# --- projections, defaults, filters ------------------------------------------


@register
def ingest_books(spark, sf_dir):
    raw = parse_tsv(inputs.book_lines(spark, sf_dir), keep=["doc_id"])
    return ingest.ingest_books(raw, "doc_id", BOOK_SAMPLE)


@register
def ingest_papers(spark, sf_dir):
    raw = parse_ndjson(inputs.paper_lines(spark, sf_dir), keep=["doc_id"])
    return ingest.ingest_papers(raw, "doc_id", PAPER_SAMPLE, ALLOWED)


@register
def dense_item_index(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("source", "doc_id")
    return dense_index(docs, ["source", "doc_id"], "row_index")


@register
def default_values(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    author = F.when(F.pmod("doc_id", F.lit(3)) == 1, "").when(F.pmod("doc_id", F.lit(3)) == 2, F.col("source"))
    return docs.select(
        "doc_id",
        ingest.default_if_null(author).alias("if_null"),
        ingest.default_if_empty(author).alias("if_empty"),
    )


@register
def drop_null_rows(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    title = F.when(F.pmod("doc_id", F.lit(4)) != 0, inputs.first_line(F.col("text")))
    return docs.select("doc_id", title.alias("title"), "text").dropna(subset=["title", "text"]).select("doc_id", "title")


@register
def filter_min_chars(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.filter(ingest.long_enough(F.col("text"))).select("doc_id", F.col("text").alias("line"))


@register
def filter_any_category(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    categories = F.when(F.pmod("doc_id", F.lit(13)) != 0, F.concat("lang", F.lit("  "), "source"))
    return docs.filter(ingest.any_category(categories, ALLOWED)).select("doc_id", "lang", "source")


@register
def filter_clean_length(spark, sf_dir):
    return clean_documents(spark, sf_dir).select("item_id", F.length("text_clean").alias("chars"))


@register
def filter_nonblank(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    blank = (
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "  \n")
        .when(F.pmod("doc_id", F.lit(5)) != 1, F.col("text"))
    )
    return usable(docs.select("doc_id", blank.alias("text_clean"))).select("doc_id", "text_clean")


@register
def first_n_kept(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    return first_rows(docs, "doc_id", 100).select("doc_id", "lang", "source")


@register
def sample_exact_n(spark, sf_dir):
    return sample_exact(inputs.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 250)


@register
def ingest_counters(spark, sf_dir):
    return ingest.ingest_counters(inputs.paper_lines(spark, sf_dir), ALLOWED)


@register
def merge_datasets(spark, sf_dir):
    return corpus(spark, sf_dir)


@register
def peek_rows(spark, sf_dir):
    return quality.peek(corpus(spark, sf_dir), "item_id", "text").select("item_id", "title", "text")


# --- text functions ----------------------------------------------------------


@register
def clean_html(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.remove_html(F.col("html")).alias("plain"))


@register
def clean_latex(spark, sf_dir):
    # pages hold runs of dollar signs; every document also gets commands
    docs = document_texts(spark, sf_dir)
    written = F.concat(F.lit("\\textbf{bold} "), "text", F.lit(" see \\cite{a} and \\alpha $x$"))
    return docs.select("doc_id", T.remove_latex(written).alias("plain"))


@register
def clean_special_chars(spark, sf_dir):
    return document_texts(spark, sf_dir).select("doc_id", T.keep_alphanumeric(F.col("text")).alias("plain"))


@register
def clean_stopwords(spark, sf_dir):
    words = F.lower(F.regexp_replace("text", "[.,]", " "))
    return document_texts(spark, sf_dir).select("doc_id", T.remove_stopwords(words).alias("kept"))


@register
def truncate_words(spark, sf_dir):
    return document_texts(spark, sf_dir).select("doc_id", T.truncate_words(F.col("text"), 120).alias("head"))


@register
def clean_text(spark, sf_dir):
    return document_texts(spark, sf_dir).select("doc_id", T.clean_text(F.col("text"), max_len=MAX_LENGTH).alias("text_clean"))


@register
def lemmatize_lookup(spark, sf_dir):
    # every word ending in "s" loses it: a dictionary as large as the corpus makes it
    cleaned = stored_documents(spark, sf_dir)
    words = cleaned.select(F.explode(F.split("text_clean", " ")).alias("word")).filter(F.col("word").endswith("s"))
    lemmas = words.distinct().select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
    return lemmatize(cleaned, "item_id", "text_clean", lemmas)


@register
def clean_text_lemmas(spark, sf_dir):
    docs = document_texts(spark, sf_dir)
    return docs.select("doc_id", T.clean_text(F.col("text"), lemmas=LEMMAS).alias("text_clean"))


@register
def strip_unicode(spark, sf_dir):
    docs = document_texts(spark, sf_dir)
    padded = F.concat(F.lit("\u00a0\u2003 \t"), "text", F.lit("\u3000\n\u00a0"))
    return docs.select("doc_id", T.strip(padded).alias("line"))


@register
def normalize_newlines(spark, sf_dir):
    docs = document_texts(spark, sf_dir)
    text = F.when(F.pmod("doc_id", F.lit(9)) != 0, F.concat(F.lit("\n "), "text", F.lit(" \n")))
    return docs.select("doc_id", T.one_line(text).alias("line"))


@register
def first_category(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    categories = F.when(F.pmod("doc_id", F.lit(13)) != 0, F.concat(F.lit(" "), "lang", F.lit("  "), "source"))
    return docs.select("doc_id", T.first_word(categories).alias("category"))


@register
def map_first_values(spark, sf_dir):
    part = inputs.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("row_key"),
        inputs.genre_text(F.col("p_partkey")).alias("raw"),
    )
    events = inputs.table(spark, sf_dir, "events").select(
        F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("row_key"), F.col("props").alias("raw")
    )
    return part.unionByName(events).select("row_key", ingest.first_values(F.col("raw")).alias("category"))


@register
def fold_accents_query(spark, sf_dir):
    return document_texts(spark, sf_dir).select("doc_id", fold_accents(F.col("text")).alias("folded"))


@register
def query_fallback(spark, sf_dir):
    # every fourth query is reduced to stop words, which cleaning empties
    queries = inputs.query_texts(spark, sf_dir)
    text = F.when(F.pmod("query_id", F.lit(4)) == 0, "What is THE").otherwise(F.col("text"))
    return queries.select("query_id", query_text(text).alias("query_text"))


# --- corpus tables and metrics -----------------------------------------------


@register
def preprocess_query(spark, sf_dir):
    return preprocess(corpus(spark, sf_dir)).select("item_id", "source", "text_clean")


@register
def preprocess_lemmas(spark, sf_dir):
    """Preparation with a lemma table, as texts are prepared by default."""
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "word string, lemma string")
    return preprocess(corpus(spark, sf_dir), lemmas=lemmas).select("item_id", "source", "text_clean")


@register
def preprocess_summary(spark, sf_dir):
    return quality.preprocess_summary(preprocess(corpus(spark, sf_dir))).withColumn(
        "avg_clean_text_len", F.round("avg_clean_text_len", 6)
    )


@register
def corpus_metrics(spark, sf_dir):
    return quality.corpus_metrics(corpus(spark, sf_dir), ("document", "page")).withColumn(
        "avg_clean_text_len", F.round("avg_clean_text_len", 6)
    )


@register
def count_by_source(spark, sf_dir):
    return quality.count_by_source(corpus(spark, sf_dir))


@register
def profile_nulls(spark, sf_dir):
    items = corpus(spark, sf_dir).withColumn("authors", F.nullif("authors", F.lit("src1")))
    return quality.null_profile(items)


@register
def quality_checks(spark, sf_dir):
    raw = corpus(spark, sf_dir)
    return quality.quality_checks(raw, preprocess(raw))


# --- terms -------------------------------------------------------------------


@register
def ngrams_query(spark, sf_dir):
    words = tokens(F.col("text_clean"), plain=True)
    return clean_documents(spark, sf_dir).select("item_id", F.array_join(ngrams(words, 1, 3), "|").alias("terms"))


@register
def term_frequency(spark, sf_dir):
    return term_counts(clean_documents(spark, sf_dir), "item_id", "text_clean")


@register
def document_frequency(spark, sf_dir):
    return term_statistics(clean_documents(spark, sf_dir), "text_clean").filter("df >= 2")


@register
def vocabulary(spark, sf_dir):
    vocab, _ = fit_terms(stored_documents(spark, sf_dir))
    return vocab.withColumn("idf", F.round("idf", 6))


@register
def tfidf_weights(spark, sf_dir):
    _, postings = fit_terms(stored_documents(spark, sf_dir))
    return postings.withColumn("weight", F.round("weight", 6))


@register
def model_metrics_sparse(spark, sf_dir):
    docs = stored_documents(spark, sf_dir)
    vocab, postings = fit_terms(docs)
    return quality.sparse_metrics(vocab, postings, docs).withColumn("sparsity", F.round("sparsity", 9))


# --- search ------------------------------------------------------------------


def _model(spark, sf_dir, items=inputs.document_items, **options):
    raw = items(spark, sf_dir)
    return fit_model(preprocess(raw), metadata=raw, **options)


_RANKED = ("query_id", "rank", "item_id", "similarity_score", "method")


@register
def tfidf_transform_queries(spark, sf_dir):
    model = _model(spark, sf_dir, encoder=None)
    queries = inputs.query_texts(spark, sf_dir).withColumn("text", query_text(F.col("text")))
    return model.query_terms(queries).withColumn("weight", F.round("weight", 6))


@register
def tfidf_topk(spark, sf_dir):
    return similar_items(inputs.query_texts(spark, sf_dir), _model(spark, sf_dir, encoder=None), "tfidf", 10).select(*_RANKED)


@register
def tfidf_topk_appended(spark, sf_dir):
    """The search of ``tfidf_topk`` in a model that was appended to twice."""
    path = fresh_path(spark, "model")
    items = clean_documents(spark, sf_dir)
    half = F.pmod(F.xxhash64("item_id"), F.lit(2))
    for name in (0, 1):
        append_batch(path, str(name), items.filter(half == name), encoder=None)
    return similar_items(inputs.query_texts(spark, sf_dir), load_version(spark, path, encoder=None), "tfidf", 10).select(*_RANKED)


@register
def tfidf_topk_index(spark, sf_dir):
    """The search of ``tfidf_topk`` through the inverted index."""
    model = _model(spark, sf_dir, encoder=None, index=True)
    return similar_items(inputs.query_texts(spark, sf_dir), model, "tfidf", 10).select(*_RANKED)


@register
def recommend_index_source(spark, sf_dir):
    """``recommend_source_filter`` through the inverted index."""
    model = _model(spark, sf_dir, corpus, encoder=None, index=True)
    queries = inputs.query_texts(spark, sf_dir)
    modes = [
        recommend(queries, model, "tfidf", source="page", mode=mode).select(F.lit(mode).alias("mode"), *_RANKED)
        for mode in ("parity", "exact")
    ]
    return reduce(DataFrame.unionByName, modes)


@register
def topk_with_metadata(spark, sf_dir):
    answers = similar_items(inputs.query_texts(spark, sf_dir), _model(spark, sf_dir, encoder=None), "tfidf", 3)
    return answers.select(*_RANKED, "title", "authors", "category", "source")


@register
def hashed_embedding(spark, sf_dir):
    vectors = item_vectors(stored_documents(spark, sf_dir))
    return vectors.select("item_id", F.posexplode("embedding").alias("slot", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 5)
    )


@register
def semantic_topk(spark, sf_dir):
    model = _model(spark, sf_dir, terms=None)
    return similar_items(inputs.query_texts(spark, sf_dir), model, "semantic", 10).select(*_RANKED)


@register
def l2_normalize_query(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x * F.pmod(F.col("item_id"), F.lit(4)))
    unit = inputs.item_vectors(spark, sf_dir).select("item_id", l2_normalize(scaled).alias("unit"))
    return unit.select("item_id", F.posexplode("unit").alias("slot", "value")).withColumn("value", F.round("value", 6))


@register
def dense_topk_exact(spark, sf_dir):
    return topk_dense(inputs.query_vectors(spark, sf_dir), inputs.item_vectors(spark, sf_dir), 10)


@register
def topk_exclude_self(spark, sf_dir):
    ranked = topk_dense(inputs.query_vectors(spark, sf_dir), inputs.item_vectors(spark, sf_dir), 11)
    return without_self(ranked, 10)


@register
def topk_exclude_self_exact(spark, sf_dir):
    return topk_dense(inputs.query_vectors(spark, sf_dir), inputs.item_vectors(spark, sf_dir), 10, below=0.9999)


@register
def model_metrics_dense(spark, sf_dir):
    return quality.dense_metrics(inputs.item_vectors(spark, sf_dir)).withColumn(
        "embedding_norm_mean", F.round("embedding_norm_mean", 6)
    )


def _cells(spark, sf_dir, trained=False):
    vectors = inputs.item_vectors(spark, sf_dir)
    cells = train_cells(vectors, CELLS) if trained else written(inputs.label_cells(spark, sf_dir), "cells")
    return cells, assign_cells(vectors, cells)


@register
def kmeans_cells(spark, sf_dir):
    """Cells and vectors of a trained index, and vectors that lie in another cell than their nearest."""
    cells, assigned = _cells(spark, sf_dir, trained=True)
    product = F.aggregate(F.zip_with("embedding", "centroid", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    own = best_products(assigned, cells)
    return own.agg(
        F.countDistinct("cell_id").alias("cells"), F.count("*").alias("vectors"),
        F.count_if(F.col("own") < F.col("best") - 0.000001).alias("misplaced"),
    )


@register
def ivf_cell_sizes(spark, sf_dir):
    return quality.cell_sizes(_cells(spark, sf_dir)[1])


@register
def dense_topk_ivf(spark, sf_dir):
    cells, assigned = _cells(spark, sf_dir)
    return topk_bounded(inputs.query_vectors(spark, sf_dir), assigned, measured(assigned, cells), 10, n_probe=4)


@register
def dense_topk_ivf_all_cells(spark, sf_dir):
    cells, assigned = _cells(spark, sf_dir, trained=True)
    return topk_cells(inputs.query_vectors(spark, sf_dir), assigned, cells, 10, n_probe=CELLS)


@register
def semantic_topk_cells(spark, sf_dir):
    """The search of ``semantic_topk`` through trained cells."""
    model = _model(spark, sf_dir, terms=None, n_cells=CELLS)
    return similar_items(inputs.query_texts(spark, sf_dir), model, "semantic", 10, n_probe=4).select(*_RANKED)


@register
def recommend_cells_source(spark, sf_dir):
    """``recommend_semantic_source`` through trained cells."""
    model = _model(spark, sf_dir, corpus, terms=None, n_cells=CELLS)
    queries = inputs.query_texts(spark, sf_dir)
    modes = [
        recommend(queries, model, "semantic", source="page", mode=mode, n_probe=4).select(F.lit(mode).alias("mode"), *_RANKED)
        for mode in ("parity", "exact")
    ]
    return reduce(DataFrame.unionByName, modes)


@register
def recommend_query(spark, sf_dir):
    model = _model(spark, sf_dir, corpus, encoder=None)
    return recommend(inputs.query_texts(spark, sf_dir), model, "tfidf").select(*_RANKED)


@register
def recommend_source_filter(spark, sf_dir):
    """Both modes side by side; they differ where over-fetching misses pages."""
    model = _model(spark, sf_dir, corpus, encoder=None)
    queries = inputs.query_texts(spark, sf_dir)
    modes = [
        recommend(queries, model, "tfidf", source="page", mode=mode).select(F.lit(mode).alias("mode"), *_RANKED)
        for mode in ("parity", "exact")
    ]
    return reduce(DataFrame.unionByName, modes)


@register
def recommend_bucketed(spark, sf_dir):
    """``recommend_source_filter`` on a saved model whose tables are bucketed by item."""
    path = fresh_path(spark, "model")
    save_model(_model(spark, sf_dir, corpus, encoder=None, buckets=BUCKETS), path, buckets=BUCKETS)
    model = load_model(spark, path, encoder=None, buckets=BUCKETS)
    queries = inputs.query_texts(spark, sf_dir)
    modes = [
        recommend(queries, model, "tfidf", source="page", mode=mode).select(F.lit(mode).alias("mode"), *_RANKED)
        for mode in ("parity", "exact")
    ]
    return reduce(DataFrame.unionByName, modes)


@register
def latent_components(spark, sf_dir):
    """Directions of the fitted encoder: length, right angles, order, and strength against all items' projections."""
    model = _model(spark, sf_dir, encoder=None)
    space = fit_latent(model, dim=LATENT)
    loadings = space.components.select("term", F.posexplode("loadings").alias("component", "x"))
    projected = model.postings.join(loadings, "term").groupBy("item_id", "component").agg(F.sum(F.col("weight") * F.col("x")).alias("p"))
    strength = projected.groupBy("component").agg(F.sum(F.col("p") * F.col("p")).alias("found"), F.count("*").alias("items"))
    products = [F.sum(F.col("loadings")[i] * F.col("loadings")[j]) - float(i == j) for i in range(LATENT) for j in range(i, LATENT)]
    off = space.components.agg(F.greatest(*map(F.abs, products))).first()[0]
    given = spark.createDataFrame([(i, s, space.strengths[max(i - 1, 0)]) for i, s in enumerate(space.strengths)], "component int, s double, before double")
    return given.join(strength, "component").select(
        "component", "items",
        (F.abs(F.col("found") - F.col("s")) <= 0.000001 * F.col("s")).alias("strength_agrees"),
        (F.col("s") <= F.col("before")).alias("falling"), F.lit(off <= 0.000001).alias("orthonormal"),
    )


@register
def latent_self_search(spark, sf_dir):
    """Items with a known term, encoded by the fitted encoder and asked for themselves: all of them, at unit length, are their own nearest."""
    model = _model(spark, sf_dir, encoder=None)
    space = fit_latent(model, dim=LATENT)
    # the cleaned texts that the model was fitted to, in as many parts as their size asks for
    parts = max(pieces(model.docs, "text_clean")[1], spark.sparkContext.defaultParallelism)
    vectors = written(space(model.docs, "item_id", "text_clean", parts), "vectors")
    norm = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda total, x: total + x)
    asked = vectors.join(model.packed.select("item_id"), "item_id", "left_semi").withColumnRenamed("item_id", "query_id")
    best = topk_dense(written(asked, "asked"), vectors, 1).join(vectors.select("item_id", norm.alias("norm")), "item_id")
    return best.select("query_id", F.round("score", 4).alias("score"), (F.abs(F.col("norm") - 1) < 0.0001).alias("unit"))


@register
def recommend_semantic_source(spark, sf_dir):
    model = _model(spark, sf_dir, corpus, terms=None)
    queries = inputs.query_texts(spark, sf_dir)
    modes = [
        recommend(queries, model, "semantic", source="page", mode=mode).select(F.lit(mode).alias("mode"), *_RANKED)
        for mode in ("parity", "exact")
    ]
    return reduce(DataFrame.unionByName, modes)


@register
def compare_methods_query(spark, sf_dir):
    model = _model(spark, sf_dir, corpus)
    queries = inputs.query_texts(spark, sf_dir)
    return compare_methods(
        recommend(queries, model, "tfidf"), recommend(queries, model, "semantic", source="document")
    )


@register
def result_cards_query(spark, sf_dir):
    model = _model(spark, sf_dir, corpus, encoder=None)
    return result_cards(recommend(inputs.query_texts(spark, sf_dir), model, "tfidf", top_n=3), LABELS)


@register
def quality_model_parity(spark, sf_dir):
    model = fit_model(clean_documents(spark, sf_dir))
    return quality.model_parity(model.docs, model.postings, model.vectors)
