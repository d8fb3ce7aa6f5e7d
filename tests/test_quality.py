import pytest

from kindred.plans import quality
from kindred.plans.model import TermOptions, fit_model
from kindred.plans.prepare import preprocess, usable
from kindred.sources.files import ITEM_COLUMNS

LONG = "granite marble basalt quartz feldspar obsidian pumice slate"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        ("a", "book", "A", f"<p>The {LONG}</p>", "x", "c"),
        ("b", "book", "B", f"{LONG} {LONG}", None, "c"),
        ("c", "paper", "C", "too short", "x", None),
        ("d", "paper", None, None, "x", "c"),
        ("e", "paper", "E", LONG.replace("granite", "gneiss"), "x", "c"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ITEM_COLUMNS))


def test_preprocess(raw):
    got = {r["item_id"]: r["text_clean"] for r in preprocess(raw).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"] == LONG
    plan = preprocess(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<(?:script") == 1  # the length filter does not clean again
    assert usable(raw, "text").count() == 4


def test_lemma_table_in_preprocess(spark, raw):
    lemmas = spark.createDataFrame([("granite", "rock")], "word string, lemma string")
    got = {r["item_id"]: r["text_clean"] for r in preprocess(raw, lemmas=lemmas).collect()}
    assert got["a"] == LONG.replace("granite", "rock") and set(got) == {"a", "b", "e"}


def test_metrics(raw):
    m = quality.corpus_metrics(raw, ("book", "paper")).first()
    assert (m["total_docs"], m["book_count"], m["paper_count"], m["rows_dropped"], m["null_text_pct"]) == (3, 2, 1, 2, 0.0)
    nulls = {r["column_name"]: r["nulls"] for r in quality.null_profile(raw).collect()}
    assert nulls == {"item_id": 0, "source": 0, "title": 1, "text": 1, "authors": 1, "category": 1}
    assert [tuple(r) for r in quality.count_by_source(raw).collect()] == [("paper", 3), ("book", 2)]
    summary = {r["source"]: r["n"] for r in quality.preprocess_summary(preprocess(raw)).collect()}
    assert summary == {"book": 2, "paper": 1, "all": 3}


def test_checks(raw):
    good = {r["check_name"]: r["passed"] for r in quality.quality_checks(raw, preprocess(raw)).collect()}
    assert len(good) == 5 and all(good.values())
    bad = {r["check_name"]: r["passed"] for r in quality.quality_checks(raw.drop("title"), raw.limit(0)).collect()}
    assert not bad["raw_missing_columns"] and not bad["clean_column_missing"] and not bad["processed_rows"]


def test_model_metrics(raw):
    model = fit_model(preprocess(raw), terms=TermOptions(max_features=5, ngram_max=1, max_df=1.0))
    m = quality.sparse_metrics(model.vocab, model.postings, model.docs).first()
    assert (m["vocab_size"], m["matrix_rows"], m["nnz"]) == (5, 3, 15) and m["sparsity"] == 0.0
    d = quality.dense_metrics(model.vectors).first()
    assert (d["embedding_dim"], d["embedding_count"]) == (64, 3) and d["embedding_norm_mean"] == pytest.approx(1, abs=1e-6)
    parity = quality.model_parity(model.docs, model.postings, model.vectors).first()
    assert parity["passed"] and parity["items_without_terms"] == 0


def test_summary_keeps_null_sources_apart(spark):
    rows = spark.createDataFrame([("a", "xx"), (None, "xxxx")], "source string, text_clean string")
    got = {(r["source"], r["n"], r["avg_clean_text_len"]) for r in quality.preprocess_summary(rows).collect()}
    assert got == {("a", 1, 2.0), (None, 1, 4.0), ("all", 2, 3.0)}


def test_blank_texts_do_not_count_in_the_model(spark):
    texts = ["apple one", "apple two", "apple three", None, "  "]
    rows = [(str(i), "s", "t", t, "a", "c", t) for i, t in enumerate(texts)]
    names = "item_id string, source string, title string, text string, authors string, category string, text_clean string"
    vocab = fit_model(spark.createDataFrame(rows, names), terms=TermOptions(max_df=1.0), encoder=None).vocab
    assert vocab.filter("term = 'apple'").first()["idf"] == 1.0
