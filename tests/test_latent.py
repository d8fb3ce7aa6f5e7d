import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.catalog.oracle import ORACLE
from kindred.catalog.queries import QUERIES
from kindred.plans import latent
from kindred.plans.latent import fit_latent, load_latent, save_latent
from kindred.plans.model import TermOptions, fit_model
from kindred.plans.recommend import nearest
from kindred.session import fresh_path

OPTIONS = TermOptions(ngram_max=1, min_df=1, max_df=1.0)


@pytest.fixture(scope="module")
def items(spark):
    """Three topics of very different size, and a text without words."""
    rng = np.random.default_rng(3)
    topics = [[f"{letter}{letter}{n}" for n in range(12)] for letter in "abc"]
    sizes = (120, 50, 20)
    texts = [" ".join(rng.choice(topics[t], 8)) for t, size in enumerate(sizes) for _ in range(size)] + [" "]
    rows = [(f"i{n}", "page", f"t{n}", x, "", "", x) for n, x in enumerate(texts)]
    return spark.createDataFrame(rows, "item_id string, source string, title string, text string, authors string, category string, text_clean string")


@pytest.fixture(scope="module")
def model(items):
    return fit_model(items, terms=OPTIONS, encoder=None)


def _matrix(model, space):
    terms, loadings = space.matrix()
    place = {t: i for i, t in enumerate(terms.to_pylist())}
    names = sorted(r["item_id"] for r in model.packed.select("item_id").collect())
    dense = np.zeros((len(names), len(place)))
    for r in model.postings.collect():
        dense[names.index(r["item_id"]), place[r["term"]]] = r["weight"]
    return names, dense, loadings


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_subspace_against_singular_vectors(model, monkeypatch, chunk):
    monkeypatch.setattr(latent, "_CHUNK", chunk)
    space = fit_latent(model, dim=3, rounds=30, tolerance=1e-12)
    names, dense, loadings = _matrix(model, space)
    _, values, right = np.linalg.svd(dense)
    assert np.allclose(space.strengths, values[:3] ** 2, rtol=1e-6)
    assert np.allclose(np.linalg.svd(right[:3] @ loadings)[1], 1, atol=1e-6)
    found = {r["item_id"]: r["embedding"] for r in space(model.docs, "item_id", "text_clean").collect()}
    wanted = dense @ loadings
    wanted /= np.linalg.norm(wanted, axis=1, keepdims=True)
    assert np.allclose([found[n] for n in names], wanted, atol=1e-5)


def test_as_encoder_of_a_model(spark, items, model):
    space = fit_latent(model, dim=3)
    path = fresh_path(spark, "latent")
    save_latent(space, path)
    again = load_latent(spark, path, OPTIONS)
    assert again.strengths == space.strengths
    searched = fit_model(items, terms=None, encoder=again)
    questions = spark.createDataFrame([(1, "bb1 bb2"), (2, "cc5 and CC6"), (3, "unknown")], "query_id int, text string")
    answers = nearest(questions, searched, "semantic", 5).join(items.select("item_id", F.col("text").alias("body")), "item_id").collect()
    for query, letter in ((1, "b"), (2, "c")):
        mine = [r for r in answers if r["query_id"] == query]
        assert mine and all(r["body"].startswith(letter) for r in mine)
    zero = again(questions, "query_id", "text").filter("query_id = 3").first()["embedding"]
    assert zero == [0.0] * 3


def test_bounds_of_the_vocabulary(spark, model, monkeypatch):
    assert len(fit_latent(model, dim=100).strengths) == 36
    monkeypatch.setattr(latent, "MATRIX_BYTES", 1000)
    with pytest.raises(ValueError, match="vocabulary"):
        fit_latent(model, dim=3)


def test_more_groups_than_one(model):
    """Partial sums of several tasks add up."""
    one = fit_latent(model, dim=2, rounds=2, tolerance=0)
    many = fit_latent(latent.Model(metadata=model.metadata, vocab=model.vocab, packed=model.packed.repartition(7), terms=OPTIONS), dim=2, rounds=2, tolerance=0)
    assert np.allclose(one.strengths, many.strengths)


def test_self_search_asks_for_every_item(spark, tmp_path):
    """All items with a known term are asked; one without any is no query, but stays in the table that is searched."""
    rng = np.random.default_rng(5)
    words = [a + b for a in "bcdfg" for b in ("alpha", "beta", "gamma", "delta", "omega")]
    texts = [" ".join(rng.choice(words, 14)) for _ in range(150)] + [" ".join(f"once{i}" for i in range(12))]
    spark.createDataFrame([(n, x, "en", "s") for n, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    found = QUERIES["latent_self_search"](spark, str(tmp_path)).collect()
    assert sorted(r["query_id"] for r in found) == sorted(f"doc_{n}" for n in range(150))
    assert all(r["unit"] and r["score"] == 1 for r in found)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE["latent_self_search"]).fetchall()) == sorted((r["query_id"], r["score"], r["unit"]) for r in found)


def test_rounds_read_numbers_for_terms_that_are_stored_once(spark, model, monkeypatch):
    """The postings are read for one pass, however many rounds there are, and small matrices add up to the same sums."""
    whole = fit_latent(model, dim=3, rounds=6, tolerance=0)
    monkeypatch.setattr(latent, "_ROWS", 7)
    monkeypatch.setattr(latent, "_DENSE", 20)
    passes = spark.sparkContext.accumulator(0)
    schema = "item_id string, terms array<string>, weights array<double>"

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    packed = model.packed.mapInArrow(counted, schema)
    pieces = fit_latent(latent.Model(metadata=model.metadata, vocab=model.vocab, packed=packed, terms=OPTIONS), dim=3, rounds=6, tolerance=0)
    assert passes.value == model.packed.count()
    assert np.allclose(pieces.strengths, whole.strengths)
    assert np.allclose(pieces.matrix()[1], whole.matrix()[1], atol=1e-6)
