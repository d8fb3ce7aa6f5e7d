import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import session
from kindred.operators import joins, postings, topk
from kindred.operators.cells import CellBounds, assign_cells, measured, topk_bounded, topk_cells, train_cells, use_cells
from kindred.operators.encode import encode_with, hashed_vectors
from kindred.operators.terms import ngrams, tokens, top_rows
from kindred.operators.topk import topk_dense, without_self
from kindred.plans.model import TermOptions, fit_model, load_model, save_model
from kindred.plans.recommend import compare_methods, query_text, recommend, result_cards, similar_items

TEXTS = [
    "deep network training data network", "speech translation network corpus", "image segmentation network vision",
    "agent reward policy learning", "graph embedding network learning", "attention encoder translation model",
    "dragon castle wizard quest", "starship robot colony quest", "detective murder clue city", "wizard castle love story",
]


def brute_tfidf(texts, low, high, max_features):
    def terms(t):
        w = [x for x in t.split() if len(x) > 1]
        return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    counts = [Counter(terms(t)) for t in texts]
    df, cf = Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        cf.update(c)
    kept = [t for t in df if 2 <= df[t] <= 0.95 * len(texts)]
    vocab = sorted(kept, key=lambda t: (-cf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}

    def weigh(c):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    return idf, [weigh(c) for c in counts], lambda q: weigh(Counter(terms(q)))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"item_{i}", "paper" if i < 6 else "book", f"Title {i}", t, f"Author {i}", "c", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows, "item_id string, source string, title string, text string, authors string, category string, text_clean string"
    )


@pytest.fixture(scope="module")
def model(items):
    return fit_model(items, terms=TermOptions(max_features=100))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(
        [(1, "network learning"), (2, "the castle of a wizard"), (3, "zebra"), (4, TEXTS[0]), (5, "  ")], "query_id int, text string"
    )


@pytest.mark.parametrize("low, high, features", [(1, 1, 100), (1, 2, 100), (1, 2, 3)])
def test_tfidf_against_brute_force(items, low, high, features):
    model = fit_model(items, terms=TermOptions(features, low, high))
    idf, weights, _ = brute_tfidf(TEXTS, low, high, features)
    assert {r["term"]: pytest.approx(r["idf"]) for r in model.vocab.collect()} == idf
    got = {}
    for r in model.postings.collect():
        got.setdefault(r["item_id"], {})[r["term"]] = r["weight"]
    expected = {f"item_{i}": w for i, w in enumerate(weights) if w}
    assert got.keys() == expected.keys()
    for item, w in expected.items():
        assert got[item] == pytest.approx(w)


def test_ngrams(apply):
    run = lambda low, high: lambda c: F.array_join(ngrams(tokens(c), low, high), "|")
    assert apply(run(1, 2), "Big x red Fox", "one", "") == ["big|red|fox|big red|red fox", "one", ""]
    assert apply(run(2, 3), "aa bb cc") == "aa bb|bb cc|aa bb cc"


@pytest.mark.parametrize("limit", [topk.ONE_TASK_ROWS, 1])
def test_top_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "ONE_TASK_ROWS", limit)
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = top_rows(df, [F.desc("v"), F.asc("id")], 20, salts=4).collect()
    assert [r["id"] for r in got] == [i for i in range(500) if i % 7 == 6][:20]


def test_similar_items_against_brute_force(model, questions):
    _, weights, query = brute_tfidf(TEXTS, 1, 2, 100)
    got = similar_items(questions, model, "tfidf", 3).collect()
    assert {r["method"] for r in got} == {"tfidf"}
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["item_id"], r["similarity_score"]))
    assert set(by_query) == {1, 2, 4}  # a query without a known term, or blank, has no answer
    for number, text in [(1, "network learning"), (2, "castle wizard"), (4, TEXTS[0])]:
        q = query(text)
        scores = [(f"item_{i}", round(sum(w.get(t, 0) * x for t, x in q.items()), 6)) for i, w in enumerate(weights)]
        # identical vectors count as the query itself; items without a shared term are not joined
        ranked = sorted([s for s in scores if 0 < s[1]], key=lambda s: (-s[1], s[0]))[:4]
        assert by_query[number] == [s for s in ranked if s[1] < 0.9999][:3]


def zipf_items(spark, n, seed=7):
    rng = np.random.default_rng(seed)
    words = np.minimum(rng.zipf(1.3, size=(n, 40)), 3000)
    rows = [(f"item_{i:05d}", "s", None, None, None, None, " ".join(f"w{w:04d}" for w in row)) for i, row in enumerate(words)]
    rows += [(f"copy_{i}", "s", None, None, None, None, rows[0][6]) for i in range(30)]  # ties across the k-th place
    return spark.createDataFrame(rows, "item_id string, source string, title string, text string, authors string, category string, text_clean string")


def test_inverted_index_equals_the_scan(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "BLOCK", 16)
    monkeypatch.setattr(postings, "GROUP", 64)
    items = zipf_items(spark, 600)
    model = fit_model(items, encoder=None, index=True, terms=TermOptions(max_features=2000))
    blocks = model.index.blocks
    assert blocks.filter("size(items) > 16 OR size(items) <> size(weights) OR top <> array_max(weights)").count() == 0
    assert blocks.agg(F.sum(F.size("items"))).first()[0] == model.postings.count() == model.index.tops.agg(F.sum("postings")).first()[0]
    texts = items.filter("item_id IN ('item_00000', 'item_00100', 'item_00200')").select("item_id", F.col("text_clean").alias("text"))
    asked = texts.selectExpr("hash(item_id) AS query_id", "text").unionByName(
        spark.createDataFrame([(1, "w0001 w0002"), (2, "w0007"), (3, "nothing known"), (4, "w0001")], "query_id int, text string")
    )
    for k, below in ((10, None), (3, 0.9999), (1000, None)):
        for lookup in (postings.LOOKUP_KEYS, 0):
            monkeypatch.setattr(postings, "LOOKUP_KEYS", lookup)
            terms = lambda block: model.query_terms(block)
            through = postings.topk_index(terms, asked, model.index, model.packed, k, below)
            assert answers(through) == answers(topk.topk_sparse(terms, asked, model.packed, k, below))
        monkeypatch.undo()
        monkeypatch.setattr(postings, "BLOCK", 16)
    part = model.packed.filter("item_id > 'item_00300'")
    assert answers(postings.topk_index(terms, asked, model.index, part, 5)) == answers(topk.topk_sparse(terms, asked, part, 5))
    assert postings.topk_index(terms, asked.limit(0), model.index, model.packed, 5).count() == 0
    save_model(model, f"{tmp_path}/model")
    loaded = load_model(spark, f"{tmp_path}/model", encoder=None, with_index=True)
    assert answers(postings.topk_index(terms, asked, loaded.index, loaded.packed, 5)) == answers(topk.topk_sparse(terms, asked, model.packed, 5))


def test_few_queries_read_a_small_share_of_the_postings(spark):
    model = fit_model(zipf_items(spark, 3000), encoder=None, index=True, terms=TermOptions(max_features=2000, ngram_max=1))
    asked = spark.createDataFrame([(1, "w0001 w0002 w0900 w0901 w0950"), (2, "w0001 w0003 w0800 w0801")], "query_id int, text string")
    wanted = model.query_terms(asked).join(model.index.tops, "term").withColumn("bound", F.col("weight") * F.col("top"))
    best = topk.topk_sparse(model.query_terms, asked, model.packed, 3).filter("rank = 3").selectExpr("query_id", "score AS least")
    read = postings.essential(wanted, best).agg(F.sum("postings")).first()[0]
    assert read < 0.1 * wanted.agg(F.sum("postings")).first()[0] < 0.1 * model.postings.count()


def test_thousands_of_keys_are_looked_up_in_files(spark, tmp_path):
    rows = spark.range(30_000).selectExpr("concat('t', lpad(id, 6, '0')) AS term", "id AS v")
    rows.coalesce(2).write.parquet(f"{tmp_path}/many")
    keys = spark.range(postings.LOOKUP_KEYS).selectExpr("concat('t', lpad(3 * id, 6, '0')) AS term")
    with session.pushing_lists(spark, postings.LIST_KEYS):
        got = postings.among(spark.read.parquet(f"{tmp_path}/many"), "term", keys)
        assert got.agg(F.count("*"), F.sum("v")).first()[:] == (10_000, 3 * sum(range(10_000)))


def test_lists_of_keys_reach_the_files(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("concat('t', lpad(id, 6, '0')) AS term", "id AS v")
    rows.repartitionByRange(8, "term").sortWithinPartitions("term").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    keys = spark.createDataFrame([(f"t{i:06d}",) for i in range(0, 40)], "term string")
    with session.pushing_lists(spark, 100):
        found = postings.among(table, "term", keys)
        assert found.count() == 40
        assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString()


def test_blocks_of_queries(spark, model, questions, monkeypatch):
    whole = recommend(questions, model, "tfidf").orderBy("query_id", "rank").collect()
    dense = recommend(questions, model, "semantic").orderBy("query_id", "rank").collect()
    monkeypatch.setattr(topk, "SPARSE_BLOCK", 1)
    monkeypatch.setattr(topk, "DENSE_BLOCK", 2)
    assert recommend(questions, model, "tfidf").orderBy("query_id", "rank").collect() == whole
    assert recommend(questions, model, "semantic").orderBy("query_id", "rank").collect() == dense


def test_modes_and_source(model, questions):
    exact = recommend(questions, model, "semantic", source="book", top_n=2, mode="exact")
    assert {r["source"] for r in exact.collect()} == {"book"}
    assert exact.filter("query_id = 1").count() == 2
    parity = recommend(questions, model, "semantic", source="book", top_n=1, mode="parity")
    assert parity.groupBy("query_id").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError):
        recommend(questions, model, "semantic", mode="other")
    with pytest.raises(ValueError):
        recommend(questions, model, "other")


def test_compare_and_cards(model, questions):
    a, b = recommend(questions, model, "tfidf", top_n=3), recommend(questions, model, "semantic", top_n=3)
    rows = compare_methods(a, b).collect()
    for r in rows:
        assert r["right_count"] == 3 and r["left_count"] <= 3 and r["overlap"] <= r["left_count"]
    cards = result_cards(a, {"book": "Book"}, "Item").collect()
    assert {c["source_tag"] for c in cards} <= {"BOOK", "PAPER"} and {c["label"] for c in cards} <= {"Book", "Item"}
    assert all(len(c["score"].split(".")[1]) == 4 for c in cards)


def test_query_fallback(apply):
    assert apply(query_text, "What is THE", "The Castle") == ["What is THE", "castle"]


def vectors_table(spark, matrix, key="item_id"):
    rows = [(f"v{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} string, embedding array<float>")


@pytest.mark.parametrize("parts", [1, 8, 64])
@pytest.mark.parametrize("below", [None, 0.9999])
def test_dense_against_numpy(spark, parts, below):
    rng = np.random.default_rng(5)
    matrix = rng.normal(size=(300, 16)).astype("float32")
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[100:200] = matrix[0]  # a third of all rows are copies of one
    matrix[7] = 0
    got = topk_dense(
        vectors_table(spark, matrix[:5], "query_id"), vectors_table(spark, matrix).repartition(parts), 10, below
    ).orderBy("query_id", "rank").collect()
    scores = np.round(matrix[:5].astype(float) @ matrix.astype(float).T, 6)
    expected = []
    for q in range(5):
        order = sorted(range(300), key=lambda i: (-scores[q, i], i))
        order = [i for i in order if below is None or scores[q, i] < below][:10]
        expected += [(f"v{q:04d}", f"v{i:04d}", n + 1) for n, i in enumerate(order)]
    assert [(r["query_id"], r["item_id"], r["rank"]) for r in got] == expected
    trimmed = without_self(topk_dense(vectors_table(spark, matrix[1:2], "query_id"), vectors_table(spark, matrix), 11), 10)
    assert trimmed.count() == 10


def test_ragged_vectors_are_refused(spark):
    bad = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "item_id string, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="one width"):
        topk_dense(vectors_table(spark, [[1, 0]], "query_id"), bad, 1).collect()


def test_cells(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16))
    matrix = np.concatenate([c + 0.2 * rng.normal(size=(60 if i else 240, 16)) for i, c in enumerate(centers)])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    vectors, asked = vectors_table(spark, matrix).cache(), vectors_table(spark, matrix[::40], "query_id")
    cells = train_cells(vectors, 8)
    assigned = assign_cells(vectors, cells).cache()
    assert assigned.count() == len(matrix)
    pairs = lambda df: {(r["query_id"], r["item_id"]) for r in df.collect()}
    exact = pairs(topk_dense(asked, vectors, 10))
    assert pairs(topk_cells(asked, assigned, cells, 10, n_probe=8)) == exact
    recalls = [len(exact & pairs(topk_cells(asked, assigned, cells, 10, n_probe=p))) / len(exact) for p in (1, 3)]
    assert recalls[0] > 0.5 and recalls[1] >= recalls[0]
    assert use_cells(1950, 50) and not use_cells(1949, 50)


def answers(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_bounded_search_equals_the_exact_one(spark, spread):
    """From vectors that lie in clear cells to ones that lie in none."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 16))
    matrix = np.concatenate([c + spread * rng.normal(size=(40, 16)) for c in centers])
    matrix[::3] /= np.linalg.norm(matrix[::3], axis=1, keepdims=True)
    matrix[5:9] = 0
    matrix[100:160] = matrix[100]  # ties across the k-th place
    vectors, asked = vectors_table(spark, matrix).cache(), vectors_table(spark, np.concatenate([matrix[::29], np.zeros((1, 16))]), "query_id")
    cells = train_cells(vectors, 12)
    assigned = assign_cells(vectors, cells).cache()
    bounds = measured(assigned, cells)
    for k, below, n_probe in ((10, None, 1), (10, 0.9999, 2), (90, None, 3), (1000, None, 1)):
        assert answers(topk_bounded(asked, assigned, bounds, k, n_probe, below)) == answers(topk_dense(asked, vectors, k, below))
    half = assigned.filter("item_id < 'v0200'")  # part of what was measured
    assert answers(topk_bounded(asked, half, bounds, 10)) == answers(topk_dense(asked, half.drop("cell_id"), 10))
    assert topk_bounded(asked.limit(0), assigned, bounds, 10).count() == 0
    known = CellBounds.collect(bounds)
    best = np.array([[(q @ np.array(rows).T).max() for q in matrix[:50]] for rows in (
        [r["embedding"] for r in assigned.filter(f"cell_id = {c}").collect()] for c in known.ids.tolist())]).T
    upper = known.upper(matrix[:50])
    assert (upper >= best).all()
    if spread == 0.05:  # the bounds rule most cells out
        tenth = np.sort(matrix[:50] @ matrix.T, axis=1)[:, -10][:, None]
        assert (upper >= tenth).mean() < 0.3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_cell_search_misses_nothing_on_the_driver_tables(spark, sf):
    from kindred.catalog.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    assert answers(QUERIES["dense_topk_ivf"](spark, folder)) == answers(QUERIES["dense_topk_exact"](spark, folder))


def test_hashed_vectors(spark):
    docs = spark.createDataFrame([("a", "red fox red"), ("b", ""), ("c", "fox red red")], "item_id string, t string")
    got = {r["item_id"]: r["embedding"] for r in hashed_vectors(docs, "item_id", "t", 32).collect()}
    assert got["a"] == got["c"] and got["b"] == [0.0] * 32
    assert math.isclose(sum(x * x for x in got["a"]), 1, abs_tol=1e-6)
    # one slot: words of opposite sign cancel out
    words = [f"word{i}" for i in range(20)]
    sign = {w: hashlib.md5(w.encode()).hexdigest()[8] < "8" for w in words}
    pair = next(w for w in words if sign[w]) + " " + next(w for w in words if not sign[w])
    cancelled = spark.createDataFrame([("a", pair)], "item_id string, t string")
    assert hashed_vectors(cancelled, "item_id", "t", 1).first()["embedding"] == [0.0]


def test_user_encoder(items, questions):
    def letter_counts():
        def encode(texts):
            return np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype="float32")

        return encode

    def encoder(table, key, text):
        return encode_with(table, key, text, letter_counts, batch_size=4)

    model = fit_model(items, terms=None, encoder=encoder)
    vectors = {r["item_id"]: r["embedding"] for r in model.vectors.collect()}
    assert len(vectors) == 10 and math.isclose(np.linalg.norm(vectors["item_3"]), 1, abs_tol=1e-6)
    assert similar_items(questions, model, "semantic", 2).filter("query_id = 1").count() == 2


def test_save_and_load(spark, model, questions, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path)
    loaded = load_model(spark, path, terms=model.terms)
    for method in ("tfidf", "semantic"):
        before = recommend(questions, model, method).orderBy("query_id", "rank").collect()
        after = recommend(questions, loaded, method).orderBy("query_id", "rank").collect()
        assert before == after
    # a path that differs in one sign is another model
    save_model(fit_model(model.docs.limit(3).withColumn("source", F.lit("x")), metadata=model.metadata), path[:-5] + "mo_el")
    assert load_model(spark, path, terms=model.terms).packed.count() == model.packed.count()


@pytest.mark.parametrize("bound", [10, None])
def test_lookup_join_paths_agree(spark, bound):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    got = joins.lookup_join(big, small, "k", bound, "left")
    assert got.count() == 300 and got.filter("v = 1").count() == 200 and got.filter("v is null").count() == 99


@pytest.mark.parametrize("how", ["inner", "left"])
def test_frequent_and_null_keys_stay_where_they_are(spark, how):
    key = F.when(F.col("id") % 3 == 0, "the").when(F.col("id") % 7 == 0, "of").when(F.col("id") % 11 != 0, F.concat(F.lit("w"), F.col("id") % 2000))
    big = spark.range(0, 20_000, 1, 8).select("id", key.alias("k"))
    small = spark.range(0, 2500).select(F.concat(F.lit("w"), "id").alias("k"), F.col("id").alias("v")).union(spark.createDataFrame([("the", -1), (None, -2)], "k string, v long"))
    hot = [r["k"] for r in joins.frequent_keys(big, "k", 16).collect()]
    assert {"the", "of"} <= set(hot) and len(hot) <= 16
    got = joins.lookup_join(big, small, "k", None, how)
    assert got.columns == ["k", "id", "v"]
    assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))
