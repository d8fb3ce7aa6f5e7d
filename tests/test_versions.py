"""Appended batches against a model fitted in one go."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.plans import versions
from kindred.plans.model import TermOptions, fit_model
from kindred.plans.recommend import recommend
from kindred.plans.versions import append_batch, current_version, load_version

TERMS = TermOptions(max_features=150)


@pytest.fixture(scope="module")
def items(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        text = " ".join(f"w{min(int(r.paretovariate(0.6)), 300)}" for _ in range(r.randrange(1, 40))) if i % 13 else [None, " "][i % 2]
        rows.append((f"i{i:03d}", "a" if i % 3 else "b", f"T{i}", text, "x", "c", text))
    return spark.createDataFrame(rows, "item_id string, source string, title string, text string, authors string, category string, text_clean string")


@pytest.fixture(scope="module")
def asked(spark, items):
    return items.filter("item_id IN ('i001', 'i050', 'i077')").select(F.col("item_id").alias("query_id"), "text")


def answers(model, asked, method):
    return recommend(asked, model, method, top_n=5, mode="exact").orderBy("query_id", "rank").collect()


def part(items, n, of=3):
    return items.filter(F.pmod(F.hash("item_id"), F.lit(of)) == n)


def test_appends_equal_one_fit(spark, items, asked, tmp_path):
    path = f"{tmp_path}/model"
    whole = fit_model(items, terms=TERMS)
    for n in range(3):
        version = append_batch(path, f"batch {n}", part(items, n), terms=TERMS)
        assert version == current_version(spark, path) and version.number == n + 1
    model = load_version(spark, path, terms=TERMS)
    assert sorted(model.vocab.collect()) == sorted(whole.vocab.collect())
    weights = lambda m: {(r["item_id"], r["term"]): r["weight"] for r in m.postings.collect()}
    assert weights(model) == pytest.approx(weights(whole))
    for method in ("tfidf", "semantic"):
        assert answers(model, asked, method) == answers(whole, asked, method)


def test_older_versions_and_repeats(spark, items, asked, tmp_path):
    path = f"{tmp_path}/model"
    with pytest.raises(ValueError):
        load_version(spark, path)
    append_batch(path, "one", part(items, 0), terms=TERMS)
    before = answers(load_version(spark, path, terms=TERMS), asked, "tfidf")
    second = append_batch(path, "two", part(items, 1), terms=TERMS)
    assert append_batch(path, "two", part(items, 2), terms=TERMS) == second  # the name is taken, nothing happens
    assert answers(load_version(spark, path, number=1, terms=TERMS), asked, "tfidf") == before
    assert load_version(spark, path, terms=TERMS).metadata.count() == part(items, 0).count() + part(items, 1).count()
    with pytest.raises(ValueError):
        append_batch(path, "a/b", items)


def test_an_append_that_dies_leaves_the_model_as_it_was(spark, items, asked, tmp_path, monkeypatch):
    path = f"{tmp_path}/model"
    append_batch(path, "one", part(items, 0), terms=TERMS)
    before = answers(load_version(spark, path, terms=TERMS), asked, "tfidf")
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            append_batch(path, "two", part(items, 1), terms=TERMS)
    assert current_version(spark, path).number == 1
    assert answers(load_version(spark, path, terms=TERMS), asked, "tfidf") == before
    torn, store = versions._files(spark, f"{path}/versions/00000002/manifest")  # a manifest without its last line
    stream = store.create(torn, False)
    stream.write(bytearray(b"3\tone\n"))
    stream.close()
    assert current_version(spark, path).number == 1
    version = append_batch(path, "two", part(items, 1), terms=TERMS)
    assert version.number == 3 and list(version.batches) == ["one", "two"] and current_version(spark, path) == version
    with pytest.raises(Exception, match="exist"):  # another writer has taken the number
        versions._publish(spark, path, version)


def test_an_empty_batch(spark, items, tmp_path):
    path = f"{tmp_path}/model"
    append_batch(path, "one", part(items, 0), terms=TERMS)
    version = append_batch(path, "none", items.limit(0), terms=TERMS)
    assert version.batches["none"] == 0
    assert load_version(spark, path, terms=TERMS).packed.count() > 0


@pytest.mark.parametrize(("most", "max_df", "pruned"), [(20, 0.95, True), (5, 0.6, True), (5, 0.3, False), (None, 0.95, False), (400, 0.95, False)])
def test_a_merge_moves_only_terms_that_may_be_in_the_vocabulary(spark, most, max_df, pruned):
    options = TermOptions(max_features=most, max_df=max_df)
    r = random.Random(9)
    tables, total = [], {}
    for _ in range(3):
        rows = [(f"t{i}", df := r.randrange(1, 2 + 200 // (i + 1)), df + r.randrange(3)) for i in range(200) if r.random() < 0.8]
        tables.append(spark.createDataFrame(rows, "term string, df bigint, cf bigint"))
        for term, df, cf in rows:
            before = total.get(term, (0, 0))
            total[term] = (before[0] + df, before[1] + cf)
    sizes = [300, 500, 200]
    kept = sorted((-cf, t) for t, (df, cf) in total.items() if options.min_df <= df <= options.max_df * 1000)[: options.max_features]
    got = versions.merged_vocabulary(tables, sizes, options)
    assert sorted(r["term"] for r in got.collect()) == sorted(t for _, t in kept)
    assert {r["term"]: (r["df"], r["cf"]) for r in got.collect()} == {t: total[t] for _, t in kept}
    assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == pruned
    alone = versions.merged_vocabulary(tables[:1], sizes[:1], options)
    assert "Aggregate" not in alone._jdf.queryExecution().optimizedPlan().toString()
