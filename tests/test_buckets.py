import re

import pytest
from pyspark.sql import functions as F

from kindred.operators import terms
from kindred.plans import recommend as plans
from kindred.plans.model import fit_model, load_model, save_model
from kindred.plans.recommend import recommend
from kindred.session import fresh_path, setting
from kindred.sources.buckets import read_bucketed, write_bucketed

_TOPICS = ("neural networks learn language", "ships sail the northern sea", "markets price risky bonds", "cells divide and grow")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"i{n}", "page" if n % 3 else "book", f"t{n}", f"{_TOPICS[n % 4]} item{n % 7}", None, "x") for n in range(80)]
    table = spark.createDataFrame(rows, "item_id string, source string, title string, text string, authors string, category string")
    return table.withColumn("text_clean", F.col("text"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_round_trip_and_another_number_of_rows(spark, items):
    path = fresh_path(spark, "bucketed")
    for rows in (items, items.limit(3), items.limit(0)):
        write_bucketed(rows, path, "item_id", 5)
        assert sorted(read_bucketed(spark, path, "item_id", 5).collect()) == sorted(rows.collect())


def test_joins_on_the_key_move_no_rows(spark, items):
    paths = [fresh_path(spark, "bucketed") for _ in range(2)]
    for path in paths:
        write_bucketed(items, path, "item_id", 8)
    left, right = (read_bucketed(spark, path, "item_id", 8) for path in paths)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        kept = left.join(right.filter("source = 'page'").select("item_id"), "item_id", "left_semi")
        plan = _plan(kept)
        assert "Exchange" not in plan and "SelectedBucketsCount: 8 out of 8" in plan
        assert kept.count() == items.filter("source = 'page'").count()


@pytest.mark.parametrize("method", ["tfidf", "semantic"])
def test_bucketed_model_answers_as_before(spark, items, method, monkeypatch):
    model = fit_model(items)
    path = fresh_path(spark, "model")
    save_model(model, path, buckets=8)
    loaded = load_model(spark, path, buckets=8)
    queries = spark.createDataFrame([(1, "language networks"), (2, "the sea")], "query_id int, text string")
    wanted = sorted(recommend(queries, model, method, source="page", mode="exact").collect())
    assert len(wanted) == 16
    # more answers than may be broadcast
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 0)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        answers = recommend(queries, loaded, method, source="page", mode="exact")
        assert sorted(answers.collect()) == wanted
        # every scan of metadata is followed by its filter, its order and the join, without an exchange
        above = [line for line in _plan(answers).splitlines()]
        for number, line in enumerate(above):
            if "FileScan" in line and "Bucketed: true" in line:
                before = above[max(0, number - 5) : number]
                join = max(i for i, x in enumerate(before) if "SortMergeJoin" in x) if any("SortMergeJoin" in x for x in before) else 0
                assert not any("Exchange" in x for x in before[join:])
        assert len(re.findall("Bucketed: true", _plan(answers))) >= 3


def test_tables_with_an_order_of_their_own_are_not_bucketed(spark, items):
    with pytest.raises(ValueError, match="order of its own"):
        save_model(fit_model(items, encoder=None, index=True), fresh_path(spark, "model"), buckets=4)


def test_postings_are_placed_and_written_once(spark, items, monkeypatch):
    monkeypatch.setattr(terms, "PIECE_BYTES", 500)
    stored = fit_model(items, encoder=None)
    model = fit_model(items, encoder=None, buckets=4)
    assert not hasattr(model.packed, "written_to") and model.buckets == 4
    path = fresh_path(spark, "model")
    save_model(model, path, buckets=4)
    loaded = load_model(spark, path, encoder=None, buckets=4)
    assert sorted(loaded.packed.collect()) == sorted(stored.packed.collect())
    assert loaded.packed.filter("item_id = 'i7'").count() == 1  # found by its bucket
    placed = model.packed.groupBy(F.spark_partition_id().alias("p"), F.expr("pmod(hash(item_id), 4)").alias("b")).count()
    rows = placed.collect()
    assert len({r["p"] for r in rows}) == len(rows) > 4 and {r["b"] for r in rows} == {0, 1, 2, 3}
    save_model(model, path, buckets=5)  # another number than it was placed for
    assert sorted(load_model(spark, path, encoder=None, buckets=5).packed.collect()) == sorted(stored.packed.collect())
