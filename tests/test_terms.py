from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import terms
from kindred.plans.model import fit_model, fit_packed
from kindred.session import SPLIT_BYTES, TEXTS, in_pieces, setting, written
from kindred.sources.files import ITEM_COLUMNS

DOCS = [
    (1, "red fox red fox x den"), (2, None), (3, ""), (4, "fox"), (None, "red fox"), (5, "a b c"),
    (1, "den hole"),  # a second text of one key: no run of words crosses from one to the other
    (None, "fox"), (6, "red red red red"), (7, " ".join(f"w{i % 50}" for i in range(3000))),
]


def runs(text, low, high):
    words = [w for w in (text or "").split(" ") if len(w) > 1]
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2), (2, 3)])
def test_counts_equal_plain_python(spark, low, high):
    docs = spark.createDataFrame(DOCS, "k int, t string").coalesce(2)
    per_key, df, cf = Counter(), Counter(), Counter()
    for key, text in DOCS:
        per_key.update((key, t) for t in runs(text, low, high))
        df.update(set(runs(text, low, high)))
        cf.update(runs(text, low, high))
    counts = terms.term_counts(docs, "k", "t", low, high).collect()
    assert {(r["k"], r["term"]): r["tf"] for r in counts} == per_key and len(counts) == len(per_key)
    got = {r["term"]: (r["df"], r["cf"]) for r in terms.term_statistics(docs, "t", low, high).collect()}
    assert got == {t: (df[t], cf[t]) for t in df}


@pytest.mark.parametrize("size", [1, 64, 4 << 20])
def test_slices_of_a_batch_change_nothing(monkeypatch, size):
    monkeypatch.setattr(terms, "_SLICE_BYTES", size)
    texts = [[t for _, t in DOCS[i : i + 2] if t is not None] for i in range(len(DOCS))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], ["k", "_texts"]).slice(1)
    got = Counter()
    for out in terms._counted(1, 2)(iter([batch])):
        for r in out.to_pylist():
            assert r["terms"] == sorted(r["terms"])
            got.update({(r["k"], t): n for t, n in zip(r["terms"], r["counts"], strict=True)})
    assert got == Counter((k, t) for k, some in enumerate(texts) if k for text in some for t in runs(text, 1, 2))


def test_weights_of_a_small_and_a_large_vocabulary_agree(spark):
    docs = spark.createDataFrame(DOCS, "k int, t string")
    vocab = terms.vocabulary(terms.term_statistics(docs, "t"), len(DOCS), None, 1)
    sent, joined = (
        sorted((str(r["k"]), r["term"], round(r["weight"], 9)) for r in terms.tfidf_weights(docs, vocab, "k", "t", max_features=most).collect())
        for most in (10_000, None)
    )
    assert sent == joined and len(sent) > 100


def test_nothing_is_grouped_by_key_and_term(spark):
    docs = spark.createDataFrame(DOCS, "k int, t string")
    vocab = terms.vocabulary(terms.term_statistics(docs, "t"), len(DOCS), None, 1)
    for frame in (terms.term_counts(docs, "k", "t"), terms.tfidf_weights(docs, vocab, "k", "t")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "count(1)" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert plan.index("Generate") < plan.index("MapInArrow")  # occurrences are rows only after they are counted


def test_parts_follow_the_size_of_the_table(spark, monkeypatch):
    docs = written(spark.createDataFrame([(i, f"fox den w{i % 9}") for i in range(400)], "item_id int, text_clean string"), "cleaned")
    parts = lambda: fit_packed(docs)[1].rdd.getNumPartitions()
    want = sorted(fit_packed(docs)[1].collect())
    assert terms.pieces(docs, "text_clean") == (400, 1) and parts() <= 4
    monkeypatch.setattr(terms, "PIECE_BYTES", 400)
    assert terms.pieces(docs, "text_clean") == (400, 10) and parts() == 10
    assert sorted(fit_packed(docs)[1].collect()) == want
    before = {name: spark.conf.get(name, None) for name in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    with in_pieces(spark, 10):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == (before["spark.sql.files.maxPartitionBytes"] or str(SPLIT_BYTES))
    with in_pieces(spark, 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert before == {name: spark.conf.get(name, None) for name in before}


def test_tasks_read_little_whatever_the_session_names(spark):
    name = "spark.sql.files.maxPartitionBytes"
    for named, want in (("128m", SPLIT_BYTES), ("1g", SPLIT_BYTES), (str(1 << 30), SPLIT_BYTES), ("1024KB", 1 << 20), ("70000b", 70_000)):
        with setting(spark, name, named):
            with in_pieces(spark, 1):
                assert spark.conf.get(name) == str(want)
            assert spark.conf.get(name) == named


def test_row_groups_can_be_shared_by_tasks(spark):
    # hex digests hardly compress, so row groups are as large as the files' bytes
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.sha2(F.concat("id", F.lit("-"), i), 256)), " ")
    docs = written(spark.range(0, 16_000, 1, 1).select("id", words.alias("text")), "cleaned", **TEXTS)
    with setting(spark, "spark.sql.files.maxPartitionBytes", "128m"), in_pieces(spark, 1):
        rows = [n for n in docs.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(rows) == 16_000 and max(rows) <= 16_000 // 2


def test_vectors_are_summed_in_parts_that_follow_the_size(spark, monkeypatch):
    rows = [(f"i{i}", "book", "t", "", "a", "c", f"fox den w{i % 9}") for i in range(400)]
    items = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in (*ITEM_COLUMNS, "text_clean")))
    few = fit_model(items, terms=None).vectors
    monkeypatch.setattr(terms, "PIECE_BYTES", 200)
    many = fit_model(items, terms=None).vectors
    assert len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < 15 < len(many.inputFiles())
    assert sorted(few.collect()) == sorted(many.collect())
