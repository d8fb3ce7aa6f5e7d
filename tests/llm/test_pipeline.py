"""Stages of the pipeline against plain Python on a small table with awkward rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, row string, doc int, digest int, label int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    draw = lambda n: [f"word{r.randrange(3000)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "one two", "One TWO", "½ ²", "a b c d e f"]
    for _ in range(12):
        base = draw(r.randrange(5, 120))
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = draw(1)[0]
            texts.append(" ".join(copy))
    texts.append(" ".join(draw(60_000)))
    texts.append(texts[-1] + " end")
    found = [(i * 37 % 1009, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "r", 1, 2, 3) for i, t in enumerate(texts)]
    return found + [found[9], found[9], (None, texts[9], None, None, None, None, None, None, None)]


def test_one_document_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    kept = kept.collect()
    groups = brute.jaccard_groups([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80)
    # a row without an id is a copy of one with; it comes first in its group, as null ids do
    stands_for = groups[rows[9][0]][1]
    want = sorted({(c if c != stands_for else None) for i, (n, c) in groups.items() if n} - {None})
    with_words = [r for r in kept if brute.WORD.search(r["text"] or "")]
    assert sorted(r["doc_id"] for r in with_words if r["doc_id"] is not None) == want
    assert [r["text"] for r in with_words if r["doc_id"] is None] == [rows[9][1]]
    assert len(kept) - len(with_words) == sum(not brute.WORD.search(r[1] or "") for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.drop_near_duplicates(spark, empty, SF).collect() == []


def test_language_stage_drops_only_what_has_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, None, None, 0), (90_001, "12 !!", "en", "s", 5)], docs.schema)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(odd), SF).collect()}
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(plain[i] == t for i, t in kept.items()) and not {90_000, 90_001} & set(kept)
    lost = [i for i, t in plain.items() if i not in kept and len(brute.WORD.findall(t or "")) >= 20 and sum(map(str.isalpha, t)) > 0.5 * len(t)]
    assert not lost


def test_secret_stage_masks_and_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "password: hunter22 é end", "en", "s", 24), (2, None, None, None, None), (3, "plain", None, None, 5)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}
    assert got[1]["text"] == "[SECRET] é end" and got[1]["n_chars"] == len("[SECRET] é end")
    assert tuple(got[2])[1:] == (None,) * 4 and got[3]["text"] == "plain"


def test_leak_stage_drops_documents_with_items_only(spark):
    extra = {c: F.lit(i) for i, c in enumerate(("row", "digest", "_digest", "item_id"))}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(extra)
    odd = spark.createDataFrame([(None, None), (90_000, ""), (90_001, "see the end")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in docs.collect() if any(item in (r["text"] or "") for item in items)}
    kept = corpus_pipeline.drop_leaks(spark, docs, SF)
    assert kept.columns == docs.columns and len(leaked) >= 3
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - leaked
    assert corpus_pipeline.drop_leaks(spark, docs.limit(0), SF).count() == 0
