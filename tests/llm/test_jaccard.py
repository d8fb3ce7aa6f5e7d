"""Jaccard join against a comparison of all pairs."""

import random

import brute

import __spark_entry__
from kindred.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, n long, mark int"


def check(spark, docs, size=4, percent=85):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df, size, percent).collect()}
    assert got == brute.jaccard_groups(docs, size, percent)


def corpus(seed, groups, copies, long, vocabulary=400):
    """Groups of texts that drift apart by edits, with passages that many share."""
    r = random.Random(seed)
    draw = lambda n: [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    shared, docs = draw(60), []
    for _ in range(groups):
        text = draw(r.randrange(3, long))
        for _ in range(r.randrange(1, copies)):
            copy = list(text)
            for _ in range(r.randrange(0, 2 + len(text) // 60)):
                copy[r.randrange(len(copy))] = draw(1)[0]
            if r.random() < 0.3:
                copy += shared
            docs.append((len(docs) * 7 % 1009, " ".join(copy)))
            text = copy if r.random() < 0.3 else text
    return docs


def test_groups_that_drift(spark):
    check(spark, corpus(1, 30, 8, 150))
    check(spark, corpus(2, 12, 25, 90), size=5, percent=80)


def test_one_large_group_of_near_copies(spark):
    docs = corpus(3, 1, 120, 300)
    while len(docs) < 60:
        docs = corpus(random.random(), 1, 120, 300)
    check(spark, docs)


def test_common_passage_does_not_link(spark):
    r = random.Random(4)
    line = " ".join(f"p{i}" for i in range(80))
    check(spark, [(i, " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 90))) + " " + line) for i in range(80)])


def test_edges(spark):
    docs = [(9, None), (8, ""), (7, " \n"), (6, "one"), (5, "ONE"), (4, "one two three"), (3, "One\ttwo  three"), (2, "É a b c d"), (1, "é a b c d"),
            (0, "a " * 500), (11, "A " * 90), (12, "b a b a b a b a"), (13, "one two")]
    check(spark, docs)


def test_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a, 0, 0), (5, b, 0, 0), (3, b, 0, 0), (None, a + " c", 0, 0), (None, "alone by itself here now", 0, 0), (3, b, 0, 0)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, [(5, 5), (5, 3), (3, 3), (3, 3), (None, 5), (None, None)]))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in __spark_entry__.queries()["op9_jaccard_join"](spark, sf).collect()}
    assert got == brute.jaccard_groups(docs)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA), 4, 85).collect() == []


def test_combinations_of_two_fit_every_set():
    from kindred.llm.jaccard import LEAST_PERCENT, _prefix_length

    for percent in range(LEAST_PERCENT, 101):
        assert all(_prefix_length(n, percent) <= n for n in range(2, 400))


def test_parity_maps_never_rule_out_too_much():
    import numpy as np

    from kindred.llm.jaccard import _parity

    r = np.random.default_rng(5)
    for n in (1, 5, 60, 400, 3000):
        x = r.integers(-(2**63), 2**63 - 1, n)
        y = np.concatenate([x[: n - n // 5], r.integers(-(2**63), 2**63 - 1, n // 4)])
        differ = sum(int(a ^ b).bit_count() if a ^ b >= 0 else int((a ^ b) + 2**64).bit_count() for a, b in zip(_parity(x).tolist(), _parity(y).tolist(), strict=True))
        assert differ <= len(set(x) ^ set(y))


def test_a_crowd_just_below_and_above_the_threshold(spark, monkeypatch):
    """Near copies of one text by more and more edits, so that wide entries hold many groups."""
    from kindred.llm import jaccard

    monkeypatch.setattr(jaccard, "WIDE", 4)
    for seed, percent, size in ((1, 85, 4), (2, 80, 5), (3, 70, 1)):
        r = random.Random(seed)
        base = [f"w{r.randrange(5000)}" for _ in range(120)]
        docs = []
        for i in range(140):
            copy = list(base[: 60 if i % 7 == 0 else 120])
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(40 if i % 2 else 10**6)}"
            docs.append((i, " ".join(copy)))
        check(spark, docs, size, percent)
