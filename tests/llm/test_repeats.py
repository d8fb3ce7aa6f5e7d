"""Suffix-array dedup against a dictionary of all stretches."""

import random

import brute
import pytest

import __spark_entry__
from kindred.llm.repeats import remove_repeats

SCHEMA = "doc_id long, text string, n_bytes int"


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, **options).collect()}
    assert got == brute.repeats(docs, **options)


def test_random_overlaps(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("ab ") for _ in range(200)) for _ in range(4)]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(r.randrange(5)):
            source, a = r.choice(pool), r.randrange(150)
            text += source[a : a + r.randrange(30, 90)] + r.choice(["", "é", "xyz", "\n"])
        docs.append((r.randrange(1000) * 100 + i, text))
    check(spark, docs)
    check(spark, docs, size=33)


def test_edges(spark):
    line = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"
    assert len(line) == 50
    docs = [(5, line), (3, "x" + line), (4, line + "x"), (1, line[:-1]), (2, None), (0, ""), (6, line * 3), (7, "z" * 4000), (8, "z" * 60),
            (9, "é" * 40), (10, "é" * 30), (11, line[:49] + "!" + line), (-4, line[1:] + "q" + line[:25])]
    check(spark, docs)


def test_many_copies_and_one_long_text(spark):
    r = random.Random(6)
    text = " ".join("".join(r.choice("etaoin") for _ in range(r.randrange(1, 9))) for _ in range(300))
    docs = [(i, text[: 1500 - i] + f" {i} " + text[1000:]) for i in range(40)] + [(100, text * 30)]
    check(spark, docs)


def test_repeated_and_null_ids(spark):
    a, b = "the first text, long enough to be matched by others in the table", "another text that is long enough to be matched by the rest here"
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (None, a + b, 0), (2, b, 0)]
    got = sorted((r["doc_id"] or 99, r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, len(b), 0), (1, len(a), 0), (1, len(a), 0), (2, len(b), len(b)), (99, len(a + b), len(a + b))]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]
    rows = __spark_entry__.queries()["op10_suffix_dedup"](spark, f"/root/testdata/sf{sf}").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute.repeats(docs)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
