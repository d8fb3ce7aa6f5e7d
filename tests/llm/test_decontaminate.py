"""Decontamination: exact verification, recall against a search of every window."""

import random
import unicodedata

import numpy as np
import pytest

import __spark_entry__
from kindred.llm import decontaminate
from kindred.llm.decontaminate import edit_distances, leaks

SCHEMA = "doc_id long, text string, item_id string"


def tokens(text):
    spaced = ""
    for c in (text or "").lower():
        if c.isascii():
            spaced += c if c.isalnum() else " "
        elif unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI")):
            spaced += f" {c} " if unicodedata.category(c)[0] in "LMN" else " "
        else:
            spaced += c if unicodedata.category(c)[0] in "LMN" else " "
    return spaced.split()


def distance(item, text):
    """Least edits between the item and any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        fresh = [0]
        for i, x in enumerate(item):
            fresh.append(min(row[i] + (x != w), row[i + 1] + 1, fresh[i] + 1))
        row = fresh
        best = min(best, row[-1])
    return best


def search(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks(d, b).collect()}


def planted(seed, share, n=160):
    r = random.Random(seed)
    pool = [f"{a}{b}" for a in ("the", "in", "on", "er", "st", "an") for b in ("", "ha", "tion", "es", "ble", "ou")]
    draw = lambda k: [r.choice(pool) for _ in range(k)]
    items = [(i, " ".join(draw(r.randrange(8, 70)))) for i in range(40)]
    docs, want = [], {}
    for i in range(n):
        k, text = r.choice(items)
        copy = text.split()
        for _ in range(int(share * len(copy))):
            at = r.randrange(len(copy))
            copy[at : at + r.choice([0, 1, 1])] = draw(r.choice([0, 1]))
        docs.append((i, " ".join(draw(r.randrange(100))).title() + "\n" + ", ".join(copy) + ". " + " ".join(draw(30))))
    for i, t in docs:
        for k, text in items:
            d, item = distance(tokens(text), tokens(t)), tokens(text)
            if d <= len(item) // 5:
                want[i, k] = d
    return docs, items, want


def test_recall_and_precision(spark):
    for seed, share, least in ((1, 0.0, 1.0), (2, 0.1, 0.97), (3, 0.2, 0.9)):
        docs, items, want = planted(seed, share)
        got = search(spark, docs, items)
        assert got.keys() <= want.keys() and all(want[k] == d for k, d in got.items()), share
        assert len(got) >= least * len(want), (share, len(got), len(want))


def test_edit_distances():
    r = np.random.default_rng(1)
    word = r.integers(0, 4, 300).astype(np.uint64)
    item = r.integers(0, 4, 12).astype(np.uint64)
    low = r.integers(0, 250, 50)
    high = np.minimum(low + r.integers(0, 40, 50), 300)
    assert edit_distances(item, word, low, high, most=7).tolist() == [distance(item.tolist(), word[a:b].tolist()) for a, b in zip(low, high, strict=True)]


def test_edges(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, None), (2, ""), (3, item.upper() + "!"), (4, item.replace(" ", "\n - ")), (5, "ten nine eight seven"), (6, (item + " ") * 500), (None, item), (3, "zero " + item)]
    items = [(10, item), (11, None), (12, ""), (13, "five six seven"), (14, item)]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 40)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    got = leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, k, n, 0) for i in (3, 3, 4, 6, None) for k, n in ((10, 10), (13, 3), (14, 10))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert leaks(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks(d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], tokens(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], tokens(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in __spark_entry__.queries()["op1_decontaminate"](spark, sf).collect()}
    joined = [(i, f" {' '.join(t)} ") for i, t in docs]
    exact = {(i, k) for i, t in joined for k, item in items if f" {' '.join(item)} " in t}
    assert len(exact) >= 3 and exact <= got
    texts = dict(docs)
    assert all(distance(dict(items)[k], texts[i]) <= len(dict(items)[k]) // 5 for i, k in got)


@pytest.mark.parametrize("n", [8, 9, 11, 17, 18, 19, 30, 38, 39, 45, 60, 66, 100])
def test_target_recall_in_every_length_class(n):
    span = decontaminate.span_of(n)
    for kind in ("substitute", "mix", "gather"):
        r = np.random.default_rng([n, 7, len(kind)])
        items = list(r.integers(1, 1 << 62, (300, n), dtype=np.uint64))
        copies = [decontaminate.edited(item, n // 5, kind, r) for item in items]
        index = decontaminate.ItemIndex.of_words(items, {span: decontaminate.walks_needed(span)})
        of = np.repeat(np.arange(300), [len(c) for c in copies])
        text, item, _ = index.candidates(np.concatenate(copies), of, 300).T
        assert len(np.unique(text[text == item])) >= 0.92 * 300, (n, kind)


def test_first_sample_finds_every_exact_copy():
    r = np.random.default_rng(5)
    for n in (*range(8, 45), 70, 200):
        items = list(r.integers(1, 9, (40, n)).astype(np.uint64))
        copies = [np.concatenate([r.integers(1, 9, r.integers(9)).astype(np.uint64), item]) for item in items]
        index = decontaminate.ItemIndex.of_words(items, {decontaminate.span_of(n): 1})
        text, item, place = index.candidates(np.concatenate(copies), np.repeat(np.arange(40), [len(c) for c in copies]), 40).T
        ends = np.cumsum([len(c) for c in copies])
        assert {(t, t, ends[t] - n) for t in range(40)} <= set(zip(text, item, place, strict=True)), n


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "机器学习模型需要大量的训练数据才能得到好的结果"
    docs = [(1, f"前言。{chinese}！后记"), (2, chinese.replace("大量", "许多")), (3, "Paris — «la ville»"), (4, "paris la"), (5, "नमस्ते दुनिया कैसे हो"),
            (6, "ภาษาไทยไม่มีช่องว่าง"), (7, "no-break\u00a0space, here"), (8, "modèle")]
    items = [(1, chinese), (2, "Paris la ville"), (3, "नमस्ते दुनिया"), (4, "ไทยไม่มี"), (5, "break space"), (6, "modele"), (7, "?!—")]
    want = {(i, k): distance(tokens(item), tokens(text)) for i, text in docs for k, item in items if tokens(item)}
    slack = {k: len(tokens(t)) // 5 if len(tokens(t)) >= 8 else 0 for k, t in items}
    want = {pair: d for pair, d in want.items() if d <= slack[pair[1]]}
    assert search(spark, docs, items) == want and {(1, 1), (2, 1), (3, 2), (5, 3), (6, 4), (7, 5)} <= want.keys()


def test_equal_items_are_searched_once(spark):
    text = " ".join(f"w{i}" for i in range(20))
    index = decontaminate.ItemIndex.build(["a"], [text])
    assert len(index.words) == 1
    got = search(spark, [(1, "x " + text), (2, "y")], [(i, text) for i in range(2000)])
    assert got == {(1, i): 0 for i in range(2000)}


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "one two three", "z", "q")], "doc_id long, text string, item_id string, item_digest string")
    b = spark.createDataFrame([(7, "two three", 1)], "item_id long, text string, doc_id long")
    assert [tuple(r) for r in leaks(d, b).collect()] == [(1, 7, 2, 0)]
