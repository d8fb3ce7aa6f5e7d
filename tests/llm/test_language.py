"""Language ID against a kernel regression written out."""

import random
import tracemalloc

import numpy as np

from kindred.llm import language

WORDS = {"en": "the of and to in that was his with for", "de": "der die und das nicht ein mit sich auf ist", "fr": "le la et les des en que une pour dans"}


def texts(seed, n, langs=tuple(WORDS)):
    r = random.Random(seed)
    return [(lang := langs[i % len(langs)], " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(3, 30)))) for i in range(n)]


def grams(text):
    """Slots of the n-grams of a text, byte by byte."""
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    slots = set()
    for n in language.ORDERS:
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big")
            slots.add((((code * 0x9E3779B1 + n) * 0x85EBCA6B + 2**63) % 2**64 - 2**63) >> 13 & (language.WIDTH - 1))
    return slots


def kernel(x, y):
    return len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))


def test_presence_bits_are_the_n_grams():
    sample = [t for _, t in texts(1, 20)] + ["", "é ß 12 !!", "A", "a\nb\tc" * 9, "中文" * 5]
    bits = np.concatenate(list(language.presence(sample)))
    for row, text in zip(bits, sample, strict=True):
        assert set(np.flatnonzero(row).tolist()) == grams(text)


def test_scores_equal_the_regression_on_kernels(spark):
    train, asked = sorted(texts(2, 90)), [t for _, t in texts(3, 40)]
    labels = [k for k, _ in train]
    model = language.fit(np.concatenate(list(language.presence([t for _, t in train]))), labels, landmarks=30)
    x, q = [grams(t) for _, t in train], [grams(t) for t in asked]
    marks = [x[i] for i in np.unique(np.linspace(0, len(x) - 1, 30).astype(int))]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    to_features = lambda rows: np.array([[kernel(a, b) for b in marks] for a in rows]) @ root
    features, share = to_features(x), np.array([1 / labels.count(k) for k in labels])[:, None]
    target = np.array([[1.0 if k == n else -1.0 for n in sorted(WORDS)] for k in labels])
    solved = np.linalg.solve(features.T @ (features * share) + language.RIDGE * np.eye(features.shape[1]), features.T @ (target * share))
    raised = np.exp(language.SHARPNESS * (to_features(q) @ solved))
    want = raised / raised.sum(1, keepdims=True)
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in language.predict(rows, model, ["doc_id"]).collect()}
    for i in range(len(asked)):
        assert got[i]["lang_pred"] == sorted(WORDS)[want[i].argmax()]
        assert abs(got[i]["score"] - want[i].max()) < 1e-3


def test_no_letters_no_language(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate(texts(4, 60))]
    odd = ["½ ²  ①", "12 !!", "", None, "٣ ৪", "_", "ª", "中", "a"]
    df = spark.createDataFrame(rows + [(100 + i, None, t) for i, t in enumerate(odd)], "doc_id int, lang string, text string")
    got = {r["doc_id"]: r for r in language.predict(df, language.learn(df), ["doc_id"]).collect()}
    for i, t in enumerate(odd):
        assert (got[100 + i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), t
    assert all(got[i]["lang_pred"] == k for i, k, _ in rows)


def test_the_fit_reads_no_more_rows_than_asked_for(spark):
    rows = [(i, f"l{i % 50}", f"text {i}") for i in range(400)] + [(500 + i, "hot", f"many {i % 3000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    seen = []
    keep = language.fit
    language.fit = lambda bits, labels: seen.append(labels) or keep(bits, labels)
    try:
        language.learn(df, rows=20)
        language.learn(df, rows=255)
    finally:
        language.fit = keep
    assert len(seen[0]) == 20 == len(set(seen[0]))
    assert len(set(seen[1])) == 51 and all(seen[1].count(k) == 5 for k in set(seen[1]))


def test_the_fit_takes_packed_bits_in_little_memory():
    train = sorted(texts(5, 300))
    bits, labels = np.concatenate(list(language.presence([t for _, t in train]))), [k for k, _ in train]
    want = language.fit(bits, labels)
    packed = np.packbits(bits, axis=1)
    del bits
    tracemalloc.start()
    got = language.fit(packed, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.languages == want.languages and np.allclose(got.weights, want.weights, atol=1e-5)
    assert peak < 2.5 * language.LANDMARKS * language.WIDTH * 4  # the landmarks and little else, not all rows as numbers
