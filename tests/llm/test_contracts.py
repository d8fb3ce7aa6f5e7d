"""Registered queries against plain Python on a small table with awkward rows."""

import random
from pathlib import Path

import brute
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
HEX = "0123456789abcdef"


def awkward_texts():
    r = random.Random(3)
    key = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(44))
    line = "the same line of many words comes again and again here\n"
    return [
        None, "", " \n\t ", "one", "a b c d e f g h", line * 6, "Tab\tand\x0bfeed\x0c and\r\nreturn  é Ünï",
        "x y z " * 9, "#*$%&|<> " * 30, "ÉÈ ß ñ " * 40, "1234 !! ..", "no letters? 12" * 3, "一二三四 五六七八",
        "password: 'hunter22' token=abc secret=token: abcdefgh API_KEY = \"zz.zz.zz-9\" passwd:ab",
        f"é AKIA{'A1' * 9} AKIASHORT {HEX * 2} {HEX} token = \"{HEX * 2}ff\" end",
        f"blob {key} and wordslongerthantwentyletters and some_name_in_code_12_with_parts {'ab1' * 12}",
        " ".join(f"w{i}" for i in range(3000)), "<|endoftext|> <|endoftext|>x\u2003 \x1c\x1f  don't we'll  ", "a" * 3000 + " " * 300,
        " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(500)),
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The driver's smallest tables with awkward rows, nulls, copies and clashing columns added."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = [(10_000 + i, t, None if i % 3 else "en", None if i % 4 == 0 else "src1", None) for i, t in enumerate(awkward_texts() * 2)]
    more = spark.createDataFrame(rows, docs.schema)
    docs = docs.unionByName(more).selectExpr("*", "'x' AS score", "1 AS size", "2 AS kept", "3 AS component", "4 AS key")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net", "https://example.net/en", "x://net/", "http://a.b.org/fr/1",
            "http://org/FR/", "ftp://example.com/de/x", "http://notexample.com/de/", "http://é.example.com/de/", "http://a.example.com?x=/de/", "see http://b.net//en/ http://c.org/fr/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60)
    extra = spark.createDataFrame([(5000 + i, u, None if i % 2 else "<p>") for i, u in enumerate(urls)] * 2, pages.schema)
    pages.unionByName(extra).selectExpr("*", "'x' AS host", "'y' AS rule").write.parquet(f"{at}/pages.parquet")
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = [(None, 0, "user", "hi"), (None, 1, None, None), (70_000, 5, "assistant", "a\\n\\|<|im_end|>\n\\"), (70_000, 2, "us\ner\\", "<\\|x"),
           (70_001, 0, "assistant", "same"), (70_001, 0, "assistant", "same"), (70_002, None, "assistant", "late"), (70_002, 0, "user", "")]
    odd += [(70_003, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(45)]
    talks.unionByName(spark.createDataFrame(odd, talks.schema)).selectExpr("*", "1 AS node", "'q' AS tree").write.parquet(f"{at}/conversations.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def run(spark, name, folder):
    found = next(k for k in __spark_entry__.queries() if k.startswith(name))
    return __spark_entry__.queries()[found](spark, folder).collect()


def test_quality(spark, folder, docs):
    got = {r["doc_id"]: r for r in run(spark, "op2_", folder)}
    assert len(got) == len(docs)
    for d in docs:
        want = brute.quality(d["text"])
        assert {k: got[d["doc_id"]][k] for k in want} == want, d
        assert not (want["base_failed"] and got[d["doc_id"]]["kept"])


def test_mixing(spark, folder, docs):
    got = run(spark, "op3_", folder)
    size = {d["doc_id"]: len(brute.WORD.findall(d["text"] or "")) for d in docs}
    by = {}
    for d in docs:
        by[d["source"]] = by.get(d["source"], 0) + size[d["doc_id"]]
    want, taken = brute.targets(by), dict.fromkeys(by, 0)
    assert len(got) == len(docs)
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[r["source"]])
        assert r["target"] == pytest.approx(want[r["source"]])
        epochs = int(want[r["source"]] / r["source_size"] + 1e-9)
        assert epochs * r["size"] <= r["taken"] <= min(2, epochs + 1) * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in by)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, "op3_", folder)))


def test_chat(spark, folder):
    turns = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r["turn"] is None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in run(spark, "op4_", folder)}
    assert got.keys() == turns.keys()
    for i, said in turns.items():
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute.chat(said), i


def test_language(spark, folder, docs):
    got = {r["doc_id"]: r for r in run(spark, "op5_", folder)}
    assert len(got) == len(docs)
    right = total = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == brute.held_out(d["doc_id"]) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["doc_id"] < 10_000 and len(d["text"]) > 100:
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert total > 15 and right / total > 0.9


def test_urls(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = run(spark, "op6_", folder)
    want = [(p["page_id"], *brute.page(p["url"])) for p in pages]
    assert sorted(map(str, [(*w[:4], w[4] or "allow") for w in want])) == sorted(
        map(str, [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got])
    )


def test_secrets(spark, folder, docs):
    got = {r["doc_id"]: r for r in run(spark, "op7_", folder)}
    assert len(got) == len(docs)
    random_spans = 0
    for d in docs:
        r, base = got[d["doc_id"]], brute.secrets(d["text"])
        assert r["base_sha256"] == brute.SHA(",".join(base))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == base
        for x in spans:
            kind, start, end = x.split(":")
            if kind == "random":
                random_spans += 1
                assert int(end) - int(start) == 44 and d["text"][int(start) - 5 : int(start)] == "blob "
    assert random_spans == 2


def test_tokens(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in run(spark, "op8_", folder):
        text = next(d["text"] for d in docs if d["doc_id"] == r["doc_id"]) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_token_split_agrees_for_every_character():
    import public_tokenizers
    from tokenizers import Tokenizer

    from kindred.llm.tokens import TokenCounter

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = TokenCounter(Path(path).read_text()), Tokenizer.from_file(path)
    for at in range(0, 0x30000, 64):
        chars = [chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f" {c}a{c} 1{c}" for c in chars)
        if counter.count(text) != len(library.encode(text, add_special_tokens=False).ids):
            wrong = [hex(ord(c)) for c in chars if counter.count(f" {c}a{c} 1{c}") != len(library.encode(f" {c}a{c} 1{c}", add_special_tokens=False).ids)]
            assert not wrong, wrong


@pytest.mark.parametrize("name", ["op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_"])
def test_empty_tables(spark, folder, tmp_path, name):
    for table in ("documents", "pages", "labels", "conversations", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert len(run(spark, name, str(tmp_path))) == (1 if name == "op4_" else 0)
