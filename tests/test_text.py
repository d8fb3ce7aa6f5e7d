import sys
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.accents import fold_accents
from kindred.functions.words import STOPWORDS
from kindred.operators.lemma import lemmatize


@pytest.mark.parametrize(
    "given, expected",
    [
        ("<div>Deep <i>sea</i></div>", "Deep  sea"),
        ("no markup", "no markup"),
        ("", ""),
        ("a<script>var x = '<p>';</script>b", "a b"),
        ("a<STYLE>p{}</STYLE >b<!-- hidden > still -->c", "a b c"),
        ("one<br><br/>two", "one two"),
        ("3 < 4 and 5 > 2", "3 < 4 and 5 > 2"),
        ("cut <a href='x", "cut "),
        ("fish &amp; chips &lt;b&gt; &amp;lt; &eacute; &#65;&#x42; &bogus; &amp", "fish & chips <b> &lt; é AB &bogus; &amp"),
        ("&#128512; &#0; &#99999999;", "😀 � �"),
    ],
)
def test_remove_html(apply, given, expected):
    assert apply(T.remove_html, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("area $a^2$ here", "area   here"),
        ("see \\cite{doe99} now", "see   now"),
        ("a \\alpha b", "a   b"),
        ("open $x\ny$ stays", "open $x\ny$ stays"),
        ("only $ one", "only $ one"),
        ("\\textbf{a {b} c}", "  c}"),
        ("line $a\rb$ sep", "line   sep"),
    ],
)
def test_remove_latex(apply, given, expected):
    assert apply(T.remove_latex, given) == expected


def test_keep_alphanumeric(apply):
    assert apply(T.keep_alphanumeric, "  Hi,\tthere!! étude  x y2 ") == "Hi there tude x y2"
    assert apply(T.keep_alphanumeric, "...") == ""


def test_remove_stopwords(apply):
    assert apply(T.remove_stopwords, "the fox jumps over x a lazy dog") == "fox jumps lazy dog"
    assert len(STOPWORDS) == 179 and len(set(STOPWORDS)) == 179


@pytest.mark.parametrize(
    "given, n, expected",
    [
        ("short text", 100, "short text"),
        ("hello world again", 11, "hello"),
        ("hello world again", 12, "hello world"),
        ("unbroken", 4, "unbr"),
        ("exact", 5, "exact"),
        ("a  b", 3, "a "),
    ],
)
def test_truncate(apply, given, n, expected):
    assert apply(lambda c: T.truncate_words(c, n), given) == expected


def test_strip_and_words(apply):
    assert apply(T.strip, " \x1c  a b 　\n") == "a b"
    assert apply(T.one_line, " a\nb  c\n", None) == ["a b  c", ""]
    assert apply(T.first_word, "  cs.AI  cs.LG", "", None) == ["cs.AI", "unknown", "unknown"]


def test_clean_text(apply):
    chain = T.clean_text
    assert apply(chain, "<p>The <b>Neural net</b> learns $x$ from \\emph{raw} DATA.</p>") == "neural net learns data"
    assert apply(chain, "", "   ", None) == ["", "", ""]
    long = apply(lambda c: T.clean_text(c, max_len=100), "stone " * 500)
    assert len(long) == 95 and long.split() == ["stone"] * 16
    assert apply(lambda c: T.clean_text(c, drop_stopwords=False), "The A-team") == "the a team"
    assert apply(lambda c: T.clean_text(c, lemmas={"wolves": "wolf"}), "Wolves howl") == "wolf howl"


def test_step_is_evaluated_once(spark):
    """No cleaning step may name its input twice: the plan would grow with every step."""
    plan = spark.range(1).select(T.clean_text(F.col("id").cast("string")).alias("t"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("<(?:script") == 1


def test_fold_accents(apply):
    assert apply(fold_accents, "Crème brûlée", "ﬁn ½", "plain", None) == ["Creme brulee", "fin 1⁄2", "plain", None]
    assert apply(fold_accents, "", "가각힣", "e\u0301\u0327 🎉") == ["", unicodedata.normalize("NFKD", "가각힣"), "e 🎉"]


def test_fold_accents_of_every_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(map(chr, codes[i : i + 500])) for i in range(0, len(codes), 500)]
    folded = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_accents(F.col("t")).alias("f"))
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()
    for r in folded.collect():
        assert r["f"] == "".join(c for c in unicodedata.normalize("NFKD", r["t"]) if not unicodedata.combining(c))


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 1])
def test_lemmatize_table(spark, monkeypatch, broadcast_rows):
    from kindred.operators import joins, lemma

    monkeypatch.setattr(lemma, "row_bound", lambda df: joins.row_bound(df, broadcast_rows))
    docs = spark.createDataFrame([("a", "wolves run wolves"), ("b", "ran")], "item_id string, t string")
    table = spark.createDataFrame([("wolves", "wolf"), ("ran", "run"), ("run", "run")], "word string, lemma string")
    got = {r["item_id"]: r["t"] for r in lemmatize(docs, "item_id", "t", table).collect()}
    assert got == {"a": "wolf run wolf", "b": "run"}


@pytest.mark.parametrize("size", [1, 4 << 20])
def test_lemmas_of_a_slice(monkeypatch, size):
    from kindred.operators import lemma

    monkeypatch.setattr(lemma, "_SLICE_BYTES", size)
    replace = lemma._replaced(pa.array(["wolves", "ran"]), pa.array(["wolf", "run"]))
    texts = pa.array(["skipped", "wolves ran home", None, "", "ran", "a  b "]).slice(1)
    assert replace(texts).to_pylist() == ["wolf run home", None, "", "run", "a  b "]
    assert replace(texts[:0]).to_pylist() == []


def test_texts_are_not_moved_for_a_lemma_table(spark):
    from kindred.plans.prepare import clean_items

    items = spark.createDataFrame([(1, "The wolves ran home"), (2, None), (2, "wolves")], "k int, text string")
    table = spark.createDataFrame([("wolves", "wolf"), ("ran", "run")], "word string, lemma string")
    cleaned = clean_items(items, lemmas=table)
    assert "Exchange" not in cleaned._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["text_clean"]) for r in cleaned.collect()) == [(1, "wolf run home"), (2, ""), (2, "wolf")]
    assert cleaned.filter("length(text_clean) > 5")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
