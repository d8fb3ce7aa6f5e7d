"""Quality rules kept as a ledger of failure bits and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import WORD, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rules by bit; a document fails where the condition holds. Thresholds are in whole numbers.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("shouting", "2 * n_upper > word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions of the policy: a document is kept if it fails none of the version's bits.
POLICIES = {1: BIT["few_words"] | BIT["repeated_words"], 2: sum(BIT.values())}


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that are found twice or more in ``words``, the first time included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))
    ))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(
            p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])
        ))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(starts, lambda s: F.transform(
            s, lambda x, i: F.coalesce(F.least(F.get(s, i + 1) - x, F.lit(window)), F.lit(window))
        ))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    count = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(count)


def measure(text: Column) -> Column:
    """Struct of all measurements of a text; null counts as empty.

    Words are runs without white space; a line counts if it holds a word. Every
    number is 0 for a text without words, but for symbols.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    held = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    upper = F.length(F.regexp_replace(held, r"\P{Lu}+", ""))
    return F.struct(
        counts.alias("c"), by_line.alias("l"), F.length(held).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), upper.cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Measurements of each document and ``failed``, one bit for each rule it fails.

    ``docs`` has ``doc_id`` and ``text``. Every rule is evaluated once; policies
    and ablations read the bits and never the texts. One row per input row, with
    ``doc_id`` as it is, null included.
    """
    m = docs.select("doc_id", measure(F.col("text")).alias("m"))
    m = m.select(
        "doc_id", "m.c.n_words", "m.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.c.n_repeat_words", "m.l.n_lines", "m.n_upper"
    )
    bits = [F.when(F.expr(f"({fails})"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return m.withColumn("failed", failed)


def passes(policy: int | Column) -> Column:
    """Whether a ledger row fails no rule of the policy, given as a mask of bits."""
    mask = policy if isinstance(policy, Column) else F.lit(policy)
    return F.col("failed").bitwiseAND(mask.cast("long")) == 0


def apply_policies(book: DataFrame, policies: dict[int, int] = POLICIES) -> DataFrame:
    """Ledger with ``kept``: a map from each policy version to its verdict."""
    verdicts = [x for version, mask in policies.items() for x in (F.lit(version), passes(mask))]
    return book.withColumn("kept", F.create_map(*verdicts))


def ablations(book: DataFrame, mask: int, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """What each rule of a policy does: documents that fail it, and that fail it alone.

    The second number is what the policy would keep without the rule. Rows are
    first reduced to a count for each pattern of bits, of which there are few.
    """
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    patterns = book.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(rules) if mask >> i & 1]
    each = patterns.withColumn("r", F.explode(F.array(*named)))
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fail"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fail_alone"),
    )
