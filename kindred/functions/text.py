"""Text cleaning as column expressions; no Python runs per row.

Each step refers to its input once. Steps are nested, and Spark works out an
expression as often as it is referred to outside of generated code, so a step
that named its input twice would double the work of all steps before it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.words import STOPWORDS

# Every character that Unicode-aware trimming removes. Java's own \s is ASCII only.
SPACE = (
    r"[\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Script, style, comments and tags; an unterminated one runs to the end.
_MARKUP = (
    r"(?is)<(?:script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|!--.*?(?:-->|\z)"
    r"|[a-z/!?][^>]*(?:>|\z))"
)
_BREAK = "\x01"  # stands for one piece of markup until runs are merged


def literal_map(entries: Mapping[str, str]) -> Column:
    """A constant string map, parsed once when the plan is optimized."""
    return F.from_json(F.lit(json.dumps(dict(entries))), "map<string,string>")


def strip(c: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def split_words(c: Column) -> Column:
    """Words between runs of white space; an empty array for blank text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def one_line(c: Column) -> Column:
    """Newlines to spaces, trimmed; null counts as empty."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def first_word(c: Column, default: str = "unknown") -> Column:
    return F.coalesce(F.get(split_words(c), F.lit(0)), F.lit(default))


def _code_point(code: Column) -> Column:
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(legal, F.decode(utf32, "UTF-32")).otherwise(F.lit("\ufffd"))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references to the characters they stand for.

    The text is cut before each ``&``, so that every reference is read once
    and ``&amp;lt;`` gives ``&lt;``. A reference needs its semicolon.
    """
    named = literal_map({name: chr(code) for name, code in name2codepoint.items()})

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"\A&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        char = (
            F.when(ref.rlike(r"\A#[0-9]"), _code_point(F.substring(ref, 2, 9).cast("bigint")))
            .when(ref.rlike(r"\A#[xX]"), _code_point(F.conv(F.substring(ref, 3, 7), 16, 10).cast("bigint")))
            .when(ref != "", F.try_element_at(named, ref))
        )
        rest = F.substr(p, F.length(ref) + 3)
        return F.when(char.isNull(), p).otherwise(F.concat(char, rest))

    return F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")


def remove_html(c: Column) -> Column:
    """Text content of an HTML string, pieces joined by a space."""
    marked = F.regexp_replace(c, _MARKUP, _BREAK)
    inner = F.regexp_replace(marked, rf"\A{_BREAK}+|{_BREAK}+\z", "")
    return decode_entities(F.regexp_replace(inner, f"{_BREAK}+", " "))


def remove_latex(c: Column) -> Column:
    """Inline math, commands with an argument and bare commands to spaces.

    ``(?d)`` limits the line breaks a dot stops at to the newline.
    """
    no_math = F.regexp_replace(c, r"(?d)\$.*?\$", " ")
    no_arguments = F.regexp_replace(no_math, r"(?d)\\[a-zA-Z]+\{.*?\}", " ")
    return F.regexp_replace(no_arguments, r"\\[a-zA-Z]+", " ")


def keep_alphanumeric(c: Column) -> Column:
    """ASCII letters and digits; any run of other characters is one space.

    Extracting the words is twice as fast as replacing what lies between them.
    """
    return F.array_join(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), 0), " ")


def remove_stopwords(c: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Drop stop words and one-character words."""
    kept = F.filter(split_words(c), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.array_join(kept, " ")


def replace_words(c: Column, lemmas: Mapping[str, str]) -> Column:
    """Each word by its entry in a small mapping, if it has one.

    A large dictionary belongs in a table: see ``operators.lemma``.
    """
    table = literal_map(lemmas)
    return F.array_join(F.transform(split_words(c), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def truncate_words(c: Column, max_len: int) -> Column:
    """At most ``max_len`` characters, cut before the last space within them."""
    whole, before_space, hard = rf".{{0,{max_len}}}\z", rf".{{0,{max_len - 1}}}(?= )", rf".{{0,{max_len}}}"
    return F.regexp_extract(c, rf"(?s)\A(?:{whole}|{before_space}|{hard})", 0)


def normalize_words(c: Column, drop_stopwords: bool = True) -> Column:
    """The steps of ``clean_text`` that come before the lemma step."""
    text = F.lower(remove_latex(remove_html(F.coalesce(c, F.lit("")))))
    if not drop_stopwords:
        return keep_alphanumeric(text)
    # one-character words are dropped with the stop words, so they are not extracted
    words = F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), 0)
    return F.array_join(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), " ")


def clean_text(
    c: Column,
    drop_stopwords: bool = True,
    lemmas: Mapping[str, str] | None = None,
    max_len: int | None = None,
) -> Column:
    """HTML, LaTeX, case, special characters, stop words, lemmas, then the length if one is given; null gives ''."""
    words = normalize_words(c, drop_stopwords)
    if lemmas:
        words = replace_words(words, lemmas)
    return F.trim(words if max_len is None else truncate_words(words, max_len))
