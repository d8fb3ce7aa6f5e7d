"""Raw collections to the common item schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import first_word, one_line, split_words, strip
from kindred.operators.position import dense_index, first_rows, hash_position
from kindred.session import written
from kindred.sources.files import ITEM_COLUMNS, assert_columns
from kindred.sources.lines import parse_ndjson

MIN_SUMMARY = 50  # fixed value: a summary is longer than this
MIN_ABSTRACT = 80  # fixed value: an abstract has at least this many characters

_STRING = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
_SCALAR = rf"(?:{_STRING}|-?[0-9][0-9.eE+-]*+)"
_PAIR = rf"\s*+{_STRING}\s*+:\s*+"
# Up to three pairs with string values, then pairs with any scalar.
_NAMES = (
    rf"(?s)\A\s*+\{{(?:{_PAIR}{_STRING}\s*+(?:,{_PAIR}{_STRING}\s*+)?+(?:,{_PAIR}{_STRING}\s*+"
    rf"(?:,{_PAIR}{_SCALAR}\s*+)*+)?+)\}}\s*+\z"
)
# Three such pairs before values of any kind, or fewer before a trailing comma.
_THREE = rf"{_PAIR}{_STRING}\s*+,{_PAIR}{_STRING}\s*+,{_PAIR}{_STRING}"
_ANY = rf"(?:{_STRING}|True|False|None|[\s\[\]{{}}(),:0-9.eE+-])*+"
_FIRST_THREE = rf"(?s)\A\s*+(\{{{_THREE})\s*+,(?={_ANY}\z).*\}}\s*+\z"
_FEWER = rf"(?s)\A\s*+(\{{{_PAIR}{_STRING}(?:\s*+,{_PAIR}{_STRING})?+)\s*+,\s*+\}}\s*+\z"


def first_values(c: Column, n: int = 3, default: str = "Unknown") -> Column:
    """The first ``n`` values of a map written as text, joined by ``, ``.

    Anything but a map whose first values are strings gives the default. A key
    that comes twice keeps its first place and its last value. Values after the
    first three may be of any kind.
    """
    head = F.concat(F.coalesce(F.nullif(F.regexp_extract(c, _FIRST_THREE, 1), F.lit("")), F.regexp_extract(c, _FEWER, 1)), F.lit("}"))
    plain = c.rlike(_NAMES)
    c = F.when(plain, c).when(head != "}", head)
    pairs = F.map_entries(
        F.from_json(c, "map<string,string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    )
    keys = F.slice(F.array_distinct(F.transform(pairs, lambda e: e["key"])), 1, n)
    values = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"])
    return F.coalesce(F.array_join(values, ", "), F.lit(default))


def default_if_null(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(c, F.lit(default))


def default_if_empty(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def any_category(c: Column, allowed: Sequence[str]) -> Column:
    """Whether one of the words of ``c`` is allowed; null and blank never match.

    Spark looks words up in a hash set of the allowed ones, however many they are.
    """
    return F.coalesce(F.exists(split_words(c), lambda w: w.isin(*allowed)), F.lit(False))


def long_enough(summary: Column) -> Column:
    return F.length(strip(summary)) > MIN_SUMMARY


def book_rows(raw: DataFrame) -> DataFrame:
    """Raw books with a title and a long enough summary."""
    return raw.dropna(subset=["title", "summary"]).filter(long_enough(F.col("summary")))


def ingest_books(raw: DataFrame, key: str, sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Items from raw books, all or a seeded exact sample, numbered in sample order.

    ``key`` decides the sample. Rows that share it have to be alike in all
    columns, as lines with the same ``line_hash`` are.
    """
    return hash_position(book_rows(raw), key, seed, "_n", below=sample_size).select(
        F.concat(F.lit("book_"), F.col("_n").cast("string")).alias("item_id"),
        F.lit("book").alias("source"),
        strip(F.col("title")).alias("title"),
        strip(F.col("summary")).alias("text"),
        default_if_null(F.col("author")).alias("authors"),
        first_values(F.col("genres_raw")).alias("category"),
    )


def paper_rows(raw: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Papers in an allowed category with a long enough abstract, normalised."""
    fields = F.struct(
        one_line(F.col("title")).alias("title"),
        one_line(F.col("abstract")).alias("text"),
        default_if_empty(F.col("authors")).alias("authors"),
        first_word(F.col("categories")).alias("category"),
    )
    others = [c for c in raw.columns if c not in ("title", "abstract", "authors", "categories")]
    # inline keeps the length filter from normalising each abstract again
    papers = raw.filter(any_category(F.col("categories"), allowed)).select(*others, F.inline(F.array(fields)))
    return papers.filter(F.length("text") >= MIN_ABSTRACT)


def ingest_papers(
    raw: DataFrame, key: str, sample_size: int | None, allowed: Sequence[str], required: bool = True
) -> DataFrame:
    """Items from raw papers: all that qualify, or the first ``sample_size`` in key order.

    A sample is cut out in one pass and numbered in the task where its rows meet anyway.
    """
    kept = paper_rows(raw, allowed)
    if sample_size is None:
        taken = dense_index(kept, [key], "_n")
    else:
        number = F.row_number().over(Window.orderBy(key)) - 1
        taken = written(first_rows(kept, key, sample_size).withColumn("_n", number), "papers")
    if required and taken.isEmpty():
        raise ValueError("no paper is in an allowed category")
    return taken.select(
        F.concat(F.lit("paper_"), F.col("_n").cast("string")).alias("item_id"),
        F.lit("paper").alias("source"),
        "title",
        "text",
        "authors",
        "category",
    )


def ingest_counters(lines: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Lines scanned, which is all but blank ones, and papers kept from them."""
    keep = any_category(F.col("categories"), allowed) & (F.length(one_line(F.col("abstract"))) >= MIN_ABSTRACT)
    scanned = lines.filter(F.length(strip(F.col("value"))) > 0).agg(F.count("*")).scalar()
    return parse_ndjson(lines).agg(F.count_if(keep).alias("kept")).select(scanned.alias("scanned"), "kept")


def merge_items(*tables: DataFrame) -> DataFrame:
    """All rows of several item tables."""
    for number, table in enumerate(tables):
        assert_columns(table, name=f"item table {number}")
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged


def metadata_table(items: DataFrame, order_by: list[str]) -> DataFrame:
    """Item columns with the row position in the given order."""
    return dense_index(items.select(*ITEM_COLUMNS), order_by, "row_index")
