"""Tab-separated and JSON lines, from files or from any table of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kindred.functions.words import MISSING_TOKENS
from kindred.sources.quoted import read_records

# The columns of the raw book file, in order.
BOOK_COLUMNS = ("wiki_id", "freebase_id", "title", "author", "pub_date", "genres_raw", "summary")

PAPER_SCHEMA = "title string, abstract string, authors string, categories string"

# A field is quoted only if the quote is its first character.
_FIELD = r'(?:\A|\t)("[^"]*+(?:""[^"]*+)*+"?[^\t]*+|[^\t]*+)'


def missing_to_null(c: Column) -> Column:
    """Null for the contents that tabular readers take as missing."""
    return F.when(~c.isin(*MISSING_TOKENS), c)


def _unquoted(field: Column) -> Column:
    """A quoted field without its quotes; doubled quotes inside become single."""
    inner = F.regexp_extract(field, r'\A"([^"]*+(?:""[^"]*+)*+)', 1)
    after = F.regexp_extract(field, r'\A"[^"]*+(?:""[^"]*+)*+"?([^\t]*+)\z', 1)
    return F.when(F.startswith(field, F.lit('"')), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), after)).otherwise(
        field
    )


def parse_tsv(lines: DataFrame, columns: Sequence[str] = BOOK_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Columns from the ``value`` of each line.

    Blank lines and lines with too many fields are skipped, missing trailing
    fields are null. ``keep`` names other columns of ``lines`` to carry along.
    """
    value = F.col("value")
    quoted = value.startswith('"') | value.contains('\t"')
    split = F.when(quoted, F.transform(F.regexp_extract_all(value, F.lit(_FIELD), 1), _unquoted)).otherwise(
        F.split(value, "\t")
    )
    # explode keeps later filters from splitting each line again
    fields = lines.filter(F.trim(value) != "").select(*keep, F.explode(F.array(split)).alias("_fields"))
    return fields.filter(F.size("_fields") <= len(columns)).select(
        *keep, *[missing_to_null(F.get("_fields", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    )


def parse_ndjson(lines: DataFrame, schema: str | StructType = PAPER_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """Columns from the JSON object in each line's ``value``.

    Blank lines and lines that are not one JSON object are skipped.
    """
    text = F.trim(F.translate(F.col("value"), "\t\r", "  "))
    options = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_bad"}
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    checked = StructType([*fields.fields, StructField("_bad", StringType())])
    # inline keeps later filters from parsing each line again
    parsed = lines.filter(text.startswith("{") & text.endswith("}")).select(
        *keep, F.inline(F.array(F.from_json(text, checked, options)))
    )
    return parsed.filter(F.col("_bad").isNull()).drop("_bad")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``line_no``, which follows the order of the file, and ``line_hash``.

    ``line_no`` orders lines by file block and place within it, is not dense and
    changes with the size of the blocks. ``line_hash`` depends on the content
    alone, so samples by it are the same however a file is split.
    """
    return (
        spark.read.text(path)
        .select(
            "value",
            F.md5("value").alias("line_hash"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("line_no"),
        )
    )


def read_tsv(
    spark: SparkSession, path: str, columns: Sequence[str] = BOOK_COLUMNS, quoted_newlines: bool = False
) -> DataFrame:
    """A headerless tab-separated file, with ``line_no``.

    Files are read in parallel. ``quoted_newlines`` lets quoted fields run over
    lines, at the price of further passes over the file.
    """
    lines = read_lines(spark, path)
    if quoted_newlines:
        lines = read_records(spark, path, "\t").select(
            "value", F.md5("value").alias("line_hash"), F.struct("file", "block", "row").alias("line_no")
        )
    return parse_tsv(lines, columns, keep=["line_no", "line_hash"])


def read_ndjson(spark: SparkSession, path: str, schema: str | StructType = PAPER_SCHEMA) -> DataFrame:
    """A file of JSON objects, one per line, with ``line_no``."""
    return parse_ndjson(read_lines(spark, path), schema, keep=["line_no", "line_hash"])
