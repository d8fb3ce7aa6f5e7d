"""Tables on storage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kindred.sources.quoted import read_records

# The columns of an item.
ITEM_COLUMNS = ("item_id", "source", "title", "text", "authors", "category")
ITEM_SCHEMA = StructType([StructField(c, StringType()) for c in ITEM_COLUMNS])

_CSV = {
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread over all cores if its files have fewer splits.

    Spark cannot split a row group. Long per-row work on a file with a single
    one would run in one task; a collection with enough splits is left alone.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_csv(spark: SparkSession, path: str, schema: StructType = ITEM_SCHEMA) -> DataFrame:
    """A CSV table with a header in each file; quoted fields may hold newlines.

    Files are split into blocks all the same. Blank lines are no records, and empty
    fields are null.
    """
    records = read_records(spark, path, ",").filter(~F.col("head") & (F.trim("value") != "")).select("value")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    # inline keeps later selections from parsing each record again
    return records.select(F.inline(F.array(F.from_csv("value", ddl, _CSV))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).option("header", "true").option("escapeQuotes", "true").csv(path)


def assert_columns(df: DataFrame, required: Iterable[str] = ITEM_COLUMNS, name: str = "table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks columns {missing}")
