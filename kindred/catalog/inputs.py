"""Driver tables shaped as the inputs of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources.files import read_table

ALLOWED = ("en", "src3")  # categories wanted by the paper queries
BOOK_SAMPLE = 500
PAPER_SAMPLE = 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def first_line(c: Column) -> Column:
    return F.split(c, "\n", 2)[0]


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("item_id"),
        F.lit("document").alias("source"),
        first_line(F.col("text")).alias("title"),
        "text",
        F.col("source").alias("authors"),
        F.col("lang").alias("category"),
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("item_id"),
        F.lit("page").alias("source"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("text"),
        F.regexp_extract("url", r"\A[a-z]+://([^/]+)", 1).alias("authors"),
        F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("category"),
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose number is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.filter(F.col("query_id") % 100 == 0)


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, as cells."""
    vectors = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("slot", "x"))
    means = vectors.groupBy("label", "slot").agg(F.avg(F.col("x").cast("double")).alias("x"))
    entries = F.sort_array(F.collect_list(F.struct("slot", "x")))
    return means.groupBy("label").agg(entries["x"].alias("centroid")).select(F.col("label").cast("int").alias("cell_id"), "centroid")


def genre_text(number: Column) -> Column:
    """Map text in several shapes, by row number."""
    n = number.cast("string")
    kind = F.pmod(number, F.lit(8))
    four = F.concat(
        F.lit('{"/m/a": "Genre '), n, F.lit('", "/m/b": "Drama", "/m/c": "Novel", "/m/d": "Fourth"}')
    )
    return (
        F.when(kind == 0, "{}")
        .when(kind == 1, F.concat(F.lit("{'x': 'Single "), n, F.lit("'}")))
        .when(kind == 2, F.concat(F.lit('{"x": '), n, F.lit("}")))
        .when(kind == 3, F.lit("not a map"))
        .when(kind == 4, F.concat(F.lit('{"k": "Old", "j": "Middle", "k": "New '), n, F.lit('"}')))
        .when(kind == 5, F.lit('["Genre"]'))
        .when(kind == 6, F.lit('{"x": "Caf\\u00e9", "y": "Say \\"hi\\""}'))
        .otherwise(four)
    )


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines from ``part``; some short, long, quoted, blank or missing."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    kind = F.pmod(key, F.lit(10))
    name = (
        F.when(kind == 5, "NA")
        .when(kind == 8, F.concat(F.lit('"'), F.col("p_name"), F.lit('\tand more"')))
        .when(kind == 9, F.concat(F.lit('"the ""'), F.col("p_name"), F.lit('"" part"')))
        .otherwise(F.col("p_name"))
    )
    head = [key.cast("string"), F.col("p_brand"), name, F.when(kind == 6, "").otherwise(F.col("p_type"))]
    tail = [F.col("p_size").cast("string"), genre_text(key)]
    summary = F.concat(F.lit("Summary of "), F.col("p_name"))
    line = (
        F.when(kind == 2, "")
        .when(kind == 3, F.concat_ws("\t", *head, *tail))
        .when(kind == 7, F.concat_ws("\t", *head, *tail, summary, F.lit("too much")))
        .otherwise(F.concat_ws("\t", *head, *tail, summary))
    )
    return part.select(F.explode(F.array(line)).alias("value"))


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated book lines from ``documents``, with their ``doc_id``."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    flat = F.translate("text", '\t\n"', "  '")
    return docs.select(
        "doc_id",
        F.concat_ws(
            "\t",
            key.cast("string"),
            F.concat(F.lit("/m/"), key.cast("string")),
            F.when(F.pmod(key, F.lit(11)) == 0, "").otherwise(F.concat(F.lit(" Title "), key.cast("string"), F.lit(" "))),
            F.when(F.pmod(key, F.lit(3)) == 0, "None").otherwise(F.col("source")),
            F.lit("2001"),
            genre_text(key),
            flat,
        ).alias("value"),
    ).select("doc_id", F.explode(F.array("value")).alias("value"))


def paper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines from ``documents``, with their ``doc_id``; some broken, blank or lists."""
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    kind = F.pmod(key, F.lit(10))
    record = F.struct(
        key.cast("string").alias("id"),
        F.when(F.pmod(key, F.lit(7)) != 0, F.concat(F.lit(" Paper\n"), key.cast("string"))).alias("title"),
        F.col("text").alias("abstract"),
        F.when(F.pmod(key, F.lit(6)) == 0, "").otherwise(F.col("source")).alias("authors"),
        F.when(F.pmod(key, F.lit(13)) != 0, F.concat(F.col("lang"), F.lit("  "), F.col("source"))).alias("categories"),
    )
    line = (
        F.when(kind == 0, F.substring(F.to_json(record), 1, 20))
        .when(kind == 1, F.lit('["a", "list"]'))
        .when(kind == 2, F.lit("  "))
        .otherwise(F.to_json(record))
    )
    return docs.select("doc_id", F.explode(F.array(line)).alias("value"))
