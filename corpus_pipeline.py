"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), reads all that the one before it kept,
and returns a table; all but the last return the columns of documents. Nulls,
empty texts, repeated rows and empty tables pass as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, jaccard, language, mixing, secrets
from kindred.llm.words import word_count
from kindred.session import written
from kindred.sources.files import read_table

LEAST_SCORE = 0.5  # a language that is not even half sure is rejected


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their own labels teach; ``und`` and unsure ones go."""
    model = language.learn(docs)
    whole = docs.select(F.struct("*").alias("row"), "text")
    found = language.predict(whole, model, ["row"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 80 % or more."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; items under eight words are phrases and drop nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    leaks = decontaminate.leaks(marked, benchmark, ("doc_id", "digest")).filter(F.col("item_words") >= decontaminate.LEAST_WORDS)
    found = written(leaks.select("doc_id", "digest").distinct(), "pipeline-leaks")
    same = marked["doc_id"].eqNullSafe(found["doc_id"]) & (marked["digest"] == found["digest"])
    return marked.join(found, same, "left_anti").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` counts the new text."""
    found = secrets.scan(docs.select(F.struct("*").alias("row"), "text"), ["row"])
    text = secrets.redact(F.col("row.text"), F.col("spans"))
    changed = F.size("spans") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*(c.alias(name) for name, c in columns.items()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, sources brought to their target weights."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weighed = mixing.labelled_quality(sized, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(weighed, F.col("size"), F.col("quality_weight"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
]

#: Language ID cannot be put in SQL; tests/llm/test_pipeline.py holds stages against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
