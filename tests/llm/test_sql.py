"""Queries that SQL can express against their SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from kindred.llm.queries import LLM_ORACLE, LLM_QUERIES
from kindred.llm.urls import judge, page_links, rule_table

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    expected = con.sql(LLM_ORACLE[name])
    got = LLM_QUERIES[name](spark, str(SF)).select(*expected.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))


@pytest.mark.skipif(not SF.exists(), reason="driver tables are absent")
def test_the_pages_hold_no_links(spark):
    """The SQL of the URL filter leaves aliases out; here is why it may."""
    assert page_links(spark.read.parquet(f"{SF}/pages.parquet")).filter("a <> b").isEmpty()


def test_blocks_spread_over_aliases(spark):
    pages = [
        (1, "https://bad.net/x", ""),  # blocked by its rule
        (2, "http://shop.io/a", '<link rel="canonical" href="https://bad.net/x">'),
        (3, "http://shop.io/b", '<meta http-equiv="refresh" content="0; url=/a">'),  # over two steps
        (4, "http://shop.org/fr/c", '<link href=//bad.net/x rel=canonical>'),  # a rule of its own allows it
        (5, "http://shop.io/free", "<p>bad.net</p>"), (6, None, None), (7, "no address", ""), (3, "http://shop.io/b", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["verdict"], r["rule"]) for r in judge(table, rule_table(table)).collect())
    assert got == [
        (1, "block", "net/"), (2, "block", None), (3, "block", None), (3, "block", None), (4, "allow", "org/fr/"),
        (5, "allow", None), (6, "allow", None), (7, "allow", None),
    ]
    assert judge(table.limit(0), rule_table(table)).isEmpty()
