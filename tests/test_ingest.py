import json
import random

import pytest
from pyspark.sql import functions as F

from kindred import session
from kindred.operators.position import dense_index, first_rows, hash_position, sample_exact
from kindred.plans.ingest import ingest_books, ingest_counters, ingest_papers, merge_items, metadata_table
from kindred.sources.files import ITEM_COLUMNS
from kindred.sources.lines import read_lines, read_ndjson, read_tsv


@pytest.fixture
def books(spark, tmp_path):
    genres = json.dumps({"g1": "Fantasy", "g2": "Satire"})
    rows = []
    for i in range(20):
        author = "" if i == 3 else f"Writer {i}"
        title = "" if i == 4 else f" Volume {i} "
        summary = "x" * (50 if i == 5 else 51) if i in (5, 6) else f"A tale of volume {i}. " * 6
        rows.append("\t".join([str(i), f"/m/{i}", title, author, "1999", genres, summary]))
    path = tmp_path / "books.txt"
    path.write_text("\n".join(rows), encoding="utf-8")
    return read_tsv(spark, str(path))


def test_books(books):
    items = ingest_books(books, "wiki_id", 100).collect()
    assert len(items) == 18  # no title, and a summary of exactly 50 characters
    assert items[0].asDict().keys() == set(ITEM_COLUMNS)
    assert sorted(r["item_id"] for r in items) == sorted(f"book_{i}" for i in range(18))
    assert {r["source"] for r in items} == {"book"} and {r["category"] for r in items} == {"Fantasy, Satire"}
    assert "Unknown" in {r["authors"] for r in items}
    assert all(r["title"] == r["title"].strip() for r in items)


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_sample_is_exact_and_stable(books, parts):
    items = ingest_books(books.repartition(parts), "wiki_id", 5).orderBy("item_id").collect()
    assert [r["item_id"] for r in items] == [f"book_{i}" for i in range(5)]
    assert items == ingest_books(books, "wiki_id", 5).orderBy("item_id").collect()


def test_papers(spark, tmp_path):
    def paper(i, cats="cs.AI", chars=80, **more):
        return json.dumps({"id": str(i), "title": f"Paper\n{i}", "abstract": "a" * chars, "authors": f"P {i}", "categories": cats} | more)

    lines = [
        paper(0), paper(1, chars=79), paper(2, "math.CO cs.AI"), paper(3, "math.CO"), "broken {",
        paper(4, "q-bio  cs.LG", authors=""), "", paper(5, authors=None), paper(6, title=None), paper(7), paper(8, None),
    ]
    path = tmp_path / "papers.json"
    path.write_text("\n".join(lines), encoding="utf-8")
    raw = read_ndjson(spark, str(path))
    got = ingest_papers(raw, "line_no", 5, ["cs.AI", "cs.LG"]).orderBy("item_id").collect()
    assert [(r["item_id"], r["title"], r["authors"], r["category"]) for r in got] == [
        ("paper_0", "Paper 0", "P 0", "cs.AI"),
        ("paper_1", "Paper 2", "P 2", "math.CO"),
        ("paper_2", "Paper 4", "Unknown", "q-bio"),
        ("paper_3", "Paper 5", "Unknown", "cs.AI"),
        ("paper_4", "", "P 6", "cs.AI"),
    ]
    counters = ingest_counters(read_lines(spark, str(path)), ["cs.AI", "cs.LG"]).first().asDict()
    assert counters == {"scanned": 10, "kept": 6}
    assert ingest_papers(raw, "line_no", None, ["cs.AI", "cs.LG"]).count() == 6
    assert ingest_papers(raw, "line_no", None, ["cs.AI", *(f"x{i}" for i in range(2_000))]).count() == 5
    with pytest.raises(ValueError, match="allowed"):
        ingest_papers(raw, "line_no", 5, ["none"])


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_positions(spark, parts):
    # a third of the rows share one group
    rows = [("hot" if i % 3 == 0 else f"g{i % 50:02d}", i) for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(parts)
    got = [(r["g"], r["i"]) for r in dense_index(df, ["g", "i"], "n").orderBy("n").collect()]
    assert got == sorted(rows)
    assert sorted(r["i"] for r in first_rows(df, "i", 100).collect()) == list(range(100))
    placed = hash_position(df, "i", 7, "n").collect()
    assert sorted(r["n"] for r in placed) == list(range(600))
    sample = {r["i"] for r in sample_exact(df, "i", 37, 7).collect()}
    assert sample == {r["i"] for r in placed if r["n"] < 37}
    assert sample_exact(df, "i", 10_000).count() == 600


def test_merge_and_metadata(spark):
    def items(prefix, n):
        return spark.createDataFrame([(f"{prefix}_{i}", prefix, "t", "x", "a", "c") for i in range(n)], list(ITEM_COLUMNS))

    merged = merge_items(items("book", 3), items("paper", 2).select(*reversed(ITEM_COLUMNS)))
    meta = metadata_table(merged, ["item_id"]).orderBy("row_index").collect()
    assert [r["item_id"] for r in meta] == ["book_0", "book_1", "book_2", "paper_0", "paper_1"]
    with pytest.raises(ValueError):
        merge_items(merged, merged.drop("title"))
    assert merged.filter(F.col("source") == "book").count() == 3


def test_dense_index_stores_nothing_and_takes_any_keys(spark, monkeypatch):
    monkeypatch.setattr(session, "fresh_path", lambda *_: pytest.fail("a table was written"))
    text = F.when(F.col("id") % 3 > 0, F.concat(F.lit('k"\\é'), F.md5(F.col("id").cast("string")).substr(1, 2)))
    df = spark.range(0, 6000, 1, 8).select((F.col("id") * 7919 % 6007).alias("a"), text.alias("b"), (F.col("id") / 7).alias("c"), F.col("id").cast("timestamp").alias("d"))
    for order in (["b", "a"], ["c"], ["d"]):
        numbered = dense_index(df, order, "n")
        assert numbered.columns == [*df.columns, "n"]
        got = [tuple(r[c] for c in order) for r in numbered.orderBy("n").collect()]
        assert got == sorted(got, key=lambda k: [(x is not None, x) for x in k]) and len(set(got)) == 6000
        assert [r["n"] for r in numbered.select("n").orderBy("n").collect()] == list(range(6000))
    parts = [r["count"] for r in dense_index(df, ["b", "a"], "n").groupBy((F.col("n") / 750).cast("int")).count().collect()]
    assert parts == [750] * 8
    assert dense_index(df.limit(0), ["a"], "n").count() == 0
    assert [r["n"] for r in dense_index(df.filter("a < 3"), ["a"], "n").orderBy("a").collect()] == [0, 1, 2]


def test_all_papers_of_a_split_file_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "papers.json"
    paper = lambda i: {"title": f"P {i}", "abstract": "word " * 60, "categories": "cs.AI" if i % 5 else "x"}
    path.write_text("\n".join(json.dumps(paper(i)) for i in range(4000)))
    with session.setting(spark, "spark.sql.files.maxPartitionBytes", "200000"):
        items = ingest_papers(read_ndjson(spark, str(path)), "line_no", None, ["cs.AI"]).collect()
    want = [i for i in range(4000) if i % 5]
    assert {r["item_id"]: r["title"] for r in items} == {f"paper_{n}": f"P {i}" for n, i in enumerate(want)}
