import csv
import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from kindred.plans.ingest import any_category, first_values
from kindred.session import setting
from kindred.sources import quoted
from kindred.sources.files import assert_columns, read_csv, write_csv
from kindred.sources.lines import parse_ndjson, parse_tsv, read_ndjson, read_tsv
from kindred.sources.quoted import read_records

FULL = "1\t/m/1\tTitle\tAuthor\t2001\t{}\tText"


def test_tsv_lines(spark):
    lines = [
        FULL,
        "2\t/m/2\tShort\tA\t2001\t{}",
        FULL + "\textra",
        "3\t/m/3\tNA\t\t2001\t{}\tText",
        '4\t/m/4\t"tab\there"\tA\t2001\t{}\t"say ""hi"" now" end',
        "",
        "   ",
    ]
    rows = parse_tsv(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    by_id = {r["wiki_id"]: r for r in rows}
    assert set(by_id) == {"1", "2", "3", "4"}
    assert by_id["2"]["summary"] is None
    assert by_id["3"]["title"] is None and by_id["3"]["author"] is None
    assert by_id["4"]["title"] == "tab\there" and by_id["4"]["summary"] == 'say "hi" now end'


def test_tsv_file(spark, tmp_path):
    path = tmp_path / "books.txt"
    path.write_text("\n".join(FULL.replace("1\t", f"{i}\t", 1) for i in range(50)), encoding="utf-8")
    rows = read_tsv(spark, str(path)).orderBy("line_no").collect()
    assert [r["wiki_id"] for r in rows] == [str(i) for i in range(50)]
    path.write_text(FULL.replace("Text", '"two\nlines"') + "\n" + FULL.replace("1\t", "2\t", 1), encoding="utf-8")
    rows = read_tsv(spark, str(path), quoted_newlines=True).orderBy("line_no").collect()
    assert [(r["wiki_id"], r["summary"]) for r in rows] == [("1", "two\nlines"), ("2", "Text")]


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        read_tsv(spark, str(tmp_path / "none.txt")).collect()


def test_ndjson(spark, tmp_path):
    good = '{"title": "T\\nU", "abstract": "A", "authors": "", "categories": "cs.AI  x"}'
    lines = [good, "", "not json", '["list"]', '{"title": null, "id": "7"}', "{'title': 'single'}", '{"title": "cut', good + " junk"]
    path = tmp_path / "papers.json"
    path.write_text("\n".join(lines), encoding="utf-8")
    rows = read_ndjson(spark, str(path)).orderBy("line_no").collect()
    assert [r["title"] for r in rows] == ["T\nU", None]
    assert rows[0]["authors"] == "" and rows[1]["categories"] is None
    assert parse_ndjson(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 2


def test_any_category(apply):
    got = apply(lambda c: any_category(c, ["cs.LG", "cs.AI"]), "x  cs.AI", "cs.AIx", "", None, " cs.LG ")
    assert got == [True, False, False, False, True]


@pytest.mark.parametrize(
    "given, expected",
    [
        ('{"a": "One", "b": "Two", "c": "Three", "d": "Four"}', "One, Two, Three"),
        ("{'a': 'One'}", "One"),
        ("{'a': \"It's\"}", "It's"),
        ("{}", "Unknown"),
        ("no map", "Unknown"),
        (None, "Unknown"),
        ('{"a": 5}', "Unknown"),
        ('{"a": "One", "b": 5}', "Unknown"),
        ('{"a": "1", "b": "2", "c": "3", "d": 4}', "1, 2, 3"),
        ("{'a': '1', 'b': '2', 'c': '3', 'd': True, 'e': ['x', None]}", "1, 2, 3"),
        ('{"a": "1", "b": True}', "Unknown"),
        ('{"a": "1", }', "1"),
        ('{"a": null}', "Unknown"),
        ('["One"]', "Unknown"),
        ('{"a": "Old", "b": "Mid", "a": "New"}', "New, Mid"),
        ('{"a": "Caf\\u00e9"}', "Café"),
        ('{"a": "x"} tail', "Unknown"),
    ],
)
def test_first_values(apply, given, expected):
    assert apply(first_values, given) == expected


def test_csv_round_trip(spark, tmp_path):
    rows = [("i1", "book", ' say "hi", ', "two\nlines\twith, commas", "NA", "")]
    items = spark.createDataFrame(rows, "item_id string, source string, title string, text string, authors string, category string")
    write_csv(items, str(tmp_path / "c"))
    got = read_csv(spark, str(tmp_path / "c")).collect()
    assert [tuple(r) for r in got] == [("i1", "book", ' say "hi", ', "two\nlines\twith, commas", "NA", None)]
    with pytest.raises(ValueError, match="text"):
        assert_columns(items.drop("text"))


@pytest.mark.parametrize("block", [13, 1 << 20])
def test_quoted_records_in_any_split(spark, tmp_path, block):
    """Blocks of any size, also those that lie wholly inside one field, give the records of csv.reader."""
    rng = random.Random(block)
    rows = [["id", "a", "b"]]
    for i in range(60):
        rows.append([str(i), *("".join(rng.choices(["x", "\n", '"', ",", "\t", "\r\n", "é"], k=rng.choice([1, 3, 40]))) for _ in range(2))])
    rows.append(["60", "end\n" * 50, '5" disk'])
    folder = tmp_path / "csv"
    folder.mkdir()
    for part in range(2):
        with open(folder / f"{part}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows([rows[0], *rows[1 + part :: 2]])
    schema = StructType([StructField(c, StringType()) for c in rows[0]])
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(block)), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        records = read_records(spark, str(folder), ",")
        table = read_csv(spark, str(folder), schema)
        got = sorted((tuple(r) for r in table.collect()), key=lambda r: int(r[0]))
        heads = records.filter("head").collect()
        assert (block > 1000) or spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    assert got == [tuple(r) for r in rows[1:]]
    assert [h["value"] for h in heads] == ["id,a,b"] * 2


@pytest.mark.parametrize("block", [9, 1 << 20])
def test_tsv_quotes_inside_fields_open_nothing(spark, tmp_path, block):
    path = tmp_path / "books.txt"
    inch = FULL.replace("Title", '5" disk')
    open_end = FULL.replace("1\t", "4\t", 1).replace("Text", '"never\n\tclosed')
    path.write_text("\r\n".join([inch, FULL.replace("1\t", "2\t", 1).replace("Title", '"a\n\n""b"" \tc" d'), "", FULL.replace("1\t", "3\t", 1), open_end]), encoding="utf-8", newline="")
    with setting(spark, "spark.sql.files.maxPartitionBytes", str(block)), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        rows = read_tsv(spark, str(path), quoted_newlines=True).orderBy("line_no").collect()
    assert [(r["wiki_id"], r["title"]) for r in rows] == [("1", '5" disk'), ("2", 'a\n\n"b" \tc d'), ("3", "Title"), ("4", "Title")]
    assert rows[0]["summary"] == "Text" and rows[3]["summary"] == "never\n\tclosed"


def test_records_of_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,a,b\n")
    assert read_csv(spark, str(tmp_path)).count() == 0


def test_records_by_shuffled_blocks(spark, tmp_path, monkeypatch):
    """More blocks than may be broadcast."""
    monkeypatch.setattr(quoted, "BROADCAST_ROWS", 0)
    (tmp_path / "a.csv").write_text('id\n"one\ntwo"\n"three"\n"four\n\nfive"\n')
    schema = StructType([StructField("id", StringType())])
    with setting(spark, "spark.sql.files.maxPartitionBytes", "6"), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        assert sorted(r["id"] for r in read_csv(spark, str(tmp_path), schema).collect()) == ["four\n\nfive", "one\ntwo", "three"]


def test_long_lines_are_put_together_a_few_at_a_time():
    import pyarrow as pa

    from kindred.sources import quoted

    lines, n = "x" * 100_000, 200
    batch = pa.record_batch(
        [pa.array(["f"] * n), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([lines] * n),
         *[pa.array([i % 2 == 0 for i in range(n)]), pa.array([i % 2 == 0 for i in range(n)])],
         pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64())],
        ["file", "block", "row", "value", "outside", "inside", "start", "origin"],
    )
    runs = list(quoted._runs(batch))
    assert sum(len(run) for _, run in runs) == n and max(len(run) for _, run in runs) * 100_000 <= quoted._RUN_BYTES
    records = [r for out in quoted._together(True)(iter([batch])) for r in out.to_pylist()]
    assert [r["row"] for r in records] == list(range(0, n, 2)) and {r["value"] for r in records} == {f"{lines}\n{lines}"}
    assert [r["head"] for r in records] == [True] + [False] * (n // 2 - 1)
