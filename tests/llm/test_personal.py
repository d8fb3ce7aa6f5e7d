"""Personal data against plain regular expressions, one match after the other."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kindred.llm import personal

SF = "/root/testdata/sf0.001"


def check(spark, texts):
    rows = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "doc_id int, text string, score double, found string")
    got = {r["doc_id"]: r["found"] for r in personal.find(rows, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(x["start"], x["kind"], x["end"]) for x in got[i]] == brute.personal(t)[1], t
        assert all(0 <= x["score"] <= 1 for x in got[i])
    return [[(personal.KINDS[x["kind"]], texts[i][x["start"] : x["end"]]) for x in got[i]] for i in range(len(texts))]


def test_kinds_and_checks(spark):
    found = check(spark, [
        "mail é a.b@c.d_x@y.z me@host nobody@x.", "at 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.000.255.0001.", "4111 1111 1111 1111 and 4111-1111-1111-1112 5",
        "+1 (555) 010-9999 call +49 30 123456 now +1 2", "IBAN DE89 3704 0044 0532 0130 00 and GB29NWBK60161331926819 THEN", "xGB29NWBK60161331926819 DE89370400440532013001",
        "my ssn 078-05-1120, part 078-05-1121 666-12-3456 ssn 000-12-3456", "phone 030 123 4567 but 030 123 4568 is far from it, order 12.34.5678",
        "tel 1.2.3.4 and tel 152.143.123.131", "Phone: 555-123-4567 Isbn 555-123-4567", None, "", " ", "+", "@", "a@b.c" * 3,
    ])
    assert found[0] == [("email", "a.b@c.d"), ("email", "_x@y.z")]
    assert found[1] == [("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "001.000.255.0001")]
    assert found[2] == [("card", "4111 1111 1111 1111")]
    assert found[3][0] == ("phone", "+1 (555) 010-9999") and found[4] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB29NWBK60161331926819")]
    assert found[5] == [] and found[6] == [("ssn", "078-05-1120")]
    assert found[7] == [("national", "030 123 4567")] and found[8] == [("ip", "1.2.3.4"), ("ip", "152.143.123.131")]


def test_words_nearby_adjust_the_score(spark):
    texts = ["call +1 555 010 9999", "+1 555 010 9999", "order +1 555 010 9999", "call, order +1 555 010 9999", "recall +1 555 010 9999"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["found"][0]["score"] for r in personal.find(rows, ["doc_id"]).collect()}
    assert [got[i] for i in range(5)] == [1.0, 0.7, 0.4, 0.8, 0.7]
    strict = personal.find(spark.createDataFrame([(1, "030 123 4567")], "doc_id int, text string"), ["doc_id"], least=0.2).first()["found"]
    assert [x["kind"] for x in strict] == [personal.KINDS.index("national")]


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "01259.+- "), (2, "ab1.@-_%+ "), (3, "0123456789- "), (4, "GBDE0129 A."), (5, "12-/. phonessn:é😀")])
def test_random_texts(spark, seed, alphabet):
    r = random.Random(seed)
    check(spark, ["".join(r.choice(alphabet) for _ in range(r.randrange(90))) for _ in range(600)])


def test_random_numbers_with_checks(spark):
    r = random.Random(9)
    texts = []
    for _ in range(200):
        body = "".join(r.choice("0123456789") for _ in range(r.randrange(12, 20)))
        country = r.choice(["DE", "NO", "XX", "GB"])
        account = "".join(r.choice("0123456789AZ") for _ in range({"DE": 18, "NO": 11, "XX": 14, "GB": 18}[country]))
        rest = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
        texts.append(f"{body} {r.choice(['', 'x', '. '])}{country}{rest:02}{account} {r.choice(['THEN', 'then', '9'])} {body[:9]}")
    kinds = [k for found in check(spark, texts) for k, _ in found]
    assert kinds.count("card") > 5 and kinds.count("iban") > 50


def test_very_long_runs_take_no_stack_and_no_square_time(spark):
    n = 400_000
    texts = ["1" * n, "1 " * n, "a" * n, "a." * n, "+1" + " " * n, "1." * n, "@" + "a." * n, "A1" * n, "x@y." * (n // 4) + "z", "1.2.3.4 " * (n // 8)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    start = time.time()
    sizes = {r["doc_id"]: r["n"] for r in personal.find(rows, ["doc_id"]).select("doc_id", F.size("found").alias("n")).collect()}
    assert time.time() - start < 120
    assert sizes[9] == n // 8 and len(sizes) == len(texts)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op11_personal_data"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base, every = brute.personal(docs[r["doc_id"]])
        say = lambda spans: ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["base_sha256"], r["spans"]) == (brute.SHA(say(base)), say(every))
        assert [r[f"n_{k}"] for k in personal.BASE] == [sum(k == x for _, x, _ in base) for k in range(4)]
    assert sum(r["n_email"] for r in got) > 0 and sum(r["n_card"] for r in got) > 0


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert personal.find(empty, ["doc_id"]).collect() == []
    rows = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c"), (1, None), (1, None)], "doc_id int, text string")
    assert sorted(len(r["found"]) for r in personal.find(rows, ["doc_id"]).collect()) == [0, 0, 1, 1]


def test_sql_on_awkward_texts(spark, tmp_path):
    import duckdb

    from kindred.llm.sql import SQL

    r = random.Random(12)
    texts = ["my ssn 078-05-1120 at 1.2.3.4", "IBAN DE89 3704 0044 0532 0130 00, serial GB29NWBK60161331926819", "phone 030 123 4567 a@b.c", None, "4111 1111 1111 1111"]
    texts += ["".join(r.choice(["tel ", "1", "22", "333", "4444", "-", " ", ".", "+", "GB", "é", "x@y.z", "ssn "]) for _ in range(30)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = con.sql(SQL["op11_personal_data"])
    got = __spark_entry__.queries()["op11_personal_data"](spark, str(tmp_path)).select(*expected.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected.fetchall()))
