"""Secret scan: keys that are few among many ordinary long tokens."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from kindred.llm import secrets

WORDS = "the of and report index article national station history general people between during another public market section".split()


def found(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["spans"] for r in secrets.scan(docs, ["doc_id"]).select("doc_id", secrets.listed(F.col("spans")).alias("spans")).collect()}


@pytest.mark.parametrize("ordinary", [40, 3000])
def test_a_key_is_found_however_many_ordinary_tokens_there_are(spark, ordinary):
    r = random.Random(2)  # its first key has a p-value near the median of such keys, 1e-6
    draw = lambda symbols, n: "".join(r.choice(symbols) for _ in range(n))
    keys = [draw(string.ascii_letters + string.digits, 64), draw("0123456789ABCDEF", 32)]
    paths = [f"{r.randrange(10)}/" + "/".join(r.choice(WORDS) for _ in range(20)) for _ in range(ordinary)]
    rows = [f"see {p[:70]} and {p[-40:-5]}{r.randrange(10)} there" for p in paths] + [f"key {k} end" for k in keys]
    got = found(spark, rows)
    assert [got[ordinary + i] for i in range(2)] == [f"random:4:{4 + len(k)}" for k in keys]
    assert sum(bool(got[i]) for i in range(ordinary)) <= 2


def test_normal_tail(spark):
    z = [-30.0, -9.5, -4.69, -2.0, -0.1, 0.0, 0.3, 2.5]
    got = [x["p"] for x in spark.createDataFrame([(x,) for x in z], "z double").select("z", secrets.normal_tail(F.col("z")).alias("p")).orderBy("z").collect()]
    assert got == pytest.approx([math.erfc(-x / 2**0.5) / 2 for x in z], rel=1e-6)
