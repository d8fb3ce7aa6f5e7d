"""Whitening and centroid clustering against plain Python on the same vectors."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from kindred.llm.centroids import cluster
from kindred.llm.lattice import exact_sum, limbs, on_grid, pack, unpack
from kindred.llm.whitening import eigen, whiten

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


def drawn(n, dims, seed=1):
    """Vectors in a few groups, with copies of one, nulls and bad entries."""
    r = random.Random(seed)
    means = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 0.3) for m in means[i % 5]]) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(n // 3)]
    bad = [None, [None] * dims, [NAN] * dims, [0.5] * (dims - 1) + [INF], [-INF] + [0.5] * (dims - 1), [0.5] * (dims - 1) + [None]]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)] + [(None, rows[1][1]), (None, rows[2][1]), (3, rows[3][1]), (3, rows[3][1])]


def usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


# --- integers ----------------------------------------------------------------


def test_packed_vectors_come_back():
    rows = [[0.5, -0.001], [], None, [1e30, -3.0], [None], [300.0, 2e6], [NAN, 1.0], [-128.0, 127.99], [2.0**40, -(2.0**70)]]
    kept, sizes, cells = on_grid(pa.array(rows, pa.list_(pa.float64())), 256)
    assert kept.tolist() == [0, 1, 3, 5, 7, 8] and sizes.tolist() == [2, 0, 2, 2, 2, 2]
    want = [[math.floor(Fraction(x) * 256) for x in rows[i]] for i in kept]
    assert cells.tolist() == [x for w in want for x in w]
    assert unpack(pack(sizes, cells), 3).tolist() == [w + [0] * (3 - len(w)) for w in want]
    small = np.array([1, -1, 32767, -32768, 40000, 0, 1 << 40, -(1 << 40)])
    twos = np.full(4, 2)
    assert unpack(pack(twos, small), 2).ravel().tolist() == small.tolist()
    assert pack(twos, small).to_pylist() == pack(twos, small.astype(object)).to_pylist()
    assert on_grid(pa.array(rows, pa.list_(pa.float32())), 1024, 2)[0].tolist() == [0, 3, 5, 7, 8]


def test_sums_in_limbs_are_exact():
    totals = [0, -1, 2**31, -(2**31) - 1, 2**63, -(2**200) + 7, 2**32 - 1]
    got = {}
    for r in limbs(np.arange(len(totals)), totals).to_pylist():
        assert abs(r["total"]) < 2**32
        got[r["slot"]] = got.get(r["slot"], 0) + (r["total"] << 32 * r["limb"])
    assert list(got.values()) == totals
    assert exact_sum(np.array([[2**62, 1]] * 4)) == [2**64, 4]


# --- whitening ---------------------------------------------------------------


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    return (q * values) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 9, 40), np.geomspace(1e-9, 1e3, 30), np.ones(12), np.r_[np.full(5, 2.0), np.full(5, 1.0), 0.5],
        np.r_[1 + 1e-7 * np.arange(6), 3, 1 + 1e-12 * np.arange(4)], np.r_[1 + 1e-15 * np.arange(5), np.zeros(5)], np.array([4.0]), 1e300 * np.arange(1.0, 5),
    ],
)
def test_eigenvectors_are_right_to_double_precision(values):
    a, _ = spectrum(np.asarray(values, float))
    a = (a + a.T) / 2
    size = np.abs(a).max()
    got, basis = eigen(a)
    assert np.abs(basis.T @ basis - np.eye(len(a))).max() < 1e-14
    assert np.abs((a / size) @ basis - basis * (got / size)).max() < 2e-15 * len(a)
    assert (np.diff(got) <= 1e-15 * size).all() and np.allclose(got, np.sort(values)[::-1], rtol=0, atol=1e-13 * size)


def test_single_precision_alone_would_not_do():
    a, q = spectrum(np.linspace(1, 2, 30))
    best = np.abs(q.T @ eigen((a + a.T) / 2)[1]).max(axis=0)
    rough = np.abs(q.T @ np.linalg.eigh(a.astype(np.float32))[1].astype(float)).max(axis=0)
    assert np.abs(best - 1).max() < 1e-14 < np.abs(rough - 1).max()


def check_whitening(spark, rows, k=4):
    got = whiten(frame(spark, rows)).collect()
    kept = usable(rows)
    dims = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(Fraction(c) * 256) for c in v] + [0] * (dims - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    k = min(k, dims)
    assert len(got) == len(kept) * k
    if not k:
        return got
    assert {r["n"] for r in got} == {n}
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    fits = lambda d: d if d < 2**63 else None
    want = sorted(str((i, fits(d), c)) for (i, _), d in zip(kept, deviation, strict=True) for c in range(1, k + 1))
    assert sorted(str((r["vec_id"], r["deviation"], r["component"])) for r in got) == want
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    real = values > 1e-12 * max(values.sum(), 1e-300)
    assert max(r["identity_error"] for r in got) < 1e-4
    table = {}
    for r in got:
        table.setdefault(r["component"], []).append(r)
    by_id = {i: np.array(v, float) - np.array([s / n for s in sums]) for (i, _), v in zip(kept, x, strict=True)}
    for c in range(k):
        mine = [r for r in table[c + 1] if r["vec_id"] in by_id and r["vec_id"] is not None]
        if not real[c]:
            assert {(r["whitened"], r["explained"]) for r in mine} <= {(0.0, 0.0)}
            continue
        assert mine[0]["explained"] == pytest.approx(values[c] / np.trace(centred.T @ centred / n), rel=1e-9)
        plain = np.array([by_id[r["vec_id"]] @ basis[:, c] / np.sqrt(values[c]) for r in mine])
        made = np.array([r["whitened"] for r in mine])
        assert min(np.abs(made - plain).max(), np.abs(made + plain).max()) < 1e-7
    return got


def test_whitening_against_numpy(spark):
    check_whitening(spark, drawn(120, 8))
    check_whitening(spark, drawn(30, 3, 2))


def test_whitening_of_awkward_tables(spark):
    assert check_whitening(spark, []) == []
    assert check_whitening(spark, [(1, None), (2, [NAN])]) == []
    assert check_whitening(spark, [(1, []), (2, [])]) == []
    check_whitening(spark, [(1, [0.5, 0.25])] * 5)  # one vector: nothing varies
    check_whitening(spark, [(i, [i / 4, i / 2, 1.0, -i / 4]) for i in range(9)])  # all on one line
    check_whitening(spark, [(i, [i / 4, (i * i % 7) / 8][: 1 + i % 2]) for i in range(20)])  # sizes differ
    check_whitening(spark, [(i, [2.0**50 * (i % 5), 2.0**50 * (i % 3), 2.0**50 * i]) for i in range(12)])  # beyond 64 bits
    one = check_whitening(spark, [(i, [float(i)]) for i in range(6)])
    assert {r["component"] for r in one} == {1}


def test_whitening_query(spark):
    got = __spark_entry__.queries()["op12_whitening"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(got) == 4 * rows and {r["component"] for r in got} == {1, 2, 3, 4}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    check_whitening(spark, [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])


# --- clustering --------------------------------------------------------------


def plain_clusters(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(Fraction(c) * 1024) for c in v]) for i, v in usable(rows) if len(v) == dims]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    order = sorted(kept, key=lambda r: sha(f"3:{'' if r[0] is None else r[0]}"))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    own = [sum(d for d, c in near if c == j) for j in range(len(centroids))]
    fits = lambda d: d if d < 2**63 else None
    over = any(d >= 2**63 for d, _ in near)
    spoilt = {c for d, c in near if d >= 2**63}
    return [
        (i, c, fits(d), None if c in spoilt else fits(own[c]), None if over else fits(sum(own)), sha(",".join(map(str, centroids[c]))))
        for (i, _), (d, c) in zip(kept, near, strict=True)
    ]


def check_clusters(spark, rows, dims):
    got = [tuple(r) for r in cluster(frame(spark, rows), dims=dims).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_clusters(rows, dims)))
    return got


def test_clusters_against_plain_python(spark):
    rows = [(i, v) for i, v in drawn(150, 6) if i is not None]
    check_clusters(spark, rows + [(7000, [0.1] * 5), (7001, [0.1] * 7), (7002, [])], 6)


def test_clusters_of_awkward_tables(spark):
    assert check_clusters(spark, [], 2) == []
    assert check_clusters(spark, [(1, None), (2, [1.0])], 2) == []
    check_clusters(spark, [(1, [0.5, 0.5]), (2, [0.25, 1.0]), (None, [1.0, 0.0])], 2)  # fewer vectors than centroids
    check_clusters(spark, [(i, [0.5, 0.5]) for i in range(30)], 2)  # ties everywhere, empty centroids stay
    check_clusters(spark, [(5, [0.5, 0.25])] * 12, 2)
    check_clusters(spark, [(i, [-(i % 4) / 2048, (i % 3) / 2048]) for i in range(40)], 2)  # floors of negative means
    big = check_clusters(spark, [(i, [2.0**30 * (i % 7), 2.0**60 * (i % 5)]) for i in range(40)], 2)  # beyond 64 bits
    assert any(r[2] is None for r in big)


def test_clusters_query(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in __spark_entry__.queries()["op13_centroids"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_clusters(rows, 64))
