import numpy as np
import pytest

from kindred.operators import boxes, topk
from kindred.operators.boxes import grow, topk_boxes
from kindred.operators.topk import topk_dense


def table(spark, matrix, key, names=None):
    rows = [(f"v{i:04d}" if names is None else names[i], [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} string, embedding array<float>")


def answers(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


def expected(asked, matrix, k, below=None):
    """Plain numpy, ties to the smaller id."""
    scores = np.round(asked.astype(np.float32).astype(float) @ matrix.astype(np.float32).astype(float).T, 6)
    found = []
    for q, row in enumerate(scores):
        order = [i for i in np.lexsort((np.arange(len(matrix)), -row)) if below is None or row[i] < below][:k]
        found += [(f"v{q:04d}", n + 1, f"v{i:04d}", row[i]) for n, i in enumerate(order)]
    return sorted(found)


def close(got, wanted):
    assert [x[:3] for x in got] == [x[:3] for x in wanted]
    assert np.allclose([x[3] for x in got], [x[3] for x in wanted], atol=2e-6)


@pytest.fixture(scope="module", params=[0.05, 1.0])
def matrix(request):
    """Clusters, or nothing of the kind; lengths differ; copies, zero vectors and a crowd of near copies."""
    rng = np.random.default_rng(17)
    centers = rng.normal(size=(10, 6))
    made = np.concatenate([c + request.param * rng.normal(size=(90, 6)) for c in centers])
    made[::2] /= np.linalg.norm(made[::2], axis=1, keepdims=True)
    made[5:9] = 0
    made[100:190] = made[100]
    made[200:290] = made[200] + 1e-4 * rng.normal(size=(90, 6))
    return made


@pytest.mark.parametrize("k, below", [(1, None), (7, None), (7, 0.9), (120, None)])
def test_equal_to_all_pairs(spark, monkeypatch, matrix, k, below):
    """Many cells, small leaves and several blocks of queries, which must not show in the answers."""
    for name, value in (("CELL_ROWS", 60), ("LEAF_ROWS", 16), ("BLOCK_BYTES", 8 * 6 * 300), ("DENSE_BLOCK", 100), ("_AT_ONCE", 40), ("_QUERIES", 30)):
        monkeypatch.setattr(boxes, name, value)
    asked = np.concatenate([matrix[::3], np.random.default_rng(2).normal(size=(60, 6)), np.zeros((2, 6))])
    found = answers(topk_boxes(table(spark, asked, "query_id"), table(spark, matrix, "item_id").repartition(5), k, below))
    close(found, expected(asked, matrix, k, below))


def test_more_queries_than_a_block_go_through_boxes(spark, monkeypatch, matrix):
    """``topk_dense`` gives the same answers by either way, with an encoder as well."""
    queries, vectors = table(spark, matrix[::4], "query_id"), table(spark, matrix, "item_id")
    plain = answers(topk_dense(queries, vectors, 3))
    monkeypatch.setattr(topk, "DENSE_BLOCK", 50)
    called = []
    real = boxes.topk_boxes
    monkeypatch.setattr(boxes, "topk_boxes", lambda *a: called.append(1) or real(*a))
    assert answers(topk_dense(queries, vectors, 3)) == plain
    assert answers(topk_dense(queries.withColumnRenamed("embedding", "text"), vectors, 3, encode=lambda q: q.withColumnRenamed("text", "embedding"))) == plain
    assert called == [1, 1]


def test_odd_tables(spark, monkeypatch):
    empty, one = table(spark, np.zeros((0, 2)), "item_id"), table(spark, np.ones((1, 2)), "item_id")
    queries = table(spark, np.eye(2), "query_id")
    assert topk_boxes(queries, empty, 2).count() == 0
    assert topk_boxes(queries.limit(0), one, 2).count() == 0
    assert answers(topk_boxes(queries, one, 2)) == [("v0000", 1, "v0000", 1.0), ("v0001", 1, "v0000", 1.0)]
    twice = table(spark, [[1, 0], [0, 1], [1, 0]], "query_id", ["q", "q", "r"])  # one id, two places
    four = table(spark, [[1, 0], [0.9, 0], [0, 0.8], [0, 0.7]], "item_id")
    monkeypatch.setattr(boxes, "CELL_ROWS", 2)
    monkeypatch.setattr(boxes, "BLOCK_BYTES", 1)
    monkeypatch.setattr(boxes, "DENSE_BLOCK", 1)
    assert [x[:3] for x in answers(topk_boxes(twice, four, 2))] == [("q", 1, "v0000"), ("q", 2, "v0001"), ("r", 1, "v0000"), ("r", 2, "v0001")]
    same = table(spark, np.ones((3, 2)), "item_id", ["b", "a", "a"])  # repeated ids
    assert [x[:3] for x in answers(topk_boxes(queries.limit(1), same, 2))] == [("v0000", 1, "a"), ("v0000", 2, "a")]
    with pytest.raises(Exception, match="one width"):
        topk_boxes(queries, empty.unionByName(one).unionByName(table(spark, [[1.0]], "item_id")).coalesce(1), 1).collect()


def test_self_search_scores_few_pairs(matrix):
    """Vectors asked for themselves meet a small part of the others, whatever the order they come in."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(20_000, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[3_000:5_000] = vectors[3_000]  # a hot group of copies
    columns, pairs, found = np.ascontiguousarray(vectors.T), [], {}
    block = boxes._Block(columns, np.full(len(vectors), 1.0), 1, None)
    real = block._scored

    def counted(rows, some):
        pairs.append(len(rows) * len(some))
        return real(rows, some)

    block._scored = counted
    for query, item, score in block.search(np.arange(len(vectors)), vectors, near=False):
        assert (score > 0.99999).all()
        for q, i in zip(query.tolist(), item.tolist()):
            found.setdefault(q, []).append(i)
    copies = [min(found[q]) for q in range(len(vectors))]
    assert copies == [3_000 if 3_000 <= q < 5_000 else q for q in range(len(vectors))]
    assert sum(pairs) < 0.05 * len(vectors) ** 2


def test_tree_deals_every_vector_to_a_cell():
    rng = np.random.default_rng(9)
    sample = np.concatenate([rng.normal(size=(500, 4)), np.ones((300, 4))])
    tree = grow(sample, 16)
    cells = tree.cells(sample)
    assert tree.sizes.sum() == len(sample) and np.array_equal(np.bincount(cells, minlength=len(tree.sizes)), tree.sizes)
    steps = np.array([np.linalg.norm(sample[cells == c].mean(0) - sample[cells == c + 1].mean(0)) for c in range(15)])
    far = [np.linalg.norm(sample[cells == c].mean(0) - sample[cells == d].mean(0)) for c in range(16) for d in range(c)]
    assert steps.mean() < np.mean(far)  # neighbours in number lie together
    assert len(tree.sizes) == 16 and set(tree.cells(rng.normal(size=(1000, 4)))) <= set(range(16))
    assert len(grow(np.ones((50, 3)), 8).sizes) == 1 and grow(np.zeros((0, 3)), 1).cells(np.ones((2, 3))).tolist() == [0, 0]


def test_blocks_hold_every_query_once(spark):
    counts = {0: 3, 1: 5, 4: 40, 5: 2, 6: 9, 9: 1}
    asked = spark.createDataFrame([(c * 100 + i, c) for c, n in counts.items() for i in range(n)], "query_id int, cell_id int")
    parts = [[r["query_id"] for r in asked.filter(mine).collect()] for mine, _ in boxes._blocks(counts, 10)]
    assert sorted(x for p in parts for x in p) == sorted(r["query_id"] for r in asked.collect())
    assert max(map(len, parts)) <= 20 and len(parts) < 12
    assert boxes._blocks({}, 10) == []
