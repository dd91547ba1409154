import random

import numpy as np
from pyspark.sql import functions as F

from hpfunnel.llm import topk as K
from tests.llm.helpers import as_dicts


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def brute(rows, queries, k=10):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if queries(i)}):
        v = min(v for i, v in ok if i == q)
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


def run(spark, df, queries, k=10):
    v = K.integer_vectors(df)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in as_dicts(K.top_k(v, v.filter(queries), k))}


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 90)
    monkeypatch.setattr(K, "BLOCK_QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 0) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6, 0) for i in range(150)]  # one common vector: ties to smaller ids
    got = run(spark, table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 4)
    rows = [(0, [1.0, -2.0], 0), (0, [1.0, -2.5], 0), (100, [0.1, 0.2], 0), (100, None, 0), (1, [float("nan"), 1.0], 0),
            (2, [None, 1.0], 0), (3, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (4, [3.0], 0), (200, [2.0], 0),
            (5, [], 0), (300, [], 0), (6, [-0.0004, 7.0], 0), (6, [-0.0004, 7.0], 0), (400, [4e5, -9e5], 0), (7, [3e5, -1e5], 0)]
    df = table(spark, rows).withColumns({"score": F.lit(1), "shard": F.lit(2)})
    ids = F.col("vec_id") % 100 == 0
    got = as_dicts(K.top_k(K.integer_vectors(df), K.integer_vectors(df).filter(ids)))
    want = brute(rows, lambda i: i % 100 == 0)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert run(spark, df.limit(0), ids) == set()


def test_pruning_skips_leaves():
    rng = np.random.default_rng(2)
    v = np.vstack([rng.integers(-9, 9, (4000, 4)), rng.integers(900, 999, (96, 4))])
    tree = K.build_tree(np.arange(len(v)), v)
    opened = []

    class Counting(dict):
        def __getitem__(self, key):
            if key == "spans":
                opened.append(key)
            return dict.__getitem__(self, key)

    q = np.array([1, 1, 1, 1])
    bounds = np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T
    K.search_tree(Counting(tree), -1, bounds, q, 10, None)
    assert len(opened) <= 4 < (tree["left"] == 0).sum()


def test_queries_skip_shards_whose_box_excludes_them(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 100)
    rng = random.Random(3)
    centres = [[rng.choice((-20.0, 20.0)) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 12]], 0) for i in range(1200)]
    pairs, cells, whole = [], [], K.sent

    def counted(asked, boxes, crowded):
        cells.append(sum(len(c) for c, _, _ in boxes.values()))
        pairs.append(whole(asked, boxes, crowded))
        return pairs[-1]

    monkeypatch.setattr(K, "sent", counted)
    got = run(spark, table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert cells[0] >= 12 and pairs[0].count() < 24 * (cells[0] - 1) / 2  # 24 queries skip most shards


def test_equal_vectors_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 50)
    rows = [(i, [1.0, 2.0], 0) for i in range(400)] + [(400 + i, [i / 7, -1.0], 0) for i in range(200)]
    v = K.integer_vectors(table(spark, rows))
    marked = K.written(K.with_cell(v, K.cell_splits(v, 600)), "test-cells")
    index = K.build_index(marked, K.crowded_cells(marked))
    sizes = [len(K.pickle.loads(r["tree"])["ids"]) for r in index.collect()]
    assert sum(sizes) == 600 and max(sizes) <= 110
    assert run(spark, table(spark, rows), F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)


def test_scores_past_doubles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 8)
    rng = random.Random(9)
    rows = [(i, [(2 ** 30 + rng.randrange(2 ** 12)) / 1024 for _ in range(2)], 0) for i in range(80)]
    rows += [(100, [3.0], 0), (101, [4.0], 0)]  # a query without ten candidates beside the others
    assert run(spark, table(spark, rows), F.col("vec_id") % 50 == 0, 4) == brute(rows, lambda i: i % 50 == 0, 4)


def test_bounds_admit_every_vector_of_a_box():
    rng = np.random.default_rng(4)
    for size in (10, 2 ** 20, 2 ** 30):
        v, q = rng.integers(-size, size, (50, 3)), rng.integers(-size, size, (20, 3))
        bounds = K.box_bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])[:, 0]
        assert all(int(a) <= int(b) for row, b in zip(q @ v.T, bounds) for a in row)
