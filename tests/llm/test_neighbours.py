import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, rank int"


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_steps_to_a_neighbouring_cell(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = N.hilbert_keys(grid, bits)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, query, k):
    scores = x @ x[query]
    order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != ids[query]]
    return [int(ids[j]) for j in order[:k]]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA)
    found = {}
    for r in N.search(df, F.col("vec_id") % 20 == 0, piece_rows=100).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    x, ids = x.astype(float), np.arange(1500)
    assert set(found) == set(range(0, 1500, 20)) and all([r["rank"] for r in v] == list(range(1, 21)) for v in found.values())
    hits = sum(len({r.vec_id for r in v} & set(brute(ids, x, q, 20))) for q, v in found.items())
    assert hits >= 0.9 * 20 * len(found)
    assert all(abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 for v in found.values() for r in v)


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(30)] + [(7, [1.0, 0.0], 0), (40, None, 0), (41, [0.0, 0.0], 0), (42, [float("nan"), 1.0], 0)]
    rows += [(43, [None, 1.0], 0), (44, [float("inf"), 1.0], 0), (None, [1.0, 0.0], 0), (45, [1.0], 0), (60, [-1.0, 0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = N.search(df, F.col("vec_id") == 20, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(20))
    few = N.search(df.where("vec_id in (20, 60, 41)"), F.lit(True), k=20).orderBy("query_id").collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(20, 60), (60, 20)]
    assert N.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [1e-9, 1e-6, 1.0, 1e6])
def test_best_of_short_and_long_vectors(size):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16)) * size
    scores = x[:5] @ x.T
    assert (np.sort(N.best_of(scores, 20), axis=1) == np.sort(np.argsort(-scores, axis=1)[:, :20], axis=1)).all()
    scores[:, ::2] = -np.inf
    scores[:, 1::2] = size ** 2 * (1 + 1e-15 * rng.random((5, 150)))
    assert (np.sort(N.best_of(scores, 20), axis=1) == np.arange(1, 40, 2)).all()
