from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from hearthline.llm import whitening as Wh

ROWS = "vec_id long, embedding array<double>, x string"


def run(spark, tmp_path, rows, kind=ROWS):
    spark.createDataFrame([(i, v, "clash") for i, v in rows], kind).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return Wh.query(spark, str(tmp_path)).collect()


def brute(rows):
    """Exact covariance in fractions, then numpy's eigenvectors of it."""
    good = [(i, [floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = [[n * x[k] - s[k] for k in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(c[a] * c[b] for c in centred), n ** 3)) for b in range(d)] for a in range(d)])
    e, c = np.linalg.eigh(v)
    return good, n, s, v, e[::-1], c[:, ::-1]


def check(got, rows):
    good, n, s, v, e, c = brute(rows)
    k = min(16, sum(e > 1e-9 * e[0]))
    assert len(got) == len(good) * k
    scale = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9)
        options = [x for i, x in good if i == r.vec_id]
        assert r.deviation in {sum((n * a - b) ** 2 for a, b in zip(x, s)) for x in options}
        wanted = [float(np.dot([float(Fraction(n * a - b, n)) for a, b in zip(x, s)], c[:, r.component - 1])) / np.sqrt(e[r.component - 1]) for x in options]
        if len(options) == 1 and abs(wanted[0]) > 1e-3:
            sign = scale.setdefault(r.component, np.sign(wanted[0] * r.whitened))
            assert r.whitened == pytest.approx(sign * wanted[0], rel=1e-6, abs=1e-8)


def test_against_exact_covariance(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = (rng.normal(size=(300, 20)) * np.linspace(3, 0.1, 20)) @ rng.normal(size=(20, 20))
    rows = [(k, list(map(float, v))) for k, v in enumerate(base)]
    rows += [(1000 + k, rows[k % 7][1]) for k in range(200)]  # copies weigh once
    rows += [(2000, None), (2001, [float("nan")] * 20), (2002, [1.0] * 19 + [None]), (2003, [float("inf")] + [0.0] * 19), (2004, [])]
    check(run(spark, tmp_path, rows), rows)


def test_repeated_ids_few_rows_and_no_rank(spark, tmp_path):
    rows = [(1, [0.0, 1.0, 2.0]), (1, [0.5, 1.0, 2.0]), (2, [0.0, 3.0, 2.0]), (2, [0.0, 3.0, 2.0]), (None, [0.25, 0.5, 2.0])]
    check(run(spark, tmp_path, rows), rows)
    assert run(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert run(spark, tmp_path, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0])]) != []  # another length takes no part
    assert {r.vec_id for r in run(spark, tmp_path, [(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [5.0])])} == {1, 2}


def test_empty_table_and_unusable_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, None), (2, [float("nan")])]) == []


def test_huge_entries_stay_exact(spark, tmp_path):
    rows = [(k, [1e15 * ((k * 7) % 5 - 2), float(k), -3e9 * (k % 3)]) for k in range(12)]
    good, n, s, *_ = brute(rows)
    got = run(spark, tmp_path, rows)
    assert {r.vec_id for r in got} == set(range(12))
    for r in got:
        exact = next(sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in good if i == r.vec_id)
        assert r.deviation == (exact if exact < 1 << 63 else None)


def test_exact_sums_over_partitions(spark):
    y = [[3, -5, 1 << 40], [7, 0, -(1 << 61)], [-(1 << 33), 2, 5], [1, 1, 1]] * 3
    rows = spark.createDataFrame([(bytearray(p),) for p in Wh.pack(np.array(y))], "packed binary").repartition(5)
    n, total = Wh.sums(rows)
    assert (n, total) == (12, [sum(v[k] for v in y) for k in range(3)])
    exact = Wh.scatter(rows, n, total)
    assert exact == [[n * sum(v[a] * v[b] for v in y) - total[a] * total[b] for b in range(3)] for a in range(3)]


def test_decomposition_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    graded = np.diag(10.0 ** -np.arange(0, 24, 2.0))  # eigenvalues 1 to 1e-22 of a graded matrix
    scaled = graded ** 0.5 @ (np.eye(12) + 0.1 * (q + q.T)) @ graded ** 0.5
    values, vectors = Wh.one_sided_jacobi(Wh.pivoted_cholesky(scaled)[:, :6])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    a = q @ np.diag(np.arange(1.0, 13)) @ q.T
    values, vectors = Wh.one_sided_jacobi(Wh.pivoted_cholesky(a))
    assert np.allclose(values, np.arange(12, 0, -1.0), rtol=1e-13) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12)
    low = q[:, :4] @ np.diag([4.0, 3, 2, 1]) @ q[:, :4].T
    assert Wh.pivoted_cholesky(low).shape[1] == 4 and Wh.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_packing_round_trip():
    rows = np.array([[0, 0], [-128, 127], [128, 0], [1 << 20, -3], [-(1 << 60), 1], [5, -(1 << 31)]], np.int64)
    data = Wh.pack(rows)
    assert Wh.unpack(data).tolist() == rows.tolist() and [d[0] for d in data] == [1, 1, 2, 4, 8, 4]
    assert Wh.pack(rows[:0]) == []
    assert [Wh.joined(Wh.limbs(v)) for v in (0, -1, 10 ** 40, -(10 ** 45))] == [0, -1, 10 ** 40, -(10 ** 45)]
