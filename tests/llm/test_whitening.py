"""Whitening against a plain eigendecomposition."""
import numpy as np
import pytest

from vigil.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def plain(rows):
    x = np.floor(np.array([v for _, v in rows], float) * 1024).astype(np.int64) + 100000
    n, total = len(x), x.sum(0)
    z = x - total / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, n, total, z, e[::-1], u[:, ::-1]


def check(got, rows, k):
    x, n, total, z, e, u = plain(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for at, (i, _) in enumerate(rows):
        assert sorted(by[i]) == list(range(1, k + 1))
        one = by[i][1][0]
        assert one.n == n and one.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], total))
    for c in range(1, k + 1):
        want = z @ u[:, c - 1] / np.sqrt(e[c - 1])
        mine = np.array([by[i][c][0].whitened for i, _ in rows])
        sign = np.sign(mine @ want)
        if c < k and min(abs(e[c - 1] - e[c]), abs(e[c - 2] - e[c - 1]) if c > 1 else np.inf) > 1e-6 * e[0]:
            assert np.abs(mine * sign - want).max() < 1e-6
        assert all(by[i][c][0].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) for i, _ in rows)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_against_eigh(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 12)) * np.geomspace(1, 0.05, 12) @ rng.standard_normal((12, 12))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    check(W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect(), rows, 8)


def test_query(spark):
    got = W.op12_query(spark, "/root/testdata/sf0.01").collect()
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    check(got, [(r.vec_id, r.embedding) for r in t], 8)


def test_clustered_eigenvalues(spark):
    """Equal eigenvalues: any basis of their space, orthonormal."""
    for v in (np.eye(9) * 4, np.diag([5.0, 5, 5, 2, 2, 2, 2, 2, 1]), np.zeros((4, 4)), np.array([[2.0]])):
        e, u = W.principal(v, 8)
        want = np.sort(np.diag(v))[::-1][:8]
        assert np.allclose(e, want[want > 0]) and np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
        assert np.allclose(v @ u, u * e, atol=1e-12)
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    v = (q * np.array([7.0] * 5 + [7.0 - 1e-9] * 3 + [1.0] * 32)) @ q.T
    e, u = W.principal((v + v.T) / 2, 8)
    assert np.allclose(e, 7, atol=1e-8) and np.allclose(u.T @ u, np.eye(8), atol=1e-12)
    assert np.abs(v @ u - u * e).max() < 1e-12 * 100


def test_defined_cases(spark):
    schema = "vec_id long, embedding array<double>, component string, w int"
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.5, 0.25]), (2, [1.0, 0.5, 0.25]), (3, [0.25, -1.0, 2.0]), (None, [-1.0, 3.0, 0.5]),
            (4, None), (5, [NAN, 0.0, 0.0]), (6, [INF, 0.0, 0.0]), (7, [None, 1.0, 1.0]), (8, []), (9, [1.0])]
    got = W.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 3 and None not in r[1] and np.isfinite(r[1]).all()]
    assert sorted((r.vec_id or 0) for r in got) == sorted((i or 0) for i, _ in kept for _ in range(3))
    check([r for r in got], kept, 3) if len({i for i, _ in kept}) == len(kept) else None
    assert {r.n for r in got} == {5} and got[0].identity_error < 1e-8
    for empty in ([], [(1, [1.0, 2.0], "x", 1)], [(1, [1.0, 2.0], "x", 1), (2, [1.0, 2.0], "x", 1)], [(1, None, "x", 1)]):
        assert W.whiten(spark.createDataFrame(empty, schema)).collect() == []


def test_huge_entries(spark):
    """Beyond the grid: entries go to its ends, deviations that no long holds are null."""
    got = W.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>"))
    got = got.collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in got)
    assert {r.deviation for r in got if r.vec_id == 1} == {None}
