import math
from collections import Counter

import numpy as np
import pytest

from fieldtally.llm.whitening import eigenpairs, whiten

KIND = "vec_id long, embedding array<float>, n string, whitened string"


def vectors(n: int = 300, size: int = 12, seed: int = 3) -> list[tuple]:
    r = np.random.default_rng(seed)
    data = (r.normal(size=(n, size)) @ r.normal(size=(size, size)) * np.linspace(3, 0.2, size)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(data)]


def plain_version(rows, size):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    e, v = np.linalg.eigh(y.T @ y / n)
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return deviations, (y @ v / np.sqrt(np.maximum(e, 1e-300)))[:, ::-1], (e / e.sum())[::-1]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], KIND).repartition(3)


def test_whitening_against_brute_force(spark):
    good = vectors() + [(None, vectors()[0][1]), (5, vectors()[5][1])]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [1.0] * 11 + [float("inf")]), (1004, [1.0] * 5), (1005, []), (1006, [3e38] * 12)]
    got = whiten(frame(spark, good + bad)).collect()
    deviations, white, explained = plain_version(good, 12)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter((i, d) for (i, _), d in zip(good, deviations))
    at = {r.vec_id: r for r in got}
    signs = np.sign(np.array(at[0].whitened) * white[0, :8])
    for (i, _), w in zip(good, white):
        assert np.array(at[i].whitened) * signs == pytest.approx(w[:8], abs=1e-9)
    assert got[0].n == len(good) and got[0].explained == pytest.approx(explained[:8], rel=1e-12) and got[0].identity_error < 1e-10
    mine = np.array([r.whitened for r in got])
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max() < 1e-10


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(i, [1.0, 2.0]) for i in range(5)], 0),
    ([(i, [float(i), 2.0, 2.0 * i]) for i in range(5)], 1), ([(i, [float(i)]) for i in range(3)], 1)])
def test_few_or_flat_vectors(spark, rows, components):
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == sum(v is not None for _, v in rows) and all(len(r.whitened) == len(r.explained) == components for r in got)
    assert all(r.identity_error <= 1e-9 for r in got)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2 ** (20 + i)), 1.0]) for i in range(20)]
    got = {r.vec_id: r.deviation for r in whiten(frame(spark, rows)).collect()}
    x = [2 ** (30 + i) + 100_000 for i in range(20)]
    want = {i: (20 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert got == {i: v if v < 2 ** 63 else None for i, v in want.items()} and None in got.values()


@pytest.mark.parametrize("values", [
    [1.0, 1.0 + 1e-9, 1.0 + 2e-9, 2.0, 5.0, 5.0], [1.0] * 6, [1e-6, 1e-6 + 1e-13, 1.0, 1.0 + 1e-12, 3.0, 3.0 + 1e-5], [0.0, 0.0, 1.0, 2.0, 3.0, 4.0], [1e12, 1.0, 1e-3, 0.5, 2.0, 7.0]])
def test_clustered_eigenvalues(values):
    r = np.random.default_rng(len(str(values)))
    q = np.linalg.qr(r.normal(size=(6, 6)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = eigenpairs(a)
    assert found == pytest.approx(np.linalg.eigvalsh(a)[::-1], rel=1e-13, abs=4e-15 * max(values))
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15
    high = np.longdouble
    residual = a.astype(high) @ x.astype(high) - x.astype(high) * found.astype(high)
    assert np.abs(residual).max() < 1e-15 * max(values)


def test_refinement_is_better_than_its_start():
    r = np.random.default_rng(1)
    a = r.normal(size=(80, 40))
    a = a.T @ a
    found, x = eigenpairs(a)
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    off = lambda v: np.abs(np.triu(v.T @ a @ v, 1)).max()
    assert off(x) < 1e-6 * off(start) and (np.diff(found) <= 0).all()
