import math
from fractions import Fraction

import numpy as np
import pytest

from roadloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors):
    """n, deviations, whitened, explained from Python's integers and fractions."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    cov = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(dims)] for i in range(dims)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s)] for r in x])
    return n, [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x], centred @ axes / np.sqrt(values), values / np.trace(cov)


def table(rows):
    out, dims = {}, max(r.component for r in rows)
    for r in rows:
        out.setdefault(r.vec_id, [None] * dims)[r.component - 1] = r.whitened
    return out


def compare(got, ids, vectors, components, tolerance):
    n, deviations, whitened, explained = brute(vectors)
    mine = table(got)
    assert len(got) == len(ids) * components and {r.n for r in got} == {n}
    for c in range(components):
        a, b = np.array([mine[i][c] for i in ids]), whitened[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance
    of = {r.vec_id: r for r in got}
    assert [int(of[i].deviation_exact) for i in ids] == deviations
    assert all(of[i].deviation == (d if d < 2**63 else None) for i, d in zip(ids, deviations))
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-4
    z = np.array([mine[i] for i in ids])
    measured = np.abs(z.T @ z / n - np.outer(z.mean(0), z.mean(0)) - np.eye(components)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - measured) < 1e-6


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_driver_vectors(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    own = rows.collect()
    compare(W.whiten(rows).collect(), [r.vec_id for r in own], [r.embedding for r in own], 32, 1e-9)


def test_wide_spectrum_and_large_means(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    vectors = (rng.normal(size=(300, 6)) * [1e5, 1e4, 1e3, 100, 10, 1]) @ q + 1e6
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    compare(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), list(range(300)), vectors.tolist(), 6, 1e-3)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 5.0], [1.5, -2.0, 5.0], [9.0, 2.5, 5.0], [9.0, 2.5, 5.0], [0.1, 0.2, 5.0]]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [nan, 1.0, 1.0]), (94, [1.0, inf, 1.0]), (95, [1.0, 2.0]), (96, [1.0] * 4), (97, [-inf, 0.0, 0.0])]
    docs = spark.createDataFrame([*enumerate(good), *odd], SCHEMA).selectExpr("*", "'x' as vector", "1 as component", "'y' as n")
    got = W.whiten(docs).collect()
    assert {r.vec_id for r in got} == set(range(5)) and len(got) == 15
    # the third dimension is constant: nothing varies along it
    assert all(r.whitened == 0.0 and r.explained == 0.0 for r in got if r.component == 3)
    assert got[0].identity_error < 1e-9
    n, deviations, whitened, _ = brute([v[:2] for v in good])
    mine = table(got)
    for c in range(2):
        a, b = np.array([mine[i][c] for i in range(5)]), whitened[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_one_row_none_and_repeats(spark):
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    twice = W.whiten(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [3.0])], SCHEMA)).collect()
    assert len(twice) == 3 and sorted(r.deviation for r in twice) == [128**2, 128**2, 256**2]
    # as many vectors of two entries as of three: the longer ones stay
    tied = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], SCHEMA)).collect()
    assert {r.vec_id for r in tied} == {2}


def test_products_beyond_doubles(spark):
    steps = np.array([[3, -(2**62)], [2**61 + 1, 2**62 - 5], [-(2**40), 12345678901]], np.int64)
    sums, cross = W.cross_products(steps)
    own = [[int(x) for x in r] for r in steps]
    assert list(sums) == [sum(r[i] for r in own) for i in range(2)]
    assert [[int(x) for x in r] for r in cross] == [[sum(r[i] * r[j] for r in own) for j in range(2)] for i in range(2)]
    many = np.tile(np.array([[2**20 - 1, -(2**20) + 1]], np.int64), (10_000, 1))
    assert int(W.cross_products(many)[1][0, 1]) == -10_000 * (2**20 - 1) ** 2
    for n, sums in ((3, [5, -7]), (10**12, [2**62, -(2**61)])):
        want = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in steps.tolist()]
        assert W.deviations(steps, n, sums) == want
        small = steps % 1000
        assert W.deviations(small, n, sums) == [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in small.tolist()]
    huge = W.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5e16, 1.5])], SCHEMA)).collect()
    assert len(huge) == 6 and all(math.isfinite(r.whitened) for r in huge)
