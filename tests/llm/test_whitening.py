"""Whitening against numpy's own decompositions, and the bidiagonal solver by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquary.llm import bidiagonal, whitening

ROWS = "vec_id bigint, embedding array<float>"


def square(diagonal, above):
    b = np.diag(diagonal) + np.diag(above, 1)
    return b.T @ b


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_bidiagonal_form(n):
    r = np.triu(np.random.default_rng(n).standard_normal((n, n)))
    diagonal, above, right = bidiagonal.bidiagonalise(r)
    v = bidiagonal.back(right, np.eye(n))
    assert np.allclose(v.T @ v, np.eye(n))
    assert np.allclose(v.T @ r.T @ r @ v, square(diagonal, above))


@pytest.mark.parametrize("n", [1, 2, 5, 30, 80])
def test_values(n):
    rng = np.random.default_rng(n)
    diagonal, above = rng.standard_normal(n), rng.standard_normal(n - 1)
    b = np.diag(diagonal) + np.diag(above, 1)
    want = np.linalg.svd(b, compute_uv=False) ** 2
    assert np.allclose(bidiagonal.squares(diagonal, above), want, rtol=1e-9, atol=1e-13)


def test_small_values_are_as_accurate_as_large_ones():
    """Graded over 30 orders of magnitude, where a product of rows would leave nothing."""
    n = 16
    diagonal = 10.0 ** -np.arange(n)
    above = diagonal[:-1] * 0.5
    found = bidiagonal.squares(diagonal, above)
    # the product of all values is that of the diagonal's squares
    assert math.isclose(np.log(found).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-12)
    inverse = np.linalg.inv(np.diag(diagonal) + np.diag(above, 1))
    assert math.isclose(1 / found[-1], np.linalg.norm(inverse, 2) ** 2, rel_tol=1e-9)


@pytest.mark.parametrize("above", [0.0, 1e-9, 1e-3, 1.0])
def test_vectors_of_close_values(above):
    n, k = 12, 5
    diagonal, over = np.ones(n), np.full(n - 1, above)
    values = bidiagonal.squares(diagonal, over)
    z = bidiagonal.vectors(diagonal, over, values, k)
    assert np.allclose(z.T @ z, np.eye(k), atol=1e-12)
    assert np.allclose(square(diagonal, over) @ z, z * values[:k], atol=1e-12)


def test_principal():
    rng = np.random.default_rng(3)
    for scale in (1e-120, 1.0, 1e120):
        x = rng.standard_normal((200, 24)) @ np.diag(1.7 ** -np.arange(24.0)) * scale
        r = np.linalg.qr(x, mode="r")
        values, z = bidiagonal.principal(r, 4)
        _, s, vt = np.linalg.svd(x / scale)
        assert np.allclose(values / scale**2, s * s, rtol=1e-10, atol=1e-14)
        assert np.allclose(np.abs(vt[:4] @ z), np.eye(4), atol=1e-12)


def test_no_component_from_rounding():
    x = np.outer(np.arange(50.0) - 24.5, np.ones(6))
    assert bidiagonal.principal(np.linalg.qr(x, mode="r"), 4)[1].shape == (6, 1)
    assert bidiagonal.principal(np.zeros((6, 6)), 4)[1].shape == (6, 0)


def plain(rows, k=4):
    good = [(i, v) for i, v in rows if v is not None and all(
        c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    whole = [(i, tuple([math.floor(256 * float(np.float32(c))) for c in v] + [0] * (d - len(v))))
             for i, v in good]
    fit = sorted({x for _, x in whole})
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(d)]
    if not fit or not d:
        return []
    x = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(x.T @ x / n)
    order = [j for j in np.argsort(-e)[:k] if e[j] > 1e-12 * max(e.max(), 1e-300)]
    out = []
    for i, row in whole:
        apart = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        y = np.array(row, dtype=float) - np.array([s / n for s in sums])
        for c, j in enumerate(order, 1):
            out.append((i, c, n, apart if apart < 2**63 else None,
                        abs(y @ v[:, j]) / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def check(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, ROWS).repartition(5))
    assert [f"{a} {b}" for a, b in found.dtypes] == whitening.SCHEMA.split(", ")
    order = lambda r: (str(r[0]), r[1], str(r[3]), r[4])
    got = sorted(((*r[:4], abs(r[4]), r[5]) for r in found.collect()), key=order)
    want = sorted(plain(rows), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-9)
    assert all(r["identity_error"] <= 1e-9 for r in found.select("identity_error").collect())


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(9) * 2.0 ** -np.arange(9)).tolist()) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(500, 650)]  # one vector holds a third of the rows
    rows += [(3, rows[4][1]), (None, rows[5][1]), (900, None), (901, [None] * 9),
             (902, [float("nan")] + [0.0] * 8), (903, [float("inf")] * 9), (904, [1.0, 2.0]),
             (905, []), (906, [-0.0] * 9)]
    check(spark, rows)


def test_few_directions(spark):
    check(spark, [(i, [float(i), 2.0 * i, 0.5]) for i in range(20)])
    check(spark, [(i, [float(i % 3), float(i % 5)]) for i in range(40)])


def test_nothing(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 3, [(1, [float("nan")])]):
        check(spark, rows)


def test_many_triangles(spark, monkeypatch):
    """The tree has several levels, and other columns do no harm."""
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS).withColumns(
        {c: F.lit("x") for c in ("x", "at", "n", "part")})
    got = {(r["vec_id"], r["component"]): abs(r["whitened"])
           for r in whitening.whiten(df).collect()}
    for i, c, _, _, y, _ in plain(rows):
        assert got[i, c] == pytest.approx(y, rel=1e-7, abs=1e-9)


def test_deviations_are_exact():
    big = np.array([[2**40, -2**40], [3, 5]], dtype=np.int64)
    n, sums = 10**7, [10**18 + 1, -7]
    want = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in big.tolist()]
    assert whitening._deviations(big, n, sums) == [w if w < 2**63 else None for w in want]
    small = np.array([[1, 2], [3, 5]], dtype=np.int64)
    assert whitening._deviations(small, 3, [4, 7]) == [2, 89]
