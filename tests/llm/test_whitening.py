"""Whitening against numpy on the same integers, and its exact parts against plain arithmetic."""

from fractions import Fraction

import numpy as np
import pytest
from llm_tables import *  # noqa: F403
from pyspark.sql import functions as F

from glossmill.llm.exact_spectrum import Roots, combined, is_prime, null_vectors, polynomial_mod, primes_for
from glossmill.llm.whitening import products, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], SCHEMA)


def check(rows, out, most=32):
    """Every column of the result for rows (id, vector) of usable vectors."""
    x = np.floor(64 * np.array([np.float32(v) for _, v in rows]).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    centred = (x * n - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(most, int((values > values.sum() * 1e-12).sum()))
    assert len(out) == n * count
    byid = {}
    for r in out:
        byid.setdefault(r.vec_id, []).append(r)
    got = np.array([[r.whitened for r in sorted(byid[i], key=lambda r: r.component)] for i, _ in rows])
    plain = centred @ axes[:, :count] / np.sqrt(values[:count])
    sign = np.sign((got * plain).sum(axis=0))
    gaps = np.abs(np.diff(values))[:count]
    clear = np.array([min(gaps[max(0, k - 1) : k + 1], default=1) > 1e-6 * values[0] for k in range(count)])
    assert np.allclose((got * sign)[:, clear], plain[:, clear], atol=1e-6)
    assert np.allclose(got.T @ got / n - np.outer(got.mean(axis=0), got.mean(axis=0)), np.eye(count), atol=1e-9)
    for (i, _), d in zip(rows, exact):
        assert [r.component for r in sorted(byid[i], key=lambda r: r.component)] == list(range(1, count + 1))
        assert all(r.n == n and r.deviation == d and r.identity_error < 1e-9 for r in byid[i])
        assert np.allclose([r.explained for r in sorted(byid[i], key=lambda r: r.component)], values[:count] / values.sum(), rtol=1e-8)


def test_given_vectors(spark, sample):
    rows = [(r.vec_id, r.embedding) for r in sample("embeddings").collect()]
    check(rows, whitened(sample("embeddings")).collect())


@pytest.mark.parametrize("dims,n", [(1, 5), (3, 40), (7, 4), (40, 90)])
def test_other_shapes(spark, dims, n):
    """Fewer dimensions than components, fewer rows than dimensions, correlated and scaled entries."""
    rng = np.random.default_rng(dims)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) * 3).tolist())]
    check(rows, whitened(frame(spark, rows).repartition(3)).collect())


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [(3 if s else -3) * (k == i) for k in range(5)]) for i in range(5) for s in (0, 1)]
    check(rows, whitened(frame(spark, rows)).collect())


def test_large_entries_are_exact(spark):
    rows = [(0, [1e9, 2.0]), (1, [-1e9, 1.0]), (2, [5e8, -1.0]), (3, [0, 0])]
    out = whitened(frame(spark, rows)).collect()
    x = [[int(np.floor(64 * float(np.float32(c)))) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x)]
    exact = [sum((4 * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    assert {r.vec_id: r.deviation for r in out} == {i: (e if e < 1 << 63 else None) for i, e in enumerate(exact)}


def test_left_out_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [i % 3, i % 5 + 0.3]) for i in range(20)] + [(None, [1, 2]), (5, [4, 4])]
    bad = [(100, None), (101, []), (102, [nan, 1]), (103, [inf, 1]), (104, [None, 1]), (105, [1]), (106, [1, 2, 3]), (107, [1e30, 1])]
    # But for the error and the last digits, which depend on how rows are multiplied together.
    but_error = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in tuple(r)[:-1]) for r in rows.collect()), key=str)
    alone = but_error(whitened(frame(spark, good)))
    mixed = frame(spark, good + bad).withColumns({c: F.lit("x") for c in ("vector", "component", "n", "whitened")})
    assert but_error(whitened(mixed)) == alone and len(alone) == 44


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(frame(spark, rows)).collect() == []


def test_polynomial_of_an_integer_matrix():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 6):
        for singular in (False, True):
            m = rng.integers(-50, 50, (size, size))
            if singular and size > 1:
                m[0] = 0
            ours = [combined(p := primes_for(10**14), [int(polynomial_mod(m % q, q)[k]) for q in p]) for k in range(size + 1)]
            # Faddeev and LeVerrier, in fractions
            c, work, a = [Fraction(1)], np.zeros((size, size), object), m.astype(object)
            for k in range(1, size + 1):
                work = a.dot(work) + np.eye(size, dtype=int).astype(object) * c[-1]
                c.append(-Fraction(1, k) * np.trace(a.dot(work)))
            assert ours == c


def test_roots_and_null_vectors_of_close_and_equal_roots():
    roots = [5 * 10**12 + 1, 5 * 10**12, 7, 7, 7, 3, 0, 0]
    coefficients = [1]
    for r in roots:
        coefficients = [a - r * b for a, b in zip([*coefficients, 0], [0, *coefficients])]
    found = [Roots(coefficients).nth(k) for k in range(1, 7)]
    assert [round(Fraction(p, 1 << b)) for p, b, _, _ in found] == roots[:6]
    assert [(m, j) for _, _, m, j in found] == [(1, 1), (1, 1), (3, 1), (3, 2), (3, 3), (1, 1)] and Roots(coefficients).positive == 6
    matrix = np.diag(roots)
    for place, bits, multiplicity, _ in found:
        v = null_vectors(matrix.tolist(), place, bits, multiplicity)
        assert np.allclose(v @ v.T, np.eye(multiplicity)) and np.allclose(matrix @ v.T, v.T * (place / (1 << bits)))


def test_products_of_any_size_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 19, 1 << 25, 1 << 60):
        x = rng.integers(-most, most, (5000, 3))
        assert (products(x) == x.astype(object).T.dot(x.astype(object))).all()


def test_primes():
    assert [n for n in range(60) if is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert is_prime((1 << 31) - 1) and not is_prime(46337 * 46339)
