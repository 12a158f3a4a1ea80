"""Whitening against numpy's eigenvectors, and the eigenvalue steps on their own."""

import math

import numpy as np
import pytest

from depotflow.llm import queries, whitening
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, n int, component string, whitened double"


def rows_of(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 0.5)
            for i, v in enumerate(vectors)]


def brute(vectors, most=32):
    """Whitened values up to sign, deviations and shares of the vectors that take part."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], float)
    n = len(x)
    centred = x - x.mean(axis=0)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    sums = [int(s) for s in x.sum(axis=0)]
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return centred @ components / np.sqrt(values), deviations, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("matrix", [
    np.eye(10), np.diag([3.0, 3, 2, 2, 2, 1, 0]), np.zeros((4, 4)), np.ones((6, 6)), np.array([[2.0]]),
    np.array([[1.0, 5], [5, 1]])])
def test_eigenvectors_of_special_matrices(matrix):
    values, vectors = whitening.leading_eigenvectors(matrix)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12)


@pytest.mark.parametrize("spread", [np.arange(1.0, 61), np.repeat([5.0, 1.0], 30), 10.0 ** -np.arange(60) * 1e9,
                                    np.concatenate([[1e6], 1 + 1e-9 * np.arange(59)])])
def test_eigenvectors_of_dense_matrices_with_close_values(spread):
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(60, 60)))
    matrix = turn @ np.diag(spread) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_eigenvectors(matrix, 32)
    size = np.abs(matrix).max()
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:32]).max() < 1e-13 * size * 60
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * size


def test_sturm_counts_equal_the_eigenvalues_below():
    diagonal, second = np.array([2.0, 0, 3, 1, 1]), np.array([1.0, 0, 2, 0.5])
    full = np.diag(diagonal) + np.diag(second, 1) + np.diag(second, -1)
    at = np.linspace(-4, 6, 41) + 1e-3
    assert whitening.sturm_counts(diagonal, second, at).tolist() == [
        int((np.linalg.eigvalsh(full) < a).sum()) for a in at]


def test_whitening_equals_numpy_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 40)) * np.linspace(0.2, 3, 40)
    good = list(good) + [good[0], good[0]]
    odd = [None, [], [None] * 40, [1.0] * 39 + [float("nan")], [1.0] * 39 + [float("inf")], [1.0] * 7,
           [1.0] * 39 + [None], [3e38] * 40]
    df = spark.createDataFrame(rows_of(good + odd) + [(None, [float(x) for x in good[1]], None, None, None)],
                               KIND).repartition(5)
    model = whitening.fit(df)
    got = whitening.by_component(whitening.whitened(df, model), model, whitening.identity_error(df, model)).collect()
    vectors = good + [good[1]]
    expected, deviations, shares = brute(vectors)
    assert model.n == len(vectors) == 303 and len(got) == 303 * 32
    found = np.full(expected.shape, np.nan)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
        found[302 if r.vec_id is None else r.vec_id, r.component - 1] = r.whitened
    assert all(len(v) == 1 for v in by_id.values())
    signs = np.sign((found * expected).sum(axis=0))
    assert np.abs(found * signs - expected).max() < 1e-8
    assert {r.vec_id: r.deviation for r in got} == dict(zip([*range(302), None], deviations))
    assert np.allclose([by_id[0, c][0].explained for c in range(1, 33)], shares, rtol=1e-9)
    assert {r.n for r in got} == {303} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10


def test_deviations_are_exact_beyond_doubles():
    sums = [10 ** 12 + 7, 3 * 10 ** 12]
    model = whitening.Whitening(999_983, sums, np.zeros(0), np.zeros((2, 0)), 0.0)
    near, far = np.array([[1_000_017, 3_000_051], [0, -5]]), np.array([[1 << 40, -(1 << 41)]])
    for numbers in (near, far):
        assert model.deviations(numbers) == [
            sum((model.n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in numbers]


def test_whitening_of_few_or_flat_vectors(spark):
    none = spark.createDataFrame([], KIND)
    model = whitening.fit(none)
    assert whitening.by_component(whitening.whitened(none, model), model, 0.0).collect() == []
    # two dimensions, one of them without variance: one component
    flat = spark.createDataFrame(rows_of([[x, 1.0] for x in (0, 1, 2, 3)]), KIND)
    model = whitening.fit(flat)
    got = whitening.by_component(whitening.whitened(flat, model), model, whitening.identity_error(flat, model)).collect()
    assert [r.component for r in got] == [1] * 4 and all(r.explained == pytest.approx(1) for r in got)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx([0.4472136, 0.4472136, 1.3416408, 1.3416408])
    same = spark.createDataFrame(rows_of([[1.0, 2.0]] * 3), KIND)
    model = whitening.fit(same)
    assert model.n == 3 and whitening.whitened(same, model).select("whitened").distinct().collect()[0].whitened == []


def test_op11_over_the_table(spark):
    df = queries.op11_whitening(spark, SF)
    vectors = [r.embedding for r in queries.table(spark, SF, "embeddings").orderBy("vec_id").collect()]
    expected, _, shares = brute(vectors)
    rows = df.orderBy("vec_id", "component").collect()
    found = np.array([r.whitened for r in rows]).reshape(len(vectors), -1)
    assert np.abs(np.abs(found) - np.abs(expected)).max() < 1e-7
    assert np.allclose([r.explained for r in rows[:32]], shares, rtol=1e-9) and rows[0].identity_error < 1e-9
