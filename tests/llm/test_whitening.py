"""Whitening against numpy over exact integers, and on hard rows."""

from decimal import Decimal

import numpy as np
import pytest

from attestry.llm import whitening

SHAPE = "vec_id long, embedding array<double>, component int, x string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 0) for i, e in rows], SHAPE)


def brute(vectors, most=4):
    x = [[int(np.floor(256 * c)) for c in e] for e in vectors]
    fit = [list(v) for v in sorted({tuple(v) for v in x})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    rows = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x]) @ vectors / np.sqrt(values)
    trace = sum(sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in fit) / n**3
    return n, rows, values / trace, [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


@pytest.mark.parametrize("d, copies", [(3, 1), (24, 40), (130, 2)])
def test_equal_to_numpy(spark, d, copies):
    r = np.random.default_rng(d)
    scale = np.linspace(3, 1, d)
    base = (r.normal(size=(300, d)) * scale + 5).tolist()
    vectors = base + [base[0]] * copies
    got = whitening.whitened(frame(spark, list(enumerate(vectors)))).toPandas()
    n, rows, share, dev = brute(vectors)
    most = min(4, d)
    assert len(got) == len(vectors) * most and set(got.n) == {n} and n == 300
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(len(vectors))].to_numpy()
    sign = np.sign((wide * rows).sum(0))
    assert np.abs(wide - rows * sign).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[range(len(vectors))]
    assert [int(v) for v in first.deviation] == dev
    for k in range(most):
        assert np.allclose(got[got.component == k + 1].explained, share[k], rtol=1e-9)
    assert set(got.identity_error) == {max(got.identity_error)} and got.identity_error.max() < 1e-9


def test_hard_rows(spark):
    rows = [(1, [0.0, -0.0]), (1, [0.0, 0.0]), (None, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [])]
    got = whitening.whitened(frame(spark, rows)).collect()
    # two distinct vectors leave one direction, and both lie one deviation from the mean
    assert sorted((r.vec_id or 0, r.component, r.n, abs(round(r.whitened, 9))) for r in got) == [(0, 1, 2, 1.0), (1, 1, 2, 1.0), (1, 1, 2, 1.0)]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


def test_lengths_are_spaces_of_their_own(spark):
    rows = [(k, [float(k % 5), float(k % 3)]) for k in range(15)] + [(100 + k, [float(k), 1.0, float(k * k)]) for k in range(6)]
    got = whitening.whitened(frame(spark, rows)).toPandas()
    assert set(got[got.vec_id < 100].n) == {15} and set(got[got.vec_id >= 100].n) == {6}
    assert set(got[got.vec_id >= 100].component) == {1, 2}
    many = spark.createDataFrame([(k, [1.0] * (k + 1), 1, "x", 0) for k in range(17)], SHAPE)
    with pytest.raises(ValueError):
        whitening.whitened(many)


def test_without_variance_or_rows(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1,)], "vec_id long")).collect() == []


def test_deviations_beyond_a_long(spark):
    vectors = [[float(2**40 * (k % 3)), float(k)] for k in range(9)]
    n, _, _, dev = brute(vectors, 1)
    got = whitening.whitened(frame(spark, list(enumerate(vectors))), components=1).orderBy("vec_id").collect()
    assert n == 9 and [r.deviation for r in got] == [Decimal(v) for v in dev]
