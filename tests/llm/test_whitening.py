"""Whitening against the eigenvectors of the covariance, and odd input."""

import math

import numpy as np
import pytest

from tidewater.llm.whitening import bidiagonalised, whitened

SCHEMA = "vec_id long, embedding array<float>, component string, n string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def expected(kept, components=8):
    x = np.floor(1024 * np.array(kept, np.float32).astype(float)) + 100_000
    centred = x - x.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(x))
    values, basis = values[::-1], basis[:, ::-1]
    count = min(components, int((values > 1e-9 * values[0]).sum()))
    exact = [sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0), strict=True)) for row in x]
    return centred @ basis[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum(), exact


def agrees(found, ids, kept, components=8):
    white, explained, exact = expected(kept, components)
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert len(got) == len(found) == len(ids) * len(explained)
    for c, share in enumerate(explained, 1):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        sign = math.copysign(1, mine @ white[:, c - 1])
        assert np.abs(mine * sign - white[:, c - 1]).max() < 1e-9
        assert all(math.isclose(got[i, c]["explained"], share, rel_tol=1e-9) for i in ids)
    for i, d in zip(ids, exact, strict=True):
        assert got[i, 1]["deviation"] == d and got[i, 1]["n"] == len(ids) and got[i, 1]["identity_error"] < 1e-9


def test_whole_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    kept = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)).tolist()
    rows = list(enumerate(kept))
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [math.nan]), (903, [math.inf] * 12), (904, [1.0, 2.0]), (905, []), (906, [2.0**43] * 12)]
    found = whitened(frame(spark, rows + odd)).collect()
    agrees(found, list(range(300)), kept)


def test_repeated_rows_zero_vectors_and_null_keys(spark):
    rng = np.random.default_rng(2)
    some = rng.standard_normal((40, 5)).tolist()
    rows = [(i, some[0]) for i in range(30)] + [(30 + i, v) for i, v in enumerate(some)] + [(70, [0.0] * 5)]
    agrees(whitened(frame(spark, rows)).collect(), [i for i, _ in rows], [v for _, v in rows])
    doubled = whitened(frame(spark, [*rows, (None, some[1]), (5, some[2])])).collect()
    assert len(doubled) == (len(rows) + 2) * 5 and sum(r["vec_id"] is None for r in doubled) == 5


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 0.0, 1.0, 4.0]), (3, [0.0, 5.0, 1.0, 4.0])]
    agrees(whitened(frame(spark, rows)).collect(), [1, 2, 3], [v for _, v in rows])
    assert whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitened(frame(spark, rows[:1])).collect() == []
    empty = whitened(frame(spark, []))
    assert empty.collect() == [] and empty.columns == whitened(frame(spark, rows)).columns


def test_long_vectors_and_few_components(spark):
    rng = np.random.default_rng(3)
    kept = (rng.standard_normal((30, 700)) * 40).tolist()
    agrees(whitened(frame(spark, list(enumerate(kept))), components=3).collect(), list(range(30)), kept, 3)


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**40 + 1000 * i), float(i % 3)]) for i in range(4)]
    found = [r for r in whitened(frame(spark, rows)).collect() if r["component"] == 1]
    values = np.array([np.float32(v[0]) for _, v in rows], float)
    x = [[int(math.floor(1024 * a)) + 100_000, int(1024 * v[1]) + 100_000] for a, (_, v) in zip(values, rows, strict=True)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in found:
        assert r["deviation"] == sum((4 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 2, 1, 0, 0], [3, 0, 0, 0], [1, 1, 1, 1, 1], [9, 8.999999, 1, 1e-7], [0, 0]])
def test_bidiagonalisation(spectrum):
    rng = np.random.default_rng(4)
    d = len(spectrum)
    left, right = np.linalg.qr(rng.standard_normal((40, d)))[0], np.linalg.qr(rng.standard_normal((d, d)))[0]
    x = left * np.array(spectrum, float) @ right.T
    values, basis, steps = bidiagonalised(lambda w: np.concatenate([x.T @ (x @ w), [(x @ w) @ (x @ w)]]), d, min(3, d))
    assert steps <= d and np.allclose(values[:3], spectrum[: len(values)][:3], atol=1e-9)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ basis[:, :2], axis=0), spectrum[: basis.shape[1]][:2], atol=1e-7)
