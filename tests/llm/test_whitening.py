"""Whitening: rank-one updates against a direct eigendecomposition, the operator against numpy, odd rows."""

import numpy as np
import pytest

from msgrisk.llm import whitening
from msgrisk.llm.whitening import Spectra, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def scatter(rows):
    return (rows - rows.mean(axis=0)).T @ (rows - rows.mean(axis=0))


@pytest.mark.parametrize("lanes,dim,rank", [(1, 5, 5), (4, 12, 3), (7, 20, 20)])
def test_lanes_equal_direct(lanes, dim, rank):
    rng = np.random.default_rng(dim)
    rows = rng.integers(-9, 9, size=(211, rank)).astype(float) @ rng.integers(-2, 3, size=(rank, dim))
    spectra = Spectra.empty(lanes, dim)
    for a in range(0, len(rows), lanes):
        part = rows[a : a + lanes]
        spectra.fold(np.pad(part, ((0, lanes - len(part)), (0, 0))), np.arange(lanes) < len(part))
    one = spectra.joined()
    wanted = scatter(rows)
    size = np.abs(wanted).max()
    assert one.n[0] == len(rows) and np.allclose(one.mean[0], rows.mean(axis=0), atol=1e-9)
    assert np.abs(one.basis[0] @ np.diag(one.roots[0]) @ one.basis[0].T - wanted).max() < 1e-8 * size
    assert np.abs(one.basis[0].T @ one.basis[0] - np.eye(dim)).max() < 1e-10
    assert np.abs(np.sort(one.roots[0]) - np.linalg.eigvalsh(wanted)).max() < 1e-8 * size


def test_secular_roots_lie_between_poles_and_solve():
    rng = np.random.default_rng(3)
    d = np.sort(rng.random((3, 8)) * 10, axis=1)
    z2 = rng.random((3, 8)) ** 4 + 1e-9
    poles, root, origin = secular_roots(d, z2, np.full(3, 8))
    found = origin + root
    for lane in range(3):
        wanted = np.linalg.eigvalsh(np.diag(d[lane]) + np.outer(np.sqrt(z2[lane]), np.sqrt(z2[lane])))
        assert np.allclose(found[lane], wanted, rtol=1e-10)
        assert (found[lane] > d[lane]).all() and (found[lane][:-1] < d[lane][1:]).all()


def test_deflation_leaves_untouched_pairs():
    d = np.array([[1.0, 1.0, 2.0, 5.0]])
    basis = np.eye(4)[None]
    x = np.array([[3.0, 4.0, 0.0, 0.0]])
    roots, vectors = rank_one(d, basis, x, np.ones(1))
    assert np.allclose(np.sort(roots[0]), [1, 2, 5, 26])
    assert np.allclose(vectors[0] @ np.diag(roots[0]) @ vectors[0].T, np.diag(d[0]) + np.outer(x[0], x[0]))
    assert rank_one(d, basis, np.zeros((1, 4)), np.ones(1))[0] is d


def brute(vectors):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    values, axes = np.linalg.eigh(scatter(fit) / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    sums = [int(s) for s in fit.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - mean) @ axes / np.sqrt(values), values / np.trace(scatter(fit) / n)


def test_operator_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TASK_ROWS", 40)  # several tasks and two levels of the tree
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 18)) * np.linspace(0.2, 1.5, 18)).astype(np.float32)
    vectors[100:220] = vectors[0]  # a vector that holds a third of all rows counts once
    rows = [(i, v.tolist(), 1, "clash") for i, v in enumerate(vectors)]
    odd = [(900, None, 1, ""), (901, [], 1, ""), (902, [float("nan")] * 18, 1, ""), (903, [None] + [0.0] * 17, 1, ""),
           (904, [float("inf")] * 18, 1, ""), (905, [1.0, 2.0], 1, "")]
    extra = [(None, vectors[1].tolist(), 1, ""), (7, vectors[7].tolist(), 1, "")]
    out = whiten(spark.createDataFrame(rows + odd + extra, SCHEMA).repartition(5)).toPandas()
    assert len(out) == (400 + 2) * 16 and set(out.vec_id.dropna()) == set(range(400)) and out.vec_id.isna().sum() == 16
    n, deviation, white, explained = brute(vectors)
    assert (out.n == n).all() and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    table = out[out.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert table.deviation.to_numpy().reshape(-1, 16)[:, 0].tolist() == deviation
    assert np.allclose(table.explained.to_numpy().reshape(-1, 16), explained, rtol=1e-10)
    own = table.whitened.to_numpy().reshape(-1, 16)
    signs = np.sign((own * white).sum(axis=0))
    assert np.allclose(own * signs, white, atol=1e-8)


def test_no_variance_and_empty(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], SCHEMA)).count() == 0
    flat = whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i], 0, "") for i in range(5)], SCHEMA)).toPandas()
    assert set(flat.component) == {1} and len(flat) == 5 and abs(flat.explained[0] - 1) < 1e-12


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0], 0, ""), (2, [-1e30, 1.0], 0, ""), (3, [5.0, 2.0], 0, "")]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert out.vec_id.nunique() == 3
    # 3 * 320 - 320 and 3 * 128 - 192, squared; the other rows' sums pass a long.
    assert out.set_index("vec_id").deviation.groupby(level=0).first().to_dict() | {1: None, 2: None} == {1: None, 2: None, 3: 446464}
