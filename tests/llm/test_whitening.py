"""Whitening against a plain version with the library's eigenvalues, and the decomposition on hard matrices."""

import math

import numpy as np
import pytest
from oracle import SF

from skytrace.llm.queries import op12_embedding_whitening
from skytrace.llm.whitening import _scaled, deviations, eigen_components, whiten_embeddings


def plain(rows):
    """vec_id: (deviation, whitened up to signs) and the shared figures, in Python's integers and one eigenvalue call."""
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda x: [n * a - s for a, s in zip(x, sums, strict=True)]
    c = np.array([centre(x) for x in fit], float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    return n, values / (c * c).sum() * n, {i: (sum(d * d for d in centre(x)), np.array(centre(x), float) / n @ vectors / np.sqrt(values)) for i, x in kept}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_vectors(spark, sf):
    folder = SF.replace("0.001", sf)
    n, shares, expected = plain([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    got = op12_embedding_whitening(spark, folder).collect()
    assert len(got) == 16 * len(expected) and len({(r["vec_id"], r["component"]) for r in got}) == len(got)
    sign = {}
    for r in got:
        deviation, whitened = expected[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and r["explained"] == pytest.approx(shares[k], rel=1e-9) and r["identity_error"] < 1e-8
        if abs(whitened[k]) > 1e-3:
            s = sign.setdefault(k, math.copysign(1, r["whitened"] * whitened[k]))
            assert r["whitened"] == pytest.approx(s * whitened[k], rel=1e-6, abs=1e-6)


def matrices():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    yield "random", (lambda a: a @ a.T)(rng.normal(size=(64, 80)))
    yield "one dimension", np.array([[3.0]])
    yield "identity", np.eye(12)
    yield "zero", np.zeros((5, 5))
    yield "diagonal", np.diag(np.arange(9.0))
    yield "equal diagonal", np.ones((8, 8))
    yield "steep", q @ np.diag(10.0 ** -np.arange(30)) @ q.T
    yield "repeated", q @ np.diag([4.0] * 10 + [2.0] * 15 + [0.0] * 5) @ q.T
    yield "close", q @ np.diag(1 + 1e-10 * np.arange(30)) @ q.T
    yield "eigenvalue at the shift", np.diag([1.0, 2.0, 3.0, 2.0, 2.0])
    yield "blocks", np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))


@pytest.mark.parametrize(("name", "a"), list(matrices()), ids=[n for n, _ in matrices()])
def test_components(name, a):
    a = (a + a.T) / 2
    values, vectors = eigen_components(a)
    size = np.linalg.norm(a) or 1
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 2e-13 * size


def test_odd(spark):
    schema = "vec_id long, embedding array<float>, n long, label int"
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=4)], 5, None) for i in range(30)]
    odd = [(50, None, 1, 1), (51, [1.0, None, 2.0, 3.0], 1, 1), (52, [1.0, math.nan, 2.0, 3.0], 1, 1), (53, [1.0, math.inf, 2.0, 3.0], 1, 1), (None, good[3][1], 1, 1), *[good[0]] * 40]
    out = whiten_embeddings(spark.createDataFrame(good + odd, schema))
    assert out.columns == ["vec_id", "label", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 4 * 71 and {r["n"] for r in rows} == {30}
    of = lambda i: sorted((r["component"], r["deviation"], r["whitened"]) for r in rows if r["vec_id"] == i)
    assert of(None) == of(3) and len(of(0)) == 4 * 41
    for few in ([], [good[0]], [good[0]] * 3, odd[:4], [(1, [], 1, 1)]):
        assert whiten_embeddings(spark.createDataFrame(few, schema)).collect() == []
    two = whiten_embeddings(spark.createDataFrame(good[:2], schema)).collect()
    assert len(two) == 2 and abs(abs(two[0]["whitened"]) - 1) < 1e-9  # one component
    with pytest.raises(ValueError, match="one length"):
        whiten_embeddings(spark.createDataFrame([*good, (1, [1.0], 1, 1)], schema))


def test_large_entries(spark):
    rows = [(i, [float(2**24 * (i + j % 3)) for j in range(4)]) for i in range(8)]
    got = {r["vec_id"]: r["deviation"] for r in whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1, offset=0).collect()}
    x = {i: [int(c) for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    assert got == {i: sum((8 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in x.items()}


def test_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    centred = _scaled(x, 1 << 30, np.array([1 << 69, 5], object))
    assert centred.tolist() == [[(1 << 70) - (1 << 69), -(1 << 70) - 5], [(3 << 30) - (1 << 69), (4 << 30) - 5]]
    assert deviations(centred) == [sum(c * c for c in row) for row in centred.tolist()]
