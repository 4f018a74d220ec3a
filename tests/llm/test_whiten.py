"""Whitening against numpy's eigenvalues and exact integers."""

import math

import numpy as np
import pytest

from predio.llm import catalogue, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, X string"


def spectrum(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [3.0, 1.0], [9, 8, 7, 6, 5, 4, 3, 2, 1.0], [1, 1, 1, 1, 1, 1.0], [4, 4, 3, 3, 3, 1e-3, 0, 0, 0.0],
        [1e6, 1e3, 1, 1e-3, 0, 0], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.1], list(np.linspace(0.9, 1.1, 64)), [2, 0, 0, 0, 0],
    ],
)
def test_contour_pairs_equal_eigh(values):
    rng = np.random.default_rng(len(values))
    matrix = spectrum(rng, np.array(values, float))
    matrix = (matrix + matrix.T) / 2
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    got, vectors = whiten.leading_pairs(matrix, min(4, len(values)))
    want = want[want > want[0] * 1e-12]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-9)
    assert np.abs(matrix @ vectors - vectors * got).max() <= 1e-12 * want[0]


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 40):
        m = rng.standard_normal((n, n))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*(values[:-1] + np.diff(values) / 2), values[0] - 1, values[-1] + 1]:
            assert whiten.Inertia(m).below(shift) == (values < shift).sum()


def plain(rows, k=4):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in usable}
    distinct = sorted({tuple(v) for v in x.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array(distinct, float) - np.array([s / n for s in sums])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, a in x.items():
        centred = np.array([c - s / n for c, s in zip(a, sums)])
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(a, sums)), centred @ vectors / np.sqrt(values))
    return out, values / np.trace(v)


def test_query_equals_plain(spark, tmp_path):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((12, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, (rng.standard_normal(12) @ mix).tolist()) for i in range(700)]
    # One vector is held by a third of the rows; others are unusable or of another length.
    rows += [(1000 + i, rows[0][1]) for i in range(350)]
    rows += [(2000, None), (2001, [None] + [0.0] * 11), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] * 12), (2004, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.op12_whitening(spark, str(tmp_path)).collect()
    want, explained = plain([r for r in rows if r[0] != 2004])
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i in want for c in (1, 2, 3, 4))
    by_id = {}
    for r in got:
        n, deviation, w = want[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
        assert abs(abs(r["whitened"]) - abs(w[r["component"] - 1])) < 1e-7
        by_id.setdefault(r["component"], []).append(r["whitened"] * w[r["component"] - 1])
    for products in by_id.values():  # one sign for all rows
        assert all(p > -1e-6 for p in products) or all(p < 1e-6 for p in products)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows, fitted = whiten.whiten(empty)
    assert rows.count() == 0 and fitted.n == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 3, "clash", "x"), (None, [1.0, 2.0], None, None, None)], SCHEMA)
    rows, fitted = whiten.whiten(same)
    assert rows.columns == ["vec_id", "label", "whitened", "deviation"] and fitted.n == 1
    assert [(r["whitened"], r["deviation"]) for r in rows.collect()] == [([], 0), ([], 0)]
    # Large integers stay exact.
    wide = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5.0, 7.0])], "vec_id long, embedding array<double>")
    rows, fitted = whiten.whiten(wide)
    x = {1: (256 * 10**12, 0), 2: (-256 * 10**12, 256), 3: (1280, 1792)}
    sums = [sum(v[j] for v in x.values()) for j in range(2)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows.collect()} == {
        i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()
    }
    assert fitted.identity_error < 1e-9
