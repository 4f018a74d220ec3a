"""K-means against plain numpy: restarts, inertia, nearest centres."""

import numpy as np
import pytest

from predio.operators import clusters, kmeans
from predio.operators.kmeans import fit_kmeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    middles = rng.uniform(-1, 1, (12, 2)) + [20, -103]
    x = np.concatenate([m + rng.normal(0, 0.02, (80, 2)) for m in middles])
    x = np.concatenate([x, np.repeat(x[:1], 400, axis=0)])  # a hot place
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    rows += [(9001, None, 1.0), (9002, float("nan"), 2.0)]
    return x, middles, spark.createDataFrame(rows, "sku long, lat double, lng double").repartition(5)


def inertia(x, centres):
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)


def test_blobs_are_found(blobs):
    x, middles, df = blobs
    rows, model = clusters.kmeans_fit(df, k=12)
    assert len(model.restarts) == 10 and model.inertia == min(model.restarts)
    assert model.inertia == pytest.approx(inertia(x, model.centres).sum(), rel=1e-9)
    assert np.sqrt(inertia(middles, model.centres)).max() < 0.02  # the best restart has every blob
    got = {r.sku: r.cluster for r in rows.collect()}
    assert got[9001] is None and got[9002] is None
    far = ((x[:, None] - model.centres[None]) ** 2).sum(axis=2)
    assert all(far[i, got[i]] == pytest.approx(far[i].min(), abs=1e-15) for i in range(len(x)))
    # Centres are the means of their points: a fixed point of Lloyd's step.
    for c in range(12):
        mine = np.array([got[i] == c for i in range(len(x))])
        np.testing.assert_allclose(x[mine].mean(axis=0), model.centres[c], atol=1e-3)


def test_restarts_do_not_depend_on_partitions(blobs):
    _, _, df = blobs
    one, two = (clusters.kmeans_fit(d, k=5, restarts=3)[1] for d in (df, df.repartition(2)))
    np.testing.assert_allclose(one.centres, two.centres, rtol=1e-9)
    assert clusters.kmeans_fit(df, k=5, restarts=1)[1].inertia >= one.inertia * (1 - 1e-9)


def test_few_points_and_none(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 2.0)], "sku long, lat double, lng double")
    rows, model = clusters.kmeans_fit(df, k=10, restarts=2)
    assert len(model.centres) == 2 and model.inertia == 0 and {r.cluster for r in rows.collect()} == {0, 1}
    rows, model = clusters.kmeans_fit(df.filter("false"))
    assert model is None and rows.count() == 0
    rows, _ = clusters.kmeans_fit(df, k=2, scale=True)
    assert {r.sku: r.cluster for r in rows.collect()} == {1: 0, 2: 0, 3: 1}


def test_three_dimensions(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.1, (50, 3)) for m in (0, 5, 10)])
    points = spark.createDataFrame([(*map(float, p), 1.0) for p in x], "a double, b double, c double, w double")
    model = fit_kmeans(points, ["a", "b", "c"], 3, 4)
    np.testing.assert_allclose(model.centres, [[0] * 3, [5] * 3, [10] * 3], atol=0.1)


def test_passes_use_all_cores_and_near_centres_only(spark, monkeypatch):
    """A small file of many places is not left to one task, and blocks leave far centres out."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (20_000, 2))
    points = spark.createDataFrame([(*map(float, p), 1.0) for p in x], "a double, b double, w double").coalesce(1)
    tasks, compared, passed, far = [], [], kmeans._pass, kmeans._far
    monkeypatch.setattr(kmeans, "_pass", lambda p, *rest: tasks.append(p.rdd.getNumPartitions()) or passed(p, *rest))
    model = fit_kmeans(points, ["a", "b"], 20, 2, passes=3)
    assert min(tasks) >= 2
    assert model.inertia == pytest.approx(inertia(x, model.centres).sum(), rel=1e-9)
    order = kmeans._near_first(x)
    assert sorted(order) == list(range(len(x)))
    blocks = [x[order[at : at + kmeans._BLOCK]] for at in range(0, len(x), kmeans._BLOCK)]
    for block in [*blocks, x, x[:1], np.repeat(x[:1], 5, axis=0)]:
        reached = kmeans._reachable(block, model.centres)
        compared.append(len(reached))
        assert (reached[far(block, model.centres[reached]).argmin(axis=1)] == far(block, model.centres).argmin(axis=1)).all()
    assert np.mean(compared[: len(blocks)]) < len(model.centres) / 2


def test_equally_near_centres_keep_the_first(spark):
    model = kmeans.KMeansModel(np.array([[-1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]), 0.0, [0.0], 1)
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (2.0, 0.0), (None, 1.0)], "a double, b double")
    named = df.select("a", model.nearest(["a", "b"]).alias("c"))
    assert [r.c for r in named.collect()][:3] == [0, 1, 2]
    # One pass over arrays of numbers, not a function of a function for each row and centre.
    assert "lambdafunction" not in named._jdf.queryExecution().optimizedPlan().toString()
