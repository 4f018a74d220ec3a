import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predio.operators import clusters
from predio.operators.components import connected_components

EARTH_KM = 6371.0088


def dbscan_by_hand(pdf, eps_km, min_samples):
    x, y = np.radians(pdf.lat.to_numpy()), np.radians(pdf.lng.to_numpy())
    h = np.sin((x[:, None] - x) / 2) ** 2 + np.cos(x[:, None]) * np.cos(x) * np.sin((y[:, None] - y) / 2) ** 2
    near = h <= np.sin(eps_km / EARTH_KM / 2) ** 2
    core = near.sum(1) >= min_samples
    label, count = np.full(len(pdf), -1), 0
    for start in range(len(pdf)):
        if label[start] == -1 and core[start]:
            label[start], todo = count, [start]
            while todo:
                point = todo.pop()
                if core[point]:
                    for q in np.flatnonzero(near[point] & (label == -1)):
                        label[q] = count
                        todo.append(q)
            count += 1
    return label


def check(spark, lat, lng, eps_km=1.5, min_samples=5, **options):
    pdf = pd.DataFrame({"sku": [f"{i:05d}" for i in range(len(lat))], "lat": lat, "lng": lng})
    got = clusters.dbscan_clusters(spark.createDataFrame(pdf), eps_km, min_samples, **options)
    got = got.toPandas().sort_values("sku").cluster.to_numpy()
    want = dbscan_by_hand(pdf, eps_km, min_samples)
    np.testing.assert_array_equal(got, want)
    return want


def test_dbscan_of_scattered_points(spark):
    rng = np.random.default_rng(1)
    n = 700
    want = check(spark, 20 + rng.random(n) * 0.35, -103 + rng.random(n) * 0.35)
    assert want.max() > 3 and (want == -1).sum() > 5


def test_dbscan_of_dense_blobs_with_salting(spark):
    rng = np.random.default_rng(2)
    lat = np.concatenate([20 + rng.normal(0, 0.004, 500), 20 + rng.normal(0, 0.004, 500), 20 + rng.normal(0, 0.05, 60)])
    lng = np.concatenate([-103 + rng.normal(0, 0.004, 500), -102.968 + rng.normal(0, 0.004, 500), -103 + rng.normal(0, 0.05, 60)])
    check(spark, lat, lng, eps_km=0.5, salt_points=10)


def test_dbscan_border_points_noise_duplicates_and_the_date_line(spark):
    km = 1 / 111.195
    left, right = [(0.0, -180 + i * 0.2 * km) for i in range(5)], [(0.0, -180 + (3.2 + i * 0.2) * km) for i in range(5)]
    border = [(0.0, -180 + 2.0 * km)]  # within 1.2 km of one point of either blob, no core
    across = [(0.0, 180 - 0.5 * km)]  # a neighbour over the date line
    lone, twins = [(10.0, 10.0)], [(40.0, 40.0)] * 5
    want = check(spark, *zip(*(right + left + border + across + lone + twins)), eps_km=1.21)
    assert want[10] == 0 and want[11] == 1 and want[12] == -1 and (want[13:] == 2).all()


def test_dbscan_near_a_pole(spark):
    rng = np.random.default_rng(4)
    check(spark, 89.9 + rng.random(150) * 0.1, rng.random(150) * 360 - 180)


def test_dbscan_without_locations(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, 3.0)], "sku string, lat double, lng double")
    got = {r.sku: r.cluster for r in clusters.dbscan_clusters(df).collect()}
    assert got == {"a": None, "b": -1}


def test_connected_components(spark):
    rng = np.random.default_rng(6)
    chain = [(i, i + 1) for i in range(0, 60)]
    ring = [(100 + i, 100 + (i + 1) % 20) for i in range(20)]
    star = [(200, 200 + i) for i in range(1, 30)]
    edges = chain + ring + star + [(5, 5)]
    rng.shuffle(edges)
    nodes = spark.range(300).withColumnRenamed("id", "node")
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a bigint, b bigint")
    groups = connected_components(nodes, df).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("n"))
    found = sorted(list(r.n) for r in groups.collect())
    alone = [i for i in range(300) if not (i <= 60 or 100 <= i < 120 or 200 <= i < 230)]
    want = [list(range(61)), list(range(100, 120)), list(range(200, 230))] + [[i] for i in alone]
    assert found == sorted(want)


@pytest.mark.parametrize("scale", [False, True])
def test_kmeans(spark, scale):
    rng = np.random.default_rng(7)
    at = rng.integers(0, 3, 300)
    pdf = pd.DataFrame({"sku": range(300), "lat": 20 + at + rng.normal(0, 0.01, 300), "lng": -100 + 2 * at})
    df = spark.createDataFrame(pdf).unionByName(
        spark.createDataFrame([(900, None, -100.0)], "sku bigint, lat double, lng double")
    )
    out = clusters.kmeans_clusters(df, k=3, scale=scale).toPandas().set_index("sku").cluster
    assert np.isnan(out[900])
    labels = out.drop(900).to_numpy()
    assert len(set(zip(at, labels))) == 3 and set(labels) == {0.0, 1.0, 2.0}
