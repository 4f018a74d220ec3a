"""The forest search: one growth for a whole grid, chunks against one task, packed trees, importances."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predio.operators import segment_forest as sf, tree_growth
from predio.operators.tree_growth import Growth

FEATURES = ["a", "b", "c"]
SMALL = sf.Grid((1, 3), (1, 3, 4), ("all", "log2"), (1, 3), (2, 20))


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(8)
    n = 420
    pdf = pd.DataFrame(
        {
            "sku": [f"k{i}" for i in range(n)], "colonia": rng.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1]),
            "a": rng.integers(0, 12, n).astype(float), "b": rng.integers(0, 5, n).astype(float), "c": rng.normal(0, 1, n).round(1),
        }
    )
    pdf["price"] = 1000 + 100 * pdf.a * (pdf.b > 1) + 30 * pdf.c + rng.normal(0, 20, n).round(3)
    return spark.createDataFrame(pdf)


def search(df, grid=SMALL, **options):
    return sf.qualify_segments_forest(
        df, FEATURES, more_than=20, folds=2, trees=grid.trees, depths=grid.depths, leaf_rows=grid.leaf_rows,
        features_at=grid.features, min_splits=grid.min_splits, bins=16, **options,
    )


def test_hash_is_sparks(spark):
    rows = spark.range(50).select(
        F.col("id").cast("string").alias("_key"), F.xxhash64(F.col("id").cast("string")).alias("k"),
    ).select("k", *[sf._weight(F.lit(r), F.lit(t)).alias(f"w{r}_{t}") for r in (0, 3) for t in (0, 17)]).toPandas()
    for r in (0, 3):
        for t in (0, 17):
            assert tree_growth.weights(rows.k.to_numpy(), r, t).tolist() == rows[f"w{r}_{t}"].tolist()


def test_one_growth_reads_off_every_stop():
    """Cut depth, tree count and minimum split read off one growth equal growths of their own."""
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 8, (150, 3)), rng.normal(0, 1, 150)
    y += bins[:, 0] * 0.5
    keys, held = rng.integers(-(2**62), 2**62, 150), rng.integers(0, 8, (60, 3))
    for subset in (1, 3):
        for leaf in (1, 3):
            whole = Growth(6, leaf, subset, 2, 8)
            _, values = tree_growth.grow_slice(bins, y, keys, range(5), whole, 77, 1, held, (2, 4, 6), (2, 9, 40))
            for i, depth in enumerate((2, 4, 6)):
                for j, least in enumerate((2, 9, 40)):
                    own = Growth(depth, leaf, subset, least, 8)
                    _, alone = tree_growth.grow_slice(bins, y, keys, range(5), own, 77, 1, held, (depth,), (2,))
                    np.testing.assert_array_equal(values[i, j], alone[0, 0])


def test_full_grid_needs_six_growths():
    assert len(sf.FULL_GRID) == 480 and len(sf.FULL_GRID.growths(5, 32)) == 6
    assert len(sf.FULL_SEGMENT_GRID) == 360
    assert [sf.features_per_node(r, 5) for r in ("all", "log2", 3)] == [5, 2, 3]
    for bad in (0, 6, "sqrt"):
        with pytest.raises(ValueError):
            sf.features_per_node(bad, 5)


def test_grid_equals_single_searches(prices):
    """Searching many values finds what searching the chosen combination alone gives."""
    quality, forest = search(prices)
    rows = quality.collect()
    assert len(rows) == 3
    scored = forest.transform(prices).select("sku", "colonia", "prediction").toPandas().set_index("sku")
    for r in rows:
        one = sf.Grid((r.trees,), (r.depth,), (r.features,), (r.leaf_rows,), (r.min_split,))
        # The segment sizes decide which rows are test rows, so each segment is searched alone.
        alone, fitted = search(prices.filter(F.col("colonia") == r.colonia), one)
        got = alone.first()
        assert (got.score, got.error, got.cv_score) == (pytest.approx(r.score), pytest.approx(r.error), pytest.approx(r.cv_score))
        other = fitted.transform(prices.filter(F.col("colonia") == r.colonia)).select("sku", "prediction").toPandas().set_index("sku")
        np.testing.assert_allclose(scored.loc[other.index].prediction, other.prediction)


def test_chunks_equal_one_task(prices):
    """Segments in many chunks, with splits decided from summed histograms, grow the same forests."""
    quality, forest = search(prices)
    chunked, other = search(prices, local_rows=40)
    want, got = (q.toPandas().set_index("colonia").sort_index() for q in (quality, chunked))
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)
    a, b = (f.transform(prices).select("sku", "prediction").toPandas().set_index("sku").sort_index() for f in (forest, other))
    np.testing.assert_allclose(a.prediction, b.prediction, rtol=1e-9)
    x, z = (f.importances().toPandas().set_index(["colonia", "feature"]).sort_index() for f in (forest, other))
    np.testing.assert_allclose(x.importance, z.importance, rtol=1e-7, atol=1e-12)


def test_scoring_and_importances(prices, spark):
    quality, forest = search(prices, sf.Grid((2,), (3,)))
    plan = forest.transform(prices)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2 and "Generate" not in plan and "Python" not in plan
    shares = forest.importances().groupBy("colonia").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1) and r.n == 3 for r in shares)
    top = forest.importances().toPandas().sort_values("importance").groupby("colonia").feature.last()
    assert top["A"] == "a"
    odd = spark.createDataFrame([("x", "A", 1.0, None, 1.0), ("y", "nowhere", 1.0, 1.0, 1.0), ("z", None, 1.0, 1.0, 1.0)], "sku string, colonia string, a double, b double, c double")
    assert [r.prediction for r in forest.transform(odd).collect()] == [None] * 3


def test_importances_by_hand(spark):
    """A tree that splits on a then b: the gains' shares."""
    rows = [(f"k{i}", "A", float(i % 2), float(i // 2 % 2), 0.0) for i in range(400)]
    rows = [(k, s, a, b, c, 100 * a + 10 * b) for k, s, a, b, c in rows]
    df = spark.createDataFrame(rows, "sku string, colonia string, a double, b double, c double, price double")
    _, forest = search(df, sf.Grid((1,), (2,)))
    got = {r.feature: r.importance for r in forest.importances().collect()}
    assert got["c"] == 0 and got["a"] == pytest.approx(10000 / 10100, abs=0.01) and sum(got.values()) == pytest.approx(1)


def test_table_wide_search(prices):
    grid = sf.Grid((2, 4), (2, 5), ("all", "log2"), (1, 2), (2, 4))
    quality, forest = sf.search_forest_grid(prices, FEATURES, grid=grid)
    row = quality.first()
    assert quality.count() == 1 and row.trees in (2, 4) and row.depth in (2, 5) and row.score > 0.5
    scored = forest.transform(prices.withColumn("_all", F.lit("all")))
    assert scored.filter("prediction IS NULL").count() == 0


def test_parts_of_chunks_equal_one_task(prices, monkeypatch):
    """Chunks that give the rows of their trees in several parts grow the same forests."""
    quality, forest = search(prices)
    monkeypatch.setattr(sf, "EMITTED", 400_000)
    chunked, other = search(prices, local_rows=60)
    want, got = (q.toPandas().set_index("colonia").sort_index() for q in (quality, chunked))
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)
    a, b = (f.transform(prices).select("sku", "prediction").toPandas().set_index("sku").sort_index() for f in (forest, other))
    np.testing.assert_allclose(a.prediction, b.prediction, rtol=1e-9)


def test_splits_compared_in_blocks_take_little_memory():
    """Many nodes at once: temporary tables of a block of nodes, and the splits of one node alone."""
    import tracemalloc

    rng = np.random.default_rng(5)
    nodes, bins = 1 << 16, 32
    growth = Growth(20, 1, 1, 2, bins)
    hn, hs = rng.integers(0, 3, (nodes, bins)).astype(float), rng.normal(0, 1, (nodes, bins))
    best = tree_growth.BestSplit(hn.sum(axis=1), hs.sum(axis=1), growth)
    tracemalloc.start()
    best.offer(0, hn, hs, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < hn.nbytes
    for i in (0, 4095, 4096, nodes - 1):
        one = tree_growth.BestSplit(hn[i : i + 1].sum(axis=1), hs[i : i + 1].sum(axis=1), growth)
        one.offer(0, hn[i : i + 1], hs[i : i + 1], None)
        assert (one.feature[0], one.cut[0]) == (best.feature[i], best.cut[i])


def test_packing_gets_no_edges(prices):
    """A node comes to its packing task with one threshold, not with all edges of its segment."""
    _, forest = search(prices, sf.Grid((2,), (3,)))
    nodes = prices.sparkSession.createDataFrame(
        [("A", 0, 1, 2.0, 5.0, 0, 1, 3.0), ("A", 0, 3, 1.0, 6.0, -1, 0, 0.0), ("A", 0, 2, 1.0, 4.0, -1, 0, 0.0)],
        "_segment string, tree int, node long, n double, mean double, feature int, cut int, gain double",
    )
    edges = prices.sparkSession.createDataFrame([("A", [[0.5, 1.5], [2.5]])], "_segment string, _edges array<array<double>>")
    packed = sf._pack(nodes, edges, "colonia", 2)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(x for x in plan.split("\n") if "FlatMapGroupsInArrow" in x)
    assert "_edges" not in grouped and "threshold" in grouped
    row = packed.first()
    assert (row.roots, row.feature, row.threshold, row.left) == ([0], [0, -1, -1], [1.5, 0.0, 0.0], [1, -1, -1])
    assert (row.value, row.steps, row.importances) == ([5.0, 4.0, 6.0], [0], [1.0, 0.0])


def test_cell_hash_is_sparks(spark):
    bins = np.array([[0, 3, 5], [1, 1, 126], [31, 0, 2]], np.int8)
    df = spark.createDataFrame([(x.tolist(),) for x in bins], "b array<tinyint>")
    assert sorted(r[0] for r in df.select(F.xxhash64("b")).collect()) == sorted(tree_growth.cell_hash(bins).tolist())
    cells, place = tree_growth.cells(bins[[2, 0, 2, 1]])
    np.testing.assert_array_equal(cells, bins)
    assert place.tolist() == [2, 0, 2, 1]


@pytest.fixture(scope="module")
def rooms(spark):
    """Many rows in few cells; one cell has a third of them and a third of the keys is missing."""
    rng = np.random.default_rng(9)
    n = 1500
    pdf = pd.DataFrame({"sku": [f"k{i}" if i % 3 else None for i in range(n)], "colonia": rng.choice(["A", "B"], n, p=[0.7, 0.3])})
    for i, c in enumerate(FEATURES):
        pdf[c] = np.where(np.arange(n) % 3 == 1, 1, rng.integers(0, 5 - i, n)).astype(float)
    pdf["price"] = np.where(rng.random(n) < 0.01, 0, 1000 + 100 * pdf.a * (pdf.b > 1) + 30 * pdf.c + rng.normal(0, 20, n).round(3))
    return spark.createDataFrame(pdf)


def test_few_cells_equal_one_task(rooms, monkeypatch):
    """Trees grown from the sums of cells, in pieces and blocks, are those of rows in one task; no chunk is made."""
    quality, forest = search(rooms, exact=False)
    for name in ("_score_large", "_top_nodes", "_entries"):
        monkeypatch.setattr(sf, name, None)
    monkeypatch.setattr(sf, "PIECE", 70)
    monkeypatch.setattr(sf, "BLOCK", 16)
    monkeypatch.setattr(sf, "SUMS", 150)
    added, other = search(rooms, local_rows=100, exact=False)
    want, got = (q.toPandas().set_index("colonia").sort_index() for q in (quality, added))
    assert len(want) == 2
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)
    places = rooms.select(F.monotonically_increasing_id().alias("i"), *rooms.columns)
    a, b = (f.transform(places).select("i", "prediction").toPandas().set_index("i").sort_index() for f in (forest, other))
    np.testing.assert_allclose(a.prediction, b.prediction, rtol=1e-9)
    x, z = (f.importances().toPandas().set_index(["colonia", "feature"]).sort_index() for f in (forest, other))
    np.testing.assert_allclose(x.importance, z.importance, rtol=1e-7, atol=1e-12)
