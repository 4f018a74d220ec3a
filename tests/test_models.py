import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predio.operators import categories, features, forest, linear, scores, segment_forest, segments, splits
from predio.operators.moments import Moments, moment_columns

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def houses(spark):
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame(
        {
            "sku": [f"k{i}" for i in range(n)],
            "colonia": rng.choice(["A", "B", "C", "tiny"], n, p=[0.6, 0.2, 0.17, 0.03]),
            "a": rng.normal(200, 50, n),
            "b": rng.integers(1, 6, n).astype(float),
            "c": rng.normal(0, 1, n),
        }
    )
    slope = pdf.colonia.map({"A": 10.0, "B": 30.0, "C": -5.0, "tiny": 0.0})
    pdf["price"] = 5000 + slope * pdf.a + 200 * pdf.b + rng.normal(0, 100, n)
    return pdf, spark.createDataFrame(pdf)


def ridge_by_hand(pdf, alpha):
    x, y = pdf[FEATURES].to_numpy(), pdf.price.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    return coef, y.mean() - coef @ x.mean(0)


def r2_by_hand(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("alpha", [0.0, 1.0, 99.0])
def test_linear_and_ridge_closed_form(houses, alpha):
    pdf, df = houses
    model = linear.fit_linear(df, FEATURES, alpha=alpha)
    coef, intercept = ridge_by_hand(pdf, alpha)
    np.testing.assert_allclose(model.coefficients, coef, rtol=1e-8)
    assert model.intercept == pytest.approx(intercept)
    scored = model.transform(df).toPandas()
    np.testing.assert_allclose(scored.prediction, pdf[FEATURES].to_numpy() @ coef + intercept, rtol=1e-8)


def test_moments_merge_and_r2(houses):
    pdf, df = houses
    rows = df.groupBy("colonia").agg(*moment_columns(FEATURES, "price")).collect()
    merged = Moments.of_row(rows[0])
    for r in rows[1:]:
        merged = merged.merge(Moments.of_row(r))
    np.testing.assert_allclose(merged.cov, np.cov(pdf[[*FEATURES, "price"]].T, bias=True), rtol=1e-8, atol=1e-6)
    coef, intercept = ridge_by_hand(pdf, 3.0)
    predicted = pdf[FEATURES].to_numpy() @ coef + intercept
    assert merged.r2(coef, intercept) == pytest.approx(r2_by_hand(pdf.price, predicted))


def test_ridge_search_and_reports(houses):
    pdf, df = houses
    folds = splits.hash_folds(df, 5).toPandas()
    found = linear.search_ridge(df, FEATURES, alphas=[0, 50, 5000])
    for alpha, score in found.scores.items():
        want = []
        for k in range(5):
            train, held = folds[folds.fold != k], folds[folds.fold == k]
            coef, intercept = ridge_by_hand(train, alpha)
            want.append(r2_by_hand(held.price, held[FEATURES].to_numpy() @ coef + intercept))
        assert score == pytest.approx(np.mean(want))
    assert found.model.alpha == max(found.scores, key=found.scores.get)

    split = splits.hash_split(df, 0.3)
    train, test = split.filter("not is_test"), split.filter("is_test")
    _, report = linear.linear_report(train, test, FEATURES)
    row = report.first()
    assert row.mean_score == pytest.approx((row.cv_score + row.train_score + row.test_score) / 3)
    ptrain, ptest = train.toPandas(), test.toPandas()
    coef, intercept = ridge_by_hand(ptrain, 0.0)
    residual = ptest.price - (ptest[FEATURES].to_numpy() @ coef + intercept)
    assert row.test_score == pytest.approx(r2_by_hand(ptest.price, ptest.price - residual))
    base = linear.baseline_report(train, test, FEATURES).first()
    assert base.test_rmse == pytest.approx(np.sqrt((residual**2).mean()))
    assert base.error_mean == pytest.approx(residual.mean())
    assert base.error_std == pytest.approx(residual.std(ddof=0))


def test_label_among_features_is_refused(houses):
    for fit in (linear.fit_linear, linear.fit_by_segment, forest.search_forest, segments.qualify_segments):
        with pytest.raises(ValueError):
            fit(houses[1], ["a", "price"])
    with pytest.raises(KeyError):
        linear.fit_linear(houses[1], ["a", "nothing"])
    with pytest.raises(KeyError):
        linear.fit_linear(houses[1], ["a", "b"]).transform(houses[1].drop("b"))


def test_models_per_segment(houses):
    pdf, df = houses
    models = linear.fit_by_segment(df, FEATURES, alpha=2.0).toPandas().set_index("colonia")
    for colonia, group in pdf.groupby("colonia"):
        coef, intercept = ridge_by_hand(group, 2.0)
        np.testing.assert_allclose(models.loc[colonia, "coefficients"], coef, rtol=1e-6)
        assert models.loc[colonia, "intercept"] == pytest.approx(intercept)


def test_segment_quality(houses):
    pdf, df = houses
    quality = segments.qualify_segments(df, FEATURES).toPandas().set_index("colonia")
    assert set(quality.index) == {"A", "B", "C"}  # tiny has no more than 50 rows
    split = splits.exact_split(df, 0.3, segment="colonia").toPandas()
    for colonia, row in quality.iterrows():
        group = split[split.colonia == colonia]
        train, test = group[~group.is_test.astype(bool)], group[group.is_test.astype(bool)]
        coef, intercept = ridge_by_hand(train, 0.0)
        predicted = test[FEATURES].to_numpy() @ coef + intercept
        assert row.score == pytest.approx(r2_by_hand(test.price, predicted))
        assert row.error == pytest.approx((abs(predicted - test.price) / test.price * 100).mean())
        assert row.diff_score == pytest.approx(100 - row.error)
        assert row.Good == (row.score >= 0.7)
    result = segments.qualify_segments(df, FEATURES)
    assert segments.good_share(result).first().good_share == pytest.approx(quality.Good.mean())
    assert segments.good_segments(result).count() == quality.Good.sum()


def test_segment_beats_general_model_here(houses):
    _, df = houses
    both = segments.segment_vs_general(df, df.limit(200), ["a", "b"]).toPandas()
    assert both.err_single.mean() < both.err_general.mean()
    assert {"pred_single", "pred_general", "err_single", "err_general"} <= set(both.columns)


def test_error_reports(spark):
    scored = spark.createDataFrame([(100.0, 106.0), (100.0, 80.0), (0.0, 5.0)], "price double, prediction double")
    row = scores.error_summary(scored).first()  # an actual value of 0 has no percentage error
    assert (row.mean_error, row.std_error) == (pytest.approx(13.0), pytest.approx(7.0))
    assert row.share_small == pytest.approx(0.5)
    report = scores.error_report({"random forest": scored, "linear": scored}).toPandas()
    assert set(report.model) == {"Random Forest", "Linear"}
    both = scores.ensemble_mean(scored.withColumn("p2", F.lit(1.0)), ["prediction", "p2"])
    assert [r.ensemble for r in both.collect()] == [53.5, 40.5, 3.0]


def test_compare_models_picks_the_first_best(houses):
    _, df = houses
    split = splits.hash_split(df, 0.3)
    train, test = split.filter("not is_test"), split.filter("is_test")
    table, best = scores.compare_models(
        train, test,
        {
            "weak": lambda t: linear.fit_linear(t, ["c"]),
            "good": lambda t: linear.fit_linear(t, FEATURES),
            "same": lambda t: linear.fit_linear(t, FEATURES),
        },
    )
    rows = table.orderBy("position").collect()
    assert [r.model for r in rows] == ["weak", "good", "same"]
    assert [r.best for r in rows] == [False, True, False]
    assert best.features == FEATURES and rows[1].test_score > rows[0].test_score


def test_forest_search(houses, spark):
    df = houses[1].filter("colonia = 'A'")
    model = forest.search_forest(df, FEATURES, trees=(5,), depths=(1, 5), folds=3)
    assert len(model.scores) == 2 and model.scores[1][1] > model.scores[0][1]
    importances = model.importances(spark).collect()
    assert [r.importance for r in importances] == sorted(r.importance for r in importances)
    assert sum(r.importance for r in importances) == pytest.approx(1)
    assert importances[-1].feature in ("a", "b")
    assert model.transform(df).filter("prediction is not null").count() == df.count()


def tree_by_hand(x, y, w, depth, leaf_rows=1):
    """Best-split regression tree on few distinct values; returns a prediction function."""
    mean = (w * y).sum() / w.sum()
    best = None
    if depth > 0:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                nl, nr = w[left].sum(), w[~left].sum()
                if nl < leaf_rows or nr < leaf_rows:
                    continue
                gain = (w * y)[left].sum() ** 2 / nl + (w * y)[~left].sum() ** 2 / nr
                if best is None or gain > best[0] * (1 + 1e-12):
                    best = (gain, f, cut)
    if best is None or best[0] <= (w * y).sum() ** 2 / w.sum() * (1 + 1e-12):
        return lambda r: mean
    _, f, cut = best
    left = x[:, f] <= cut
    lower = tree_by_hand(x[left], y[left], w[left], depth - 1, leaf_rows)
    upper = tree_by_hand(x[~left], y[~left], w[~left], depth - 1, leaf_rows)
    return lambda r: lower(r) if r[f] <= cut else upper(r)


def test_segment_forest_equals_trees_grown_by_hand(spark):
    rng = np.random.default_rng(11)
    n = 240
    pdf = pd.DataFrame(
        {
            "sku": [f"k{i}" for i in range(n)],
            "colonia": rng.choice(["A", "B"], n, p=[0.7, 0.3]),
            "a": rng.integers(0, 9, n).astype(float),
            "b": rng.integers(0, 4, n).astype(float),
        }
    )
    pdf["price"] = 1000 + 100 * pdf.a * (pdf.b > 1) + rng.normal(0, 20, n)
    df = spark.createDataFrame(pdf)
    quality, fitted = segment_forest.qualify_segments_forest(
        df, ["a", "b"], trees=(1, 3), depths=(1, 3), folds=2, more_than=20
    )
    quality = quality.toPandas().set_index("colonia")
    assert set(quality.index) == {"A", "B"} and (quality.score > 0.5).all()
    assert (quality.score <= 1).all() and (quality.error >= 0).all()

    split = splits.exact_split(df, 0.3, segment="colonia")
    weights = (
        split.select("sku", "colonia", F.col("sku").alias("_key"), "is_test")
        .withColumn("_tree", F.explode(F.array(*[F.lit(t) for t in range(3)])))
        .withColumn("w", segment_forest._weight(F.lit(2), F.col("_tree")))
        .toPandas()
    )
    scored = fitted.transform(df).toPandas().set_index("sku")
    for colonia, group in pdf.groupby("colonia"):
        trees, depth = int(quality.trees[colonia]), int(quality.depth[colonia])
        total = np.zeros(len(group))
        for t in range(trees):
            w = weights[(weights._tree == t) & (weights.colonia == colonia) & ~weights.is_test.astype(bool)]
            rows = group.set_index("sku").loc[w.sku]
            used = w.w.to_numpy() > 0
            tree = tree_by_hand(
                rows[["a", "b"]].to_numpy()[used], rows.price.to_numpy()[used], w.w.to_numpy()[used].astype(float), depth
            )
            total += [tree(r) for r in group[["a", "b"]].to_numpy()]
        np.testing.assert_allclose(scored.loc[group.sku].prediction, total / trees, rtol=1e-9)


def test_poisson_weights(spark):
    drawn = spark.range(20000).select(F.col("id").cast("string").alias("_key")).select(
        segment_forest._weight(F.lit(0), F.lit(1)).alias("w")
    ).toPandas().w
    assert abs(drawn.mean() - 1) < 0.03 and abs((drawn == 0).mean() - np.exp(-1)) < 0.02


def test_features_follow_the_property_type(listing):
    house = listing({}, {}).withColumn("endocer_colonia", F.lit(3))
    row = features.with_feature_vector(house).first()
    assert list(row.features) == [150.0, 200.0, 3.0, 2.0, 1.0, 3.0] and row.label == 2_000_000.0
    flat = listing({"tipo_inmueble": "Departamento", "m2_terreno": None}).withColumn("endocer_colonia", F.lit(3))
    assert list(features.with_feature_vector(flat).first().features) == [150.0, 3.0, 2.0, 1.0, 3.0]
    for bad in (listing({}, {"tipo_inmueble": "Departamento"}), listing({"tipo_inmueble": "Oficina"})):
        with pytest.raises(ValueError):
            features.feature_names(bad)


def test_amenities(listing):
    df = listing(
        {"amenidades": ["jardin", "alberca", "jardin"]}, {"amenidades": None}, {"amenidades": []},
        {"amenidades": ["gym", None]},
    )
    flags, names = categories.with_amenities(df)
    assert names == ["alberca", "gym", "jardin"]
    cells = [[r[n] for n in names] for r in flags.orderBy("sku").collect()]
    assert cells == [[True, False, True], [False] * 3, [False] * 3, [False, True, False]]
    with pytest.raises(ValueError, match="existing"):
        categories.with_amenities(listing({"amenidades": ["price"]}))
    with pytest.raises(ValueError, match="max_columns"):
        categories.with_amenities(df, max_columns=2)


def test_dummies(listing):
    df = listing({}, {"tipo_inmueble": "Departamento", "tipo_oferta": "Renta"}, {"tipo_inmueble": "Oficina"})
    rows = categories.with_dummies(df).orderBy("sku").collect()
    assert [(r.venta, r.casa, r.dummie_Oficina) for r in rows] == [(1, 1, 0), (0, 0, 0), (1, 0, 1)]
    fixed = categories.with_dummies(df, offers=["Renta", "Venta"], types=["Casa", "Departamento", "Villa"])
    assert {"venta", "casa", "dummie_Villa"} <= set(fixed.columns) and "dummie_Oficina" not in fixed.columns


def test_forest_queries_search_the_operators_grids():
    import inspect

    from predio.plans import catalogue

    source = inspect.getsource(catalogue)
    assert "depths=" not in source and "trees=" not in source
