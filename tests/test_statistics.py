import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from predio.operators import codes, outliers, quantiles, reports, scaling, splits


@pytest.fixture(scope="module")
def sample(spark):
    """Skewed, tied, negative and missing values in groups of very different sizes."""
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "sku": [f"k{i}" for i in range(n)],
            "colonia": rng.choice(["A", "B", "C", None], n, p=[0.6, 0.25, 0.05, 0.1]),
            "x": np.where(rng.random(n) < 0.1, np.nan, rng.lognormal(0, 2, n)),
            "y": -rng.lognormal(0, 1, n),
            "z": rng.integers(0, 5, n).astype(float),
        }
    )
    return pdf, spark.createDataFrame(
        pdf.astype(object).where(pdf.notna(), None), "sku string, colonia string, x double, y double, z double"
    )


PROBS = [0.0, 0.01, 0.25, 0.5, 0.95, 0.99, 1.0]


def test_quantiles_equal_pandas(sample):
    pdf, df = sample
    found = quantiles.exact_quantiles(
        df.filter("colonia is not null"), ["x", "y", "z"], PROBS, ["colonia"]
    ).toPandas().set_index("colonia")
    for colonia, group in pdf.groupby("colonia"):
        for c in ("x", "y", "z"):
            np.testing.assert_allclose(found.loc[colonia, f"q_{c}"], group[c].quantile(PROBS), rtol=1e-12)


def test_global_quantiles(sample, spark):
    pdf, df = sample
    row = quantiles.exact_quantiles(df, ["x", "z"], PROBS).first()
    np.testing.assert_allclose(row.q_x, pdf.x.quantile(PROBS), rtol=1e-12)
    np.testing.assert_allclose(row.q_z, pdf.z.quantile(PROBS), rtol=1e-12)
    empty = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(empty, ["x"], PROBS).first().q_x is None


@pytest.mark.parametrize("small", [True, False])
def test_bracket_selection_at_every_accuracy(sample, spark, monkeypatch, small):
    """Rough sketches, brackets over several tasks, and brackets that miss all give the same quantiles."""
    pdf, df = sample
    if not small:
        monkeypatch.setattr(quantiles, "WINDOW_VALUES", 0)
    for accuracy in (3, 50):
        found = quantiles.exact_quantiles(df, ["x", "z"], PROBS, ["colonia"], accuracy).toPandas().set_index("colonia")
        for colonia, group in pdf.dropna(subset=["colonia"]).groupby("colonia"):
            for c in ("x", "z"):
                np.testing.assert_allclose(found.loc[colonia, f"q_{c}"], group[c].quantile(PROBS), rtol=1e-12)
    # A sketch that is wrong is noticed by its counts.
    whole = quantiles._sketches
    monkeypatch.setattr(
        quantiles, "_sketches",
        lambda *a: whole(*a).withColumn("_s0", F.struct(F.col("_s0")["n"].alias("n"), F.transform(F.col("_s0")["v"], lambda v: v + 0.5).alias("v"))),
    )
    row = quantiles.exact_quantiles(df, ["x", "z"], PROBS).first()
    np.testing.assert_allclose(row.q_x, pdf.x.quantile(PROBS), rtol=1e-12)
    np.testing.assert_allclose(row.q_z, pdf.z.quantile(PROBS), rtol=1e-12)


def test_only_the_brackets_are_shuffled(spark):
    """Of 200 000 rows a few per cent are ordered."""
    df = quantiles.settle(spark.range(200_000).select(F.rand(3).alias("x")), "many")
    seen = []
    real = quantiles.settle
    quantiles.settle = lambda d, label="table": seen.append((label, real(d, label))) or seen[-1][1]
    try:
        quantiles.exact_quantiles(df, ["x"], [0.01, 0.5, 0.95]).collect()
    finally:
        quantiles.settle = real
    inside = dict(seen)["inside"]
    assert inside.count() < 0.05 * 200_000


def test_quantiles_with_infinities_and_neighbouring_doubles(spark):
    inf = float("inf")
    values = [-inf, -1e300, 0.0, 5e-3, np.nextafter(5e-3, 1), 1e300, inf, inf]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [i / 7 for i in range(8)]
    direct = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).first().q
    assert quantiles.exact_quantiles(df, ["x"], probs).first().q_x == direct


def test_skew_equals_pandas(sample, spark):
    pdf, df = sample
    skew = outliers.skew_by_segment(df, ["x", "y", "z"]).toPandas().set_index("colonia")
    want = pdf.groupby("colonia")[["x", "y", "z"]].skew()
    np.testing.assert_allclose(skew.loc[want.index, ["x", "y", "z"]], want, rtol=1e-9)
    flagged = {r.colonia for r in outliers.skewed_segments(outliers.skew_by_segment(df, ["x", "z"])).collect()}
    assert flagged == set(want.index[(want[["x", "z"]].abs() > 1).any(axis=1)])


def test_skew_of_tiny_and_constant_groups(spark):
    df = spark.createDataFrame(
        [("one", 1.0), ("two", 1.0), ("two", 5.0), ("same", 2.0), ("same", 2.0), ("same", 2.0),
         ("three", 1.0), ("three", 2.0), ("three", 9.0), ("three", None)], "colonia string, x double",
    )
    skew = {r.colonia: r.x for r in outliers.skew_by_segment(df, ["x"]).collect()}
    assert skew["one"] is None and skew["two"] is None and not skew["same"]
    assert skew["three"] == pytest.approx(pd.Series([1.0, 2.0, 9.0]).skew())
    assert [r.colonia for r in outliers.skewed_segments(outliers.skew_by_segment(df, ["x"])).collect()] == ["three"]


def trim_by_hand(pdf, columns):
    gone = pd.Series(False, index=pdf.index)
    for _, group in pdf.groupby("colonia"):
        for c in columns:
            skew = group[c].skew()
            if abs(skew) > 1:
                low, high = group[c].quantile([0.01, 0.95] if skew > 1 else [0.05, 0.99])
                gone |= gone.index.isin(group.index[(group[c] <= low) | (group[c] >= high)])
    return pdf[~gone]


def test_trim_by_segment(sample):
    pdf, df = sample
    keyed = df.withColumn("id", F.col("sku"))
    kept = outliers.trim_by_segment(keyed, ["x", "y", "z"])
    assert "sku" not in kept.columns
    want = trim_by_hand(pdf, ["x", "y", "z"])
    assert sorted(r.id for r in kept.select("id").collect()) == sorted(want.sku)
    assert want.x.isna().sum() > 0 and want.colonia.isna().sum() > 0  # both stay


@pytest.mark.parametrize("negative", [False, True])
def test_trim_global(sample, negative):
    pdf, df = sample
    kept = outliers.trim_global(df, ["x", "y", "z"], trim_negative=negative)
    want = pdf[(pdf.x > pdf.x.quantile(0.01)) & (pdf.x < pdf.x.quantile(0.95))]
    if negative:
        want = want[(want.y > want.y.quantile(0.05)) & (want.y < want.y.quantile(0.99))]
    assert sorted(r.sku for r in kept.select("sku").collect()) == sorted(want.sku)


def test_trim_global_needs_columns(sample):
    with pytest.raises(ValueError):
        outliers.trim_global(sample[1], None)
    with pytest.raises(KeyError):
        outliers.trim_global(sample[1], ["nothing"])


def test_missing_report(spark):
    rows = [(None, 1.0, "a")] * 2 + [(1.0, float("nan"), None)] + [(1.0, 1.0, "a")] * 197
    df = spark.createDataFrame(rows, "p double, q double, r string")
    share = [(r["column"], r.missing) for r in reports.missing_report(df).collect()]
    assert share == [("p", 0.01)]  # 1 of 200 rounds half-even to 0.0
    counts = [(r["column"], r.missing) for r in reports.missing_report(df, share=False).collect()]
    assert counts == [("p", 2), ("q", 1), ("r", 1)]


def test_describe_correlation_and_sizes(sample):
    pdf, df = sample
    got = reports.describe(df, ["x", "y"]).toPandas().set_index("column")
    want = pdf[["x", "y"]].describe().round().T
    np.testing.assert_array_equal(
        got[["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float), want
    )
    r = {(v.a, v.b): v.r for v in reports.correlation_matrix(df, ["x", "y", "z"]).collect()}
    want = pdf[["x", "y", "z"]].corr()
    assert len(r) == 9 and r["x", "x"] == 1
    assert r["x", "z"] == pytest.approx(want.loc["x", "z"]) and r["x", "y"] == r["y", "x"]
    sizes = pdf.colonia.value_counts()
    assert {v.colonia: v.n for v in reports.large_segments(df, 500).collect()} == dict(sizes[sizes > 500])
    assert {v.colonia: v.n for v in reports.small_segments(df, 500).collect()} == dict(sizes[sizes <= 500])


def test_column_profile(listing):
    profile = {r["column"]: r for r in reports.column_profile(listing({}, {"price": None}), exact=True).collect()}
    assert profile["price"].n_missing == 1 and profile["price"].n_distinct == 1
    assert profile["price"].role == "numeric" and profile["amenidades"].dtype == "array<string>"


def test_scaling_equals_numpy(sample):
    pdf, df = sample
    same = df.withColumn("same", F.lit(3.0))
    standard = scaling.scale_standard(same, ["y", "same"]).orderBy("sku").toPandas()
    y = pdf.sort_values("sku").y.to_numpy()
    np.testing.assert_allclose(standard.y, (y - y.mean()) / y.std(), rtol=1e-9)
    assert (standard["same"] == 0).all()
    spread = scaling.scale_minmax(same, ["y", "same"]).orderBy("sku").toPandas()
    np.testing.assert_allclose(spread.y, (y - y.min()) / (y.max() - y.min()), rtol=1e-9)
    assert (spread["same"] == 0).all()


def test_codes_are_sorted_and_dense(spark):
    values = [f"c{i * 37 % 101}" for i in range(101)] * 3 + [None]
    df = spark.createDataFrame([(v,) for v in values], "colonia string")
    encoder = codes.fit_encoder(df)
    assert [r.colonia for r in encoder.orderBy("endocer_colonia").collect()] == sorted(set(values) - {None})
    assert sorted(r.endocer_colonia for r in encoder.collect()) == list(range(101))
    unseen = spark.createDataFrame([("c5",), ("new",), (None,)], "colonia string")
    assert [r.endocer_colonia is None for r in codes.encode(unseen, encoder).collect()] == [False, True, True]
    assert codes.code_of(encoder, "c0").first().endocer_colonia == 0


def test_splits_and_folds(sample):
    import hashlib
    import math

    pdf, df = sample
    pdf = pdf.assign(h=[hashlib.md5(s.encode()).hexdigest() for s in pdf.sku]).sort_values("h")
    split = splits.exact_split(df, 0.3, segment="colonia").toPandas()
    for colonia, group in pdf.groupby("colonia"):
        want = set(group.sku[: math.ceil(len(group) * 0.3)])
        assert set(split.sku[(split.colonia == colonia) & split.is_test.eq(True)]) == want
    assert split.is_test[split.colonia.isna()].isna().all()

    whole = splits.exact_split(df, 0.2).filter("is_test").toPandas()
    assert set(whole.sku) == set(pdf.sku[: math.ceil(len(pdf) * 0.2)])
    folds = splits.exact_folds(df, 7).toPandas().set_index("sku").fold
    assert [folds[s] for s in pdf.sku] == sorted(folds)  # contiguous blocks of the hash order
    sizes = folds.value_counts().sort_index().tolist()
    assert sizes == [len(b) for b in np.array_split(range(len(pdf)), 7)]
    per = splits.exact_folds(df, 3, segment="colonia").toPandas().dropna(subset=["fold"])
    for _, group in per.groupby("colonia"):
        assert group.fold.value_counts().max() - group.fold.value_counts().min() <= 1

    approximate = splits.hash_split(df, 0.3).toPandas()
    assert set(approximate.sku[approximate.is_test]) == set(pdf.sku[pdf.h.str[:4] < "4ccd"])
    assert splits.hash_folds(df, 5).select("fold").distinct().count() == 5
    other = splits.hash_split(df, 0.3, seed=72).toPandas()
    assert set(other.sku[other.is_test]) != set(approximate.sku[approximate.is_test])


def test_folds_of_fewer_rows_than_folds(spark):
    df = spark.createDataFrame([("a",), ("b",)], "sku string")
    assert sorted(r.fold for r in splits.exact_folds(df, 5).collect()) == [0, 1]


def test_hash_split_does_not_shuffle(sample):
    plan = splits.hash_split(sample[1], 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_splits_at_the_edges_and_without_keys(spark):
    df = spark.createDataFrame([(f"s{i}" if i % 3 else None, i) for i in range(300)], "sku string, i int")
    for share, least, most in ((0, 0, 0), (0.3, 40, 220), (0.99999, 299, 300), (1, 300, 300)):
        n = splits.hash_split(df, share).filter("is_test").count()
        assert least <= n <= most
    split = splits.hash_split(df, 0.3).toPandas()
    assert split.is_test.notna().all() and split[split.sku.isna()].is_test.nunique() == 1
    assert splits.hash_folds(df, 5).filter("fold is null").count() == 0
    exact = splits.exact_split(df.filter("sku is not null"), 0.3).filter("is_test").count()
    assert exact == 60 and splits.exact_split(df, 0.3).filter("is_test is null").count() == 0
    for wrong in (-0.1, 1.1):
        with pytest.raises(ValueError):
            splits.hash_split(df, wrong)


def test_amenity_names_that_spark_takes_for_one(spark):
    from predio.operators import categories

    df = spark.createDataFrame([(["Pool"], 1.0), (["pool", "gym"], 2.0), (None, 3.0), (["gym"], 4.0)], "amenidades array<string>, price double")
    rows, names = categories.with_amenities(df)
    assert names == ["Pool", "gym"]
    assert [(r["Pool"], r["gym"]) for r in rows.orderBy("price").collect()] == [(True, False), (True, True), (False, False), (False, True)]
    clash = spark.createDataFrame([(["Price"], 1.0)], "amenidades array<string>, price double")
    with pytest.raises(ValueError):
        categories.with_amenities(clash)


def test_constant_folds_and_missing_places(spark):
    from predio.operators import clusters, linear

    rows = [(f"s{i}", float(i), float(i * 2 % 7) if i < 40 else 5.0, i // 20) for i in range(60)]
    df = spark.createDataFrame(rows, "sku string, x double, price double, fold int")
    scores = linear.cross_validate(df, ["x"], "price", (0.0, 1.0))
    assert all(np.isfinite(v) for v in scores.values())
    with pytest.raises(ValueError):
        linear.cross_validate(df.filter("fold = 2").withColumn("fold", (df.x % 2).cast("int")), ["x"], "price")
    places = [(f"p{i}", 20.0 + i / 1000, -103.0) for i in range(8)] + [("n", float("nan"), -103.0), ("m", None, -103.0)]
    found = clusters.dbscan_clusters(spark.createDataFrame(places, "sku string, lat double, lng double")).toPandas().set_index("sku")
    assert found.cluster[["n", "m"]].isna().all() and (found.cluster.drop(["n", "m"]) == 0).all()
    means = clusters.kmeans_clusters(spark.createDataFrame(places, "sku string, lat double, lng double"), k=2).toPandas().set_index("sku")
    assert means.cluster[["n", "m"]].isna().all() and means.cluster.drop(["n", "m"]).notna().all()


@pytest.mark.parametrize("n, k", [(0, 3), (2, 5), (10, 3), (1000, 7), (9, 3)])
def test_ordered_folds_are_contiguous_blocks(spark, n, k):
    df = spark.range(n).select((F.col("id") * 37 % max(n, 1)).alias("place")).repartition(4)
    df = df.filter("place IS NOT NULL").dropDuplicates(["place"]) if n else df
    rows = splits.ordered_folds(df, k, ["place"]).orderBy("place").collect()
    want = [f for f, block in enumerate(np.array_split(np.arange(len(rows)), k)) for _ in block]
    assert [r.fold for r in rows] == want
    with pytest.raises(ValueError):
        splits.ordered_folds(df, 0, ["place"])


def test_exact_profile_shuffles_no_text(spark):
    df = spark.createDataFrame(
        [("a", 0.0, ["x"], None), ("b", -0.0, ["x"], None), ("a", float("nan"), None, None), (None, 1.0, ["x", "y"], None)],
        "t string, `a.b` double, l array<string>, n string",
    )
    profile = reports.column_profile(df, exact=True)
    assert {r.column: (r.n_missing, r.n_distinct) for r in profile.collect()} == {"t": (1, 2), "a.b": (1, 2), "l": (1, 2), "n": (4, 0)}
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    rough = {r.column: r.n_distinct for r in reports.column_profile(df).collect()}
    assert rough == {"t": 2, "a.b": 2, "l": 2, "n": 0}
