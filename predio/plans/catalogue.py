"""Registered queries: each runs one or more operators over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from predio.functions.stats import percent_error
from predio.operators import (
    categories,
    cleaning,
    clusters,
    codes,
    dedup,
    features,
    filters,
    forest,
    linear,
    outliers,
    quantiles,
    reports,
    scaling,
    scores,
    segment_forest,
    segments,
    splits,
)
from predio.plans import oracles
from predio.plans.pipelines import clean_and_encode, model_rows
from predio.scale import new_path, settle
from predio.schema import HOUSE, HOUSE_FEATURES, OUTLIER_COLUMNS, RESULT_SCHEMA, SALE
from predio.sources import listing_store, snapshots, star, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

LAND_FEATURES = ["m2_terreno", "m2_const", "habitaciones", "banos", "autos"]
ONE_FEATURE = ["m2_const"]


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles.sql()


# --- inputs ---------------------------------------------------------------------


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """First record per sku."""
    first = dedup.keep_first(star.read_rows(spark, folder), star.ROW_ORDER, star.ROW_KEY)
    return star.with_attributes(first, folder).drop(*star.SNAPSHOT_ORDER)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_listings(listings(spark, folder))


def zone(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned houses for sale."""
    kind = {"tipo_oferta": SALE, "tipo_inmueble": HOUSE}
    return filters.where_equal(clean(spark, folder), allow_empty=True, **kind)


def stored_zone(spark, folder, columns) -> DataFrame:
    """The columns of the zone that a several-pass operator reads, stored once."""
    return settle(zone(spark, folder).select(*columns), "zone")


def train_test(spark, folder, columns=("sku", "colonia", "price", *LAND_FEATURES)):
    parts = splits.hash_split(stored_zone(spark, folder, columns), segments.TEST_SHARE)
    return parts.filter(~F.col("is_test")).drop("is_test"), parts.filter("is_test").drop("is_test")


def rounded(digits: int, *names: str) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def listing_columns() -> list:
    return [
        "sku", "tipo_inmueble", "tipo_oferta", "sub_category", "colonia", "ciudad", "estado",
        *rounded(2, "price"), "m2_terreno", "m2_const", "habitaciones", "banos", "autos",
        "total_habitaciones", "antiguedad", "link", "link_img", "agent", "divisa", "fecha_pub",
        "descripcion", F.array_join("amenidades", "|").alias("amenidades"), *rounded(6, "lat", "lng"),
    ]


# --- sources and deduplication -----------------------------------------------------


@_query
def dedup_listings(spark, folder):
    return listings(spark, folder).select(*listing_columns())


@_query
def append_snapshots(spark, folder):
    raw = star.read_listings(spark, folder)
    frames = [raw.filter(F.col("snapshot_id") == i) for i in range(9)]
    return (
        dedup.append(frames)
        .groupBy("snapshot_id")
        .agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total_price"))
    )


@_query
def distinct_types(spark, folder):
    return dedup.distinct_values(listings(spark, folder), "tipo_inmueble")


def _write_snapshots(spark, folder) -> list[str]:
    rows = star.read_joined(spark, folder)
    return star.write_snapshots(rows, new_path(spark, "snapshots"), star.ROW_ORDER, star.listings_of)


@_query
def load_snapshots(spark, folder):
    paths = _write_snapshots(spark, folder)
    return snapshots.load_listings(spark, *paths).select(*listing_columns())


@_query
def add_snapshots(spark, folder):
    """The same snapshots, each added to a store that does not read the ones before."""
    store = new_path(spark, "store")
    listing_store.create(spark, store)
    for path in _write_snapshots(spark, folder):
        listing_store.add_snapshot(spark, store, path)
    return listing_store.read_store(spark, store).select(*listing_columns())


@_query
def encoder_roundtrip(spark, folder):
    path = new_path(spark, "encoder")
    tables.save_encoder(codes.fit_encoder(clean(spark, folder)), path)
    return tables.load_encoder(spark, path)


# --- cleaning and derived columns ------------------------------------------------------


@_query
def clean_listings(spark, folder):
    return clean(spark, folder).select(
        "sku", "tipo_inmueble", "tipo_oferta", "sub_category", "colonia", "ciudad", "estado",
        *rounded(2, "price"), "m2_terreno", "m2_const", "habitaciones", "banos", "autos", "antiguedad",
        F.date_format("fecha_pub", "yyyy-MM-dd HH:mm:ss").alias("fecha_pub"), "descripcion",
        F.array_join("amenidades", "|").alias("amenidades"), *rounded(6, "lat", "lng"),
        "m2_price", "m2_const_price", "m2_abs_price", "sector_inmo",
    )


@_query
def rows_removed_per_rule(spark, folder):
    return cleaning.rows_removed(listings(spark, folder))


@_query
def sector_counts(spark, folder):
    return clean(spark, folder).groupBy("tipo_oferta", "sector_inmo").agg(F.count("*").alias("n"))


@_query
def m2_prices(spark, folder):
    houses = filters.where_equal(listings(spark, folder), allow_empty=True, tipo_inmueble=HOUSE)
    nonzero = F.coalesce(F.col("m2_terreno") != 0, F.lit(True)) & F.coalesce(
        F.col("m2_const") != 0, F.lit(True)
    )
    stored = settle(
        houses.filter(nonzero).select("sku", "tipo_inmueble", "price", "m2_terreno", "m2_const"), "houses"
    )
    priced = filters.with_total_price(filters.with_built_price(filters.with_land_price(stored)))
    return priced.select("sku", "m2_price", "m2_const_price", "m2_abs_price")


@_query
def change_types(spark, folder):
    small = cleaning.change_types(listings(spark, folder), ("habitaciones", "banos", "autos"), "tinyint")
    return cleaning.change_types(small, ("m2_terreno", "m2_const"), "float").select(
        "sku", "habitaciones", "banos", "autos", "m2_terreno", "m2_const"
    )


# --- selections -----------------------------------------------------------------------


@_query
def drop_missing_mask_inf(spark, folder):
    infinite = F.when(F.col("m2_terreno") == 0, float("inf")).otherwise(
        F.try_divide("price", "m2_terreno")
    )
    df = listings(spark, folder).withColumn("ratio", infinite)
    return filters.drop_missing(df, "habitaciones", "banos", "autos", "colonia").select(
        "sku", "ratio", *rounded(2, "price"), "habitaciones", "colonia"
    )


@_query
def filter_casa_venta(spark, folder):
    return zone(spark, folder).select(
        "sku", "colonia", *rounded(2, "price"), "m2_terreno", "m2_const", "sector_inmo"
    )


@_query
def segment_subset(spark, folder):
    chosen = filters.where_in(clean(spark, folder), "colonia", ["Nuevo Vallarta", "NATION_7", "NATION_12"])
    return chosen.select("sku", "colonia", *rounded(2, "price"))


@_query
def min_land_rows(spark, folder):
    stored = stored_zone(spark, folder, ["sku", "colonia", "m2_terreno", "price"])
    return filters.where_minimum(stored, "m2_terreno").select(
        "sku", "colonia", "m2_terreno", *rounded(2, "price")
    )


# --- reports --------------------------------------------------------------------------


@_query
def missing_report_share(spark, folder):
    return reports.missing_report(listings(spark, folder))


@_query
def missing_report_count(spark, folder):
    return reports.missing_report(listings(spark, folder), share=False)


@_query
def column_profile(spark, folder):
    return reports.column_profile(clean(spark, folder), exact=True)


@_query
def big_segments(spark, folder):
    return reports.large_segments(zone(spark, folder))


@_query
def small_segments(spark, folder):
    return reports.small_segments(zone(spark, folder))


@_query
def segment_count(spark, folder):
    return reports.large_segments(zone(spark, folder)).agg(F.count("*").alias("segments"))


@_query
def describe_zone(spark, folder):
    return reports.describe(zone(spark, folder), OUTLIER_COLUMNS)


@_query
def corr_matrix(spark, folder):
    return reports.correlation_matrix(clean(spark, folder)).select("a", "b", *rounded(6, "r"))


# --- skewness, quantiles, outliers -----------------------------------------------------


@_query
def skew_by_colonia(spark, folder):
    skew = outliers.skew_by_segment(clean(spark, folder))
    return skew.select("colonia", *rounded(6, *OUTLIER_COLUMNS))


@_query
def skewed_colonias(spark, folder):
    return outliers.skewed_segments(outliers.skew_by_segment(clean(spark, folder)))


@_query
def skew_global(spark, folder):
    skew = outliers.skew_global(clean(spark, folder), OUTLIER_COLUMNS)
    return skew.select("column", *rounded(6, "skew"))


@_query
def quantiles_by_colonia(spark, folder):
    columns, probs = ["price", "m2_const"], [0.01, 0.05, 0.95, 0.99]
    stored = settle(clean(spark, folder).select("colonia", *columns), "clean")
    found = quantiles.exact_quantiles(stored, columns, probs, ["colonia"])
    return found.select(
        "colonia",
        *[
            F.round(F.col(f"q_{c}")[i], 4).alias(f"{c}_q{int(q * 100):02d}")
            for c in columns
            for i, q in enumerate(probs)
        ],
    )


@_query
def trim_by_colonia(spark, folder):
    columns = ["sku", "colonia", "tipo_inmueble", "tipo_oferta", *OUTLIER_COLUMNS, "lat", "descripcion"]
    stored = settle(clean(spark, folder).select(*columns), "clean")
    return outliers.trim_by_segment(stored).select(
        "colonia", "tipo_inmueble", "tipo_oferta", *rounded(2, "price"), "m2_terreno", "m2_const",
        "habitaciones", "banos", "autos", *rounded(6, "lat"), "descripcion",
    )


@_query
def trim_global(spark, folder):
    columns = oracles.TRIM_GLOBAL_COLUMNS
    stored = settle(clean(spark, folder).select("sku", "m2_const", *columns), "clean")
    return outliers.trim_global(stored, columns).select(
        "sku", *rounded(2, "price"), "m2_const", "m2_const_price"
    )


# --- categories -------------------------------------------------------------------------


@_query
def encode_colonia(spark, folder):
    encoded, _ = clean_and_encode(listings(spark, folder))
    return encoded.select("sku", "colonia", "endocer_colonia")


@_query
def code_lookup(spark, folder):
    return codes.code_of(codes.fit_encoder(clean(spark, folder)), "NATION_7")


@_query
def dummies(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "tipo_oferta", "tipo_inmueble"), "clean")
    return categories.with_dummies(stored).select("sku", "venta", "casa", "dummie_Oficina")


@_query
def amenities_onehot(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "amenidades"), "clean")
    flags, names = categories.with_amenities(stored)
    return flags.select("sku", *names)


@_query
def model_data(spark, folder):
    rows = model_rows(listings(spark, folder))
    features.feature_names(rows)
    return features.with_target(rows).select("sku", *HOUSE_FEATURES, *rounded(2, "label"))


@_query
def feature_vector(spark, folder):
    rows = features.with_feature_vector(model_rows(listings(spark, folder)))
    values = vector_to_array("features")
    return rows.select(
        "sku", *[values[i].alias(f"f{i}") for i in range(len(HOUSE_FEATURES))], *rounded(2, "label")
    )


# --- splits and scaling -------------------------------------------------------------------


def _count_and_total(df, *keys):
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total_price")
    )


@_query
def split_counts(spark, folder):
    split = splits.hash_split(clean(spark, folder), segments.TEST_SHARE)
    return _count_and_total(split, "colonia", "is_test")


@_query
def exact_split(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "colonia"), "clean")
    return splits.exact_split(stored, segments.TEST_SHARE, segment="colonia").select("sku", "is_test")


@_query
def split_null_keys(spark, folder):
    """Some listings have no key: they are one key and all on one side."""
    key = F.when(F.substring(F.md5("sku"), 32, 1) != "0", F.col("sku"))
    keyed = stored_zone(spark, folder, ["sku"]).withColumn("key", key)
    split = splits.hash_folds(splits.hash_split(keyed, segments.TEST_SHARE, key="key"), 5, key="key")
    return split.groupBy(F.col("key").isNull().alias("no_key"), "is_test", "fold").agg(F.count("*").alias("n"))


@_query
def split_edges(spark, folder):
    """Test rows at the smallest and largest shares."""
    stored = stored_zone(spark, folder, ["sku"])
    shares = [0.0, 0.5, 0.99999, 1.0]
    marks = [splits.hash_split(stored, s).filter("is_test").select(F.lit(s).alias("share")) for s in shares]
    return dedup.append(marks).groupBy("share").agg(F.count("*").alias("n"))


@_query
def fold_counts(spark, folder):
    return _count_and_total(splits.hash_folds(clean(spark, folder), linear.SEARCH_FOLDS), "fold")


@_query
def ordered_folds(spark, folder):
    """Contiguous folds in the row order of the snapshots."""
    first = dedup.keep_first(star.read_listings(spark, folder), star.SNAPSHOT_ORDER).select("sku", *star.SNAPSHOT_ORDER)
    return splits.ordered_folds(first, 3, [*star.SNAPSHOT_ORDER, "sku"]).select("sku", "fold")


@_query
def exact_folds(spark, folder):
    return splits.exact_folds(settle(clean(spark, folder).select("sku"), "clean"), linear.SEARCH_FOLDS)


@_query
def scale_standard(spark, folder):
    columns = ["m2_const", "m2_terreno", "autos"]
    stored = stored_zone(spark, folder, ["sku", *columns])
    return scaling.scale_standard(stored, columns).select("sku", *rounded(6, *columns))


@_query
def scale_minmax(spark, folder):
    columns = ["m2_const", "m2_terreno", "autos"]
    stored = stored_zone(spark, folder, ["sku", *columns])
    return scaling.scale_minmax(stored, columns).select("sku", *rounded(6, *columns))


# --- linear models --------------------------------------------------------------------------


@_query
def ols_by_segment(spark, folder):
    models = linear.fit_by_segment(zone(spark, folder), ONE_FEATURE)
    # Two listings or fewer fit any line: their colonia has no model.
    return models.select(
        "colonia",
        "n",
        F.when(F.col("n") > 2, F.round(F.col("coefficients")[0], 4)).alias("slope"),
        F.when(F.col("n") > 2, F.round("intercept", 2)).alias("intercept"),
    )


@_query
def ols_report(spark, folder):
    train, test = train_test(spark, folder)
    _, report = linear.linear_report(train, test, ONE_FEATURE)
    return report.select(*rounded(6, "cv_score", "train_score", "test_score", "mean_score"))


@_query
def ridge_fixed_alpha(spark, folder):
    train, _ = train_test(spark, folder)
    model = linear.fit_linear(train, ONE_FEATURE, alpha=99)
    row = (model.coefficients[0], model.intercept)
    fitted = spark.createDataFrame([row], "slope double, intercept double")
    return fitted.select(*rounded(4, "slope"), *rounded(2, "intercept"))


@_query
def ridge_search(spark, folder):
    train, _ = train_test(spark, folder)
    found = linear.search_ridge(train, ONE_FEATURE).table(spark)
    return found.select("alpha", *rounded(6, "cv_score"), "best")


@_query
def ridge_search_all_features(spark, folder):
    train, _ = train_test(spark, folder)
    found = linear.search_ridge(train, LAND_FEATURES).table(spark)
    return found.select("alpha", *rounded(6, "cv_score"), "best")


@_query
def baseline_report(spark, folder):
    split = splits.hash_split(stored_zone(spark, folder, ["sku", "price", *LAND_FEATURES]), 0.20)
    report = linear.baseline_report(split.filter(~F.col("is_test")), split.filter("is_test"))
    return report.select(
        *rounded(6, "cv_score"), *rounded(2, "train_rmse"), *rounded(6, "train_score"),
        *rounded(2, "test_rmse"), *rounded(6, "test_score"), *rounded(2, "error_mean", "error_std"),
    )


def _scored(spark, folder):
    """Both splits, with one-feature least squares and ridge fitted on the train rows."""
    train, test = train_test(spark, folder)
    ols = linear.fit_linear(train, ONE_FEATURE)
    ridge = linear.fit_linear(train, ONE_FEATURE, alpha=99)
    return train, test, ols, ridge


def _error_digits(df, *keys):
    return df.select(*keys, *rounded(4, "mean_error", "std_error"), *rounded(6, "share_small"))


@_query
def error_summary(spark, folder):
    _, test, ols, _ = _scored(spark, folder)
    return _error_digits(scores.error_summary(ols.transform(test)))


@_query
def error_report(spark, folder):
    _, test, ols, ridge = _scored(spark, folder)
    report = scores.error_report({"linear": ols.transform(test), "ridge": ridge.transform(test)})
    return _error_digits(report, "model")


@_query
def ensemble_mean(spark, folder):
    _, test, ols, ridge = _scored(spark, folder)
    both = ridge.transform(ols.transform(test, "p_ols"), "p_ridge")
    return scores.ensemble_mean(both, ["p_ols", "p_ridge"]).select("sku", *rounded(2, "ensemble"))


def _score_digits(table):
    return table.select(
        "position", "model", *rounded(6, "train_score"), *rounded(4, "train_error"),
        *rounded(6, "test_score"), *rounded(4, "test_error"), "best",
    )


@_query
def score_table(spark, folder):
    train, test = train_test(spark, folder)
    table, _ = scores.compare_models(
        train,
        test,
        {
            "linear": lambda t: linear.fit_linear(t, ONE_FEATURE),
            "ridge": lambda t: linear.fit_linear(t, ONE_FEATURE, alpha=99),
        },
    )
    return _score_digits(table)


@_query
def compare_models(spark, folder):
    train, test = train_test(spark, folder)
    table, _ = scores.compare_models(
        train,
        test,
        {
            "linear": lambda t: linear.fit_linear(t, LAND_FEATURES),
            "ridge": lambda t: linear.search_ridge(t, LAND_FEATURES).model,
            "forest": lambda t: forest.search_forest(t, LAND_FEATURES),
        },
    )
    return table


@_query
def batch_scoring(spark, folder):
    train, test, ols, _ = _scored(spark, folder)
    return ols.transform(train.unionByName(test)).select("sku", *rounded(2, "price", "prediction"))


@_query
def what_if(spark, folder):
    """A typical listing per colonia, scored by the general model."""
    train, test, ols, _ = _scored(spark, folder)
    scenarios = train.unionByName(test).groupBy("colonia").agg(F.avg("m2_const").alias("m2_const"))
    return ols.transform(scenarios).select("colonia", *rounded(2, "prediction"))


# --- segments -------------------------------------------------------------------------------


# No colonia of the test tables has a good model; this score has colonias on both sides.
FAIR_SCORE = 0.02


def _quality(spark, folder, **options):
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *ONE_FEATURE])
    return segments.qualify_segments(stored, ONE_FEATURE, **options)


def _quality_digits(df):
    return df.select("colonia", *rounded(6, "score"), *rounded(4, "error", "diff_score"), "Good")


@_query
def segment_quality(spark, folder):
    return _quality_digits(_quality(spark, folder))


@_query
def segment_quality_all_features(spark, folder):
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *LAND_FEATURES])
    return _quality_digits(segments.qualify_segments(stored, LAND_FEATURES, alpha=1.0))


@_query
def good_segments(spark, folder):
    return _quality_digits(segments.good_segments(_quality(spark, folder, good=FAIR_SCORE)))


@_query
def good_share(spark, folder):
    return segments.good_share(_quality(spark, folder, good=FAIR_SCORE)).select(*rounded(6, "good_share"))


@_query
def first_results(spark, folder):
    return _quality_digits(_quality(spark, folder)).orderBy("colonia").limit(5)


@_query
def read_result_table(spark, folder):
    path = new_path(spark, "quality")
    tables.write_column_tables(_quality(spark, folder), path, ["colonia"], rows_per_file=10)
    return _quality_digits(tables.read_column_table(spark, path, RESULT_SCHEMA))


@_query
def segment_error(spark, folder):
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *ONE_FEATURE])
    rows = segments.split_rows(
        segments.modelled_rows(stored, ONE_FEATURE), segments.TEST_SHARE, "colonia", "sku", exact=True
    )
    scored = segments.score_segments(
        rows.filter(~F.col("is_test")), rows.filter("is_test"), ONE_FEATURE
    )
    return scored.select(
        "sku", "colonia", *rounded(2, "prediction"),
        F.round(percent_error("price", "prediction"), 4).alias("error"),
    )


@_query
def segment_vs_general(spark, folder):
    train, test = train_test(spark, folder)
    fitted = train.groupBy("colonia").agg((F.count("*") > 2).alias("_fitted"))
    scored = segments.segment_vs_general(train, test, ONE_FEATURE).join(settle(fitted, "fitted"), "colonia", "left")
    own = {c: F.when(F.col("_fitted"), F.col(c)) for c in ("pred_single", "err_single")}
    return scored.withColumns(own).select(
        "sku", "colonia", *rounded(2, "pred_single", "pred_general"), *rounded(4, "err_single", "err_general")
    )


# --- forests ----------------------------------------------------------------------------------


@_query
def rf_search(spark, folder):
    train, _ = train_test(spark, folder)
    found = forest.search_forest(train, LAND_FEATURES)
    rows = [(p["numTrees"], p["maxDepth"], float(s)) for p, s in found.scores]
    return spark.createDataFrame(rows, "trees int, depth int, cv_score double")


@_query
def rf_importances(spark, folder):
    train, _ = train_test(spark, folder)
    return forest.search_forest(train, LAND_FEATURES).importances(spark)


@_query
def rf_segments(spark, folder):
    """A random forest per large colonia, searched over trees and depth."""
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *LAND_FEATURES])
    quality, _ = segment_forest.qualify_segments_forest(stored, LAND_FEATURES)
    return quality


@_query
def rf_segments_full_grid(spark, folder):
    """The full grid of a segment: 360 combinations, read off six growths."""
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *LAND_FEATURES])
    return segment_forest.search_segments_grid(stored, LAND_FEATURES)[0]


@_query
def rf_search_full_grid(spark, folder):
    """The full grid of one table: 480 combinations, read off six growths."""
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *LAND_FEATURES])
    return segment_forest.search_forest_grid(stored, LAND_FEATURES)[0].drop("_all")


def _segment_forest(spark, folder):
    stored = stored_zone(spark, folder, ["sku", "colonia", "price", *LAND_FEATURES])
    return stored, segment_forest.qualify_segments_forest(stored, LAND_FEATURES)[1]


@_query
def forest_scoring(spark, folder):
    """Every listing of the zone, scored by its colonia's forest."""
    stored, forests = _segment_forest(spark, folder)
    return forests.transform(stored).select("sku", "colonia", *rounded(2, "price", "prediction"))


@_query
def forest_scoring_bounds(spark, folder):
    """What holds for any forest: all listings of its colonias are scored, within their prices."""
    stored, forests = _segment_forest(spark, folder)
    scored = settle(forests.transform(stored).select("colonia", "price", "prediction"), "scored")
    ranges = scored.groupBy("colonia").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    outside = ~F.col("prediction").between(F.col("low"), F.col("high"))
    judged = scored.filter("prediction IS NOT NULL").join(ranges, "colonia").groupBy("colonia").agg(
        F.count("prediction").alias("n_scored"), F.sum(outside.cast("long")).alias("n_outside")
    )
    sizes = scored.groupBy("colonia").agg(F.count("*").alias("n"))
    return sizes.join(judged, "colonia").select("colonia", "n", "n_scored", "n_outside")


@_query
def segment_importances(spark, folder):
    """Feature importances of every colonia's forest."""
    return _segment_forest(spark, folder)[1].importances()


@_query
def forest_importance_totals(spark, folder):
    totals = _segment_forest(spark, folder)[1].importances().groupBy("colonia")
    return totals.agg(F.count("*").cast("int").alias("n"), F.round(F.sum("importance"), 6).alias("total"))


# --- clusters -----------------------------------------------------------------------------------


@_query
def kmeans_geo(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "lat", "lng"), "clean")
    return clusters.kmeans_clusters(stored).select("sku", "cluster")


@_query
def kmeans_geo_scaled(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "lat", "lng"), "clean")
    return clusters.kmeans_clusters(stored, scale=True).select("sku", "cluster")


@_query
def kmeans_geo_check(spark, folder):
    """What holds for any run: every located listing is with its nearest centre and no restart is better."""
    stored = settle(clean(spark, folder).select("sku", "lat", "lng"), "clean")
    rows, model = clusters.kmeans_fit(stored)
    # Listings of one place and cluster are judged once.
    places = settle(rows.groupBy("lat", "lng", "cluster").agg(F.count("*").alias("w")), "clustered")
    centres = spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(model.centres)], "cluster int, cx double, cy double"
    )
    own = places.join(centres, "cluster").select(
        ((F.col("lat") - F.col("cx")) ** 2 + (F.col("lng") - F.col("cy")) ** 2).alias("own"), "lat", "lng", "w"
    )
    far = [(F.col("lat") - float(x)) ** 2 + (F.col("lng") - float(y)) ** 2 for x, y in model.centres]
    least = F.array_min(F.array(*far))
    return own.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        F.lit(len(model.centres)).alias("centres"),
        F.coalesce(F.sum(F.when(F.col("own") > least, F.col("w")).otherwise(0)), F.lit(0)).alias("not_nearest"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("own") * F.col("w")), F.lit(model.inertia)) - 1, F.lit(0.0)), 6).alias("inertia_off"),
        F.lit(sum(x < model.inertia for x in model.restarts)).cast("long").alias("better_restarts"),
    )


@_query
def kmeans_one_centre(spark, folder):
    """One cluster: its centre is the mean and its inertia the variance times the rows."""
    stored = settle(clean(spark, folder).select("sku", "lat", "lng"), "clean")
    rows, model = clusters.kmeans_fit(stored, k=1, restarts=3)
    (lat, lng), inertia = model.centres[0].tolist(), model.inertia
    return rows.agg(F.count("cluster").alias("n")).select(
        "n", F.round(F.lit(lat), 6).alias("lat"), F.round(F.lit(lng), 6).alias("lng"), F.round(F.lit(inertia), 2).alias("inertia")
    )


@_query
def dbscan_geo(spark, folder):
    stored = settle(clean(spark, folder).select("sku", "lat", "lng"), "clean")
    return clusters.dbscan_clusters(stored).select("sku", "cluster")
