import datetime

import pytest
from pyspark.sql import functions as F

from predio.functions.nulls import nan_to_null
from predio.operators import bands, cleaning, dedup, filters
from predio.schema import DROPPED_COLUMNS, category_columns, numeric_columns


def skus(df):
    return sorted(r.sku for r in df.select("sku").collect())


# One record per rule that only this rule removes, and its neighbour that stays.
CASES = [
    ("F1", {"agent": None}, {"antiguedad": None}),
    ("F1", {"colonia": None}, {"ciudad": None}),
    ("F2", {"m2_terreno": None}, {"m2_terreno": None, "tipo_inmueble": "Departamento"}),
    ("F3", {"m2_const": 20.0}, {"m2_const": 20.5}),
    ("F3", {"m2_const": 5000.0}, {"m2_const": 4999.0}),
    ("F4", {"price": 100.0, "tipo_oferta": "Renta"}, {"price": 101.0, "tipo_oferta": "Renta"}),
    ("F5", {"price": 99_999.0}, {"price": 100_000.0}),
    ("F6", {"price": 1e8, "m2_const": 4000.0, "m2_terreno": 4000.0}, {"price": 9.9e7, "m2_const": 4000.0, "m2_terreno": 4000.0}),
    ("F7", {"m2_terreno": 50.0}, {"m2_terreno": 51.0}),
    ("F8", {"m2_terreno": 5000.0}, {"m2_terreno": 4999.0}),
    ("F9", {"habitaciones": 0.0}, {"habitaciones": 1.0}),
    ("F9", {"banos": 0.0}, {"banos": 1.0}),
    ("F10", {"banos": 10.0}, {"banos": 9.0}),
    ("F11", {"tipo_inmueble": "Departamento", "habitaciones": 8.0}, {"habitaciones": 8.0}),
    ("F12", {"habitaciones": 10.0}, {"habitaciones": 9.0}),
    ("F13", {"autos": 30.0}, {"autos": 29.0}),
    ("F14", {"autos": 0.0}, {"autos": 0.0, "colonia": "Puerto Vallarta Sur"}),
    ("F14", {"autos": 0.0, "colonia": "vallarta"}, {"autos": 0.0, "colonia": "Vallarta"}),
    ("F15", {"tipo_oferta": "Renta", "price": 150_001.0}, {"tipo_oferta": "Renta", "price": 150_000.0}),
    ("F16", {"price": 15_000_001.0, "m2_terreno": 400.0}, {"price": 15_000_000.0, "m2_terreno": 400.0}),
    ("F17", {"price": 9_000_001.0, "m2_terreno": 100.0}, {"price": 9_000_000.0, "m2_terreno": 100.0}),
]


def test_every_rule_at_its_edge(listing):
    records = []
    for i, (_, removed, kept) in enumerate(CASES):
        records += [{"sku": f"{i:02d}-removed", **removed}, {"sku": f"{i:02d}-kept", **kept}]
    df = listing(*records)
    assert skus(cleaning.clean_listings(df)) == [f"{i:02d}-kept" for i in range(len(CASES))]
    removed = {r.rule: r.removed for r in cleaning.rows_removed(df).collect()}
    expected = {f"F{i}": 0 for i in range(1, 18)}
    for rule, _, _ in CASES:
        expected[rule] += 1
    assert removed == expected


def test_missing_types_are_kept_by_negated_rules(listing):
    df = listing(
        {"tipo_inmueble": None, "m2_terreno": 10.0},
        {"tipo_oferta": None, "price": 500.0},
        {"tipo_inmueble": None, "m2_terreno": None},
        {"tipo_inmueble": "Oficina", "m2_terreno": 0.0},
    )
    clean = cleaning.clean_listings(df)
    assert clean.count() == 4
    assert clean.filter("m2_price is null").count() == 2  # no land, or land of 0


def test_derived_columns_types_and_roles(listing):
    clean = cleaning.clean_listings(listing({}))
    row = clean.first()
    assert row.m2_price == 2_000_000 / 200 and row.m2_const_price == 2_000_000 / 150
    assert row.m2_abs_price == 2_000_000 / 350
    assert row.fecha_pub == datetime.datetime(2022, 3, 12)
    assert row.descripcion == "hola mundo"
    assert row.sector_inmo == "Interés Medio"
    assert not set(DROPPED_COLUMNS) & set(clean.columns)
    types = dict(clean.dtypes)
    assert types["habitaciones"] == types["banos"] == types["autos"] == "smallint"
    assert category_columns(clean) == [
        "tipo_inmueble", "tipo_oferta", "sub_category", "colonia", "ciudad", "estado",
    ]
    assert "price" in numeric_columns(clean) and "sku" not in numeric_columns(clean)


def test_unreadable_dates_fail_unless_lenient(listing):
    df = listing({"fecha_pub": "ayer"})
    assert cleaning.clean_listings(df, strict=False).first().fecha_pub is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.clean_listings(df).collect()


def test_price_bands_and_their_gaps(listing):
    sale = {
        1_000_000.5: "Interés Social", 1_000_001.0: "Interés Medio", 3_000_000.0: "Interés Medio",
        3_000_000.5: None, 3_000_001.0: "Residencial", 7_000_000.5: None, 7_000_001.0: "Residencial Plus",
        15_000_000.0: "Residencial Plus", 15_000_001.0: "Premium", 15_000_000.5: "Premium",
    }
    rent = {
        5_000.5: "Interés Social", 5_001.0: "Interés Medio", 10_000.5: None, 10_001.0: "Residencial",
        15_000.5: None, 15_001.0: "Residencial Plus", 30_000.0: "Residencial Plus", 30_001.0: "Premium",
    }
    records = [{"price": p, "tipo_oferta": "Venta", "agent": b} for p, b in sale.items()]
    records += [{"price": p, "tipo_oferta": "Renta", "agent": b} for p, b in rent.items()]
    records += [{"price": 10.0, "tipo_oferta": "Traspaso", "agent": None}]
    for row in bands.with_price_band(listing(*records)).collect():
        assert row.sector_inmo == row.agent, row.price


def test_keep_first_over_snapshots(spark):
    first = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), (None, 3.0, 2)], "sku string, price double, row int")
    second = spark.createDataFrame(
        [("a", 9.0, 0, "x"), (None, 8.0, 1, "y"), ("c", 7.0, 2, "z")], "sku string, price double, row int, extra string"
    )
    both = dedup.append([first.withColumn("snapshot", F.lit(0)), second.withColumn("snapshot", F.lit(1))])
    kept = {r.sku: (r.price, r.extra) for r in dedup.keep_first(both, ["snapshot", "row"]).collect()}
    assert kept == {"a": (1.0, None), "b": (2.0, None), None: (3.0, None), "c": (7.0, "z")}


def test_keep_first_limits_rows_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id % 2 as string) as sku", "id as row")
    plan = dedup.keep_first(df, ["row"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_equality_filters(listing):
    df = listing({"colonia": "A"}, {"colonia": "B"}, {"colonia": "B", "tipo_inmueble": "Oficina"})
    assert skus(filters.where_equal(df, tipo_inmueble="Casa", colonia="B")) == ["s1"]
    assert skus(filters.where_in(df, "colonia", ["A", "C"])) == ["s0"]
    with pytest.raises(ValueError):
        filters.where_equal(df, colonia="nowhere")
    with pytest.raises(KeyError):
        filters.where_equal(df, colony="A")


def test_minimum_keeps_ties_and_no_nulls(listing):
    df = listing({"m2_terreno": 80.0}, {"m2_terreno": None}, {"m2_terreno": 80.0}, {"m2_terreno": 90.0})
    assert skus(filters.where_minimum(df, "m2_terreno")) == ["s0", "s2"]


def test_drop_missing_then_mask_infinity(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [("a", inf, 1.0), ("b", 1.0, inf), ("c", nan, 1.0), ("d", -inf, None), ("e", None, 2.0)],
        "sku string, price double, area double",
    )
    out = {r.sku: (r.price, r.area) for r in filters.drop_missing(nan_to_null(df), "price").collect()}
    assert out == {"a": (None, 1.0), "b": (1.0, None), "d": (-inf, None)}
    assert filters.drop_missing(df).count() == 5


def test_gated_unit_prices(listing):
    houses = listing({}, {"m2_terreno": None})
    assert [r.m2_price for r in filters.with_land_price(houses).orderBy("sku").collect()] == [10_000.0, None]
    assert filters.with_total_price(houses).first().m2_abs_price == 2_000_000 / 350
    zero = listing({}, {"m2_terreno": 0.0, "m2_const": 0.0})
    for gated in (filters.with_land_price, filters.with_built_price, filters.with_total_price):
        with pytest.raises(ValueError):
            gated(zero)
    flats = listing({"tipo_inmueble": "Departamento"})
    for gated in (filters.with_land_price, filters.with_total_price):
        with pytest.raises(ZeroDivisionError):
            gated(flats)
    assert filters.with_built_price(flats).first().m2_const_price == 2_000_000 / 150


def test_change_types(listing):
    df = cleaning.change_types(listing({"banos": 2.7}), ("banos", "autos"), "tinyint")
    assert df.first().banos == 2 and dict(df.dtypes)["autos"] == "tinyint"
    assert category_columns(cleaning.change_types(df, ("agent",))) == ["agent"]
    with pytest.raises(KeyError):
        cleaning.change_types(df, ("coloniaa",))
    assert cleaning.change_types(listing({"banos": 1e9}), ("banos",), "tinyint", strict=False).first().banos is None
