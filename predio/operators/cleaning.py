"""The listing quality rules as data, derived price columns and final types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from predio.functions.nulls import holds, unless
from predio.operators.bands import price_band
from predio.schema import (
    APARTMENT,
    CATEGORY_COLUMNS,
    COUNT_COLUMNS,
    DROPPED_COLUMNS,
    HOUSE,
    RENT,
    SALE,
    as_category,
    require_columns,
)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the quality rules.  Fixed values of the listing contract."""

    required: tuple = (
        "colonia", "m2_const", "habitaciones", "banos", "autos", "price", "link_img", "agent",
    )
    built_min: float = 20
    built_max: float = 5000
    price_min: float = 100
    sale_price_min: float = 100_000
    price_max: float = 100_000_000
    land_min: float = 50
    land_max: float = 5000
    baths_max: float = 10
    apartment_rooms_max: float = 7
    rooms_max: float = 10
    parking_max: float = 30
    no_parking_segment: str = "Vallarta"
    rent_price_max: float = 150_000
    built_price_max: float = 100_000
    land_price_max: float = 90_000


@dataclass(frozen=True)
class Rule:
    """One quality rule: rows are kept where ``keep`` is True (it is never NULL)."""

    id: str
    keep: Column = field(compare=False)


def land_price() -> Column:
    return F.try_divide("price", "m2_terreno")


def built_price() -> Column:
    return F.try_divide("price", "m2_const")


def total_price() -> Column:
    return F.try_divide(F.col("price"), F.col("m2_terreno") + F.col("m2_const"))


def rules(limits: Limits = Limits()) -> list[Rule]:
    house = F.col("tipo_inmueble") == HOUSE
    apartment = F.col("tipo_inmueble") == APARTMENT
    sale = F.col("tipo_oferta") == SALE
    rent = F.col("tipo_oferta") == RENT
    price, land, built = F.col("price"), F.col("m2_terreno"), F.col("m2_const")
    rooms, baths, parking = (F.col(c) for c in COUNT_COLUMNS)

    present = F.lit(True)
    for name in limits.required:
        present = present & F.col(name).isNotNull()

    keep = {
        "F1": present,
        "F2": unless(house & land.isNull()),
        "F3": holds((built > limits.built_min) & (built < limits.built_max)),
        "F4": holds(price > limits.price_min),
        "F5": unless(sale & (price < limits.sale_price_min)),
        "F6": holds(price < limits.price_max),
        "F7": unless(house & (land <= limits.land_min)),
        "F8": unless(house & (land >= limits.land_max)),
        "F9": unless((rooms == 0) | (baths == 0)),
        "F10": holds(baths < limits.baths_max),
        "F11": unless(apartment & (rooms > limits.apartment_rooms_max)),
        "F12": holds(rooms < limits.rooms_max),
        "F13": holds(parking < limits.parking_max),
        "F14": unless((parking == 0) & ~F.contains("colonia", F.lit(limits.no_parking_segment))),
        "F15": unless(rent & (price > limits.rent_price_max)),
        "F16": unless(built_price() > limits.built_price_max),
        "F17": unless(house & (land_price() > limits.land_price_max)),
    }
    return [Rule(name, expr) for name, expr in keep.items()]


def apply_rules(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All quality rules as one filter; Catalyst pushes the parts it can to the scan."""
    require_columns(df, limits.required)
    for rule in rules(limits):
        df = df.filter(rule.keep)
    return df


def rows_removed(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows removed by each rule, counted at the first rule that rejects them: one aggregate."""
    first = F.coalesce(*[F.when(~r.keep, F.lit(r.id)) for r in rules(limits)])
    ids = [r.id for r in rules(limits)]
    counts = df.select(first.alias("_rule")).agg(
        *[F.count_if(F.col("_rule") == i).alias(i) for i in ids]
    )
    return counts.unpivot([], ids, "rule", "removed")


def with_unit_prices(df: DataFrame) -> DataFrame:
    """Price per land, built and total square metre; NULL where the area is 0."""
    return df.withColumns(
        {"m2_price": land_price(), "m2_const_price": built_price(), "m2_abs_price": total_price()}
    )


def with_parsed_text(df: DataFrame, strict: bool = True) -> DataFrame:
    """Publication date as a timestamp and the description without its ``"text":`` marks.

    ``strict`` raises on unreadable dates; otherwise they become NULL.
    """
    date = F.col("fecha_pub")
    return df.withColumns(
        {
            "fecha_pub": date.cast("timestamp_ntz") if strict else date.try_cast("timestamp_ntz"),
            "descripcion": F.regexp_replace("descripcion", '"text":', ""),
        }
    )


def with_clean_types(df: DataFrame, strict: bool = True) -> DataFrame:
    """Counts as SMALLINT, categories tagged; measures stay DOUBLE.

    ``strict`` raises when a count does not fit; otherwise it becomes NULL.
    """
    counts = {
        c: F.col(c).cast("smallint") if strict else F.col(c).try_cast("smallint")
        for c in COUNT_COLUMNS
    }
    return df.withColumns(counts).withColumns({c: as_category(c) for c in CATEGORY_COLUMNS})


def clean_listings(df: DataFrame, limits: Limits = Limits(), strict: bool = True) -> DataFrame:
    """Rules, unit prices, parsed text, price band and types, as one narrow stage."""
    return (
        df.transform(apply_rules, limits)
        .transform(with_unit_prices)
        .transform(with_parsed_text, strict)
        .withColumn("sector_inmo", price_band())
        .transform(with_clean_types, strict)
        .drop(*DROPPED_COLUMNS)
    )


def change_types(df: DataFrame, columns, to: str = "category", strict: bool = True) -> DataFrame:
    """Cast ``columns`` to one type; ``category`` tags a STRING column.  KeyError if unknown."""
    columns = require_columns(df, columns)
    if to == "category":
        return df.withColumns({c: as_category(c) for c in columns})
    return df.withColumns(
        {c: F.col(c).cast(to) if strict else F.col(c).try_cast(to) for c in columns}
    )
