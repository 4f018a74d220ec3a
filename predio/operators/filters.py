"""Row selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from predio.functions.nulls import is_floating
from predio.operators.cleaning import built_price, land_price, total_price
from predio.schema import HOUSE, require_columns


def where_equal(df: DataFrame, allow_empty: bool = False, **values) -> DataFrame:
    """Rows equal to all given values; ValueError when there are none."""
    require_columns(df, values)
    for column, value in values.items():
        df = df.filter(F.col(column) == F.lit(value))
    if not allow_empty and df.isEmpty():
        raise ValueError(f"no rows where {values}")
    return df


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def where_minimum(df: DataFrame, column: str) -> DataFrame:
    """All rows holding the minimum of ``column``; the minimum is a scalar subquery."""
    return df.filter(F.col(column) == df.agg(F.min(column)).scalar())


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows missing any of ``columns``, then turn +inf into NULL in every column."""
    if columns:
        df = df.na.drop(subset=require_columns(df, columns))
    inf = F.lit(float("inf"))
    floating = [f.name for f in df.schema.fields if is_floating(f)]
    return df.withColumns({c: F.when(F.col(c) != inf, F.col(c)) for c in floating})


def _check_area(df: DataFrame, area, what: str) -> None:
    zero = df.filter((area == 0) & (F.col("price") > 0))
    if not zero.isEmpty():
        raise ValueError(f"{what}: some listings have area 0, so the mean is infinite; clean them first")


def _check_houses(df: DataFrame, what: str) -> None:
    types = [r[0] for r in df.select("tipo_inmueble").distinct().take(2)]
    if types != [HOUSE]:
        raise ZeroDivisionError(f"{what} is only defined for tipo_inmueble = {HOUSE}; found {types}")


def with_land_price(df: DataFrame, name: str = "m2_price") -> DataFrame:
    """Price per square metre of land: houses only, no zero areas."""
    _check_houses(df, name)
    _check_area(df, F.col("m2_terreno"), name)
    return df.withColumn(name, land_price())


def with_built_price(df: DataFrame, name: str = "m2_const_price") -> DataFrame:
    """Price per built square metre: any type, no zero areas."""
    _check_area(df, F.col("m2_const"), name)
    return df.withColumn(name, built_price())


def with_total_price(df: DataFrame, name: str = "m2_abs_price") -> DataFrame:
    """Price per land and built square metre: houses only, no zero total."""
    _check_houses(df, name)
    _check_area(df, F.col("m2_terreno") + F.col("m2_const"), name)
    return df.withColumn(name, total_price())
