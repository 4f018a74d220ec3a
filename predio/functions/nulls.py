"""Missing values.  A comparison with a missing value counts as False, never as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def holds(cond: Column) -> Column:
    """``cond``, with NULL read as False."""
    return F.coalesce(cond, F.lit(False))


def unless(cond: Column) -> Column:
    """Keep a row unless ``cond`` surely holds; rows where it is NULL are kept."""
    return ~holds(cond)


def is_floating(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column; done once, at ingest."""
    floating = [f.name for f in df.schema.fields if is_floating(f)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def is_missing(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    return value.isNull() | F.isnan(value) if is_floating(field) else value.isNull()
