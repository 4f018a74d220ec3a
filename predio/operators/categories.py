"""Indicator columns from categories and from lists of amenities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from predio.schema import APARTMENT, HOUSE, SALE

MAX_COLUMNS = 500


def _bounded_names(values: DataFrame, max_columns: int) -> list[str]:
    """Sorted distinct names for new columns; never more than ``max_columns`` reach the driver."""
    names = [r[0] for r in values.distinct().take(max_columns + 1)]
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} names would become columns; raise max_columns")
    return sorted(n for n in names if n is not None)


def amenity_names(
    df: DataFrame, column: str = "amenidades", max_columns: int = MAX_COLUMNS
) -> list[str]:
    return _bounded_names(df.select(F.explode(column)), max_columns)


def _folding(df: DataFrame):
    """How Spark compares column names in this session."""
    return str if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def _refuse_clash(df: DataFrame, names: list[str]) -> None:
    fold = _folding(df)
    taken = {fold(c) for c in df.columns}
    clash = sorted(n for n in names if fold(n) in taken)
    if clash or len({fold(n) for n in names}) < len(names):
        raise ValueError(f"new columns named like existing ones: {clash or names}")


def with_amenities(
    df: DataFrame,
    column: str = "amenidades",
    names: list[str] | None = None,
    max_columns: int = MAX_COLUMNS,
) -> tuple[DataFrame, list[str]]:
    """One BOOLEAN column per amenity, and their names.

    Give ``names`` to fix the schema and skip the pass that finds them.  A missing list
    has no amenities.  Spellings that are one column name to Spark share the column of the
    first of them; an amenity named like a column of ``df`` is an error.
    """
    if names is None:
        names = amenity_names(df, column, max_columns)
    fold = _folding(df)
    spellings: dict[str, list[str]] = {}
    for n in names:
        spellings.setdefault(fold(n), []).append(n)
    _refuse_clash(df, [s[0] for s in spellings.values()])
    has = {
        s[0]: F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(n) for n in s])), F.lit(False))
        for s in spellings.values()
    }
    return df.withColumns(has), list(has)


def with_dummies(
    df: DataFrame,
    offers: list[str] | None = None,
    types: list[str] | None = None,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """0/1 columns per offer (without the first, sorted) and per type (without apartments).

    ``Venta`` and ``Casa`` become ``venta`` and ``casa``; others ``dummie_<name>``.
    """
    if offers is None:
        offers = _bounded_names(df.select("tipo_oferta"), max_columns)
    if types is None:
        types = _bounded_names(df.select("tipo_inmueble"), max_columns)

    def indicator(column, value):
        return F.coalesce((F.col(column) == value).cast("int"), F.lit(0))

    short = {SALE: "venta", HOUSE: "casa"}
    new = {
        short.get(v, f"dummie_{v}"): indicator("tipo_oferta", v) for v in sorted(offers)[1:]
    } | {
        short.get(v, f"dummie_{v}"): indicator("tipo_inmueble", v)
        for v in sorted(types)
        if v != APARTMENT
    }
    _refuse_clash(df, list(new))
    return df.withColumns(new)
