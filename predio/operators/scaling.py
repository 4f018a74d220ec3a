"""Standard and min-max scaling; each fits with one aggregate row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from predio.schema import require_columns


def scale_standard(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    columns = require_columns(df, columns)
    fit = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return df.withColumns(
        {f"{c}{suffix}": (F.col(c) - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c in columns}
    )


def scale_minmax(df: DataFrame, columns, suffix: str = "") -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    columns = require_columns(df, columns)
    fit = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"a_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"z_{c}") for c in columns],
    ).first()

    def scaled(c):
        low, high = fit[f"a_{c}"], fit[f"z_{c}"]
        width = 1.0 if low is None or low == high else high - low
        return (F.col(c) - F.lit(low)) / F.lit(width)

    return df.withColumns({f"{c}{suffix}": scaled(c) for c in columns})
