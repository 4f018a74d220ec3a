"""Skewness and the removal of outliers, per segment or over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predio.functions.nulls import unless
from predio.functions.stats import g1_skew
from predio.operators.quantiles import exact_quantiles
from predio.scale import settle
from predio.schema import KEY, OUTLIER_COLUMNS, SEGMENT, require_columns

# --- fixed values: when a column is skewed and where its tails are cut -------
SKEW_LIMIT = 1
RIGHT_CUT = (0.01, 0.95)
LEFT_CUT = (0.05, 0.99)
# ------------------------------------------------------------------------------


def skew_by_segment(df: DataFrame, columns=None, segment: str = SEGMENT) -> DataFrame:
    """G1 skewness of each column per segment: one partially aggregated shuffle."""
    columns = list(columns or OUTLIER_COLUMNS)
    return (
        df.filter(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(*[g1_skew(c).alias(c) for c in columns])
    )


def _is_skewed(column: str) -> Column:
    return F.abs(column) > SKEW_LIMIT


def skewed_segments(skew: DataFrame, segment: str = SEGMENT) -> DataFrame:
    """Segments of a skew table where any column is skewed to either side."""
    flagged = F.lit(False)
    for c in skew.columns:
        if c != segment:
            flagged = flagged | F.coalesce(_is_skewed(c), F.lit(False))
    return skew.filter(flagged).select(segment)


def skew_global(df: DataFrame, columns) -> DataFrame:
    """G1 skewness over the whole table as rows ``(column, skew)``."""
    columns = require_columns(df, columns)
    return df.agg(*[g1_skew(c).alias(c) for c in columns]).unpivot([], columns, "column", "skew")


def trim_bounds(df: DataFrame, columns: list[str], segment: str = SEGMENT) -> DataFrame:
    """Per skewed segment, the bounds ``lo_<c>, hi_<c>`` of its skewed columns (else NULL)."""
    narrow = df.select(segment, *columns).filter(F.col(segment).isNotNull())
    stats = settle(
        narrow.groupBy(segment).agg(
            F.count("*").alias("n"), *[g1_skew(c).alias(f"s_{c}") for c in columns]
        ),
        "skew",
    )
    any_skewed = F.lit(False)
    for c in columns:
        any_skewed = any_skewed | F.coalesce(_is_skewed(f"s_{c}"), F.lit(False))
    flagged = settle(stats.filter(any_skewed), "flagged")

    # Only the rows and columns that can be trimmed enter the quantile passes.
    candidates = narrow.join(flagged.drop("n"), [segment]).select(
        segment, *[F.when(_is_skewed(f"s_{c}"), F.col(c)).alias(c) for c in columns]
    )
    quantiles = exact_quantiles(candidates, columns, [*RIGHT_CUT, *LEFT_CUT], [segment])

    def bound(c: str, side: int) -> Column:
        return F.when(F.col(f"s_{c}") > SKEW_LIMIT, F.col(f"q_{c}")[side]).when(
            F.col(f"s_{c}") < -SKEW_LIMIT, F.col(f"q_{c}")[2 + side]
        )

    return settle(
        quantiles.join(flagged, segment).select(
            segment,
            *[bound(c, 0).alias(f"lo_{c}") for c in columns],
            *[bound(c, 1).alias(f"hi_{c}") for c in columns],
        ),
        "bounds",
    )


def trim_by_segment(
    df: DataFrame,
    columns=None,
    segment: str = SEGMENT,
    key: str = KEY,
) -> DataFrame:
    """Remove the rows at or beyond a segment's bounds; missing values stay.  Drops ``key``.

    Skewness and quantiles of a segment come from all its rows, so all columns are
    trimmed in one filter.  ``df`` is scanned several times: pass a stored table.
    """
    columns = require_columns(df, columns or OUTLIER_COLUMNS)
    bounds = trim_bounds(df, columns, segment)
    outside = F.lit(False)
    for c in columns:
        beyond = (F.col(c) <= F.col(f"lo_{c}")) | (F.col(c) >= F.col(f"hi_{c}"))
        outside = outside | F.coalesce(beyond, F.lit(False))
    return df.join(bounds, [segment], "left").filter(unless(outside)).select(
        *[c for c in df.columns if c != key]
    )


def trim_global(df: DataFrame, columns, trim_negative: bool = False) -> DataFrame:
    """Trim skewed columns one after the other over the whole table.

    Skewness is taken once, up front.  Each right-skewed column then keeps the rows
    strictly inside its bounds, computed on the rows the columns before it left; rows
    missing the value go.  Left-skewed columns are only trimmed with ``trim_negative``.
    The bounds are a few numbers on the driver, so the result is ``df`` with one filter.
    """
    if not columns:
        raise ValueError("columns: name at least one column to trim")
    columns = require_columns(df, columns)
    narrow = settle(df.select(*columns), "narrow")
    skew = narrow.agg(*[g1_skew(c).alias(c) for c in columns]).first()
    todo = [(c, RIGHT_CUT) for c in columns if skew[c] is not None and skew[c] > SKEW_LIMIT]
    if trim_negative:
        todo += [(c, LEFT_CUT) for c in columns if skew[c] is not None and skew[c] < -SKEW_LIMIT]

    kept = F.lit(True)
    for c, cut in todo:
        left = narrow.filter(kept).select(c)
        low, high = exact_quantiles(left, [c], list(cut)).first()[0] or (None, None)
        kept = kept & (F.col(c) > F.lit(low)) & (F.col(c) < F.lit(high))
    return df.filter(kept)
