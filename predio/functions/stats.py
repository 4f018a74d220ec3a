"""Statistical aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def g1_skew(column: str) -> Column:
    """Bias-adjusted sample skewness (G1); NULL for fewer than three values.

    Built on Spark's population skewness, whose buffers merge map-side.
    """
    n = F.count(column).cast("double")
    return F.when(n >= 3, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def percent_error(actual, predicted) -> Column:
    """Absolute error in percent of the actual value; NULL where that is 0."""
    return F.abs(F.try_divide(F.col(predicted) - F.col(actual), F.col(actual))) * 100


def signed_percent_error(actual, predicted) -> Column:
    return F.try_divide(F.col(predicted) - F.col(actual), F.col(actual)) * 100


def r2(actual, predicted) -> Column:
    """Coefficient of determination; NULL when the actual values do not vary."""
    y, p = F.col(actual), F.col(predicted)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def rmse(actual, predicted) -> Column:
    d = F.col(actual) - F.col(predicted)
    return F.sqrt(F.avg(d * d))
