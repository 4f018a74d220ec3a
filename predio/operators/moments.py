"""Means and covariances of features and label: all that linear models need.

One aggregate collects ``n``, the means and the upper triangle of the population
covariance (Spark's ``covar_pop``, whose buffers are centred and merge map-side).
Least squares, ridge for any alpha, and R² on held-out rows all follow from them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from predio.schema import require_columns


def check_features(df: DataFrame, features: list[str], label: str) -> list[str]:
    if label in features:
        raise ValueError(f"the label {label!r} is among the features")
    return require_columns(df, features)


def complete_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows that have all features and the label, as doubles."""
    columns = [*features, label]
    return df.na.drop(subset=columns).withColumns({c: F.col(c).cast("double") for c in columns})


def moment_columns(features: list[str], label: str) -> list[Column]:
    names = [*features, label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return [
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("mean"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"),
    ]


def ridge_solver(alpha: float):
    """A function from one moment row to ``(coefficients, intercept)``.

    It refers to numpy only, so that Spark tasks can run it without this package.
    """

    def solve(n, mean, upper):
        mean = np.asarray(mean, float)
        size = len(mean)
        cov = np.zeros((size, size))
        cov[np.triu_indices(size)] = upper
        cov = cov + np.triu(cov, 1).T
        scale = np.sqrt(np.diag(cov)[:-1])
        scale[scale == 0] = 1.0
        system = (cov[:-1, :-1] + alpha / n * np.eye(size - 1)) / np.outer(scale, scale)
        coef = np.linalg.lstsq(system, cov[:-1, -1] / scale, rcond=None)[0] / scale
        return coef.tolist(), float(mean[-1] - coef @ mean[:-1])

    return solve


class Moments:
    """``n``, mean vector and covariance matrix of features and label (the last one)."""

    def __init__(self, n, mean, cov):
        self.n, self.mean, self.cov = n, np.asarray(mean, float), np.asarray(cov, float)

    @classmethod
    def of_row(cls, row) -> Moments:
        size = len(row["mean"])
        cov = np.zeros((size, size))
        cov[np.triu_indices(size)] = row["cov"]
        return cls(row["n"], row["mean"], cov + np.triu(cov, 1).T)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        shift = other.mean - self.mean
        mean = self.mean + shift * (other.n / n)
        between = np.outer(shift, shift) * (self.n * other.n / n**2)
        return Moments(n, mean, (self.n * self.cov + other.n * other.cov) / n + between)

    def solve(self, alpha: float = 0.0) -> tuple[list[float], float]:
        """Coefficients and intercept of ridge regression; alpha 0 is least squares."""
        return ridge_solver(alpha)(self.n, self.mean, self.cov[np.triu_indices(len(self.mean))])

    def r2(self, coef: list[float], intercept: float) -> float | None:
        """R² of a linear model on the rows behind these moments; None if the label is constant."""
        if not self.cov[-1, -1] > 0:
            return None
        weights = np.append(-np.asarray(coef), 1.0)
        bias = weights @ self.mean - intercept
        return float(1 - (weights @ self.cov @ weights + bias**2) / self.cov[-1, -1])
