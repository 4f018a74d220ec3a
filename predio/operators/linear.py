"""Least squares and ridge regression from moments, for a table or for every segment."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from predio.functions.stats import r2, rmse
from predio.operators.moments import (
    Moments,
    check_features,
    complete_rows,
    moment_columns,
    ridge_solver,
)
from predio.operators.splits import hash_folds
from predio.schema import KEY, SEGMENT, TARGET, require_columns

# --- fixed values: the searched ridge penalties and fold counts --------------
ALPHAS = range(0, 100)
SEARCH_FOLDS = 5
REPORT_FOLDS = 10
REPORT_FEATURES = ["m2_const", "banos", "autos"]
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float
    alpha: float = 0.0

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Score a table with a plain column expression."""
        require_columns(df, self.features)
        terms = [F.col(c) * F.lit(w) for c, w in zip(self.features, self.coefficients)]
        return df.withColumn(prediction, reduce(lambda a, b: a + b, terms) + F.lit(self.intercept))


def fit_linear(
    df: DataFrame, features: list[str], label: str = TARGET, alpha: float = 0.0
) -> LinearModel:
    """Fit on the complete rows of ``df``; one aggregate row reaches the driver."""
    features = check_features(df, features, label)
    row = complete_rows(df, features, label).agg(*moment_columns(features, label)).first()
    if row["n"] == 0:
        raise ValueError("no complete rows to fit on")
    coef, intercept = Moments.of_row(row).solve(alpha)
    return LinearModel(features, coef, intercept, alpha)


def _fold_moments(df: DataFrame, features, label, fold) -> list[Moments]:
    rows = (
        complete_rows(df, features, label).groupBy(fold).agg(*moment_columns(features, label)).orderBy(fold)
    )
    return [Moments.of_row(r) for r in rows.collect()]  # one row per fold


def cross_validate(
    df: DataFrame,
    features: list[str],
    label: str = TARGET,
    alphas=(0.0,),
    fold: str = "fold",
) -> dict[float, float]:
    """Mean held-out R² per alpha, over the folds whose label varies.

    All alphas and folds come from one grouped aggregate.
    """
    features = check_features(df, features, label)
    folds = _fold_moments(df, features, label, fold)
    if len(folds) < 2:
        raise ValueError("cross validation needs at least two non-empty folds")
    rest = [reduce(Moments.merge, folds[:i] + folds[i + 1 :]) for i in range(len(folds))]
    scores = {}
    for alpha in alphas:
        each = [held.r2(*other.solve(alpha)) for held, other in zip(folds, rest)]
        defined = [r for r in each if r is not None]
        if not defined:
            raise ValueError("the label is constant in every fold")
        scores[alpha] = sum(defined) / len(defined)
    return scores


@dataclass(frozen=True)
class RidgeSearch:
    scores: dict[float, float]
    model: LinearModel

    def table(self, spark) -> DataFrame:
        rows = [(float(a), s, a == self.model.alpha) for a, s in self.scores.items()]
        return spark.createDataFrame(rows, "alpha double, cv_score double, best boolean")


def search_ridge(
    train: DataFrame,
    features: list[str],
    label: str = TARGET,
    alphas=ALPHAS,
    folds: int = SEARCH_FOLDS,
    key: str = KEY,
) -> RidgeSearch:
    """Choose alpha by cross-validated R² (the first best wins) and refit on all of ``train``."""
    scores = cross_validate(hash_folds(train, folds, key), features, label, alphas)
    best = max(scores, key=scores.get)
    return RidgeSearch(scores, fit_linear(train, features, label, best))


def linear_report(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = TARGET,
    folds: int = SEARCH_FOLDS,
    key: str = KEY,
) -> tuple[LinearModel, DataFrame]:
    """Least squares with its cross-validated, train and test R² and their mean."""
    cv = cross_validate(hash_folds(train, folds, key), features, label)[0.0]
    model = fit_linear(train, features, label)
    scores = _split_metrics(model, train, test, features, label)
    report = scores.select(
        F.lit(cv).alias("cv_score"),
        "train_score",
        "test_score",
        ((F.lit(cv) + F.col("train_score") + F.col("test_score")) / 3).alias("mean_score"),
    )
    return model, report


def _split_metrics(model, train, test, features, label) -> DataFrame:
    """Metrics of both splits, as one row, from one scan of each."""
    residual = F.col(label) - F.col("prediction")
    metrics = {
        "score": r2(label, "prediction"),
        "rmse": rmse(label, "prediction"),
        "error_mean": F.avg(residual),
        "error_std": F.stddev_pop(residual),
    }
    both = complete_rows(train, features, label).withColumn("_s", F.lit("train")).unionByName(
        complete_rows(test, features, label).withColumn("_s", F.lit("test"))
    )
    per_split = model.transform(both).groupBy("_s").agg(*[m.alias(k) for k, m in metrics.items()])
    return per_split.groupBy().pivot("_s", ["train", "test"]).agg(
        *[F.first(k).alias(k) for k in metrics]
    )


def baseline_report(
    train: DataFrame,
    test: DataFrame,
    features=None,
    label: str = TARGET,
    folds: int = REPORT_FOLDS,
    key: str = KEY,
) -> DataFrame:
    """One row on least squares: CV R², RMSE and R² per split, test residual mean and deviation."""
    features = list(features or REPORT_FEATURES)
    cv = cross_validate(hash_folds(train, folds, key), features, label)[0.0]
    model = fit_linear(train, features, label)
    metrics = _split_metrics(model, train, test, features, label)
    return metrics.select(
        F.lit(cv).alias("cv_score"),
        "train_rmse", "train_score", "test_rmse", "test_score",
        F.col("test_error_mean").alias("error_mean"),
        F.col("test_error_std").alias("error_std"),
    )


def fit_by_segment(
    train: DataFrame,
    features: list[str],
    label: str = TARGET,
    segment: str = SEGMENT,
    alpha: float = 0.0,
) -> DataFrame:
    """One model per segment: ``(segment, n, coefficients, intercept)``.

    One shuffle of partially aggregated moments, so a hot segment costs no more than
    others; the small solves run on batches of moment rows.
    """
    features = check_features(train, features, label)
    moments = (
        complete_rows(train, features, label)
        .filter(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(*moment_columns(features, label))
    )
    fit_row = ridge_solver(alpha)

    def solve(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        fits = [fit_row(*row) for row in zip(n, mean, cov)]
        return pd.DataFrame(fits, columns=["coefficients", "intercept"])

    solved = F.pandas_udf(solve, "coefficients array<double>, intercept double")
    return moments.select(segment, "n", solved("n", "mean", "cov").alias("_fit")).select(
        segment, "n", "_fit.coefficients", "_fit.intercept"
    )


def linear_prediction(features: list[str]):
    """Prediction from the ``coefficients`` and ``intercept`` columns of a segment's model."""
    terms = [F.col(c) * F.col("coefficients")[i] for i, c in enumerate(features)]
    return reduce(lambda a, b: a + b, terms) + F.col("intercept")
