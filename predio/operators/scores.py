"""Error reports and comparisons of scored tables and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from predio.functions.stats import percent_error, r2, signed_percent_error
from predio.operators.dedup import append
from predio.schema import TARGET

# --- fixed values: a small error in percent and the R² of a good segment -----
SMALL_ERROR = 7
GOOD_SCORE = 0.70
# ------------------------------------------------------------------------------


def _error_columns(actual: str, predicted: str):
    error = percent_error(actual, predicted)
    return [
        F.avg(error).alias("mean_error"),
        F.stddev_pop(error).alias("std_error"),
        F.avg((error <= SMALL_ERROR).cast("double")).alias("share_small"),
    ]


def error_summary(scored: DataFrame, actual: str = TARGET, predicted: str = "prediction") -> DataFrame:
    """Mean and population deviation of the percentage error, share of errors up to 7 %."""
    return scored.agg(*_error_columns(actual, predicted))


def error_report(
    scored: dict[str, DataFrame], actual: str = TARGET, predicted: str = "prediction"
) -> DataFrame:
    """``error_summary`` of several named scored tables, one row per model."""
    frames = [
        df.select(F.initcap(F.lit(name)).alias("model"), actual, predicted)
        for name, df in scored.items()
    ]
    return append(frames).groupBy("model").agg(*_error_columns(actual, predicted))


def ensemble_mean(df: DataFrame, predictions: list[str], name: str = "ensemble") -> DataFrame:
    total = sum((F.col(p) for p in predictions[1:]), F.col(predictions[0]))
    return df.withColumn(name, total / len(predictions))


def compare_models(
    train: DataFrame,
    test: DataFrame,
    fitters: dict[str, Callable[[DataFrame], object]],
    label: str = TARGET,
) -> tuple[DataFrame, object]:
    """Fit each model on ``train``; compare R² and signed mean percentage error per split.

    Returns the table (``best`` marks the first model with the highest test R²) and the
    best model.  A fitter takes the training table and returns a model with ``transform``.
    """
    models = {name: fit(train) for name, fit in fitters.items()}
    frames = []
    for position, (name, model) in enumerate(models.items()):
        for split, df in (("train", train), ("test", test)):
            frames.append(
                model.transform(df).select(
                    F.lit(position).alias("position"),
                    F.lit(name).alias("model"),
                    F.lit(split).alias("_split"),
                    label,
                    "prediction",
                )
            )
    table = (
        append(frames)
        .groupBy("position", "model")
        .pivot("_split", ["train", "test"])
        .agg(
            r2(label, "prediction").alias("score"),
            F.avg(signed_percent_error(label, "prediction")).alias("error"),
        )
    )
    # One row per model, so the ranking window is as small as the list of models.
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("test_score"), "position"))
    rows = table.withColumn("best", rank == 1).collect()
    best = next(r["model"] for r in rows if r["best"])
    result = train.sparkSession.createDataFrame(
        sorted(rows, key=lambda r: r["position"]),
        "position int, model string, train_score double, train_error double,"
        " test_score double, test_error double, best boolean",
    )
    return result, models[best]
