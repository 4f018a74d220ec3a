"""Price models per segment, their quality table, and segment against general models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from predio.functions.nulls import holds
from predio.functions.stats import percent_error, r2
from predio.operators.linear import fit_by_segment, fit_linear, linear_prediction
from predio.operators.moments import check_features, complete_rows
from predio.operators.scores import GOOD_SCORE
from predio.operators.splits import exact_split, hash_split
from predio.scale import settle
from predio.schema import KEY, SEGMENT, TARGET

# --- fixed values: a segment is modelled above this size; share of test rows --
MORE_THAN = 50
TEST_SHARE = 0.30
# ------------------------------------------------------------------------------


def modelled_rows(
    df: DataFrame, features: list[str], label: str = TARGET, segment: str = SEGMENT,
    more_than: int = MORE_THAN, key: str = KEY,
) -> DataFrame:
    """Complete, narrow rows of the segments with more than ``more_than`` rows, settled."""
    features = check_features(df, features, label)
    narrow = complete_rows(
        df.select(key, segment, label, *features).filter(F.col(segment).isNotNull()), features, label
    )
    narrow = settle(narrow, "segment_rows")
    sizes = narrow.groupBy(segment).count().filter(F.col("count") > more_than).select(segment)
    return narrow.join(settle(sizes, "segments"), [segment], "left_semi")


def quality_table(
    scored: DataFrame, label: str = TARGET, predicted: str = "prediction", segment: str = SEGMENT,
    good: float = GOOD_SCORE,
) -> DataFrame:
    """``(segment, score, error, diff_score, Good)`` of rows scored by their segment's model.

    ``Good`` is true from a score of ``good`` on.
    """
    return (
        scored.groupBy(segment)
        .agg(r2(label, predicted).alias("score"), F.avg(percent_error(label, predicted)).alias("error"))
        .withColumn("diff_score", 100 - F.col("error"))
        .withColumn("Good", holds(F.col("score") >= good))
    )


def split_rows(rows: DataFrame, share: float, segment: str, key: str, exact: bool) -> DataFrame:
    if exact:
        return exact_split(rows, share, key, segment)
    return hash_split(rows, share, key)


def score_segments(
    train: DataFrame, rows: DataFrame, features: list[str], label: str = TARGET,
    segment: str = SEGMENT, alpha: float = 0.0, name: str = "prediction",
) -> DataFrame:
    """Fit a linear model per segment on ``train`` and score ``rows`` with their own model."""
    models = settle(fit_by_segment(train, features, label, segment, alpha).drop("n"), "models")
    return (
        rows.join(models, [segment], "left")
        .withColumn(name, linear_prediction(features))
        .drop("coefficients", "intercept")
    )


def qualify_segments(
    df: DataFrame, features: list[str], label: str = TARGET, segment: str = SEGMENT,
    more_than: int = MORE_THAN, share: float = TEST_SHARE, alpha: float = 0.0,
    key: str = KEY, exact: bool = True, good: float = GOOD_SCORE,
) -> DataFrame:
    """Quality of a linear model per large segment, on a test share of its rows."""
    rows = modelled_rows(df, features, label, segment, more_than, key)
    rows = split_rows(rows, share, segment, key, exact)
    scored = score_segments(
        rows.filter(~F.col("is_test")), rows.filter("is_test"), features, label, segment, alpha
    )
    return quality_table(scored, label, segment=segment, good=good)


def good_share(quality: DataFrame) -> DataFrame:
    return quality.agg(F.avg(F.col("Good").cast("double")).alias("good_share"))


def good_segments(quality: DataFrame) -> DataFrame:
    return quality.filter("Good")


def segment_vs_general(
    train: DataFrame, scenarios: DataFrame, features: list[str], general_features=None,
    label: str = TARGET, segment: str = SEGMENT, alpha: float = 0.0,
) -> DataFrame:
    """Score scenarios with their segment's model and with the general model.

    Scenarios hold the segment, the features and the true price; the errors are in
    percent of it.
    """
    general = fit_linear(train, list(general_features or features), label, alpha)
    scored = score_segments(train, scenarios, features, label, segment, alpha, "pred_single")
    return general.transform(scored, "pred_general").withColumns(
        {
            "err_single": percent_error(label, "pred_single"),
            "err_general": percent_error(label, "pred_general"),
        }
    )
