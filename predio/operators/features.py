"""Features and target of the price models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from predio.operators.moments import check_features
from predio.schema import APARTMENT, APARTMENT_FEATURES, HOUSE, HOUSE_FEATURES, TARGET


def feature_names(df: DataFrame) -> list[str]:
    """Features of the one property type in ``df``: apartments have no land."""
    types = [r[0] for r in df.select("tipo_inmueble").distinct().take(2)]
    if types == [HOUSE]:
        return list(HOUSE_FEATURES)
    if types == [APARTMENT]:
        return list(APARTMENT_FEATURES)
    raise ValueError(f"features need listings of one type, {HOUSE} or {APARTMENT}; found {types}")


def with_target(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def with_feature_vector(df: DataFrame, features: list[str] | None = None, label: str = TARGET) -> DataFrame:
    """Add the ``features`` vector and the ``label``."""
    features = check_features(df, features or feature_names(df), label)
    return VectorAssembler(inputCols=features, outputCol="features").transform(with_target(df, label))
