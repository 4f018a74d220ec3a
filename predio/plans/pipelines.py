"""Composed entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from predio.operators.cleaning import clean_listings
from predio.operators.codes import encode, fit_encoder
from predio.operators.features import with_feature_vector
from predio.operators.filters import where_equal
from predio.scale import settle
from predio.schema import HOUSE, SALE
from predio.sources.snapshots import load_listings

DEFAULT_FILTER = {"tipo_oferta": SALE, "tipo_inmueble": HOUSE}


def clean_and_encode(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean listings once, code their segments; the encoder covers all cleaned rows."""
    clean = settle(clean_listings(listings), "clean")
    encoder = fit_encoder(clean)
    return encode(clean, encoder), encoder


def load_and_clean(spark: SparkSession, *paths: str, **options) -> tuple[DataFrame, DataFrame]:
    """Read snapshots, keep first records, clean and encode."""
    return clean_and_encode(load_listings(spark, *paths, **options))


def model_rows(listings: DataFrame, filter_by: dict | None = None) -> DataFrame:
    """Cleaned, encoded listings of one kind; ValueError when there are none."""
    encoded, _ = clean_and_encode(listings)
    return where_equal(encoded, **(filter_by or DEFAULT_FILTER))


def model_data(
    spark: SparkSession, *paths: str, filter_by: dict | None = None, **options
) -> DataFrame:
    """From snapshot files to a table with a feature vector and a label."""
    return with_feature_vector(model_rows(load_listings(spark, *paths, **options), filter_by))
