"""Price bands per kind of offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from predio.schema import RENT, SALE

# --- fixed values: band names and their inclusive price bounds ---------------
BANDS = ["Interés Social", "Interés Medio", "Residencial", "Residencial Plus", "Premium"]
SALE_BOUNDS = [(1_000_001, 3_000_000), (3_000_001, 7_000_000), (7_000_001, 15_000_000)]
RENT_BOUNDS = [(5_001, 10_000), (10_001, 15_000), (15_001, 30_000)]
# ------------------------------------------------------------------------------


def _band(price: Column, bounds: list[tuple[int, int]]) -> Column:
    band = F.when(price < bounds[0][0], BANDS[0])
    for name, (low, high) in zip(BANDS[1:], bounds):
        band = band.when(price.between(low, high), name)
    return band.when(price > bounds[-1][1], BANDS[-1])


def price_band(price: str = "price", offer: str = "tipo_oferta") -> Column:
    """Band of a price; NULL for other offers and for prices between two bands."""
    p = F.col(price)
    return F.when(F.col(offer) == SALE, _band(p, SALE_BOUNDS)).when(
        F.col(offer) == RENT, _band(p, RENT_BOUNDS)
    )


def with_price_band(df: DataFrame) -> DataFrame:
    return df.withColumn("sector_inmo", price_band())
