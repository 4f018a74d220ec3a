"""Dense 0-based codes of sorted distinct values, without an unbounded single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from predio.scale import settle
from predio.schema import CODE, SEGMENT


def dense_codes(
    values: DataFrame, order: list[str], name: str
) -> DataFrame:
    """Number the rows of ``values`` (distinct in ``order``) 0, 1, 2, … in that order.

    The rows are range-partitioned and stored with their partition number, numbered inside
    each partition, and shifted by the number of rows in the partitions before it.
    """
    values = settle(values, "values")

    ranged = settle(
        values.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One offset row per range partition, so the broadcast side is bounded by their number.
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (rank - 1 + F.col("_offset")).cast("int"))
        .drop("_part", "_offset")
    )


def fit_encoder(
    df: DataFrame,
    column: str = SEGMENT,
    name: str = CODE,
) -> DataFrame:
    """The encoder: a stored dimension ``(column, code)`` of the sorted distinct values."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return settle(dense_codes(values, [column], name), "encoder")


def encode(df: DataFrame, encoder: DataFrame, column: str = SEGMENT) -> DataFrame:
    """Add the code column; values the encoder has not seen get NULL."""
    return df.join(encoder, [column], "left").select(
        *df.columns, *[c for c in encoder.columns if c != column]
    )


def code_of(encoder: DataFrame, value: str, column: str = SEGMENT) -> DataFrame:
    return encoder.filter(F.col(column) == value)
