"""Row numbers over a whole table, without an unbounded single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from predio.scale import settle


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the order of the columns ``order``; ties are numbered arbitrarily.

    Rows are range-partitioned and stored in order; a row's number is its place in its partition plus
    the rows of the partitions before it.
    """
    both = F.monotonically_increasing_id()  # partition number and place in it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", both)
    stored = settle(
        ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"),
        "numbered",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    # One offset row per range partition, so the broadcast side is bounded by their number.
    return stored.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop(
        "_part", "_at", "_offset"
    )
