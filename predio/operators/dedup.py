"""Appending snapshots and keeping the first record per listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def append(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, order: list[str], key: str | list[str] = "sku") -> DataFrame:
    """Keep the first row per ``key`` (a column or several) in ``order``; NULL keys count as one key.

    Rank 1 makes Spark keep at most one row per key and map task *before* the shuffle
    (WindowGroupLimit), so a key that holds a third of all rows sends one row per task.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
