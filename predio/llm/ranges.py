"""Running sums over ordered groups of any size, by range partitions.

Rows are range-partitioned by group and order, so a group may be spread over many tasks.  Each
task adds up its own rows as they stream by; what the earlier partitions of a group hold is added
from a table with a few rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from predio.scale import settle


def _changes(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Is each value another one than the value before it?  ``last`` stands before the first one."""
    out = np.ones(len(column), bool)
    if last is not None:
        out[0] = not (last.equals(column[0]) or (not last.is_valid and not column[0].is_valid))
    a, b = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    out[1:] = other | (a.is_valid().to_numpy(zero_copy_only=False) != b.is_valid().to_numpy(zero_copy_only=False))
    return out


def running(df: DataFrame, group: str | None, order: list[str], sums: list[str], label: str) -> DataFrame:
    """Add ``before_<c>`` for each long column c of ``sums``: its sum over the earlier rows of the group.

    Rows without a group are a group of their own.  Rows that tie in ``order`` keep the order they
    are stored in.  The result is stored once; ``sums`` must hold no nulls.
    """
    keys = [*([group] if group else []), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"before_{c}", T.LongType(), False) for c in sums]])
    arrow, names = to_arrow_schema(schema), rows.columns
    at = [names.index(c) for c in sums]
    group_at = names.index(group) if group else None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(at)
        for batch in batches:
            if not batch.num_rows:
                continue
            if group_at is None:
                fresh = np.zeros(batch.num_rows, bool)
            else:
                column = batch.column(group_at)
                fresh = _changes(column, last)
                last = column[-1]
            starts = np.flatnonzero(fresh)
            own = np.searchsorted(starts, np.arange(batch.num_rows), "right") - 1  # -1: the group of the batch before
            new = []
            for j, i in enumerate(at):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                until = np.cumsum(values)
                before = until - values
                base = np.where(own >= 0, before[starts[own]] if len(starts) else 0, -carried[j])
                new.append(pa.array(before - base))
                carried[j] = int(until[-1] - base[-1])
            yield pa.RecordBatch.from_arrays(
                [*[c.cast(f.type) for c, f in zip(batch.columns, arrow)], *new], schema=arrow
            )

    rows = settle(rows.mapInArrow(add, schema), label)
    # What a group's earlier partitions hold; only groups in several partitions matter.
    by_group = [group] if group else []
    runs = rows.groupBy(*by_group, "_part").agg(*[F.sum(c).alias(f"_s{j}") for j, c in enumerate(sums)])
    earlier = Window.partitionBy(*by_group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(c).alias("_group") for c in by_group],
        F.col("_part").alias("_run"),
        *[F.sum(f"_s{j}").over(earlier).alias(f"_s{j}") for j in range(len(sums))],
        F.lag("_part").over(Window.partitionBy(*by_group).orderBy("_part")).alias("_previous"),
    )
    runs = settle(runs.filter(F.col("_previous").isNotNull()).drop("_previous"), "runs")
    same = F.col("_part") == F.col("_run")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_group"))
    return rows.join(runs, same, "left").select(
        *df.columns,
        *[(F.col(f"before_{c}") + F.coalesce(f"_s{j}", F.lit(0))).alias(f"before_{c}") for j, c in enumerate(sums)],
    )
