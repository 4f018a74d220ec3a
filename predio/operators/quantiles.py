"""Exact quantiles with linear interpolation, per group or over the whole table.

Mergeable sketches first enclose every wanted rank between two values; then one pass counts the
values below each bracket and, by value, those inside it.  Only the counted values inside, a small
share of the rows, are shuffled and put in order.  Should a bracket miss its ranks, which the counts
tell, that group and column are selected from all their values.  A bracket with many values is
range-partitioned by group and value: each partition adds up its own counts, and the counts of a
group's earlier partitions are added.  No rows are gathered or approximated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from predio.scale import settle

ACCURACY = 2000  # a sketch's ranks are off by at most 1 / ACCURACY of the rows
WINDOW_VALUES = 1_000_000  # brackets with more distinct values are ordered over several tasks


def _between_ranks(low, high):
    """High and low values weighted by the distance to the other rank, as percentile does."""
    below, above = F.floor("_at"), F.ceil("_at")
    return F.when(low == high, low).otherwise((above - F.col("_at")) * low + (F.col("_at") - below) * high)


def _of_small(counted: DataFrame, ranks: DataFrame, group: list[str]) -> DataFrame:
    """The values at the ranks of groups with a bounded number of counted values."""
    until = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))
    running = counted.withColumn("_until", until)
    held = (F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_c"))
    return running.join(ranks, group).filter(held)


def _of_large(counted: DataFrame, ranks: DataFrame, group: list[str]) -> DataFrame:
    """The values at the ranks of groups of any size, over range partitions."""
    ordered = counted.repartitionByRange(*group, "_v").sortWithinPartitions(*group, "_v")
    ordered = settle(ordered.withColumn("_part", F.spark_partition_id()), "ordered")
    # One row per group and partition.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*group, "_part").agg(F.sum("_c").alias("_rows"))
    parts = settle(parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))), "parts")
    # Only the partition that holds a rank is asked for it.
    asked = ranks.join(parts, group).filter("_rank >= _before and _rank < _before + _rows")
    asked = settle(asked.drop("_rows"), "ranks")
    so_far = Window.partitionBy(*group, "_part").orderBy("_v")
    running = ordered.withColumn("_until", F.sum("_c").over(so_far))
    held = (F.col("_rank") < F.col("_before") + F.col("_until")) & (
        F.col("_rank") >= F.col("_before") + F.col("_until") - F.col("_c")
    )
    return running.join(asked, [*group, "_part"]).filter(held)


def _selected(counted: DataFrame, ranks: DataFrame, group: list[str], most: int) -> DataFrame:
    """``(*group, _at, _q)`` for the 0-based ``_rank`` around ``_at`` among the counted values."""
    found = (_of_small if most <= WINDOW_VALUES else _of_large)(counted, ranks, group)
    return found.groupBy(*group, "_at").agg(_between_ranks(F.min("_v"), F.max("_v")).alias("_q"))


def _sketches(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Per group and column a struct ``_s<i>``: the number of values and the ends of every bracket."""
    slack = 2.0 / accuracy
    ends = [min(max(p + side * slack, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = [F.struct(F.count(c).alias("n"), F.percentile_approx(c, ends, accuracy).alias("v")) for c in columns]
    return settle(df.groupBy(*keys).agg(*[x.alias(f"_s{i}") for i, x in enumerate(sketch)]), "sketches")


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], keys: list[str] | None = None, accuracy: int = ACCURACY,
) -> DataFrame:
    """``keys`` plus one array ``q_<column>`` of quantiles per column.

    Missing values are ignored, and so are rows without a key; a column without values gives
    NULL.  ``df`` is read three times: pass a stored table.
    """
    keys = keys or []
    if keys:
        df = df.na.drop(subset=keys)
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    sketches = _sketches(narrow, keys, columns, probs, accuracy)
    if keys:
        joined = narrow.join(sketches, keys)
    else:  # the sketches of the whole table are one row
        joined = narrow.withColumn("_one", F.lit(1)).join(F.broadcast(sketches.withColumn("_one", F.lit(1))), "_one")
    places = [(i, c, j, float(p)) for i, c in enumerate(columns) for j, p in enumerate(probs)]

    def end(i, j, side):
        return F.col(f"_s{i}")["v"][2 * j + side]

    def place(c, j, *more):
        return F.struct(F.lit(c).alias("_column"), F.lit(j).alias("_pos"), *more)

    wanted = F.array(
        *[place(c, j, F.col(f"_s{i}")["n"].alias("_n"), ((F.col(f"_s{i}")["n"] - 1) * p).alias("_at")) for i, c, j, p in places]
    )
    brackets = sketches.select(*keys, F.inline(wanted)).filter("_n > 0")
    below = F.array(*[place(c, j, F.count_if(F.col(c) < end(i, j, 0)).alias("_below")) for i, c, j, _ in places])
    counted_below = joined.groupBy(*keys).agg(below.alias("b")).select(*keys, F.inline("b"))
    hits = F.array(
        *[F.when((F.col(c) >= end(i, j, 0)) & (F.col(c) <= end(i, j, 1)), place(c, j, F.col(c).alias("_v"))) for i, c, j, _ in places]
    )
    values = joined.select(*keys, F.inline(F.filter(hits, lambda x: x.isNotNull())))

    group = [*keys, "_column", "_pos"]
    counted = settle(values.groupBy(*group, "_v").agg(F.count("*").alias("_c")), "inside")
    sizes = counted.groupBy(*group).agg(F.sum("_c").alias("_inside"), F.count("*").alias("_distinct"))
    checked = settle(
        brackets.join(counted_below, group).join(sizes, group, "left")
        .withColumn("_hit", (F.col("_below") <= F.floor("_at")) & (F.ceil("_at") < F.col("_below") + F.coalesce("_inside", F.lit(0)))),
        "ranks",
    )
    both = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))
    most, missed = checked.agg(F.max(F.when(F.col("_hit"), F.col("_distinct"))), F.count_if(~F.col("_hit"))).first()
    ranks = checked.filter("_hit").select(*group, "_at", both.alias("_rank"), "_below")
    ranks = ranks.select(*group, "_at", (F.col("_rank") - F.col("_below")).alias("_rank"))
    each = _selected(counted, ranks, group, most or 0)
    if missed:
        again = checked.filter("NOT _hit")
        points = narrow.unpivot(keys, columns, "_column", "_v").filter("_v is not null")
        all_values = points.join(again.select(*group), [*keys, "_column"]).groupBy(*group, "_v").agg(F.count("*").alias("_c"))
        each = each.unionByName(_selected(all_values, again.select(*group, "_at", both.alias("_rank")), group, WINDOW_VALUES + 1))

    listed = [
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_column") == c, F.struct("_pos", "_q")))),
            lambda s: s["_q"],
        ).alias(c)
        for c in columns
    ]
    answers = each.groupBy(*keys).agg(*listed)
    filled = [F.when(F.size(c) > 0, F.col(c)).alias(f"q_{c}") for c in columns]
    if not keys:
        return answers.select(*filled)
    # Keys whose values are all missing.
    every = df.select(*keys).distinct()
    return every.join(answers, keys, "left").select(*keys, *filled)
