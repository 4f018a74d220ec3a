"""Descriptive reports, each from one partially aggregated pass."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F, types as T

from predio.functions.nulls import is_floating, is_missing
from predio.operators.quantiles import exact_quantiles
from predio.scale import settle
from predio.schema import OUTLIER_COLUMNS, SEGMENT, column_role, require_columns


def missing_report(df: DataFrame, share: bool = True) -> DataFrame:
    """Columns with missing values, most first: ``(column, missing)``.

    ``share`` gives the fraction rounded half-even to 2 digits (shares that round to 0
    are left out), otherwise the count.
    """
    counts = [F.count_if(is_missing(f)).alias(f.name) for f in df.schema.fields]
    report = df.agg(F.count("*").alias("_n"), *counts).unpivot(
        ["_n"], df.columns, "column", "missing"
    )
    if share:
        report = report.withColumn("missing", F.bround(F.try_divide("missing", "_n"), 2))
    return report.drop("_n").filter("missing > 0").orderBy(F.desc("missing"), "column")


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """``(column, dtype, role, n_missing, n_distinct)`` of every column.

    Distinct counts are HyperLogLog estimates in one pass unless ``exact``.  Exact ones come from
    two 64-bit hashes per value, made distinct in the map tasks and counted per column: no text is
    shuffled, and with n values in a column the odds of a mistake are n² / 2^129.
    """
    values = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if is_floating(f):
            value = F.when(~F.isnan(value), value)
        elif isinstance(f.dataType, T.ArrayType):
            value = F.to_json(value)
        values.append(value)
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count_if(is_missing(f)).alias(f"m{i}"))
        if not exact:
            aggs.append(F.approx_count_distinct(values[i]).alias(f"d{i}"))
        rows.append(
            F.struct(
                F.lit(i).alias("at"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(column_role(f)).alias("role"),
                F.col(f"m{i}").alias("n_missing"),
                (F.lit(0).cast("bigint") if exact else F.col(f"d{i}")).alias("n_distinct"),
            )
        )
    profile = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if not exact:
        return profile.drop("at")
    hashed = [
        F.when(v.isNotNull(), F.struct(F.lit(i).alias("at"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit("b"), v).alias("b")))
        for i, v in enumerate(values)
    ]
    each = df.select(F.inline(F.filter(F.array(*hashed), lambda h: h.isNotNull())))
    counts = each.distinct().groupBy("at").agg(F.count("*").alias("n"))
    return profile.join(counts, "at", "left").select(
        "column", "dtype", "role", "n_missing", F.coalesce("n", "n_distinct").alias("n_distinct")
    )


def segment_sizes(df: DataFrame, segment: str = SEGMENT) -> DataFrame:
    """Rows per segment, largest first; missing segments are not counted."""
    return (
        df.filter(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), segment)
    )


def large_segments(df: DataFrame, more_than: int = 50, segment: str = SEGMENT) -> DataFrame:
    return segment_sizes(df, segment).filter(F.col("n") > more_than)


def small_segments(df: DataFrame, at_most: int = 50, segment: str = SEGMENT) -> DataFrame:
    return segment_sizes(df, segment).filter(F.col("n") <= at_most)


def describe(df: DataFrame, columns) -> DataFrame:
    """Count, mean, sample deviation and five-number summary, rounded half-even.

    One row per column.  Quartiles are exact at any size (see ``exact_quantiles``).
    """
    columns = require_columns(df, columns)
    narrow = settle(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "narrow")
    moments = narrow.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    quartiles = exact_quantiles(narrow, columns, [0.25, 0.5, 0.75])
    # Both sides are global aggregates, hence exactly one row each.
    both = moments.withColumn("_one", F.lit(1)).join(quartiles.withColumn("_one", F.lit(1)), "_one")

    def row(c):
        m, q = F.col(c), F.col(f"q_{c}")
        stats = {
            "mean": m["mean"], "std": m["std"], "min": m["min"],
            "p25": q[0], "p50": q[1], "p75": q[2], "max": m["max"],
        }
        return F.struct(
            F.lit(c).alias("column"),
            m["count"].alias("count"),
            *[F.bround(v, 0).alias(k) for k, v in stats.items()],
        )

    return both.select(F.inline(F.array(*[row(c) for c in columns])))


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlations over pairwise complete rows, as ``(a, b, r)``; one aggregate."""
    columns = list(columns or OUTLIER_COLUMNS)
    pairs = list(combinations(columns, 2))
    wide = df.agg(
        *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    )

    def entry(a, b, r):
        return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r"))

    entries = []
    for i, (a, b) in enumerate(pairs):
        entries += [entry(a, b, F.col(f"r{i}")), entry(b, a, F.col(f"r{i}"))]
    for i, c in enumerate(columns):  # 1 unless the column is constant or empty
        entries.append(entry(c, c, F.when(F.col(f"v{i}") > 0, F.lit(1.0))))
    return wide.select(F.inline(F.array(*entries)))
