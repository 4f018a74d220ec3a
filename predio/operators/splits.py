"""Deterministic train/test splits and folds by the md5 of a row key.

The default split and folds compare hashes with a constant: no shuffle at all.  The
exact-size variants need the row at given ranks of the md5 order.  They never sort a
whole group: md5 spreads a group evenly over 65 536 buckets (its first four hex digits),
bucket counts locate the bucket of each rank, and only the rows of those buckets are
ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from predio.operators.numbering import number_rows
from predio.scale import settle
from predio.schema import KEY

_HEX = 4
_BUCKETS = 16**_HEX


def row_hash(key: str = KEY, seed: int | None = None) -> Column:
    """The md5 that orders rows; rows without a key count as one key, the empty text."""
    value = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.md5(value if seed is None else F.concat(F.lit(f"{seed}:"), value))


def _position(key: str, seed: int | None) -> Column:
    """The first 32 bits of the hash as a number."""
    return F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint")


def _checked(share: float) -> float:
    if not 0 <= share <= 1:
        raise ValueError(f"a share lies between 0 and 1, not {share}")
    return share


def hash_split(df: DataFrame, share: float, key: str = KEY, seed: int | None = None) -> DataFrame:
    """Add ``is_test``, true for about ``share`` (0 to 1) of the rows; no shuffle."""
    cut = math.ceil(_checked(share) * 16**8)
    return df.withColumn("is_test", _position(key, seed) < F.lit(cut).cast("bigint"))


def hash_folds(df: DataFrame, k: int, key: str = KEY, seed: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1, of about equal sizes; no shuffle."""
    return df.withColumn("fold", (_position(key, seed) * k / F.lit(16**8)).cast("int"))


def _cuts(
    hashes: DataFrame, groups: list[str], ranks: Callable[[Column], list[Column]]
) -> DataFrame:
    """Per group, array ``_cuts`` of the hashes at the 1-based ranks of the md5 order.

    ``ranks`` maps the group size to the wanted ranks; rank 0 gives the empty string,
    which lies before every hash.
    """
    bucket = F.substring("_h", 1, _HEX)
    counts = settle(
        hashes.groupBy(*groups, bucket.alias("_b")).agg(F.count("*").alias("_c")), "buckets"
    )
    until = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_b"))
    sizes = counts.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    wanted = sizes.select(
        *groups,
        F.posexplode(F.array(*[r.cast("bigint") for r in ranks(F.col("_n"))])).alias("_j", "_rank"),
    )
    spans = counts.withColumn("_until", until).withColumn("_from", F.col("_until") - F.col("_c"))
    if not groups:
        groups, wanted, spans = ["_g"], wanted.withColumn("_g", F.lit(0)), spans.withColumn("_g", F.lit(0))
        hashes = hashes.withColumn("_g", F.lit(0))
    wanted = settle(wanted, "ranks")
    located = settle(
        spans.join(wanted, groups)
        .filter("_rank > _from and _rank <= _until")
        .select(*groups, "_b", "_j", (F.col("_rank") - F.col("_from")).alias("_within")),
        "located",
    )
    # Only the buckets that hold a cut are ranked.
    in_bucket = Window.partitionBy(*groups, "_b").orderBy("_h")
    ranked = (
        hashes.withColumn("_b", bucket).join(settle(located.select(*groups, "_b").distinct(), "cut_buckets"), [*groups, "_b"], "left_semi")
        .withColumn("_within", F.row_number().over(in_bucket).cast("bigint"))
        .join(located, [*groups, "_b", "_within"])
        .select(*groups, "_j", F.col("_h").alias("_cut"))
    )
    cuts = wanted.join(ranked, [*groups, "_j"], "left").groupBy(*groups).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_j", F.coalesce("_cut", F.lit("")).alias("_cut")))),
            lambda s: s["_cut"],
        ).alias("_cuts")
    )
    return settle(cuts, "cuts")


def _with_cuts(
    df: DataFrame, segment: str | None, key: str, seed: int | None, ranks
) -> DataFrame:
    df = df.withColumn("_h", row_hash(key, seed))
    if segment is None:
        cuts = _cuts(df.select("_h"), [], ranks).first()
        values = cuts["_cuts"] if cuts else []
        return df.withColumn("_cuts", F.lit(values).cast("array<string>"))
    narrow = df.select(segment, "_h").filter(F.col(segment).isNotNull())
    return df.join(_cuts(narrow, [segment], ranks), [segment], "left")


def exact_split(
    df: DataFrame, share: float, key: str = KEY, segment: str | None = None, seed: int | None = None
) -> DataFrame:
    """Add ``is_test`` for exactly ceil(n * share) rows, overall or of each segment.

    ``key`` must be unique; rows without a key count as one key and go to the same side.  Rows
    without a segment get NULL.
    """
    _checked(share)
    cut = _with_cuts(df, segment, key, seed, lambda n: [F.ceil(n * F.lit(share))])
    return cut.select(*df.columns, (F.col("_h") <= F.col("_cuts")[0]).alias("is_test"))


def exact_folds(
    df: DataFrame, k: int, key: str = KEY, segment: str | None = None, seed: int | None = None
) -> DataFrame:
    """Add ``fold`` in 0..k-1: contiguous blocks of the hash order, sizes as ``ntile(k)``."""

    def block_ends(n):
        return [F.floor(n / k) * j + F.least(F.lit(j), n % k) for j in range(1, k)]

    cut = _with_cuts(df, segment, key, seed, block_ends)
    fold = F.size(F.filter("_cuts", lambda c: c < F.col("_h")))
    return cut.select(*df.columns, F.when(F.col("_cuts").isNotNull(), fold).alias("fold"))


def ordered_folds(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Add ``fold`` in 0..k-1: contiguous blocks of the rows in the order of ``order``, unshuffled.

    Sizes differ by one at most, the larger blocks first.  Rows that tie in ``order`` may fall to
    either side of a block's end.  An empty table gives an empty table.
    """
    if k < 1:
        raise ValueError("at least one fold is needed")
    numbered = number_rows(df, order, "_number")
    n = numbered.count()
    small, larger = n // k, n % k
    edge = larger * (small + 1)  # the rows of the larger blocks
    number = F.col("_number")
    fold = F.when(number < edge, F.floor(number / (small + 1))).otherwise(
        larger + F.floor((number - edge) / max(small, 1))
    )
    return numbered.withColumn("fold", fold.cast("int")).drop("_number")
