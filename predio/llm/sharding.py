"""Shards that all have the mixture of the sources, by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked there.  A row of rank r
among n gets the fraction (r + 0.5) / n; sorted by fraction every stretch of rows holds the
sources in proportion, and the sorted rows are cut into shards of equal counts.

Ranks are taken over range partitions, so a source may hold any share of the rows: each
sorted partition numbers its own rows, and counts of the partitions before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from predio.llm.frames import without
from predio.scale import settle

_INNER = ["_part", "_at", "_h", "_f", "_n", "_first", "_before"]


def shuffle_hash(key: str, seed: int) -> Column:
    """The md5 that orders a source's rows; a missing key counts as the text ``null``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def _numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Stored rows in the order, with their range partition ``_part`` and place ``_at`` in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # partition number and place in the partition
    rows = rows.withColumn("_at", number)
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    return settle(rows, label)


def stratified_shards(
    df: DataFrame, shards: int, source: str = "source", key: str = "doc_id", seed: int = 0
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1, counts at most one apart) and ``slot`` (0, 1, … in it).

    Rows without a source form a source of their own; rows that share a key and repeated rows keep
    an arbitrary order among themselves and each get a slot of their own; texts are not looked at.
    An empty table gives an empty table.  Columns of ``df`` named ``shard`` or ``slot`` are
    replaced, and so are those named like the operator's inner ones.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = without(df, ["shard", "slot", *_INNER]).withColumn("_h", shuffle_hash(key, seed))
    kept = [c for c in rows.columns if c != "_h"]
    rows = _numbered(rows, [source, "_h", key], "in_source")
    # A source's rows in a partition stand together: one row per source and partition.
    runs = rows.groupBy(source, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col(source).alias("_source"),
        F.col("_part").alias("_run"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(source)).alias("_n"),
    )
    runs = settle(runs, "runs")
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    placed = rows.join(runs, (F.col("_part") == F.col("_run")) & F.col(source).eqNullSafe(F.col("_source"))).select(
        *kept, "_h", ((rank + F.lit(0.5)) / F.col("_n")).alias("_f")
    )
    placed = _numbered(placed, ["_f", "_h", key], "interleaved")
    # One row per range partition.
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total, before, at = sum(counts.values()), {}, 0
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    spark = df.sparkSession
    offsets = spark.createDataFrame(sorted(before.items()), "_part bigint, _before bigint")
    position = F.col("_at") + F.col("_before")
    shard = F.expr(f"(_position * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_position", position)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_position") - first)
        .select(*kept, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Write one folder ``shard=k`` per shard, rows in slot order; files hold at most ``file_rows`` rows."""
    piece = F.floor(F.col("slot") / file_rows)
    (
        sharded.withColumn("_piece", piece)
        .repartition("shard", "_piece")
        .sortWithinPartitions("shard", "slot")
        .drop("_piece")
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", file_rows)
        .parquet(path)
    )
