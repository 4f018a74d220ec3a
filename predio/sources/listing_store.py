"""First records of all snapshots so far, kept as stored tables that a new snapshot is added to.

A store is a folder with

``records/load=…``  the records that a snapshot was the first to have, in that snapshot's columns,
``keys/load=…``     their keys,
``bits/load=…``     a bitmap of the hashes of all keys up to that snapshot, in buckets of 32768 bits,
``log``             one row per added snapshot, in order: its load, rows and size of the bitmap.

Adding a snapshot reads that snapshot, first its keys and then its records.  Keys whose bit is not set are new; only if other keys are
left are they looked up in ``keys``.  Records and older snapshot files are never read again.  The log
row is written last, so a load that was broken off counts for nothing and can be repeated.
One writer at a time may add to a store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from predio.operators.dedup import append, keep_first
from predio.scale import settle
from predio.schema import KEY, LISTING_SCHEMA
from predio.sources.snapshots import ROW_ORDER, read_snapshot

#: Bits of the bitmap per key, at least; the size is doubled before they are fewer.
BITS_PER_KEY = 8
_BUCKET = 32768  # bits of one bitmap of Spark's
_LOG = "position long, load string, n long, total long, buckets long"


def create(spark: SparkSession, store: str) -> None:
    """An empty store in the new folder ``store``."""
    spark.createDataFrame([], _LOG).write.parquet(f"{store}/log")


def _log(spark: SparkSession, store: str) -> list:
    """Rows of the log, one per added snapshot, in order."""
    return spark.read.schema(_LOG).parquet(f"{store}/log").orderBy("position").collect()


def _place(key: str, buckets: int) -> tuple[Column, Column]:
    """Bucket and bit of a key, a missing one included."""
    place = F.pmod(F.xxhash64(key), F.lit(buckets * _BUCKET))
    return F.floor(place / _BUCKET).alias("_bucket"), (place % _BUCKET).alias("_bit")


def _bitmap(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    return keys.select(*_place(key, buckets)).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _possible(keys: DataFrame, bits: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of ``keys`` whose bit is set."""
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    both = keys.select(key, *_place(key, buckets)).join(bits, "_bucket")
    return both.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(key)


def _known(spark: SparkSession, store: str, log: list, fresh: DataFrame, key: str) -> DataFrame | None:
    """The keys of ``fresh`` that the store, which has some, has too; None if it has none of them."""
    last = log[-1]
    bits = spark.read.parquet(f"{store}/bits/load={last['load']}")
    # Most keys of a snapshot are new: their bits are looked up as they are read, and only the others are gathered.
    possible = settle(_possible(fresh, bits, key, last["buckets"]).distinct(), "possible")
    if possible.isEmpty():
        return None
    # Both sides have a key once, so no key is hot.
    stored = _stored_keys(spark, store, log)
    return settle(possible.join(stored, possible[key].eqNullSafe(stored[key]), "left_semi"), "known")


def _stored_keys(spark: SparkSession, store: str, log: list) -> DataFrame:
    return spark.read.parquet(*[f"{store}/keys/load={r['load']}" for r in log])


def add_snapshot(
    spark: SparkSession,
    store: str,
    path: str,
    key: str = KEY,
    schema: T.StructType = LISTING_SCHEMA,
    layout: str = "lines",
    longitude: str = "long",
) -> int:
    """Add the records of a snapshot whose key the store has not yet; their number.

    Within the snapshot the first record per key counts; a missing key is one key.  ``schema``, ``layout`` and
    ``longitude`` are those of ``read_snapshot``.  An empty snapshot adds nothing, one added again neither.
    """
    log, load = _log(spark, store), uuid.uuid4().hex
    order = [c for c in ROW_ORDER if c != "snapshot_id"]
    read = read_snapshot(spark, path, schema, layout, longitude)
    known = None
    if log and log[-1]["total"]:
        # Only the key is taken from a record here; a column-oriented file has its records in all columns.
        short = schema if layout == "columns" else T.StructType([schema[key]])
        known = _known(spark, store, log, read_snapshot(spark, path, short, layout, longitude).select(key), key)
    new = keep_first(read, order, key).drop(*order)
    if known is not None:
        # An equality keeps the rows where the choice of the first one has put them; it never holds for a missing key.
        missing_known = not known.filter(F.col(key).isNull()).isEmpty()
        new = new.join(known, key, "left_anti")
        if missing_known:
            new = new.filter(F.col(key).isNotNull())
    new.write.parquet(f"{store}/records/load={load}")

    records = spark.read.schema(new.schema).parquet(f"{store}/records/load={load}")
    records.select(key).write.parquet(f"{store}/keys/load={load}")
    keys = spark.read.schema(records.select(key).schema).parquet(f"{store}/keys/load={load}")
    n = keys.count()
    total, buckets = n, 1
    if log:
        total, buckets = total + log[-1]["total"], log[-1]["buckets"]
    grown = buckets
    while grown * _BUCKET < BITS_PER_KEY * total:
        grown *= 2
    if grown > buckets and log:
        # All keys are hashed again; doubling makes that rare.
        keys = append([_stored_keys(spark, store, log), keys])
    bits = _bitmap(keys, key, grown)
    if grown == buckets and log:
        old = spark.read.parquet(f"{store}/bits/load={log[-1]['load']}")
        bits = bits.unionByName(old).groupBy("_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    bits.write.parquet(f"{store}/bits/load={load}")
    entry = spark.createDataFrame([(len(log), load, n, total, grown)], _LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{store}/log")
    return n


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All records of a store: the first per key over its snapshots in the order they were added.

    Columns that a snapshot lacks are NULL in its records; a store without snapshots is an error.
    """
    log = _log(spark, store)
    if not log:
        raise ValueError("the store has no snapshot yet")
    return append([spark.read.parquet(f"{store}/records/load={r['load']}") for r in log])
