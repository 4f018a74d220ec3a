"""Snapshots added one at a time against the deduplication of all of them."""

import json
import os
import random

import pytest
from pyspark.sql import types as T

from predio.sources import listing_store, snapshots

SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("sku", T.StringType()), ("price", T.DoubleType()), ("lng", T.DoubleType())]])


def _write(path, records):
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n")
    return str(path)


def _rows(df):
    return sorted(map(tuple, df.select("sku", "price").collect()), key=str)


def test_added_snapshots_equal_the_full_dedup(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    paths, every = [], []
    for k in range(4):
        # Keys come again, within and across snapshots; one is a third of all rows, some are missing.
        keys = [rng.choice(["hot", "hot", f"s{rng.randrange(150)}", f"s{rng.randrange(60 * (k + 1))}", f"n{k}-{rng.random()}", None]) for _ in range(200)]
        paths.append(_write(tmp_path / f"{k}.json", [{"sku": s, "price": k * 1000 + i} for i, s in enumerate(keys)]))
        every.append(set(keys))
    # A small bitmap, so that it grows between loads and unset bits, set bits and false hits occur.
    monkeypatch.setattr(listing_store, "_BUCKET", 128)
    store = str(tmp_path / "store")
    listing_store.create(spark, store)
    seen = set()
    for k, path in enumerate(paths):
        assert listing_store.add_snapshot(spark, store, path, schema=SCHEMA) == len(every[k] - seen)
        seen |= every[k]
        os.remove(path) if k < 3 else None  # older files are never read again
    for k, path in enumerate(paths[:3]):
        assert not os.path.exists(path)
    got = _rows(listing_store.read_store(spark, store))
    first = {}
    for k in range(4):
        for s in every[k]:
            first.setdefault(s, k)
    assert {s: int(p // 1000) for s, p in got} == first and len(got) == len(seen)
    log = listing_store._log(spark, store)
    assert [r["position"] for r in log] == [0, 1, 2, 3] and log[-1]["buckets"] > log[0]["buckets"]
    assert log[-1]["total"] == len(seen) and log[-1]["buckets"] * 128 >= 8 * len(seen)


def test_equal_to_load_listings(spark, tmp_path):
    one = _write(tmp_path / "1.json", [{"sku": "a", "price": 1, "long": -103.5}, {"sku": "a", "price": 2}, {"sku": None, "price": 3}])
    two = _write(tmp_path / "2.json", [{"sku": None, "price": 9}, {"sku": "b", "price": 8, "other": 5}, {"sku": "a", "price": 7}])
    none = tmp_path / "3.json"
    none.write_text("")
    wider = T.StructType([*SCHEMA.fields, T.StructField("other", T.IntegerType())])
    store = str(tmp_path / "store")
    listing_store.create(spark, store)
    with pytest.raises(ValueError):
        listing_store.read_store(spark, store)
    assert listing_store.add_snapshot(spark, store, str(none), schema=SCHEMA) == 0
    assert listing_store.add_snapshot(spark, store, one, schema=SCHEMA) == 2
    assert listing_store.add_snapshot(spark, store, two, schema=wider) == 1
    assert listing_store.add_snapshot(spark, store, two, schema=wider) == 0
    full = snapshots.load_listings(spark, one, two, schema={one: SCHEMA, two: wider})
    got = listing_store.read_store(spark, store)
    assert sorted(map(str, got.select(*full.columns).collect())) == sorted(map(str, full.collect()))
    assert got.columns == full.columns


def test_a_broken_load_counts_for_nothing(spark, tmp_path, monkeypatch):
    one = _write(tmp_path / "1.json", [{"sku": "a", "price": 1}])
    two = _write(tmp_path / "2.json", [{"sku": "a", "price": 5}, {"sku": "b", "price": 6}])
    store = str(tmp_path / "store")
    listing_store.create(spark, store)
    listing_store.add_snapshot(spark, store, one, schema=SCHEMA)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(listing_store, "_bitmap", broken)
        with pytest.raises(RuntimeError):
            listing_store.add_snapshot(spark, store, two, schema=SCHEMA)
    assert _rows(listing_store.read_store(spark, store)) == [("a", 1.0)]
    assert listing_store.add_snapshot(spark, store, two, schema=SCHEMA) == 1
    assert _rows(listing_store.read_store(spark, store)) == [("a", 1.0), ("b", 6.0)]


def test_only_keys_are_taken_from_records_to_look_them_up(spark, tmp_path, monkeypatch):
    one = _write(tmp_path / "1.json", [{"sku": "a", "price": 1}, {"sku": "b", "price": 2}])
    two = _write(tmp_path / "2.json", [{"sku": "b", "price": 5}, {"sku": "c", "price": 6}])
    read, real = [], listing_store.read_snapshot
    monkeypatch.setattr(listing_store, "read_snapshot", lambda s, path, schema, *a: read.append(schema.names) or real(s, path, schema, *a))
    made, settle = [], listing_store.settle
    monkeypatch.setattr(listing_store, "settle", lambda df, label="table": made.append(label) or settle(df, label))
    store = str(tmp_path / "store")
    listing_store.create(spark, store)
    assert listing_store.add_snapshot(spark, store, one, schema=SCHEMA) == 2
    assert read == [SCHEMA.names] and not made  # an empty store knows no key
    assert listing_store.add_snapshot(spark, store, two, schema=SCHEMA) == 1
    assert sorted(read[1:], key=len) == [["sku"], SCHEMA.names]
    assert _rows(listing_store.read_store(spark, store)) == [("a", 1.0), ("b", 2.0), ("c", 6.0)]
