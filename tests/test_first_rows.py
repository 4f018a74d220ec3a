"""The first row per sku is chosen before texts of parts and suppliers are joined."""

import datetime

import pytest

from predio.operators import dedup
from predio.plans import catalogue
from predio.sources import listing_store, snapshots, star

_DAY = datetime.date(2024, 5, 6)


@pytest.fixture
def tables(spark, folder):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    line = lambda order, number, part, supplier, price: (order, number, part, supplier, 4.0, price, "A", "F", _DAY)
    write(
        "lineitem",
        [
            line(1, 1, 99, 9, 5.0), line(1, 1, 2, 9, 6.0), line(1, 1, 2, 9, 7.0),  # the first row has no part
            line(2, 1, 1, 99, 5.0), line(2, 1, 3, 1, 8.0),  # the first row has no supplier
            line(3, 1, 1, 2, 9.0), line(3, 1, 1, 2, 9.0),
            line(None, 1, 1, 1, 3.0), line(4, None, 1, 9, 4.0),  # missing skus are one
            line(5, 1, None, 9, 1.0), line(6, 1, 1, None, 1.0),
        ],
        "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
        " l_returnflag string, l_linestatus string, l_shipdate date",
    )
    parts = [(k, f"red fir {k}", "B", "T", 7) for k in (1, 2, 3, None)]
    write("part", [*parts, parts[0]], "p_partkey long, p_name string, p_brand string, p_type string, p_size long")
    write("supplier", [(k, f"S{k}", 1, 10.0) for k in (1, 2, 9, 9)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")
    write("nation", [(1, "N", 1), (2, "M", 1)], "n_nationkey long, n_name string, n_regionkey long")
    write("region", [(1, "R")], "r_regionkey long, r_name string")
    return folder


def test_first_rows_equal_those_of_the_whole_join(spark, tables):
    got = catalogue.listings(spark, tables)
    whole = dedup.keep_first(star.read_listings(spark, tables), star.SNAPSHOT_ORDER).drop(*star.SNAPSHOT_ORDER)
    assert got.columns == whole.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    assert {(r.sku, r.price) for r in got.collect()} == {("1-1", 1200.0), ("2-1", 1600.0), ("3-1", 1800.0), (None, 800.0)}


def test_no_text_of_a_part_is_shuffled_by_sku(spark, tables):
    plan = catalogue.listings(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "p_name" not in below[: below.index("Relation")]


def test_no_sku_is_shuffled_as_text(spark, tables):
    plan = catalogue.listings(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "concat(" not in below[: below.index("Relation")]


def test_rows_without_a_sku_keep_their_numbers(spark, tables):
    first = dedup.keep_first(star.read_rows(spark, tables), star.ROW_ORDER, star.ROW_KEY)
    rows = star.with_attributes(first, tables).filter("sku is null").collect()
    assert [(r.link, r.habitaciones) for r in rows] == [("u/4", None)]


def test_snapshots_are_compressed_and_keep_their_order(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "FILE_RECORDS", 2)
    raw = star.read_listings(spark, tables)
    paths = star.write_snapshots(raw, str(tmp_path / "snapshots"))
    files = [f for f in (tmp_path / "snapshots").rglob("*.json*") if not f.name.startswith(".")]
    assert len(files) >= raw.count() / 2 and all(f.name.endswith(".json.gz") for f in files)
    got = snapshots.load_listings(spark, *paths)
    want = catalogue.listings(spark, tables)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_store_reads_the_keys_of_a_snapshot_then_its_records(spark, tables, tmp_path, monkeypatch):
    """No table of whole records is stored but the one of new records; missing keys are known too."""
    made, real = [], listing_store.settle
    monkeypatch.setattr(listing_store, "settle", lambda df, label="table": made.append(df.columns) or real(df, label))
    store, raw = str(tmp_path / "store"), star.read_listings(spark, tables)
    listing_store.create(spark, store)
    paths = star.write_snapshots(raw, str(tmp_path / "snapshots"))
    added = [listing_store.add_snapshot(spark, store, p) for p in [*paths, paths[0], paths[-1]]]
    assert sum(added) == 4 and added[-2:] == [0, 0]
    assert made and all(c == ["sku"] for c in made)
    want = catalogue.listings(spark, tables)
    got = listing_store.read_store(spark, store).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_text_of_a_part_is_shuffled_by_supplier(spark, tables):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = catalogue.listings(spark, tables)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(limit, before)
    at, exchange = next((i, x) for i, x in enumerate(plan) if "Exchange hashpartitioning(l_suppkey" in x)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(exchange):
            break
        below.append(line)
    assert below and not [x for x in below if "p_name" in x]


def test_suppliers_are_counted_as_large_as_their_files(spark, tables):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100000")  # more than each file, less than their product
    try:
        plan = catalogue.listings(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert any("l_suppkey" in x and "s_suppkey" in x for x in plan.splitlines() if "BroadcastHashJoin" in x)


def test_flags_are_shuffled_as_a_number(spark, tables):
    rows = star.read_rows(spark, tables)
    assert not [c for c, kind in rows.dtypes if kind == "string"]
    kinds = [(a, b) for a in ("A", "R", "N", None) for b in ("F", "O", None)]
    lines = [(100 + i, 1, 1, 1, 4.0, 5.0, a, b, _DAY) for i, (a, b) in enumerate(kinds)]
    schema = spark.read.parquet(f"{tables}/lineitem.parquet").schema
    spark.createDataFrame(lines, schema).write.mode("append").parquet(f"{tables}/lineitem.parquet")
    got = {r.sku: (r.tipo_inmueble, r.tipo_oferta, r.m2_terreno) for r in catalogue.listings(spark, tables).collect()}
    want = {r.sku: (r.tipo_inmueble, r.tipo_oferta, r.m2_terreno) for r in star.read_listings(spark, tables).collect()}
    for i, _ in enumerate(kinds):
        assert got[f"{100 + i}-1"] == want[f"{100 + i}-1"]


def test_flags_are_joined_as_a_number(spark, tables):
    """Rows shuffled by part hold no text of a line: the two flags are one number until the joins are done."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = catalogue.clean(spark, tables)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(limit, before)
    at = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(l_partkey" in x)
    rows = next(x for x in plan[at:] if "Project [" in x)
    assert "flags#" in rows and "l_returnflag" not in rows and "l_linestatus" not in rows


def test_snapshots_are_shuffled_as_short_rows(spark, tables, tmp_path, monkeypatch):
    """Listings are made of rows in their places: the shuffle has no text that is made of others, the result is the same."""
    given, real = [], star.write_snapshots
    monkeypatch.setattr(star, "write_snapshots", lambda rows, *a: given.append(rows) or real(rows, *a))
    monkeypatch.setattr(star, "FILE_RECORDS", 2)
    got = catalogue.load_snapshots(spark, tables)
    assert not {"sku", "link", "descripcion", "sub_category", "agent", "divisa"} & set(given[0].columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, catalogue.dedup_listings(spark, tables).collect()))
    raw = star.read_listings(spark, tables)
    made = star.listings_of(given[0])
    same = [c for c in raw.columns if not c.startswith("ord")]
    assert sorted(map(repr, made.select(*same).collect())) == sorted(map(repr, raw.select(*same).collect()))


def test_written_snapshots_are_in_order(spark, tables, tmp_path):
    """Tasks hold ranges of the order, each with rows of all snapshots; files of a snapshot follow one another."""
    schema = spark.read.parquet(f"{tables}/lineitem.parquet").schema
    lines = [(100 + i, 1, i % 3 + 1, (1, 2, 9)[i % 5 % 3], 4.0, float(i * 7 % 60), "A", "F", _DAY) for i in range(60)]
    spark.createDataFrame(lines, schema).write.mode("append").parquet(f"{tables}/lineitem.parquet")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        paths = star.write_snapshots(star.read_joined(spark, tables), str(tmp_path / "s"), star.ROW_ORDER, star.listings_of)
    finally:
        spark.conf.set(coalesce, before)
    want = star.read_listings(spark, tables).collect()
    assert paths == [f"{tmp_path}/s/snapshot_id={i}" for i in sorted({r.snapshot_id for r in want})]
    several = 0
    for path in paths:
        rows = snapshots.read_snapshot(spark, path).orderBy("file", "block", "row").collect()
        several += len({r.file for r in rows}) > 1
        own = sorted((r for r in want if path.endswith(f"={r.snapshot_id}")), key=lambda r: (r.ord1, r.ord2, r.ord3))
        assert [(r.price, r.autos) for r in rows] == [(r.price, r.autos) for r in own]
    assert several
