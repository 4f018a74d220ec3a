"""The ``listings`` relation derived from the star-schema Parquet tables.

``sku`` repeats across snapshots, as it does when the same listing is scraped twice;
``snapshot_id, ord1, ord2, ord3`` give every row a place in its snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from predio.scale import settle

SNAPSHOT_ORDER = ["snapshot_id", "ord1", "ord2", "ord3"]


_SKU = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as sku"
_SNAPSHOT = "l_suppkey % 9 as snapshot_id"
#: ``SNAPSHOT_ORDER`` among the columns of ``read_rows``.
ROW_ORDER = ["snapshot_id", "l_partkey", "l_suppkey", "l_extendedprice"]
#: ``sku`` among the columns of ``read_rows``, as numbers: both are missing where it is.
ROW_KEY = ["sku_order", "sku_line"]
_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: The two flags as one number, which tells the values that ``_listings`` tells; its rows are shorter than with texts.
_FLAGS = (
    "cast(case l_returnflag when 'A' then 0 when 'R' then 2 else 4 end"
    " + case l_linestatus when 'F' then 0 else 1 end as tinyint) as flags"
)
_FLAG_TEXTS = [
    "case flags div 2 when 0 then 'A' when 1 then 'R' end as l_returnflag",
    "case flags % 2 when 0 then 'F' end as l_linestatus",
]
_NUMBERS = [
    "if(l_linenumber is null, null, l_orderkey) as sku_order",
    "if(l_orderkey is null, null, l_linenumber) as sku_line",
    "if(l_orderkey is null or l_linenumber is null, struct(l_orderkey, l_linenumber), null) as without_sku",
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _table(spark, folder, "supplier")
        .join(_table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(_table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    )


def _with_partner(rows: DataFrame, column: str, partners: DataFrame, key: str) -> DataFrame:
    """The rows whose value of ``column`` is a ``key`` of ``partners``; only the values without one are sent around."""
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    lost = settle(values.join(partners, values[column] == partners[key], "left_anti"), "lost")
    return rows.filter(F.col(column).isNotNull()).join(lost, column, "left_anti")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_listings`` by what names and orders them: ``ROW_KEY``, ``ROW_ORDER`` and few numbers.

    ``with_attributes`` adds the rest, after the first row per sku is chosen: no text of a part or supplier is
    shuffled for that, nor the sku's.
    """
    rows = _table(spark, folder, "lineitem").selectExpr(*_LINE, _FLAGS, *_NUMBERS, _SNAPSHOT)
    rows = _with_partner(rows, "l_partkey", _table(spark, folder, "part"), "p_partkey")
    return _with_partner(rows, "l_suppkey", _suppliers(spark, folder), "s_suppkey")


def with_attributes(rows: DataFrame, folder: str) -> DataFrame:
    """The listings of chosen rows, one for each: of parts or suppliers that share a key, one is taken.

    Suppliers come first and parts last, so no text of a part is shuffled by supplier.  The suppliers' size is known
    from their files, so that Spark can send them to every task: joined with nation and region they would count as the
    product of all three.  The flags become texts only after all joins.
    """
    spark = rows.sparkSession
    part = _table(spark, folder, "part").dropDuplicates(["p_partkey"])
    nations = _table(spark, folder, "nation").join(_table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    nations = nations.select("n_nationkey", "n_name", "r_name").dropDuplicates(["n_nationkey"])
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    located = F.expr("s_nationkey = n_nationkey")
    suppliers = suppliers.join(nations.select("n_nationkey"), located, "left_semi").dropDuplicates(["s_suppkey"])
    rows = rows.selectExpr(
        *_LINE, "flags", "coalesce(sku_order, without_sku.l_orderkey) as l_orderkey",
        "coalesce(sku_line, without_sku.l_linenumber) as l_linenumber",
    )
    joined = rows.join(suppliers, F.expr("l_suppkey = s_suppkey")).join(part, F.expr("l_partkey = p_partkey"))
    return _listings(joined.join(nations, located).selectExpr("*", *_FLAG_TEXTS))


def read_listings(spark: SparkSession, folder: str) -> DataFrame:
    joined = (
        _table(spark, folder, "lineitem")
        .join(_table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
        .join(_table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(_table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(_table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return _listings(joined)


_RECORD = [
    "case l_returnflag when 'A' then 'Casa' when 'R' then 'Departamento' else 'Oficina' end"
    " as tipo_inmueble",
    "case l_linestatus when 'F' then 'Venta' else 'Renta' end as tipo_oferta",
    "case when l_orderkey % 97 = 0 then null when n_nationkey = 0 then 'Nuevo Vallarta'"
    " else n_name end as colonia",
    "case l_linestatus when 'F' then l_extendedprice * 200 else l_extendedprice * 2 end as price",
    "case when l_partkey % 61 = 0 then 0D when l_returnflag = 'R' or l_partkey % 89 = 0 then null"
    " else cast(p_size * 10 as double) end as m2_terreno",
    "case when l_partkey % 79 = 0 then 0D when l_partkey % 83 = 0 then null"
    " else l_quantity * 8 end as m2_const",
    "cast(l_linenumber + l_partkey % 4 - 1 as double) as habitaciones",
    "cast(l_linenumber + l_suppkey % 5 - 1 as double) as banos",
    "cast(l_partkey % 4 as double) as autos",
    "cast(l_linenumber + 2 as double) as total_habitaciones",
    "case when l_partkey % 3 = 0 then null else cast(p_size as double) end as antiguedad",
    "case when l_partkey % 53 = 0 then null else p_brand end as link_img",
    "concat('u/', cast(l_orderkey as string)) as link",
    "'MXN' as divisa",
    "s_name as agent",
    "cast(l_shipdate as string) as fecha_pub",
    "concat('\"text\":', p_name) as descripcion",
    "p_type as sub_category",
    "n_name as ciudad",
    "r_name as estado",
    "split(p_name, ' ') as amenidades",
    "20.0D + s_acctbal / 10000 as lat",
    "-103.0D - cast(s_nationkey as double) / 25 as lng",
]


def _listings(joined: DataFrame) -> DataFrame:
    return joined.selectExpr(
        _SKU, _SNAPSHOT, "l_partkey as ord1", "l_suppkey as ord2", "l_extendedprice as ord3", *_RECORD
    )


def read_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_listings`` before they become listings: the numbers and texts these are made of, and ``ROW_ORDER``.

    ``listings_of`` makes the listings.  The suppliers' size is known from their files, and parts are joined after them.
    """
    lines = _table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_LINE, _FLAGS, _SNAPSHOT)
    suppliers = _table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    parts = _table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (
        lines.join(suppliers, F.expr("l_suppkey = s_suppkey"))
        .join(parts, F.expr("l_partkey = p_partkey"))
        .join(_table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(_table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .drop("s_suppkey", "p_partkey", "n_nationkey", "n_regionkey", "r_regionkey")
    )


def listings_of(joined: DataFrame) -> DataFrame:
    """Rows of ``read_joined`` as listings with their snapshot, in the order they come."""
    rows = joined.selectExpr("*", "s_nationkey as n_nationkey", *_FLAG_TEXTS)
    return rows.selectExpr(_SKU, "snapshot_id", *_RECORD)


#: Records of a snapshot's file: it is compressed, so one task reads it.
FILE_RECORDS = 250_000


def write_snapshots(listings: DataFrame, folder: str, order: list[str] = SNAPSHOT_ORDER, records: Callable[[DataFrame], DataFrame] | None = None) -> list[str]:
    """Write one folder of compressed JSON Lines per snapshot, rows in order; returns the paths in order.

    ``records`` makes the listings of rows that have ``order`` only when these are in their places, so that short rows
    are shuffled.  A task has the rows of all snapshots in a range of the rest of the order.
    """
    seen = Observation()
    placed = listings.repartitionByRange(*order[1:]).observe(seen, F.collect_set(order[0]).alias("ids"))
    ordered = placed.sortWithinPartitions(*order)
    ordered = (records(ordered) if records else ordered.drop(*order[1:])).withColumnRenamed("lng", "long")
    write = ordered.write.partitionBy(order[0]).option("maxRecordsPerFile", FILE_RECORDS)
    write.option("zlib.compress.level", "BEST_SPEED").json(folder, compression="gzip")
    return [f"{folder}/{order[0]}={i}" for i in sorted(seen.get["ids"])]  # one per snapshot
