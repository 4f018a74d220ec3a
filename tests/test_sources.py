import json

import pytest
from pyspark.sql import functions as F, types as T

from predio.operators import codes
from predio.plans import pipelines
from predio.scale import settle, shared_folder
from predio.schema import LISTING_SCHEMA, RESULT_SCHEMA
from predio.sources import snapshots, tables

SCHEMA = T.StructType(
    [
        T.StructField("sku", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
    ]
)


@pytest.fixture
def files(tmp_path):
    one = [{"sku": "a", "price": 1, "long": -103.5}, {"sku": "b", "price": 2.5}, {"sku": None, "price": 3}]
    two = [{"sku": "b", "price": 9}, {"sku": "c", "price": None, "other": [1]}, {"sku": "a", "price": 8}]

    def write(layout):
        paths = []
        for i, records in enumerate((one, two)):
            path = tmp_path / f"{layout}-{i}.json"
            if layout == "json lines":
                text = "\n".join(json.dumps(r) for r in records)
            elif layout == "one per line":
                text = "[\n" + ",\n".join(json.dumps(r) for r in records) + "\n]"
            elif layout == "columns":
                names = sorted({k for r in records for k in r if k != "other"})
                text = json.dumps({n: {str(j): r.get(n) for j, r in enumerate(records)} for n in names})
            else:
                text = json.dumps(records, indent=2 if layout == "pretty" else None)
            path.write_text(text)
            paths.append(str(path))
        return paths

    return write


@pytest.mark.parametrize(
    "kind, layout",
    [("json lines", "lines"), ("one per line", "lines"), ("compact", "lines"), ("compact", "document"),
     ("pretty", "document"), ("columns", "columns")],
)
def test_snapshots_keep_the_first_record(spark, files, kind, layout):
    first, second = files(kind)
    load = lambda *paths: {
        r.sku: r.price
        for r in snapshots.load_listings(spark, *paths, schema=SCHEMA, layout=layout).collect()
    }
    assert load(first, second) == {"a": 1.0, "b": 2.5, None: 3.0, "c": None}
    assert load(second, first) == {"b": 9.0, "c": None, "a": 8.0, None: 3.0}
    assert [r.lng for r in snapshots.read_snapshot(spark, first, SCHEMA, layout).filter("sku = 'a'").collect()] == [-103.5]


def test_snapshots_with_different_columns(spark, files):
    first, second = files("json lines")
    wider = T.StructType([*SCHEMA.fields, T.StructField("other", T.ArrayType(T.IntegerType()))])
    both = snapshots.load_listings(spark, first, second, schema={first: SCHEMA, second: wider})
    assert {r.sku: r.other for r in both.collect()} == {"a": None, "b": None, None: None, "c": [1]}


def test_unreadable_records_are_errors(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"sku": "a"}\n{"sku": \n')
    with pytest.raises(Exception):
        snapshots.load_listings(spark, str(path), schema=SCHEMA).collect()
    with pytest.raises(ValueError):
        snapshots.read_snapshots(spark)
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, str(path), layout="xml")


def test_from_files_to_features(spark, listing, folder):
    rows = listing({}, {"colonia": "Arcos"}, {"agent": None}, {"tipo_inmueble": "Departamento"})
    rows.withColumnRenamed("lng", "long").write.json(folder)
    encoded, encoder = pipelines.load_and_clean(spark, folder)
    assert encoded.count() == 3 and [r.colonia for r in encoder.orderBy("endocer_colonia").collect()] == ["Arcos", "Valle"]
    data = pipelines.model_data(spark, folder)
    assert sorted(list(r.features)[-1] for r in data.collect()) == [0.0, 1.0]
    with pytest.raises(ValueError):
        pipelines.model_data(spark, folder, filter_by={"tipo_oferta": "Renta"})


def test_column_table_of_the_stored_kind(spark, tmp_path):
    path = tmp_path / "by_cluster"
    path.write_text(
        '{"colonia":{"0":54,"1":94},"score":{"0":0.81,"1":null},"error":{"1":12.5,"0":7.0},'
        '"diff_score":{"0":93.0,"1":87.5},"Good":{"0":true,"1":false}}'
    )
    rows = tables.read_column_table(spark, str(path), RESULT_SCHEMA).orderBy("colonia").collect()
    assert [tuple(r) for r in rows] == [("54", 0.81, 7.0, 93.0, True), ("94", None, 12.5, 87.5, False)]


@pytest.mark.parametrize("rows_per_file", [1000, 3])
def test_column_table_round_trip(spark, folder, rows_per_file):
    df = spark.range(20).select(
        F.concat(F.lit("Las Cañadas "), "id").alias("colonia"), (F.col("id") / 7).alias("score"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("error"), F.lit(1.0).alias("diff_score"),
        (F.col("id") > 4).alias("Good"),
    )
    tables.write_column_tables(df, folder, ["colonia"], rows_per_file)
    back = tables.read_column_table(spark, folder, RESULT_SCHEMA)
    assert back.count() == 20
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_result_sinks_and_encoder(spark, folder, fmt):
    df = spark.createDataFrame([("A",), ("B",)], "colonia string")
    encoder = codes.fit_encoder(df)
    tables.write_results(encoder, f"{folder}/results", fmt)
    assert spark.read.format(fmt).load(f"{folder}/results").count() == 2
    tables.save_encoder(encoder, f"{folder}/encoder")
    assert codes.encode(df, tables.load_encoder(spark, f"{folder}/encoder")).count() == 2
    with pytest.raises(ValueError):
        tables.write_results(encoder, f"{folder}/x", "xml")


def test_settled_tables_live_in_the_configured_folder(spark):
    table = settle(spark.range(3), "three")
    assert table.count() == 3 and all(shared_folder(spark) in f for f in table.inputFiles())


def test_schema_has_the_fields_of_a_listing():
    assert len(LISTING_SCHEMA) == 24


def test_lines_with_and_without_the_array_around_them(spark, tmp_path):
    """A line that is a record is read as it is; brackets and commas of an array go, those of a record stay."""
    lines = ["[", '{"sku":"a]"},', ' {"sku":"b,"} ', '[{"sku":"c"},', '{"sku":"d"}, {"sku":"[e"}', '{"sku":"f"}]', "]", "", "[]"]
    path = tmp_path / "odd.json"
    path.write_text("\n".join(lines) + "\n")
    read = snapshots.read_snapshot(spark, str(path), SCHEMA)
    assert [r.sku for r in read.orderBy("row").collect()] == ["a]", "b,", "c", "d", "[e", "f"]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith(" in plan and "EndsWith(" in plan  # the pattern is for other lines only
