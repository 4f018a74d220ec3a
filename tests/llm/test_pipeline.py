"""The pipeline on planted documents, and the registered queries against their SQL."""

import os
import random

import duckdb
import pytest
from helpers import edited, prose

import __spark_entry__ as registry
import corpus_pipeline
from check import TABLES, difference

FOLDER = "/root/testdata/sf0.001"


def test_planted_documents(spark, folder):
    rng = random.Random(7)
    junk = lambda t: " ".join(w.upper() + "!!" for w in t.split())
    clean = [(i, prose(rng, 120)) for i in range(150)]
    noise = [(200 + i, junk(prose(rng, 120))) for i in range(60)]
    passage, item = prose(rng, 70, 100), prose(rng, 30, 100)
    shared = [(300 + i, prose(rng, 100) + "\n" + passage + "\n" + prose(rng, 40)) for i in range(5)]
    long = prose(rng, 400, 1000)
    copies = [(400, clean[3][1]), (401, clean[3][1]), (410, long), (411, edited(rng, long, 0.01)), (412, "A " + long)]
    leaks = [(500 + i, prose(rng, 60) + "\n" + prose(rng, 5) + " " + item + " " + prose(rng, 60)) for i in range(3)]
    rows = clean + noise + shared + copies + leaks
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in noise]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs, texts[k] = out, {r["doc_id"]: r["text"] for r in out.collect()}
    assert not [i for i, _ in noise if i in texts[0]] and all(texts[0][i] == t for i, t in clean)
    assert sum(passage in t for t in texts[1].values()) == 1 and not {400, 401} & set(texts[1])
    assert all(texts[1][i] == t for i, t in clean)
    assert 410 in texts[2] and not {411, 412} & set(texts[2])
    assert not {500, 501, 502} & set(texts[3])
    assert all(texts[4][i] == t for i, t in clean)
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in last} == set(texts[4])


NAMES = [n for n in registry.queries() if n.startswith("op")]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in registry.queries()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(NAMES) & set(registry.oracle_sql())))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = registry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, db.sql(registry.oracle_sql()[name]).df()) is None
