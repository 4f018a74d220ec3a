"""The quality classifier: held-out accuracy and edge cases."""

import random
import zlib

import pyarrow as pa
from helpers import prose

from predio.llm import classifier


def junk(rng, text):
    return rng.choice([
        lambda: " ".join(w.upper() + "!!" for w in text.split()), lambda: " | ".join(text.split()),
        lambda: " ".join(w for w in text.split() for _ in range(6)),
    ])()


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        text, good = prose(rng, rng.randint(30, 150)), rng.random() < 0.8
        rows.append((i, text if good else junk(rng, text), "s"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    model = classifier.train(docs.filter(~classifier.held_out()), spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = classifier.score(docs, model).withColumn("h", classifier.held_out()).collect()
    truth = dict(labels)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    held = [r for r in scored if r["h"]]
    assert len(held) > 90 and sum((r["score"] >= 0.7) == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored)
    # The same whatever stands beside a text.
    texts = [t for _, t, _ in rows[:20]]
    whole = model.scores(pa.array(texts + ["", None]))
    assert all(abs(whole[i] - model.scores(pa.array([t]))[0]) < 1e-9 for i, t in enumerate(texts))
    assert whole[20] == whole[21] and 0 < whole[20] < 1


def test_labels_that_do_not_help(spark):
    docs = spark.createDataFrame([(1, "a text"), (None, None), (2, "")], "doc_id long, text string")
    schema = "doc_id long, quality int"
    for rows in ([], [(1, 1)], [(1, None), (None, 0), (7, 3)], [(8, 0), (9, 1)], [(2, 0), (1, 1), (1, 0)]):
        model = classifier.train(docs, spark.createDataFrame(rows, schema))
        assert classifier.score(docs, model).count() == 3
    assert classifier.score(docs.filter("false"), model).count() == 0


def test_labels_without_a_document_count_for_nothing(spark):
    rng, rows = random.Random(4), []
    for i in range(60):
        text = prose(rng, 40)
        rows.append((i, junk(rng, text) if i % 2 else text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1 - i % 2) for i in range(60)]
    other = [(1000 + i, int(i % 10 > 0)) for i in range(3000)]
    few = classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample=20)
    many = classifier.train(docs, spark.createDataFrame(labels + other, "doc_id long, quality int"), sample=20)
    texts = pa.array([t for _, t in rows])
    assert (few.scores(texts) == many.scores(texts)).all()
    assert abs(many.scores(pa.array([""]))[0] - 0.5) < 1e-6
