"""License scans against a plain search."""

import random

from helpers import prose

from predio.llm import licenses


def test_notices(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(120):
        text = prose(rng, 120)
        if k % 2:
            t = k // 2 % len(licenses.TEMPLATES)
            notice = licenses.TEMPLATES[t][1]
            if k > 80:
                notice = notice.upper()
            place = text.index("\n", 100)
            text = text[:place] + "\n" + notice + "\n" + text[place + 1 :]
            want.add((k, licenses.TEMPLATES[t][0]))
        rows.append((k, text))
    rows += [(None, rows[1][1]), (500, None), (501, ""), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, license string")
    got = licenses.find_licenses(docs)
    found = {(r["doc_id"], r["license"]) for r in got.collect()}
    assert found == want | {(None, licenses.TEMPLATES[0][0])}
    assert got.filter("doc_id = 1").count() == 1
    assert licenses.find_licenses(docs.filter("false")).count() == 0


def test_changed_words(spark):
    rng = random.Random(6)
    long = [(i, name, text) for i, (name, text) in enumerate(licenses.TEMPLATES) if len(text.split()) > 20]
    rows = []
    for i, _, text in long:
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, prose(rng, 80) + " " + " ".join(words) + " " + prose(rng, 80)))
        rows.append((1000 + i, prose(rng, 80) + " " + " ".join(words[::2]) + " " + prose(rng, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["template"]) for r in licenses.find_licenses(docs, contained=0.7).collect()}
    assert found == {(i, i) for i, _, _ in long}


def test_own_templates(spark):
    known = spark.createDataFrame([(0, "own", "free for all readers of this book"), (1, "none", None), (2, "none", "")], "template int, license string, text string")
    docs = spark.createDataFrame([(1, "it is free for all readers of this book today")], "doc_id long, text string")
    assert [r["license"] for r in licenses.find_licenses(docs, known).collect()] == ["own"]


def test_short_notices_inside_a_line(spark):
    rows = [
        (1, "Copyright 2020 Acme. All rights reserved."), (2, "A long paragraph about nothing that ends here, all rights\nreserved by them and others"),
        (3, "all the rights are reserved"), (4, "All rights reserved"), (5, None), (6, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["license"], r["at"]) for r in licenses.find_licenses(docs).collect()}
    assert found == {(1, "All rights reserved", 3), (2, "All rights reserved", 8), (4, "All rights reserved", 0)}
