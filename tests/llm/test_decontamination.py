"""Overlaps with benchmark items against a plain search."""

import itertools
import random

import numpy as np
from helpers import prose

from predio.llm import decontamination as d


def _case(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n).capitalize() + ".") for i, n in enumerate([40, 30, 20, 16, 13, 12, 9, 6, 5, 4])]
    items += [(20, None), (21, "")]
    docs, want = [], set()
    for k in range(60):
        text = prose(rng, 150)
        if k % 2:
            i, item = items[k // 2 % 10]
            words = item.replace("\n", " ").split(" ")
            style = k // 20
            if style == 1:
                words = [w.upper() + "," for w in words]
            if style == 2 and len(words) >= 16:  # a changed word in every nine
                words = [w if j % 9 != 4 else "zzz" for j, w in enumerate(words)]
            text = text[:200] + "\n" + " ".join(words) + " " + text[200:]
            if len(words) >= d.LEAST:
                want.add((k, i))
        docs.append((k, text))
    docs += [(None, docs[1][1]), (100, None), (101, ""), (1, docs[1][1]), (1, "clean text under a used key " + prose(rng, 30))]
    frame = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, item_id string")
    return frame, spark.createDataFrame(items, "item_id long, text string"), want | {(None, 0)}, docs


def test_overlaps(spark):
    docs, items, want, rows = _case(spark)
    found = d.overlaps(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert all(100 * r["equal"] >= 80 * r["words"] for r in found.collect())
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns
    bad = {k for k, _ in want}
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert left == sorted(((k, t) for k, t in rows if k not in bad or (t or "").startswith("clean")), key=str)


def test_scattered_words_do_not_count(spark):
    rng = random.Random(9)
    item = prose(rng, 30).split()
    half = " ".join(w if j % 2 else "zz" for j, w in enumerate(item))
    few = " ".join(item[:8])
    docs = spark.createDataFrame([(1, half), (2, few + " " + prose(rng, 20))], "doc_id long, text string")
    assert d.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == 0


def test_empty_tables(spark):
    docs, items, _, rows = _case(spark)
    assert d.overlaps(docs.filter("false"), items).count() == 0
    assert d.overlaps(docs, items.filter("false")).count() == 0
    assert d.decontaminate(docs, items.filter("false")).count() == len(rows)


def test_every_placement_of_changed_words(spark):
    rng, items, docs, want = random.Random(5), [], [], set()
    for n in range(d.LEAST, d.STRETCH + 1):
        words = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        changed = n - -(-n * d.PERCENT // 100)
        ways = list(itertools.combinations(range(n), changed))
        for way in [*ways, *rng.sample(list(itertools.combinations(range(n), changed + 1)), 3)]:
            text = " ".join("zz" if i in way else w for i, w in enumerate(words))
            if len(way) == changed:
                want.add((len(docs), n))
            docs.append((len(docs), f"before it {text} after it"))
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_filter_passes_all_seeds():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000, 300_000):
        seeds = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        bits = d._filter_bits(n)
        packed = np.zeros(1 << bits - 3, np.uint8)
        for part in np.array_split(seeds, 3):
            d._set_slots(packed, d._slots(part, bits).ravel())
        slots = d._slots(seeds, bits).ravel().astype(np.int64)
        plain = np.zeros(1 << bits, bool)
        plain[slots] = True
        assert (np.unpackbits(packed, bitorder="little").astype(bool) == plain).all()
        assert len(d._passes(packed, seeds, bits)) == n
        others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert len(d._passes(packed, others, bits)) <= 200
    assert d._filter_bits(1 << 40) == d.MOST_BITS
