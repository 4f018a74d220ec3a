"""The Jaccard join against comparing all pairs."""

import random
import string

import numpy as np
import pytest
from helpers import edited, prose

from predio.llm import jaccard

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, k=5):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_force(rows, percent=80):
    sets = [(key, shingle_set(text)) for key, text in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(s), least.get(find(i))) for i, (key, s) in enumerate(sets)), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60)
    for n in (3, 5, 6, 9, 12, 14, 16, 17, 19, 22, 27, 40, 60, 90, 150, 400):
        base = prose(rng, n, 1000)
        rows += [base, base.upper()]
        words = base.split(" ")
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            rows += [edited(rng, base, share) for _ in range(4)]
        rows += [" ".join(words[: -(-len(words) * p // 100)]) for p in (95, 90, 85, 80, 75)]
        rows += [base + " " + prose(rng, max(1, n * p // 100)) for p in (5, 10, 20, 25, 30)]
    rows += [passage + " " + prose(rng, rng.randint(5, 40)) for _ in range(60)]
    rows += [None, "", " \n\t", "one", "one", "two words"]
    keys = list(range(len(rows)))
    rng.shuffle(keys)
    return list(zip(keys, rows))


@pytest.mark.parametrize("hot", [False, True])
def test_equals_all_pairs(spark, monkeypatch, hot):
    if hot:  # every signature counts as hot and is dealt out
        monkeypatch.setattr(jaccard, "HOT_SAMPLE", 1.0)
        monkeypatch.setattr(jaccard, "_hot_signatures", lambda texts, percent, k, lower: np.sort(np.array(
            [r[0] for r in jaccard._signatures(texts, percent, k, lower, np.empty(0, np.uint64)).select("_sig").distinct().collect()], np.int64
        ).view(np.uint64)))
    rows = rows_of(int(hot))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute_force(rows)


def test_uncovered_sets_are_compared_by_shingle(spark, monkeypatch):
    """With far too few segments most sets are uncovered; the result is the same."""
    monkeypatch.setattr(jaccard, "bands", lambda percent, largest: [(17, 1 << 20, 3)])
    rows = rows_of(5)[::2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:3] for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute_force(rows)


def test_missing_and_repeated_keys(spark):
    a, b = prose(random.Random(1), 50), prose(random.Random(2), 50)
    rows = [(None, a), (4, a), (4, a), (2, b), (2, a), (None, None), (None, "lone words here")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _class string")
    got = sorted((tuple(r)[:3] for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 46, 2), (4, 46, 2), (4, 46, 2), (2, 46, 2), (2, 46, 2), (None, 0, None), (None, 1, None)], key=str)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == 4 and {None, "lone words here", b, a} == set(texts)
    assert jaccard.near_duplicates(docs.filter("false")).count() == 0 and jaccard.keep_one(docs.filter("false")).count() == 0


def test_keep_one_of_each_component(spark):
    rows = rows_of(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {key for key, n, least in brute_force(rows) if n == 0 or key == least}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == sorted(want)


def test_isolated_pairs_astride_the_band_borders(spark):
    """Pairs with no other near partner, just similar enough and in neighbouring bands, all link."""
    rng, rows, word = random.Random(7), [], 0
    for _, border, _ in jaccard.bands(80, 300):
        for _ in range(150):
            a, b = border - rng.randint(0, 2), border + 1 + rng.randint(0, 2)
            both = -(-80 * (a + b) // 180)
            assert 100 * both >= 80 * (a + b - both)
            names = [f"w{word + i}" for i in range(a + b - both)]
            word += len(names)
            rows += [" ".join(names[:a]), " ".join(names[a - both :])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, k=1).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


def _signed(spark, rows, hot):
    texts = spark.createDataFrame([(t or "",) for _, t in rows], "_text string")
    return jaccard._signatures(texts, 80, 5, True, hot)


def test_salts_are_taken_off_again(spark):
    plain = _signed(spark, rows_of(2), np.empty(0, np.uint64))
    hot = np.sort(np.array([r[0] for r in plain.select("_sig").distinct().collect()], np.int64).view(np.uint64))
    salted = _signed(spark, rows_of(2), hot)
    assert salted.select("_sig").distinct().count() > len(hot)  # dealt to several buckets
    assert set(jaccard._unsalted(salted).collect()) == set(jaccard._unsalted(plain).collect())


def test_signatures_are_sorted_by_one_number_and_only_wanted_texts_are_read_again(spark, monkeypatch):
    plans, real = {}, jaccard.settle

    def settle(df, label="table"):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(jaccard, "settle", settle)
    rng = random.Random(11)
    base = prose(rng, 200)
    rows = [*enumerate([base, base + " end", *[prose(rng, 60) for _ in range(30)]])]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 2 else i for i, _ in rows}
    sort = next(x for x in plans["shared"].splitlines() if "Sort [" in x)
    assert sort.count("ASC") == 1 and "_sig" in sort
    assert "LeftSemi" in plans["sets"][plans["sets"].index("MapInArrow"):]
