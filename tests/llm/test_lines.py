"""Line deduplication against plain Python."""

import random

import re
from collections import Counter, defaultdict

import pytest
from helpers import prose
from pyspark.sql import functions as F

from predio.llm import lines


def test_recurring_lines(spark):
    rng = random.Random(1)
    shared = prose(rng, 60, 100)
    texts = [prose(rng, 60, 12) for _ in range(6)]
    rows = [
        (10, texts[0] + "\n" + shared), (11, shared + "\n" + texts[1]), (12, texts[2] + "\n  " + shared.replace(" ", "  ") + "\n" + texts[2].split("\n")[0]),
        (13, "user 17 logged in from 10.0.0.1 at noon\nshort line\n" + texts[3]),
        (14, "short line\nuser 99 logged in from 10.9.8.7 at dusk\n" + texts[4]),
        (15, texts[0] + "\n" + shared), (16, None), (17, ""), (18, "\n\n"), (None, shared), (None, "only here and nowhere else"),
        (19, texts[5] + "\n" + texts[5].split("\n")[0]),
    ]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, n_lines string")
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs).collect()}
    size = lambda t: t.count("\n") + 1
    first = texts[2].split("\n")[0]
    assert got == {
        (None, 1, 0, shared), (None, 1, 0, "only here and nowhere else"),  # documents without a key come first
        (10, 6, 1, texts[0]), (11, 6, 1, texts[1]), (12, 7, 1, texts[2] + "\n" + first),
        (13, 7, 0, rows[3][1]), (14, 7, 1, "short line\n" + texts[4]),
        (15, 6, 6, ""), (16, 0, 0, None), (17, 1, 0, ""), (18, 3, 0, "\n\n"), (19, 6, 0, rows[-1][1]),
    }
    assert size(rows[0][1]) == 6
    kept = lines.dedup_lines(docs, drop_empty=True)
    assert {r["doc_id"] for r in kept.collect()} == {None, 10, 11, 12, 13, 14, 16, 17, 18, 19}


def test_generalised_variables_and_clean_lines(spark):
    rng = random.Random(2)
    base = [prose(rng, 30, 100) for _ in range(20)]
    changed = [" ".join(w if i < 5 or i % 4 else "other" for i, w in enumerate(b.split(" "))) for b in base]
    clean = [prose(rng, 30, 100) for _ in range(40)]
    rows = list(enumerate(base)) + [(100 + i, c) for i, c in enumerate(changed)] + [(200 + i, c) for i, c in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(docs).filter("n_dropped > 0").collect()}
    assert gone == {100 + i for i in range(20)}
    # Repeated rows are one document.
    twice = spark.createDataFrame([(1, base[0]), (1, base[0])], "doc_id long, text string")
    assert [r["n_dropped"] for r in lines.dedup_lines(twice).collect()] == [0, 0]
    assert lines.dedup_lines(docs.filter("false")).count() == 0


def test_rows_of_numbers_and_short_lines_stay(spark):
    rows = [
        (1, "2021 12 5\nred apples are very cheap"), (2, "1999 3 7\nred apples are not cheap"), (3, "2021 12 5"),
        (4, "Total 17 18 19"), (5, "Total 20 21 22"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs, drop_empty=True).collect()}
    assert got == {k: t for k, t in rows if k != 3}


def test_several_templates_in_a_leaf(spark):
    names = ["ada", "bob", "cy", "dee", "eve", "fay"]
    families = ["the new server {} was started without any error", "the new server has lost its link to {}"]
    families += [f"the new server w{c} x{c} y{c} z{c} v{c} {{}}".replace("{c}", c) for c in "abcdefgh"]
    rows = [f.format(n) for f in families for n in names[: 6 if f is families[0] else 4]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"] for r in lines.dedup_lines(docs).filter("n_dropped > 0").collect()}
    assert len(rows) - len(got) == len(families)


def parsed(line):
    """A line as the tree sees it."""
    line = re.sub("[\t\r\x0b\x0c ]+", " ", line).strip(" ")
    masked = [("<*>" if re.search("[0-9]", w) else w) for w in line.split(" ")]
    constant = sum(w != "<*>" for w in masked)
    return " ".join(masked) if constant >= 3 and 2 * constant >= len(masked) else line


def alike(a, b):
    lead = sum(w != "<*>" for w in a[:3])
    same = [x for x, y in zip(a[3:], b[3:]) if x == y]
    constant = lead + sum(w != "<*>" for w in same)
    return len(a) > 3 and 2 * len(same) >= len(a) - 3 + 2 and constant >= 3 and 2 * constant >= len(a)


def template_tree(rows, hashes):
    """Which lines of which documents go, by the passes in plain Python."""
    places = [(key, i, parsed(x)) for key, text in rows for i, x in enumerate(text.split("\n"))]
    places = [p for p in places if len(p[2].split(" ")) >= 3]
    n = Counter(p[2] for p in places)
    rank = {x: (n[x], hashes[x]) for x in n}
    leaves = defaultdict(list)
    for x in n:
        w = x.split(" ")
        leaves[len(w), tuple(w[:3])].append(x)
    name = {x: x for x in n}
    for members in leaves.values():
        left = set(members)
        for _ in range(lines.PASSES):
            pairs = defaultdict(list)
            for x in left:
                rest = x.split(" ")[3:]
                number = len(rest) // 2
                for i in range(number if number > 1 else 0):
                    pairs[i, tuple(rest[2 * i : 2 * i + (3 if i == number - 1 else 2)])].append(x)
            pivots = [max(v, key=rank.get) for v in pairs.values() if len(v) > 1]
            seen = {x: {p for v in pairs.values() if len(v) > 1 and x in v for p in [max(v, key=rank.get)] if p != x} for x in left}
            agree = {x: {p for p in ps if alike(x.split(" "), p.split(" "))} for x, ps in seen.items()}
            top = {p for p in pivots if not agree[p]}
            taken = {x: max(ps & top, key=rank.get) for x, ps in agree.items() if ps & top}
            name.update(taken)
            left -= top | set(taken)
            left = {x for x in left if any(x in v for v in pairs.values() if len(v) > 1)}
    docs = defaultdict(set)
    for key, _, x in places:
        docs[name[x]].add(key)
    return {(key, i) for key, i, x in places if len(docs[name[x]]) > 1 and key != min(docs[name[x]])}


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_plain(spark, seed):
    rng = random.Random(seed)
    words = ["red", "green", "blue", "7", "x9", "oak", "elm", "fir", "ash"]
    families = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(25)]

    def line():
        if rng.random() < 0.3:
            return " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        own = ["the", "new", "door", *rng.choice(families)]
        return "  ".join(rng.choice(words) if i > 2 and rng.random() < 0.25 else w for i, w in enumerate(own))

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 8)))) for i in range(120)]
    every = sorted({parsed(x) for _, t in rows for x in t.split("\n")})
    frame = spark.createDataFrame([(x,) for x in every], "x string")
    hashes = {r["x"]: r["h"] for r in frame.select("x", F.xxhash64("x").alias("h")).collect()}
    gone = lines.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["_key"], r["_pos"]) for r in gone.collect()} == template_tree(rows, hashes)


def test_passes_do_not_grow_with_the_leaf(spark, monkeypatch):
    """Lines that share start, length and a pair but nothing else take a fixed number of tables."""
    rng = random.Random(4)
    counts = []
    for n in (50, 2000):
        made = []
        real = lines.settle
        monkeypatch.setattr(lines, "settle", lambda df, label="table": made.append(label) or real(df, label))
        rows = [(i, "the new door is open " + " ".join("".join(prose(rng, 4).split()) for _ in range(6))) for i in range(n)]
        assert lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").count() == 0
        monkeypatch.setattr(lines, "settle", real)
        counts.append(len(made))
    assert max(counts) <= 16 + 6 * lines.PASSES


def test_very_long_texts(spark):
    one = "\n".join(f"line number {i} of a very long text that recurs" + " word" * (i % 50) for i in range(20000))
    rows = [(1, one), (2, one), (3, "word " * 400_000), (4, "word " * 400_000)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (20000, 0), 2: (20000, 20000), 3: (1, 0), 4: (1, 1)}


def test_bitmaps_pass_all_wanted_hashes(spark, monkeypatch):
    rows = spark.range(100_000).select(F.xxhash64("id").alias("_hash"))
    wanted = rows.filter("_hash % 50 = 0")
    left = lines._may_match(rows, wanted)
    assert left.join(wanted, "_hash", "left_semi").count() == wanted.count()
    assert left.count() < 20_000
    monkeypatch.setattr(lines, "FILTER_BYTES", 1)
    assert lines._may_match(rows, wanted).count() == 100_000


def test_lines_left_by_the_passes_find_their_template(spark, monkeypatch):
    """Many templates that share a pair: each pass settles one of them, and the rest is not dropped."""
    rng = random.Random(9)
    word = lambda: "".join(prose(rng, 3).split())
    families = [[word() for _ in range(8)] for _ in range(30)]
    rows = []
    for f in families:
        # All pairs after the first differ within a family; more than half of its words are equal.
        for turn in range(2):
            rest = [w if i < 2 or i % 3 or not turn else word() for i, w in enumerate(f)]
            rows.append("the new door is open " + " ".join(rest))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for passes in (1, 4):
        monkeypatch.setattr(lines, "PASSES", passes)
        assert lines.dedup_lines(docs).filter("n_dropped > 0").count() == len(families), passes


def test_the_rest_alone_finds_all_that_agree(spark, monkeypatch):
    """Without passes that settle lines, the most frequent line down takes what agrees with it."""
    rng = random.Random(10)
    words = ["red", "green", "blue", "oak", "elm", "fir"]
    made = sorted({" ".join(["the", "new", "door", *(rng.choice(words) for _ in range(6))]) for _ in range(150)})
    frame = spark.createDataFrame([(x, rng.randint(1, 3)) for x in made], "_line string, _n long")
    texts = frame.select(F.xxhash64("_line").alias("_hash"), "_line")
    open_rows = frame.select(F.xxhash64("_line").alias("_hash"), F.struct("_n", F.xxhash64("_line").alias("_hash")).alias("_rank"))
    got = lines._rest_taken(open_rows, texts, spark.createDataFrame([], "_hash long, _template long"))
    rank = {r["_line"]: (r["_n"], r["h"]) for r in frame.select("*", F.xxhash64("_line").alias("h")).collect()}
    want, templates = {}, []
    for x in sorted(made, key=rank.get, reverse=True):
        own = [t for t in templates if alike(x.split(" "), t.split(" "))]
        if own:
            want[rank[x][1]] = rank[max(own, key=rank.get)][1]
        else:
            templates.append(x)
    assert {r["_hash"]: r["_template"] for r in got.collect()} == want and len(want) > 20
