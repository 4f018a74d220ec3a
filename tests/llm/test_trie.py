"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from predio.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def nodes(convs):
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        n = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * n + sum(saved[k] for k in kids[p])
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(kids[p]), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def found(df, **sizes):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = trie.prefix_trie(*trie.rebuilt_turns(df), **sizes).select(columns).collect()
    return sorted(tuple(-(10**9) if x is None else x for x in r) for r in rows)


def test_minima():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 9, 31, 64, 100):
        values = rng.integers(-1, 6, n)
        table = trie.Minima(values)
        at, least = np.repeat(np.arange(n), 8), np.tile(np.arange(8), n)
        right = [next((j for j in range(i, n) if values[j] < d), n) for i, d in zip(at, least)]
        left = [next((j for j in range(i, -1, -1) if values[j] < d), -1) for i, d in zip(at, least)]
        assert table.right(at, least).tolist() == right and table.left(at, least).tolist() == left
        a, b = np.array([(i, j) for i in range(n) for j in range(i, n)]).T
        assert table.of(a, b).tolist() == [values[i : j + 1].min() for i, j in zip(a, b)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 2, "block": 3}])
def test_trie_equals_plain(spark, sizes):
    rng = random.Random(5)
    words = ["a", "b b", "", None, "c c d\n e", "x"]
    rows = []
    for conv in range(60):
        if conv % 20 == 0 and rng.random() < 0.4:
            continue  # a family without a head
        for turn in [*([None] if rng.random() < 0.2 else []), *range(rng.randint(1, 6))]:
            rows.append((conv, turn, rng.choice(["user", None, "assistant"]), rng.choice(words)))
    # A hot first turn, many equal conversations, short families of one turn, one long conversation and its copy.
    for conv in range(200, 320):
        rows += [(conv, 0, "user", "hi there"), (conv, 1, "assistant", "hi")][: 2 if conv % 3 else 1]
    for conv in (400, 420):
        rows += [(conv, i, "user", f"t {i}") for i in range(90)]
    rows += [(c, 0, "user", "alone") for c in range(1001, 1019)] + [(None, 0, "user", "nobody")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df, **sizes) == nodes(rebuild(rows))


def test_equal_turns_and_extra_columns(spark):
    # Turns that tie are ordered by role and text; repeated rows are turns of their own.
    rows = [(20, 1, "user", "same", 1, "x"), (20, 1, "user", "same", 2, "y"), (40, 1, "user", "same", 3, "z")]
    df = spark.createDataFrame(rows, SCHEMA + ", pos long, CONV string")
    assert found(df) == nodes(rebuild([r[:4] for r in rows]))
    assert found(df.filter("false")) == []


def test_all_turnless(spark):
    alone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "x") for c in alone]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    assert got == nodes(rebuild(rows)) and len(got) == 1 and got[0][5] == 1


def test_very_long_texts(spark):
    long = "word " * 500_000
    rows = [(20, 0, "user", long), (40, 0, "user", long), (60, 0, "user", long + "x")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == nodes(rebuild(rows))
