"""Quality rules and stratified shards against plain Python."""

import collections
import random

from helpers import prose

from predio.llm import rules, sharding


def counts(text):
    text = text or ""
    w = text.encode().split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_rule_counts_and_hosts(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "a b c a b c", "x\n\nx\n \nx ", "# | <b> é　é $", "a a a", "one two", "日本 語 " * 30]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, f"h{i % 4}", "e") for i, t in enumerate(texts)]
    rows += [(1000 + i, "too short", "bad", None) for i in range(30)] + [(2000, prose(rng, 90), "bad", None), (2000, prose(rng, 90), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Kept string")
    got = rules.host_rules(docs, keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(r["text"])
        assert tuple(r[c] for c in rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] < 0.5)
    rate = {r["source"]: r["host_rate"] for r in got}
    assert 0.5 < rate["bad"] < 30 / 31 and rate[None] < 0.5
    assert not any(r["kept"] for r in got if r["source"] == "bad") and any(r["kept"] for r in got if r["source"] is None)
    assert rules.host_rules(docs.filter("false")).count() == 0


def test_shards_have_the_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 6)}", "e") for i in range(2000)]
    rows += [(5, "s1", "e"), (5, "s1", "e"), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, Shard string")
    got = sharding.stratified_shards(docs, 24).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got if r["source"]) == sorted((a, b) for a, b, _ in rows if b)
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    per = collections.Counter((r["shard"], r["source"]) for r in got)
    total = collections.Counter(b for _, b, _ in rows)
    for (s, source), n in per.items():
        assert abs(n - total[source] / 24) <= 2
    again = {(r["doc_id"], r["shard"]) for r in sharding.stratified_shards(docs.repartition(7), 24).collect() if r["doc_id"] not in (None, 5)}
    assert again == {(r["doc_id"], r["shard"]) for r in got if r["doc_id"] not in (None, 5)}


def test_few_rows_and_files(spark, folder):
    docs = spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, source string")
    got = sharding.stratified_shards(docs, 24).collect()
    assert len({r["shard"] for r in got}) == 5 and {r["slot"] for r in got} == {0}
    assert sharding.stratified_shards(docs.filter("false"), 3).count() == 0
    sharding.write_shards(sharding.stratified_shards(docs, 2), folder, file_rows=2)
    back = spark.read.parquet(folder)
    assert back.count() == 5 and {r["shard"] for r in back.collect()} == {0, 1}
