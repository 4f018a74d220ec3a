"""Token files: round trip, keyed access, perfect hashes."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from predio.llm import tokenfiles
from predio.llm.perfect_hash import PerfectHash

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 33, 5000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    perfect = PerfectHash.build(keys)
    assert sorted(perfect.numbers(keys).tolist()) == list(range(len(keys)))


def test_round_trip(spark, folder):
    rows = [(5, "five words are in here"), (1, "one"), (None, "no key"), (3, None), (3, "again the key"), (3, ""), (3, "again the key"), (9, "nine " * 500)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    tokenfiles.write(docs, folder, PATH)
    places = tokenfiles.locate(docs.select("doc_id"), folder)
    got = sorted(((r["start"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenfiles.read(places, folder).collect()), key=lambda r: r[0])
    assert len(got) == len(rows)
    assert [d for _, d, _ in got] == [None, 1, 3, 3, 3, 3, 5, 9]
    at = 0
    for start, _, ids in got:
        assert start == at and ids[-1] == 2
        at += len(ids)
    want = sorted([-1 if d is None else d, LIBRARY.encode(t or "", add_special_tokens=False).ids + [2]] for d, t in rows)
    assert sorted([-1 if d is None else d, ids] for _, d, ids in got) == want


def test_unknown_keys_and_empty_tables(spark, folder):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    tokenfiles.write(docs, folder, PATH)
    asked = spark.createDataFrame([(i,) for i in (7, 7, 299, 300, 10**12, -1)], "doc_id long")
    assert sorted(r["doc_id"] for r in tokenfiles.locate(asked, folder).collect()) == [7, 299]
    tokenfiles.write(docs.filter("false"), folder + "2", PATH)
    places = tokenfiles.locate(asked, folder + "2")
    assert places.count() == 0 and tokenfiles.read(places, folder + "2").count() == 0
