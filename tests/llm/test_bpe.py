"""Encoding and decoding against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from predio.llm import bpe
from predio.llm.words import row_blocks, text_buffers

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", "  ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>x", "I'll don't WE'VE x'S 123 4½", "Σας ΟΔΥΣΣΕΥΣ ΟΔΟΣ.",
    "é é Éa", "a b　c d\x85e\x1cf", "日本語テキスト 한국어 한", "😀👍🏽 emoji", "İstanbul ŉ ſ ß ẞ",
    "́start  ​ zero", "x" * 3000, "\x00 nul \x7f", "<| not", "ạ̈b", "ﬁ Ⅷ ²", "don’t it's 'LL'", "'", "É×Ü÷ÿ",
    "Licensed under the Apache License, Version 2.0.",
]


def _random_texts():
    rng = random.Random(3)
    out = ["".join(rng.choice("aAbB'tsL l.!é É́Σσ9½ \n\t中 <|endoftext|>") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    spans = [(32, 0x24F), (0x300, 0x600), (0x1E00, 0x2100), (0x3040, 0x30FF)]
    out += ["".join(chr(rng.randint(*rng.choice(spans))) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "tion", "ing", "schau", "ñez"]
    out += [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    return out


@pytest.mark.parametrize("library", [False, True])
def test_ids_and_text_equal_the_library(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 3000)  # the cache is emptied on the way
    own = bpe.TextEncoder(PATH, library)
    texts = ODD + _random_texts()
    data, at = text_buffers(pa.array(texts))
    found = []
    for a, b in row_blocks(at, 4000):
        ids, row = own.encode(data, at, a, b)
        found += [ids[x:y] for x, y in zip(row[:-1], row[1:])]
    for text, ids in zip(texts, found):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_speculation_is_needed_and_mended():
    own = bpe.encoder(PATH).encode_words
    words = sorted({w for t in _random_texts()[-40:] for w in t.encode().split()})
    flat = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = np.concatenate([[0], end[:-1]])
    token, owner = own.propose(flat, start, end)
    exact, which = own.merge(flat, start, end)
    order = np.argsort(which, kind="stable")
    found, count = own(flat, start, end)
    assert found.tolist() == exact[order].tolist()
    assert token.tolist() != exact[order].tolist()  # some proposals were wrong


def test_frames(spark):
    rows = [(1, "Hello, world!", "x", None), (1, "Hello, world!", "x", None), (2, None, None, "k"), (None, "", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, Extra string")
    got = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert [r["Extra"] for r in got] == [None, None, "k", "z"] and "IDS" not in got[0].asDict()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got[:2]] == [LIBRARY.encode(rows[0][1], add_special_tokens=False).ids] * 2
    assert [bytes(r["ids"]) for r in got[2:]] == [b"", b""] and got[2]["decoded"] == ""
    again = bpe.decode(bpe.encode(docs, PATH), PATH).select("decoded").collect()
    assert [r[0] for r in again] == [r["decoded"] for r in got]
    empty = bpe.encode(docs.filter("false"), PATH)
    assert empty.count() == 0 and "ids" in empty.columns
    assert bpe.decode(docs.withColumn("ids", F.lit(None).cast("binary")), PATH).first()["decoded"] == ""
