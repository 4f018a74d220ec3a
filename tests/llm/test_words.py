"""Word and shingle arrays against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from predio.llm import words as w


def _texts(seed):
    rng = random.Random(seed)

    def one():
        return rng.choice([
            None, "", "  ", "a", "ab\tcd", " x" * rng.randint(0, 9), "q" * rng.randint(0, 300),
            " ".join("".join(rng.choice("abcé　Z") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))),
        ])

    return [one() for _ in range(rng.randint(0, 40))]


@pytest.mark.parametrize("size", [7, 16, 64, 1 << 17])
def test_words_and_shingles(monkeypatch, size):
    monkeypatch.setattr(w, "SLICE", size)
    for seed in range(30):
        texts = _texts(seed)
        data, at = w.text_buffers(pa.array(texts, pa.string()))
        for a, b in w.row_blocks(at, 1000):
            starts, ends, hashes, row = w.words(data, at, a, b)
            want = [(t or "").encode().split() for t in texts[a:b]]
            assert [bytes(data[x:y]) for x, y in zip(starts, ends)] == [x for r in want for x in r]
            assert np.diff(row).tolist() == [len(r) for r in want]
            names = {}
            for x, h in zip((x for r in want for x in r), hashes):
                assert names.setdefault(x, h) == h
            assert len(set(names.values())) == len(names)
            for k in (3, 5):
                found, begin = w.shingles(hashes, row, k)
                names = {}
                for i, r in enumerate(want):
                    own = [tuple(r[j : j + k]) for j in range(len(r) - k + 1)] if len(r) >= k else [tuple(r)] * bool(r)
                    assert begin[i + 1] - begin[i] == len(own)
                    for x, h in zip(own, found[begin[i] : begin[i + 1]]):
                        assert names.setdefault(x, h) == h
                assert len(set(names.values())) == len(names)


def test_sliced_columns():
    column = pa.array(["one two", "three", None, "four five six"]).slice(1, 3)
    data, at = w.text_buffers(column)
    _, _, hashes, row = w.words(data, at, 0, 3)
    assert np.diff(row).tolist() == [1, 0, 3]
