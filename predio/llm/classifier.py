"""A quality classifier: supervised subword embeddings, averaged per document, with a softmax.

Features are hashed words, pairs of neighbouring words and character n-grams of words with
their borders.  Their vectors and the softmax are learnt by stochastic gradient descent in
numpy, on a bounded, balanced sample of labelled documents.  Averaging and the softmax's
input are linear, so a document's score needs one number per feature: scoring is a lookup
over whole texts inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from predio.llm.frames import add_columns
from predio.llm.words import PLACES, mix, text_buffers, words
from predio.scale import settle

#: Labelled documents learnt from at most, per label.
SAMPLE = 1200
BITS = 16
NGRAMS = (3, 4)
_U = np.uint64
_BLANK = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint32)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BITS)).astype(np.int64)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of all rows, kind by kind, with the place where each row begins."""
    data, at = text_buffers(column)
    n = len(column)
    _, _, hashes, row = words(data, at, 0, n)
    yield _bucket(hashes), row
    if len(hashes) > 1:
        # Word pairs; a word said twice is the same feature for every word.
        pair = mix(hashes[:-1] * PLACES[1] + hashes[1:] * PLACES[2])
        pair[hashes[:-1] == hashes[1:]] = _U(0x0123456789ABCDEF)
        own = np.ones(len(pair), bool)
        crossing = row[1:-1] - 1
        own[crossing[(crossing >= 0) & (crossing < len(pair))]] = False
        kept = np.flatnonzero(own)
        yield _bucket(pair[kept]), np.searchsorted(kept, row)
    raw = data[at[0] : at[n]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    edges = np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), at - at[0])
    blank = (points <= 0x20) & np.isin(points, _BLANK)
    points = np.where(blank, np.uint32(0x20), points).astype(_U)
    spaces = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    for size in NGRAMS:
        m = len(points) - size + 1
        if m < 1:
            continue
        gram = points[:m] * PLACES[8]
        for j in range(1, size):
            gram += points[j : m + j] * PLACES[8 + j]
        fine = spaces[size - 1 : m + size - 1] == spaces[1 : m + 1]  # no border inside
        for j in range(1, size):
            crossing = edges[1:-1] - j
            fine[crossing[(crossing >= 0) & (crossing < m)]] = False
        kept = np.flatnonzero(fine)
        yield _bucket(mix(gram[kept] + _U(size))), np.searchsorted(kept, edges)


@dataclass
class Model:
    """One number per feature bucket, and the offset that restores the labels' shares."""

    weights: np.ndarray
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(column)), np.zeros(len(column), np.int64)
        for bucket, row in _features(column):
            filled = np.flatnonzero(np.diff(row))
            if len(filled):
                total[filled] += np.add.reduceat(self.weights[bucket], row[filled], dtype=np.float64)
                count += np.diff(row)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.offset, -60, 60)))


def _bags(sample: DataFrame, text: str) -> DataFrame:
    """Distinct feature buckets of each sampled document and their counts."""

    def run(column: pa.Array) -> list[pa.Array]:
        kinds = list(_features(column))
        ids, counts = [], []
        for i in range(len(column)):
            own = np.concatenate([b[r[i] : r[i + 1]] for b, r in kinds])
            unique, count = np.unique(own, return_counts=True)
            ids.append(unique.astype("<i4").tobytes())
            counts.append(count.astype("<f4").tobytes())
        return [pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]

    fields = [T.StructField("_ids", T.BinaryType(), False), T.StructField("_counts", T.BinaryType(), False)]
    return add_columns(sample, fields, lambda: run, text, 1 << 20)


def train(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    size: int = 16,
    epochs: int = 6,
    rate: float = 0.5,
    seed: int = 0,
) -> Model:
    """Fit on at most ``sample`` documents of each label (0 and 1), those first by a hash of the key.

    Labels other than 0 and 1, labels without a document and documents without a label are passed
    over; a document labelled both ways counts as 0.  Shares and sample count labels of ``documents`` only.  Without documents of both labels the model
    scores every text by the share of label 1 (1 if there is no label at all).
    """
    spark = documents.sparkSession
    labelled = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(label).cast("int").alias("_label"))
    )
    # Only labels of the documents count, for the shares as for the sample.
    own = documents.select(F.col(key).alias("_key")).distinct()
    labelled = settle(labelled.join(own, "_key", "left_semi"), "labelled")
    shares = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    flat = Model(np.zeros(1 << BITS, np.float32), float(np.clip(np.log((n1 + 1e-9) / (n0 + 1e-9)), -30, 30)) if n0 + n1 else 30.0)
    if not n0 or not n1:
        return flat
    order = F.xxhash64(F.col("_key"), F.lit(seed))
    chosen = []
    for value in (0, 1):
        chosen += labelled.filter(F.col("_label") == value).orderBy(order, "_key").limit(sample).collect()
    # At most 2 * sample keys.
    keys = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], labelled.schema))
    texts = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = _bags(texts.join(keys, "_key"), "_text").select("_key", "_label", "_ids", "_counts").collect()
    rows.sort(key=lambda r: (str(r["_key"]), bytes(r["_ids"])))
    bags = [(np.frombuffer(r["_ids"], "<i4"), np.frombuffer(r["_counts"], "<f4"), r["_label"]) for r in rows]
    bags = [(i, c / c.sum(), y) for i, c, y in bags if len(i)]
    ones = sum(y for _, _, y in bags)
    if not ones or ones == len(bags):
        return flat

    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    softmax = np.zeros((size, 2), np.float32)
    steps, step = epochs * len(bags), 0
    share = np.array([len(bags) - ones, ones]) / len(bags)
    for _ in range(epochs):
        for i in random.permutation(len(bags)):
            ids, weight, y = bags[i]
            now = rate * (1 - step / steps) / (2 * share[y])
            step += 1
            mean = weight @ vectors[ids]
            logits = mean @ softmax
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = softmax @ p
            softmax -= now * np.outer(mean, p)
            # A bag's vectors share the step in proportion to their squared weights.
            vectors[ids] -= (now / float(weight @ weight)) * np.outer(weight, back)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return Model(weights, float(np.log(n1 / n0)))


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability (0 to 1) of label 1 for each whole text.

    A null text counts as empty and an empty text gets the labels' share; other columns may be null
    and are passed on; rows may repeat; an empty table gives an empty table; a column of ``df`` named
    like the new one is replaced.
    """
    fields = [T.StructField(name, T.DoubleType(), False)]
    return add_columns(df, fields, lambda: lambda column: [pa.array(model.scores(column))], text, 1 << 20)


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the key as text leaves 2 when divided by 4; never a missing key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
