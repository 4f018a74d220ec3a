"""Benchmark decontamination by spaced seeds, verified with tolerance for substituted words.

Each mask is laid on every stretch of words and hashes the words at its ones, so a changed
word under a zero does not matter.  Hashes of the texts that pass a filter over the
benchmark's hashes, sized by their number, are joined with them.  A joined pair carries the words around the hit
on both sides, and is kept if a stretch that covers the hit agrees in enough places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from predio.llm.frames import maybe_broadcast
from predio.llm.words import KEEP_CASE, PLACES, mix, row_blocks, text_buffers, words
from predio.scale import settle

#: Ones are compared, zeros ignored, by words of the item (16 stands for more): the masks of a length hit
#: every way to change as many words as ``PERCENT`` allows.
MASKS = {
    5: ["11101", "1111", "11011", "10111"],
    6: ["11111", "11101", "100111"],
    7: ["11111", "1100111", "1111001"],
    8: ["1111101", "11101111", "10110111", "1011111"],
    9: ["1111101", "11101111", "110110011"],
    10: ["1111101", "110110011", "11101111", "1010010111", "1101001111", "1100011011", "1110001101"],
    11: ["11101111", "110110011", "1111101", "1101001111", "1010010111"],
    12: ["11101111", "1101001111", "1011110101", "111100100101", "101010011011", "110001110101"],
    13: ["11101111", "1101001111", "1101100010011", "1011110101"],
    14: ["11101111", "101010011011", "111010010111"],
    15: ["11101111", "1101100010011", "1101001111", "110001010010011", "111100100101", "101010011011"],
    16: ["110011101011", "111010010111", "11101111", "1101100010011", "1101001111", "110001010010011"],
}
SPAN = max(len(m) for masks in MASKS.values() for m in masks)
#: Words on either side of a hit that verification sees.
AROUND = 16
#: Length of the stretch that must agree, and the share of its words that must be equal.
STRETCH, PERCENT = 16, 80
#: Benchmark texts with fewer words are not looked for.
LEAST = 5
#: Bits of the filter per seed of the benchmark and bits set by each, so that about 6 in a million other hashes
#: pass, and the power of two that bounds the filter (32 MB): beyond about 8 million seeds more of them go to the join.
BITS_PER_SEED, PROBES, MOST_BITS = 32, 8, 28
WIDE = 2 * AROUND + SPAN

_U = np.uint64
#: ASCII marks separate words here.
_FOLD = KEEP_CASE.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _windows(hashes: np.ndarray, row: np.ndarray, offsets: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Masked hashes of all stretches inside a row, and where they begin."""
    span = offsets[-1] + 1
    n = len(hashes) - span + 1
    if n < 1:
        return np.empty(0, _U), np.empty(0, np.int64)
    total = np.full(n, salt, _U)
    for j in offsets:
        total += hashes[j : n + j] * PLACES[j]
    inside = np.ones(n, bool)
    for j in range(1, span):
        crossing = row[1:-1] - j
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    at = np.flatnonzero(inside)
    return mix(total[at]), at


def _seeds(lengths: list[int]) -> dict[str, list[int]]:
    """Offsets compared by each mask that items of these lengths need."""
    masks = sorted({m for n in lengths for m in MASKS[n]})
    return {m: [j for j, c in enumerate(m) if c == "1"] for m in masks}


def _around(hashes: np.ndarray, row: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words from ``AROUND`` before to ``AROUND`` after the stretch at each place; 0 outside the row."""
    place = at[:, None] + np.arange(-AROUND, SPAN + AROUND)
    real = (place >= row[owner][:, None]) & (place < row[owner + 1][:, None])
    return np.where(real, hashes[np.where(real, place, at[:, None])], _U(0))


def _filter_bits(seeds: int) -> int:
    """The filter for so many seeds has 2 to this power bits."""
    return min(MOST_BITS, max(10, (BITS_PER_SEED * seeds - 1).bit_length()))


def _slot(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The place of each hash's bit ``k`` in a filter of ``2 ** bits`` bits."""
    step = (hashes & _U(0xFFFFFFFF)) | _U(1)
    return ((hashes >> _U(32)) + _U(k) * step) & _U((1 << bits) - 1)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of all bits of each hash."""
    return np.stack([_slot(hashes, k, bits) for k in range(PROBES)])


def _set_slots(packed: np.ndarray, slots: np.ndarray) -> None:
    """Set the bits at ``slots`` in a filter of bytes."""
    slots = np.unique(slots)
    byte, first = np.unique(slots >> _U(3), return_index=True)
    if len(byte):
        one = np.left_shift(1, (slots & _U(7)).astype(np.int64)).astype(np.uint8)
        packed[byte.astype(np.int64)] |= np.bitwise_or.reduceat(one, first)


def _passes(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes all of whose bits are set."""
    at = np.arange(len(hashes))
    for k in range(PROBES):
        slot = _slot(hashes[at], k, bits)
        at = at[(packed[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 != 0]
    return at


def _fixed(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix.astype("<u8")], pa.binary())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with their word hashes; the text is the last column."""
    for batch in batches:
        data, at = text_buffers(batch.column(batch.num_columns - 1))
        for a, b in row_blocks(at):
            _, _, hashes, row = words(data, at, a, b, _FOLD)
            # 0 stands for no word.
            yield batch.slice(a, b - a), np.where(hashes == 0, _U(1), hashes), row


def _lengths(benchmark: DataFrame) -> list[int]:
    """Numbers of words that items have, none above ``STRETCH``."""

    def run(batches):
        for batch, _, row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.diff(row), STRETCH))], names=["n"])

    lengths = benchmark.mapInArrow(run, "n bigint").filter(F.col("n") >= LEAST).distinct()
    return sorted(r["n"] for r in lengths.collect())  # at most STRETCH values


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Verified overlaps: one row per text and benchmark item, with the stretch that agrees best.

    Columns: ``key``, ``_print`` (a hash of the text, so that texts sharing a key stay apart), ``item``,
    ``words`` and ``equal`` (length of the stretch and equal words in it) and ``hits``.  Words are runs of
    letters and digits, in lower case (ASCII marks separate).  A stretch of 16 words, or the whole item if that is
    shorter, must agree in at least 80 % of its words; items of fewer than 5 words (or null or empty ones)
    are hit by none.  Null and empty texts overlap with
    nothing; a missing key is kept as such; repeated rows give one row; an empty table on either side gives
    an empty table.  Other columns are not looked at.
    """
    items = benchmark.select(F.col(item).alias("_item"), F.lower(F.coalesce(F.col(item_text), F.lit(""))).alias("_text")).distinct()
    seeds = _seeds(_lengths(items.select("_text")))

    def seed_items(batches):
        for batch, hashes, row in _rows(batches):
            size = np.diff(row)
            for k, (mask, offsets) in enumerate(seeds.items()):
                found, at = _windows(hashes, row, offsets, k)
                owner = np.searchsorted(row, at, "right") - 1
                # Each mask is for items of some lengths only.
                own = np.isin(np.minimum(size[owner], STRETCH), [n for n in MASKS if mask in MASKS[n]])
                found, at, owner = found[own], at[own], owner[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)), batch.column(0).take(pa.array(owner)),
                        pa.array(np.minimum(size[owner], STRETCH).astype(np.int32)), _fixed(_around(hashes, row, owner, at)),
                    ],
                    names=["_hash", "_item", "_least", "_item_words"],
                )

    kind = items.schema["_item"].dataType.simpleString()
    test = settle(items.mapInArrow(seed_items, f"_hash bigint, _item {kind}, _least int, _item_words binary"), "seeds")

    distinct = settle(test.select("_hash").distinct(), "seed_hashes")
    bits = _filter_bits(distinct.count())

    def partial_filter(batches):
        part = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            _set_slots(part, _slots(batch.column(0).to_numpy().view(_U), bits).ravel())
        yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["bits"])

    # A filter for each of at most 8 parts of the seeds, joined by "or".
    whole = np.zeros(1 << bits - 3, np.uint8)
    for r in distinct.coalesce(8).mapInArrow(partial_filter, "bits binary").toLocalIterator():
        whole |= np.frombuffer(r["bits"], np.uint8)
    packed = whole.tobytes()

    def seed_texts(batches):
        known = np.frombuffer(packed, np.uint8)
        for batch, hashes, row in _rows(batches):
            for k, offsets in enumerate(seeds.values()):
                found, at = _windows(hashes, row, offsets, k)
                hit = _passes(known, found, bits)
                found, at = found[hit], at[hit]
                owner = np.searchsorted(row, at, "right") - 1
                for a in range(0, len(at), 1 << 14):
                    o, p = owner[a : a + (1 << 14)], at[a : a + (1 << 14)]
                    take = pa.array(o)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found[a : a + (1 << 14)].view(np.int64)), batch.column(0).take(take),
                            batch.column(1).take(take), _fixed(_around(hashes, row, o, p)),
                        ],
                        names=["_hash", "_key", "_print", "_text_words"],
                    )

    texts = docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_print"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")
    )
    key_kind = texts.schema["_key"].dataType.simpleString()
    train = texts.mapInArrow(seed_texts, f"_hash bigint, _key {key_kind}, _print bigint, _text_words binary")
    pairs = train.join(test, "_hash").select("_key", "_print", "_item", "_least", "_text_words", "_item_words")

    def verify(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            side = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(n, WIDE)
            equal = (side(4) == side(5)) & (side(5) != 0)
            there = side(5) != 0
            least = batch.column(3).to_numpy()
            sums = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(equal, 1)], 1)
            real = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(there, 1)], 1)
            best = np.full(n, -1)
            for size in np.unique(least).tolist():
                own = least == size
                # Stretches inside the item that meet the seed.
                for a in range(max(0, AROUND - size + 1), AROUND + SPAN):
                    if a + size > WIDE:
                        break
                    whole = own & (real[:, a + size] - real[:, a] == size)
                    agree = sums[:, a + size] - sums[:, a]
                    best = np.where(whole & (agree > best), agree, best)
            good = np.flatnonzero(100 * best >= PERCENT * least)
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(take) for i in range(4)], pa.array(best[good].astype(np.int32))],
                names=["_key", "_print", "_item", "_words", "_equal"],
            )

    found = pairs.mapInArrow(verify, f"_key {key_kind}, _print bigint, _item {kind}, _words int, _equal int")
    best = F.max(F.struct((F.col("_equal") / F.col("_words")).alias("share"), "_words", "_equal")).alias("_best")
    return found.groupBy("_key", "_print", "_item").agg(best, F.count("*").alias("hits")).select(
        F.col("_key").alias(key), "_print", F.col("_item").alias(item), F.col("_best._words").alias("words"),
        F.col("_best._equal").alias("equal"), "hits",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the texts that overlap with a benchmark item; all columns and repeated rows stay."""
    bad = overlaps(docs, benchmark, key, text, **names).select(F.col(key).alias("_bad_key"), F.col("_print").alias("_bad_print")).distinct()
    bad = maybe_broadcast(settle(bad, "contaminated"))
    same: Column = docs[key].eqNullSafe(F.col("_bad_key")) & (F.xxhash64(docs[text]) == F.col("_bad_print"))
    return docs.join(bad, same, "left_anti")
