"""BPE encoding and decoding with word ends, by speculation and verification.

A word's tokens are proposed greedily, longest match first.  The proposal is right exactly
if no merge of the vocabulary would cross the border of two neighbouring tokens before they
are complete; that is checked for all distinct neighbours at once with arrays.  Only words
that fail are merged step by step.

Words are encoded independently of their neighbours, so each distinct word of some MB of text
is encoded once, and frequent ones are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from predio.llm.frames import add_columns
from predio.llm.words import LOWER, SPACE, cut, range_hashes, text_buffers

#: Bytes of text encoded at once, and units whose ids a Python worker keeps.
BLOCK = 1 << 20
CACHED = 1 << 18
_NEVER = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Lookup:
    """A hash table from whole numbers to whole numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for unknown keys."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class WordBpe:
    """Merges of one vocabulary, applied to many words at once; words are bytes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocabulary.values()) + 1
        self.size = np.int64(size)
        a = np.array([vocabulary[x] for x, _ in merges], np.int64)
        b = np.array([vocabulary[y] for _, y in merges], np.int64)
        self.made = np.array([vocabulary[x + y] for x, y in merges], np.int64)
        self.rank = Lookup(a * size + b, np.arange(len(merges), dtype=np.int64))
        born = np.full(size, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        if not (np.maximum(born[a], born[b]) < born[self.made]).all():
            raise ValueError("a merge stands before the merges that make its parts")
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        left[self.made], right[self.made] = a, b
        self.right_spine, self.right_until = self._spine(right, born)
        self.left_spine, self.left_until = self._spine(left, born)
        # Tokens that merging their own characters yields; parts have lower ranks than wholes.
        sound = np.ones(size, bool)
        whole = self._apart(a, b, np.arange(len(merges), dtype=np.int64))
        for z, x, y, ok in zip(self.made.tolist(), a.tolist(), b.tolist(), whole.tolist()):
            sound[z] = ok and sound[x] and sound[y]
        symbols = byte_symbols()
        self.inside = np.array([vocabulary[c] for c in symbols], np.int64)
        self.ending = np.array([vocabulary[c + suffix] for c in symbols], np.int64)
        self._plant(vocabulary, suffix, sound, {c: i for i, c in enumerate(symbols)})

    def _plant(self, vocabulary: dict[str, int], suffix: str, sound: np.ndarray, byte: dict[str, int]) -> None:
        """The tree of all tokens by their bytes, with the token that stands inside or ends a word."""
        child: dict[int, int] = {}
        inside, ending = [-1], [-1]
        for token, i in vocabulary.items():
            if not sound[i]:
                continue
            ends = token.endswith(suffix) and len(token) > len(suffix)
            node = 0
            for c in token[: -len(suffix)] if ends else token:
                key = node * 256 + byte[c]
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(inside)
                    inside.append(-1)
                    ending.append(-1)
            (ending if ends else inside)[node] = i
        self.child = Lookup(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        self.token_inside, self.token_ending = np.array(inside), np.array(ending)

    @staticmethod
    def _spine(child: np.ndarray, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the parts at one edge, from the whole inwards, and the rank that ends each part."""
        now = np.arange(len(child), dtype=np.int64)
        spine, ends = [now], [np.full(len(child), _NEVER)]
        while True:
            inner = np.where(now >= 0, child[now], -1)
            if (inner < 0).all():
                return np.stack(spine, 1), np.stack(ends, 1)
            spine.append(inner)
            ends.append(np.where(now >= 0, born[now], 0))
            now = inner

    def _apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """True where no merge (of a rank below ``limit``) crosses the border between tokens a and b.

        Equal ranks go from left to right: inside a first, across the border before inside b.
        """
        apart = np.ones(len(a), bool)
        for j in range(self.right_spine.shape[1]):
            outer = np.flatnonzero(self.right_spine[a, j] >= 0)
            if not len(outer):
                break
            some = outer
            for k in range(self.left_spine.shape[1]):
                v = self.left_spine[b[some], k]
                some, v = some[v >= 0], v[v >= 0]
                if not len(some):
                    break
                rank = self.rank(self.right_spine[a[some], j] * self.size + v)
                hit = (rank >= 0) & (rank < self.right_until[a[some], j]) & (rank <= self.left_until[b[some], k])
                if limit is not None:
                    hit &= rank < limit[some]
                apart[some[hit]] = False
        return apart

    def propose(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all words side by side: tokens word after word, and each one's word."""
        word, at, found, owner = np.arange(len(start)), start.copy(), [], []
        while len(word):
            walk, node, now = np.arange(len(word)), np.zeros(len(word), np.int64), at.copy()
            token, stop = np.full(len(word), -1, np.int64), at.copy()
            while len(walk):
                node = self.child(node * 256 + flat[now])
                alive = node >= 0
                walk, node, now = walk[alive], node[alive], now[alive] + 1
                last = now == end[word[walk]]
                match = np.where(last, self.token_ending[node], self.token_inside[node])
                good = match >= 0
                token[walk[good]], stop[walk[good]] = match[good], now[good]
                walk, node, now = walk[~last], node[~last], now[~last]
            found.append(token)
            owner.append(word)
            more = stop < end[word]
            word, at = word[more], stop[more]
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return found[order], owner[order]

    def merge(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words side by side, lowest rank first and from left to right."""
        found, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        length = end - start
        for bits in np.unique(np.ceil(np.log2(length)).astype(int)).tolist():
            width = 1 << bits
            own = np.flatnonzero((length <= width) & (length > width // 2))
            for group in np.array_split(own, max(1, len(own) * width >> 20)):
                self._merge(flat, start[group], length[group], width, group, found, owner)
        return np.concatenate(found), np.concatenate(owner)

    def _merge(self, flat, start, length, width: int, group: np.ndarray, out: list, owner: list) -> None:
        column = np.arange(width)
        real = column < length[:, None]
        ids = np.where(real, self.inside[flat[np.where(real, start[:, None] + column, start[:, None])]], -1)
        ids[np.arange(len(group)), length - 1] = self.ending[flat[start + length - 1]]
        rank = np.full(ids.shape, _NEVER)
        pairs = real[:, 1:]
        found = self.rank(ids[:, :-1][pairs] * self.size + ids[:, 1:][pairs])
        rank[:, :-1][pairs] = np.where(found >= 0, found, _NEVER)
        left = length.copy()
        while len(group):
            at = rank.argmin(1)
            best = rank[np.arange(len(group)), at]
            done = best == _NEVER
            if done.any():
                out.append(ids[done][column < left[done][:, None]])
                owner.append(np.repeat(group[done], left[done]))
                keep = ~done
                group, ids, rank, at, best, left = group[keep], ids[keep], rank[keep], at[keep], best[keep], left[keep]
            line = np.arange(len(group))
            shifted = np.minimum(column + (column > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, shifted, 1), np.take_along_axis(rank, shifted, 1)
            ids[line, at] = self.made[best]
            left = left - 1
            rank[line, left - 1] = _NEVER
            for side in (0, -1):
                some = np.flatnonzero((at + side >= 0) & (at + side + 1 < left))
                i = at[some] + side
                found = self.rank(ids[some, i] * self.size + ids[some, i + 1])
                rank[some, i] = np.where(found >= 0, found, _NEVER)

    def __call__(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words ``flat[start:end]``, word after word, and their numbers."""
        token, owner = self.propose(flat, start, end)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(token[at] * self.size + token[at + 1], return_inverse=True)
        wrong = np.unique(owner[at[~self._apart(pairs // self.size, pairs % self.size)[where]]])
        if len(wrong):
            merged, which = self.merge(flat, start[wrong], end[wrong])
            right = ~np.isin(owner, wrong)
            token, owner = np.concatenate([token[right], merged]), np.concatenate([owner[right], wrong[which]])
            token = token[np.argsort(owner, kind="stable")]
        return token, np.bincount(owner, minlength=len(start))


class LibraryWords:
    """The same for the tokenizers library's own model: one call for many words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        full = Tokenizer.from_file(path)
        self.model = Tokenizer(full.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = full.model.end_of_word_suffix
        self.ends = np.zeros(full.get_vocab_size(with_added_tokens=False), bool)
        for token, i in full.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(suffix) and len(token) > len(suffix)

    def __call__(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = flat.tobytes()
        text = b" ".join([raw[a:b] for a, b in zip(start.tolist(), end.tolist())]).decode()
        token = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        stop = np.flatnonzero(self.ends[token])  # every word has one token that ends it
        return token, np.diff(stop, prepend=-1)


_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[SPACE] = _SPACE
_CLASS[ord("'")] = _ODD


def units(data: np.ndarray, at: np.ndarray, first: int, last: int):
    """What is encoded on its own in rows ``first`` to ``last``: words and odd chunks.

    Chunks of ASCII without apostrophes and of accented Latin-1 letters are lowered and split into
    runs of letters, single digits and runs of marks; other chunks stay whole.  Gives the lowered
    bytes from the first row on, unit starts and ends in them, hashes, which units are odd chunks,
    and the unit where each row begins.
    """
    lo, hi = int(at[first]), int(at[last])
    edges = at[first : last + 1]
    lowered = np.empty(hi - lo, np.uint8)
    starts, ends, hashes, odds = [], [], [], []
    begin = lo
    while begin < hi:
        stop = cut(data, edges, begin, hi)
        piece = data[begin:stop]
        kind = _CLASS[piece]
        low = LOWER[piece]
        if (piece >= 128).any():
            lead = np.flatnonzero(piece[:-1] == 0xC3)
            after = piece[lead + 1]
            fine = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
            lead, after = lead[fine], after[fine]
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead[after < 0x9F] + 1] += 32
        kind[np.flatnonzero((piece[:-1] == 60) & (piece[1:] == 124))] = _ODD
        change = np.empty(len(piece) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[:-1] |= kind == _DIGIT
        change[edges[np.searchsorted(edges, begin + 1) : np.searchsorted(edges, stop)] - begin] = True
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            solid = kind != _SPACE
            edge = np.ones(len(piece) + 1, bool)  # where chunks begin and end
            np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
            edge[edges[np.searchsorted(edges, begin + 1) : np.searchsorted(edges, stop)] - begin] = True
            edge = np.flatnonzero(edge)
            for i in np.unique(np.searchsorted(edge, odd, "right") - 1).tolist():
                a, b = edge[i], edge[i + 1]
                change[a + 1 : b] = False
                kind[a:b] = _ODD
                low[a:b] = piece[a:b]
        edge = np.flatnonzero(change)
        s, e = edge[:-1], edge[1:]
        real = kind[s] != _SPACE
        s, e = s[real], e[real]
        odd = kind[s] == _ODD
        hashes.append(range_hashes(low, s, e) ^ np.where(odd, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)))
        lowered[begin - lo : stop - lo] = low
        starts.append(s + (begin - lo))
        ends.append(e + (begin - lo))
        odds.append(odd)
        begin = stop
    if not starts:
        none = np.empty(0, np.int64)
        return lowered, none, none, np.empty(0, np.uint64), np.empty(0, bool), np.zeros(last - first + 1, np.int64)
    starts = np.concatenate(starts)
    return (
        lowered, starts, np.concatenate(ends), np.concatenate(hashes), np.concatenate(odds),
        np.searchsorted(starts, edges - lo),
    )


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, … of each run, run after run."""
    total = np.cumsum(length)
    return np.repeat(start - (total - length), length) + np.arange(int(total[-1]) if len(total) else 0)


class TextEncoder:
    """Encodes whole texts; ``encode_words`` maps distinct new words to ids.

    Ids of up to ``CACHED`` units are kept between calls, by their 64-bit hash.
    """

    def __init__(self, path: str, library: bool = False) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.encode_words = LibraryWords(path) if library else WordBpe(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = t
        self.byte = {ord(c): b for b, c in enumerate(byte_symbols())}
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _odd(self, chunk: bytes) -> list[int]:
        """Ids of a chunk with other characters: words by the library's rules, special tokens by their strings."""
        out: list[int] = []
        text = chunk.decode("utf-8", "replace")
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                split = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
                words = [w.translate(self.byte).encode("latin-1") for w, _ in split]
                if words:
                    end = np.cumsum([len(w) for w in words])
                    flat = np.frombuffer(b"".join(words), np.uint8)
                    out += self.encode_words(flat, np.concatenate([[0], end[:-1]]), end)[0].tolist()
        return out

    def _learn(self, hashes, lowered, start, end, odd) -> None:
        """Add new units to the known ones."""
        if len(self.known) + len(hashes) > CACHED:
            self._forget()
        length = np.zeros(len(hashes), np.int64)
        found = []
        plain = np.flatnonzero(~odd)
        if len(plain):
            token, length[plain] = self.encode_words(lowered, start[plain], end[plain])
            found.append(token)
        order = [plain]
        for i in np.flatnonzero(odd).tolist():
            own = self._odd(lowered[start[i] : end[i]].tobytes())
            found.append(np.array(own, np.int64))
            length[i] = len(own)
            order.append(np.array([i]))
        order = np.concatenate(order)
        begin = np.empty(len(hashes), np.int64)
        begin[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        known = np.concatenate([self.known, hashes])
        by = np.argsort(known, kind="stable")
        self.known = known[by]
        self.start = np.concatenate([self.start, begin])[by]
        self.length = np.concatenate([self.length, length])[by]
        self.ids = np.concatenate([self.ids, *[f.astype(np.uint32) for f in found]])

    def encode(self, data: np.ndarray, at: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows ``first`` to ``last``, row after row, and where each row begins in them."""
        lowered, start, end, hashes, odd, row = units(data, at, first, last)
        if not len(hashes):
            return np.empty(0, np.uint32), np.zeros(last - first + 1, np.int64)
        unique, one, each = np.unique(hashes, return_index=True, return_inverse=True)

        def missing() -> np.ndarray:
            if not len(self.known):
                return np.arange(len(unique))
            at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            return np.flatnonzero(self.known[at] != unique)

        new = missing()
        if len(new):
            if len(self.known) + len(new) > CACHED:  # start again from this block
                self._forget()
                new = missing()
            self._learn(unique[new], lowered, start[one[new]], end[one[new]], odd[one[new]])
        unit = np.searchsorted(self.known, unique)[each]
        length = self.length[unit]
        ids = self.ids[ragged(self.start[unit], length)]
        return ids, np.concatenate([[0], np.cumsum(length)])[row]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def encoder(path: str, library: bool = False) -> TextEncoder:
    """One encoder per Python worker and vocabulary file."""
    return TextEncoder(path, library)


def binary_rows(values: np.ndarray, row: np.ndarray) -> pa.Array:
    """A binary column with one slice of ``values`` per row."""
    offsets = (row * values.itemsize).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(row) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )
    return large.cast(pa.binary())


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, library: bool = False
) -> DataFrame:
    """Add ``ids``, the token ids of the whole text as little-endian unsigned 32-bit integers.

    ``path`` is a vocabulary file of the tokenizers library (BPE with a word-end suffix and byte
    symbols) that stands at the same place on every machine.  With ``decoded`` the text decoded
    from those ids is added too.  The strings of special tokens get their ids, as the library does.
    With ``library`` the library's model encodes the distinct words.

    A null or empty text has no ids and decodes to an empty text; other columns may be null and
    are passed on; rows may repeat; an empty table gives an empty table; columns of ``df`` named
    like a new one are replaced.  Texts of any length are encoded whole.
    """
    fields = [T.StructField(ids, T.BinaryType(), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))

    def work():
        own = encoder(path, library)

        def run(column: pa.Array) -> list[pa.Array]:
            data, at = text_buffers(column)
            found, row = own.encode(data, at, 0, len(column))
            out = [binary_rows(found.astype("<u4", copy=False), row)]
            if decoded:
                texts = [own.decode(found[a:b]) for a, b in zip(row[:-1].tolist(), row[1:].tolist())]
                out.append(pa.array(texts, pa.string()))
            return out

        return run

    return add_columns(df, fields, work, text, BLOCK)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, decoded from ``ids``; null ids give an empty text, an unknown id is an error."""

    def work():
        own = encoder(path)
        return lambda column: [pa.array([own.decode(np.frombuffer(e, "<u4")) for e in column.to_pylist()], pa.string())]

    source = df.withColumn(ids, F.coalesce(F.col(ids), F.lit(b"")))
    return add_columns(source, [T.StructField(text, T.StringType(), False)], work, ids)
