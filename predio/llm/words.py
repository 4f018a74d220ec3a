"""Words and shingles of whole texts as arrays, computed batch by batch from Arrow buffers.

A word is a run of bytes outside space and 09-0D.  Its hash is a polynomial over its bytes,
read off a running sum, so no Python object is made per word.  Bytes are taken in slices of
at most ``SLICE`` that end at a word's end, which bounds the working memory at any text size;
a single word longer than that makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP_CASE = np.arange(256, dtype=np.uint8)
#: Odd multipliers by position in a shingle.
PLACES = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64) for j in range(256)], _U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
        filled += step
    return out


_tables: dict[str, np.ndarray] = {"up": _powers(_BASE, SLICE), "down": _powers(pow(_BASE, -1, 1 << 64), SLICE)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; longer than ``SLICE`` only for one huge word."""
    if n > SLICE:
        return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def row_blocks(at: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes; a longer row is a run of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def cut(data: np.ndarray, edges: np.ndarray, begin: int, hi: int) -> int:
    """Where the slice from ``begin`` ends: the last word's or row's end in reach, else the next one."""
    reach = begin + SLICE
    if reach >= hi:
        return hi
    gaps = np.flatnonzero(SPACE[data[begin:reach]])
    row = int(edges[np.searchsorted(edges, reach, "right") - 1])
    stop = max(begin + int(gaps[-1]) + 1 if len(gaps) else 0, row)
    if stop > begin:
        return stop
    row = int(edges[np.searchsorted(edges, reach)])
    for at in range(reach, row, SLICE):
        ahead = np.flatnonzero(SPACE[data[at : min(row, at + SLICE)]])
        if len(ahead):
            return at + int(ahead[0]) + 1
    return row


def range_hashes(piece: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``piece[s:e]``, alike wherever they stand."""
    up, down = _power_tables(len(piece))
    total = np.empty(len(piece) + 1, _U)
    total[0] = 0
    np.cumsum((piece.astype(_U) + _U(1)) * up[: len(piece)], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xA24BAED4963EE407))


def words(data: np.ndarray, at: np.ndarray, first: int, last: int, fold: np.ndarray = KEEP_CASE):
    """Word starts, ends and hashes of rows ``first`` to ``last``, and the word number where each row begins."""
    lo, hi = int(at[first]), int(at[last])
    edges = at[first : last + 1]
    starts, ends, hashes = [], [], []
    begin = lo
    while begin < hi:
        stop = cut(data, edges, begin, hi)
        piece = fold[data[begin:stop]]
        solid = np.empty(len(piece) + 2, bool)
        solid[0] = solid[-1] = False
        np.logical_not(SPACE[piece], out=solid[1:-1])
        inside = edges[np.searchsorted(edges, begin + 1) : np.searchsorted(edges, stop)] - begin  # rows that begin here
        change = solid[1:] != solid[:-1]
        s = change & solid[1:]
        e = change & solid[:-1]
        if len(inside):
            joined = inside[solid[inside] & solid[inside + 1]]
            s[joined] = True
            e[joined] = True
        s, e = np.flatnonzero(s), np.flatnonzero(e)
        hashes.append(range_hashes(piece, s, e))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = stop
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, _U), np.zeros(last - first + 1, np.int64)
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return starts, ends, hashes, np.searchsorted(starts, edges)


def shingles(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles, row after row, and where each row begins.

    A row with one to ``k`` - 1 words has its whole sequence as its only shingle.
    """
    counts = np.diff(row)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(int(begin[-1]), _U)
    n = len(hashes) - k + 1
    if n > 0:
        total = hashes[:n] * PLACES[0]
        for j in range(1, k):
            total += hashes[j : n + j] * PLACES[j]
        full = np.ones(n, bool)  # does the shingle end in its own row?
        for j in range(1, k):
            crossing = row[1:-1] - j
            crossing = crossing[(crossing >= 0) & (crossing < n)]
            full[crossing] = False
        # Rows shorter than k hold no full shingle: every start in them is marked above.
        target = np.ones(int(begin[-1]), bool)
        target[begin[:-1][(counts > 0) & (counts < k)]] = False
        out[target] = mix(total[full])
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        own = hashes[row[r] : row[r + 1]]
        out[begin[r]] = mix((own * PLACES[: len(own)]).sum(dtype=_U).reshape(1) + _U(len(own)))[0]
    return out, begin
