"""Growing regression trees on binned rows with numpy: many trees level by level at once.

Nodes are numbered like a heap (root 1, children 2k and 2k + 1).  A node's split needs only its
``(weight, weighted label)`` sums per feature and bin, which are added up for all open nodes of
all trees in one pass per feature, whether over rows held here or over sums from other tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NODES = 1 << 12  # nodes whose splits are compared at once
_U = np.uint64
# --- fixed values: the primes of 64-bit xxHash --------------------------------
_P1, _P2, _P3, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
# Cumulative Poisson(1) probabilities: a bootstrap weight is the number of them below u.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
           0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
# ------------------------------------------------------------------------------


def hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """The 64-bit xxHash of a 32-bit number, as Spark's ``xxhash64`` chains it to a seed."""
    h = seed.astype(_U) + _P5 + _U(4)
    h = h ^ (np.atleast_1d(np.asarray(value)).astype(_U) & _U(0xFFFFFFFF)) * _P1
    h = ((h << _U(23)) | (h >> _U(41))) * _P2 + _P3
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def weights(key_hash: np.ndarray, run: int, tree: int) -> np.ndarray:
    """Bootstrap weights of rows in a tree: Poisson(1), from the hash of key, run and tree."""
    return tree_weights(hash_int(run, key_hash.view(_U)), tree)


def tree_weights(run_hash: np.ndarray, tree: int) -> np.ndarray:
    """``weights`` from the hash of key and run."""
    u = (hash_int(tree, run_hash) >> _U(11)).astype(np.float64) / float(1 << 53)
    below = np.zeros(len(u), np.int8)
    for p in POISSON:
        below += u > p
    return below.astype(np.float64)


def cells(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``bins`` in order, and the place of every row among them."""
    order = np.lexsort(bins.T[::-1])
    ordered = bins[order]
    first = np.ones(len(bins), bool)
    first[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(bins), np.int64)
    place[order] = np.cumsum(first) - 1
    return ordered[first], place


def cell_hash(bins: np.ndarray) -> np.ndarray:
    """The hash that Spark's ``xxhash64`` gives the rows of ``bins`` as arrays of numbers."""
    h = np.full(len(bins), 42, _U)
    for f in range(bins.shape[1]):
        h = hash_int(bins[:, f].astype(np.int64), h)
    return h.view(np.int64)


@dataclass(frozen=True)
class Growth:
    """What decides a tree's shape; ``subset`` features are drawn for each node."""

    max_depth: int
    leaf_rows: int
    subset: int
    min_split: int
    bins: int


def drawn(growth: Growth, features: int, seed: int, run: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray | None:
    """Which features each node may split on; None means all of them."""
    if growth.subset >= features:
        return None
    of_node = hash_int(node & 0xFFFFFFFF, hash_int(tree, hash_int(run, np.full(len(tree), seed, np.int64).view(_U))))
    order = np.stack([hash_int(f, of_node) for f in range(features)], axis=1).argsort(axis=1, kind="stable")
    out = np.zeros((len(tree), features), bool)
    np.put_along_axis(out, order[:, : growth.subset], True, axis=1)
    return out


class BestSplit:
    """The best split of each node, offered one feature after the other; the first best wins."""

    def __init__(self, n: np.ndarray, s: np.ndarray, growth: Growth):
        self.n, self.s, self.growth = n, s, growth
        self.parent = s * s / n
        self.gain = self.parent * 1e-12
        self.feature = np.full(len(n), -1, np.int32)
        self.cut = np.zeros(len(n), np.int32)

    def offer(self, feature: int, hn: np.ndarray, hs: np.ndarray, allowed: np.ndarray | None) -> None:
        """``hn`` and ``hs``: sums of weights and of weighted labels per node and bin."""
        for at in range(0, len(self.n), NODES):
            own = slice(at, at + NODES)
            self._offer(own, feature, hn[own], hs[own], None if allowed is None else allowed[own])

    def _offer(self, own: slice, feature: int, hn: np.ndarray, hs: np.ndarray, allowed: np.ndarray | None) -> None:
        n, s = self.n[own], self.s[own]
        nl, sl = np.cumsum(hn, axis=1)[:, :-1], np.cumsum(hs, axis=1)[:, :-1]
        nr, sr = n[:, None] - nl, s[:, None] - sl
        least = max(self.growth.leaf_rows, 1)
        fits = (nl >= least) & (nr >= least) & (n >= self.growth.min_split)[:, None]
        if allowed is not None:
            fits &= allowed[:, feature, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, sl * sl / nl + sr * sr / nr - self.parent[own, None], -np.inf)
        at = gain.argmax(axis=1)
        best = gain[np.arange(len(at)), at]
        better = best > self.gain[own]
        self.gain[own] = np.where(better, best, self.gain[own])
        self.feature[own][better] = feature
        self.cut[own][better] = at[better]


@dataclass
class Nodes:
    """Nodes of one level: arrays of equal length; ``feature`` is -1 for a leaf."""

    tree: np.ndarray
    node: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray


class Held:
    """Held-out rows on their way down: for every minimum split the mean of the node where it would stop.

    ``at[d]`` has those means, ``[min_splits, rows]``, for each recorded depth d.
    """

    def __init__(self, count: int, depths, min_splits):
        self.depths, self.min_splits = tuple(depths), tuple(min_splits)
        self.value = np.zeros((len(self.min_splits), count))
        self.going = np.ones((len(self.min_splits), count), bool)
        self.at: dict[int, np.ndarray] = {}

    def visit(self, depth: int, rows: np.ndarray, mean: np.ndarray, n: np.ndarray) -> None:
        for i, least in enumerate(self.min_splits):
            going = self.going[i, rows]
            self.value[i, rows] = np.where(going, mean, self.value[i, rows])
            self.going[i, rows] = going & (n >= least)
        if depth in self.depths:
            self.at[depth] = self.value.copy()

    def finish(self) -> np.ndarray:
        """``[depths, min_splits, rows]``."""
        return np.stack([self.at.get(d, self.value) for d in self.depths])


def grow(
    bins: np.ndarray, slot: np.ndarray, row: np.ndarray, w: np.ndarray, wy: np.ndarray, tree: np.ndarray, node: np.ndarray,
    growth: Growth, seed: int, run: int, held: Held | None = None, held_bins: np.ndarray | None = None,
    held_slot: np.ndarray | None = None, held_row: np.ndarray | None = None, keep: bool = False,
) -> list[Nodes]:
    """Grow the subtrees below the nodes ``(tree, node)``, all at one depth.

    Entries are rows in a tree: ``slot`` numbers their node, ``row`` their place in ``bins``, ``w`` is their
    weight and ``wy`` their weighted label.  Held-out entries follow their nodes down, whichever rows they are.
    """
    levels: list[Nodes] = []
    depth = int(node[0]).bit_length() - 1 if len(node) else 0
    going = np.arange(len(held_slot)) if held is not None else None  # held entries in an open node
    while len(node):
        count = len(node)
        n, s = np.bincount(slot, w, count), np.bincount(slot, wy, count)
        with np.errstate(invalid="ignore"):
            mean = s / n
        if held is not None:
            held.visit(depth, going, mean[held_slot], n[held_slot])
        best = BestSplit(n, s, growth)
        if depth < growth.max_depth:
            allowed = drawn(growth, bins.shape[1], seed, run, tree, node)
            for f in range(bins.shape[1]):
                cell = slot * growth.bins + bins[row, f]
                size = count * growth.bins
                shape = (count, growth.bins)
                best.offer(f, np.bincount(cell, w, size).reshape(shape), np.bincount(cell, wy, size).reshape(shape), allowed)
        if keep:
            levels.append(Nodes(tree, node, n, mean, best.feature, best.cut, np.where(best.feature >= 0, best.gain, 0.0)))
        split = best.feature >= 0
        child = np.cumsum(split) * 2 - 2  # slot of the left child
        open_rows = split[slot]
        slot, row, w, wy = slot[open_rows], row[open_rows], w[open_rows], wy[open_rows]
        slot = child[slot] + (bins[row, best.feature[slot]] > best.cut[slot])
        if held is not None:
            on = split[held_slot]
            going, held_slot, held_row = going[on], held_slot[on], held_row[on]
            held_slot = child[held_slot] + (held_bins[held_row, best.feature[held_slot]] > best.cut[held_slot])
        tree, node = np.repeat(tree[split], 2), np.repeat(node[split] * 2, 2)
        node[1::2] += 1
        depth += 1
    return levels


def grow_slice(
    bins: np.ndarray, y: np.ndarray, key_hash: np.ndarray, trees: range, growth: Growth, seed: int, run: int,
    held_bins: np.ndarray | None = None, depths=(), min_splits=(), keep: bool = False,
) -> tuple[list[Nodes], np.ndarray | None]:
    """Whole trees on rows held here; with held-out rows, their values ``[depths, min_splits, trees, rows]``."""
    w = np.stack([weights(key_hash, run, t) for t in trees])
    return grow_sums(bins, w, w * y, trees, growth, seed, run, held_bins, depths, min_splits, keep)


def grow_sums(
    bins: np.ndarray, w: np.ndarray, wy: np.ndarray, trees: range, growth: Growth, seed: int, run: int,
    held_bins: np.ndarray | None = None, depths=(), min_splits=(), keep: bool = False,
) -> tuple[list[Nodes], np.ndarray | None]:
    """As ``grow_slice``, from the weights and weighted labels ``[trees, rows]`` of rows, or their sums over rows with equal bins."""
    slot, row = np.nonzero(w)
    have = np.bincount(slot, minlength=len(trees)) > 0  # a tree without a row has no nodes
    number = np.cumsum(have) - 1
    tree = np.array(trees, np.int64)[have]
    held = held_slot = held_row = None
    if held_bins is not None:
        held = Held(int(have.sum()) * len(held_bins), depths, min_splits)
        held_slot = np.repeat(np.arange(int(have.sum())), len(held_bins))
        held_row = np.tile(np.arange(len(held_bins)), int(have.sum()))
    root = np.ones(len(tree), np.int64)
    levels = grow(bins, number[slot], row, w[slot, row], wy[slot, row], tree, root, growth, seed, run, held, held_bins, held_slot, held_row, keep)
    if held is None:
        return levels, None
    values = np.full((len(depths), len(min_splits), len(trees), len(held_bins)), np.nan)
    values[:, :, have] = held.finish().reshape(len(depths), len(min_splits), -1, len(held_bins))
    return levels, values
