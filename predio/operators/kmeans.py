"""K-means with restarts: every pass over the points serves all restarts at once.

Starting centres come from k-means||: a few passes draw points in proportion to their squared
distance from the points drawn so far, the drawn points are weighted by the points nearest to them,
and k-means++ picks k of these.  A Lloyd pass adds up the points nearest to each centre of each
restart that still moves; per task and centre it gives one row.  On the driver there are only
centres and drawn points: a few times k for each restart, whatever the data.

Points are stored once in blocks of near ones, spread over all cores.  A block is compared only with
centres that can be nearest to a point of its bounding box, which is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from predio.operators.tree_growth import hash_int
from predio.scale import settle

# --- fixed values: as the usual k-means ----------------------------------------
CLUSTERS = 100
RESTARTS = 10
PASSES = 300
TOLERANCE = 1e-4
# -------------------------------------------------------------------------------
_DRAWS = 5  # passes that draw starting points, about twice k each
_BLOCK = 1 << 9  # points compared with the same centres
_TASK = 1 << 12  # points worth a task of their own
_MOST = 1 << 18  # points of a stored part
_SORTED = 1 << 16  # points that a task puts in order at a time


@dataclass(frozen=True)
class KMeansModel:
    """Centres in the order of their coordinates, the inertia of every restart and the best one's."""

    centres: np.ndarray
    inertia: float
    restarts: list[float]
    passes: int

    def nearest(self, columns: list[str]) -> Column:
        """The number of the nearest centre (the first of equally near ones), as one expression."""
        centres = self.centres

        @F.arrow_udf("int")
        def number(*axes: pa.Array) -> pa.Array:
            x = np.stack([a.to_numpy(zero_copy_only=False).astype(float) for a in axes], axis=1)
            blocks = (x[at : at + _BLOCK] for at in range(0, len(x), _BLOCK))
            return pa.array(np.concatenate([_far(b, centres).argmin(axis=1) for b in blocks] or [[]]).astype(np.int32))

        return number(*columns)


def _far(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    return sum((points[:, None, j] - centres[None, :, j]) ** 2 for j in range(points.shape[1]))


def _reachable(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The numbers of the centres that may be nearest to a point of a block, by the box around it."""
    low, high = points.min(axis=0), points.max(axis=0)
    least = (np.maximum(np.maximum(low - centres, centres - high), 0) ** 2).sum(axis=1)
    most = (np.maximum(high - centres, centres - low) ** 2).sum(axis=1).min()
    return np.flatnonzero(~(least > most * (1 + 1e-9)))  # all of them if a coordinate is not a number


def _near_first(x: np.ndarray) -> np.ndarray:
    """An order of the points in which every ``_BLOCK`` of them are near each other: halves across the widest side."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= _BLOCK:
            done.append(at)
            continue
        own = x[at]
        middle = -(-len(at) // _BLOCK) // 2 * _BLOCK
        halves = at[np.argpartition(own[:, np.ptp(own, axis=0).argmax()], middle)]
        todo += [halves[middle:], halves[:middle]]
    return np.concatenate(done)


def _spread(points: DataFrame, dims: int, count: int) -> DataFrame:
    """The points (coordinates, weight, hash), stored in blocks of near ones, for as many tasks as there are cores."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-count // _MOST), min(-(-count // _TASK), 4 * cores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _SORTED:
                yield ordered(held)
                held = []
        if held:
            yield ordered(held)

    def ordered(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x = np.stack([block.column(j).to_numpy(zero_copy_only=False) for j in range(dims)], axis=1)
        return block.take(pa.array(_near_first(x)))

    ranged = points.repartitionByRange(parts, *points.columns[:dims])
    return settle(ranged.mapInArrow(run, points.schema), "spread")


def _pass(points: DataFrame, dims: int, work: Callable, schema: str) -> DataFrame:
    """``work(x, w, h)`` on blocks of points (coordinates, weights, hashes); it gives rows of arrays."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            x = np.stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(dims)], axis=1)
            w, h = (batch.column(dims + j).to_numpy(zero_copy_only=False) for j in range(2))
            for at in range(0, len(x), _BLOCK):
                work(state, x[at : at + _BLOCK], w[at : at + _BLOCK].astype(float), h[at : at + _BLOCK].view(np.uint64))
        if state:
            columns = [np.concatenate([part[i] for part in state]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return points.mapInArrow(run, schema)


def _add(state: list, columns: list[np.ndarray]) -> None:
    """Add equally long columns up in one entry of the task's state, after the first two that name the rows."""
    if not state:
        state.append([c.copy() for c in columns])
    else:
        for old, new in zip(state[0][2:], columns[2:]):
            old += new


def _uniform(h: np.ndarray, restart: int, turn: int) -> np.ndarray:
    return (hash_int(turn, hash_int(restart, h)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _first_points(points, dims, restarts, seed) -> list[np.ndarray]:
    """For each restart the point with the smallest hash."""

    def work(state, x, w, h):
        rows = []
        for r in range(restarts):
            u = _uniform(h, seed + r, 0)
            at = int(u.argmin())
            rows.append((r, u[at], *x[at]))
        block = [np.array([row[i] for row in rows], np.int64 if i == 0 else float) for i in range(2 + dims)]
        if not state:
            state.append(block)
        else:
            better = block[1] < state[0][1]
            for old, new in zip(state[0], block):
                old[better] = new[better]

    schema = "restart bigint, u double, " + ", ".join(f"x{j} double" for j in range(dims))
    best: dict[int, tuple] = {}
    for row in _pass(points, dims, work, schema).toLocalIterator():  # one row per task and restart
        key = (row["u"], *row[2:])
        best[row["restart"]] = min(best.get(row["restart"], key), key)
    return [np.array([best[r][1:]]) for r in sorted(best)]


def _summed(points, dims, centres: list[np.ndarray], columns: int, work) -> dict[int, np.ndarray]:
    """Per restart and centre the sums that ``work`` gives, over all tasks."""
    schema = "restart bigint, centre bigint, " + ", ".join(f"s{j} double" for j in range(columns))
    rows = _pass(points, dims, work, schema).groupBy("restart", "centre").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(columns)])
    out = {r: np.zeros((len(c), columns)) for r, c in enumerate(centres) if c is not None}
    for row in rows.toLocalIterator():  # restarts x centres
        out[row["restart"]][row["centre"]] = row[2:]
    return out


def _nearest_sums(points, dims, centres: list[np.ndarray | None]) -> dict[int, np.ndarray]:
    """Per centre: the weight, the weighted coordinates and the inertia of the points nearest to it."""
    numbers = [np.arange(len(c)) if c is not None else np.empty(0, np.int64) for c in centres]
    names = [np.repeat(np.arange(len(centres)), [len(n) for n in numbers]), np.concatenate(numbers)]

    def work(state, x, w, h):
        parts = []
        for c in centres:
            if c is None:
                continue
            reached = _reachable(x, c)
            d = _far(x, c[reached])
            first = d.argmin(axis=1)
            at, least = reached[first], d[np.arange(len(x)), first]
            sums = [np.bincount(at, w, len(c)), *[np.bincount(at, w * x[:, j], len(c)) for j in range(dims)], np.bincount(at, w * least, len(c))]
            parts.append(np.stack(sums))
        total = np.concatenate(parts, axis=1)
        _add(state, [*names, *total])

    return _summed(points, dims, centres, dims + 2, work)


def _drawn(points, dims, centres, cost, k, seed, turn) -> list[np.ndarray]:
    """Points drawn with a chance of ``2 k w d² / cost``, restart by restart."""

    def work(state, x, w, h):
        for r, c in enumerate(centres):
            chance = 2 * k * w * _far(x, c[_reachable(x, c)]).min(axis=1) / cost[r] if cost[r] > 0 else np.zeros(len(x))
            mine = _uniform(h, seed + r, turn) < chance
            if mine.any():
                state.append([np.full(int(mine.sum()), r), *x[mine].T])

    schema = "restart bigint, " + ", ".join(f"x{j} double" for j in range(dims))
    more: list[list] = [[] for _ in centres]
    for row in _pass(points, dims, work, schema).toLocalIterator():  # about 2 k a restart
        more[row["restart"]].append(row[1:])
    return [np.unique(np.concatenate([c, np.array(m)]), axis=0) if m else c for c, m in zip(centres, more)]


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ on weighted points; fewer centres if there are fewer points."""
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    least = _far(x, x[chosen]).min(axis=1)
    while len(chosen) < k and (least * w).sum() > 0:
        # Of a few points drawn by distance, the one that lowers the cost most.
        tries = rng.choice(len(x), size=2 + int(np.log(k)), p=least * w / (least * w).sum())
        after = np.minimum(least[:, None], _far(x, x[tries]))
        best = int((after * w[:, None]).sum(axis=0).argmin())
        chosen.append(int(tries[best]))
        least = after[:, best]
    return x[chosen]


def fit_kmeans(
    points: DataFrame, columns: list[str], k: int = CLUSTERS, restarts: int = RESTARTS, seed: int = 42,
    passes: int = PASSES, tolerance: float = TOLERANCE,
) -> KMeansModel | None:
    """The best of ``restarts`` runs by inertia; None without points.

    ``points``: a stored table of distinct points with the double ``columns`` and their weights
    ``w``.  A run ends when its centres move less than ``tolerance`` times the mean variance of the
    columns (in squares, added up) or after ``passes`` passes.  A centre that no point is nearest to
    stays where it is.
    """
    dims = len(columns)
    moments = points.agg(
        F.sum("w").alias("n"), F.count("*").alias("points"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{j}") for j, c in enumerate(columns)]
    ).first()
    if not moments["n"]:
        return None
    # Coordinates around their mean lose no digits in differences.
    mean = np.array([moments[f"m{j}"] for j in range(dims)])
    rows = points.select(
        *[(F.col(c) - float(mean[j])).alias(f"x{j}") for j, c in enumerate(columns)], "w", F.xxhash64(*columns).alias("h")
    )
    rows = _spread(rows, dims, moments["points"])
    centres = _first_points(rows, dims, restarts, seed)
    for turn in range(1, _DRAWS + 1):
        cost = [s[:, -1].sum() for s in _nearest_sums(rows, dims, centres).values()]
        if turn == 1:
            least = tolerance * cost_variance(rows, dims, moments["n"])
        centres = _drawn(rows, dims, centres, cost, k, seed, turn)
    held = _nearest_sums(rows, dims, centres)
    centres = [_plus_plus(c, held[r][:, 0], k, np.random.default_rng(seed + r)) for r, c in enumerate(centres)]

    inertia, moving, done = [np.inf] * restarts, [True] * restarts, 0
    final: list[np.ndarray] = list(centres)
    while any(moving) and done < passes:
        sums = _nearest_sums(rows, dims, [c if m else None for c, m in zip(centres, moving)])
        done += 1
        for r, s in sums.items():
            inertia[r], final[r] = float(s[:, -1].sum()), centres[r]  # of the centres the pass was made with
            filled = s[:, 0] > 0
            after = centres[r].copy()
            after[filled] = s[filled, 1 : 1 + dims] / s[filled, :1]
            moved = float(((after - centres[r]) ** 2).sum())
            centres[r] = after
            moving[r] = moved > least
    best = int(np.argmin(inertia))
    order = np.lexsort(final[best].T[::-1])
    return KMeansModel(final[best][order] + mean, inertia[best], inertia, done)


def cost_variance(rows: DataFrame, dims: int, n: float) -> float:
    """The mean over the columns of their variance, of rows around their mean."""
    row = rows.agg(*[(F.sum(F.col("w") * F.col(f"x{j}") * F.col(f"x{j}")) / n).alias(f"v{j}") for j in range(dims)]).first()
    return float(np.mean(list(row)))
