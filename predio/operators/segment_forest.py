"""Random forests for all segments at once, searched over a whole grid.

A fit per segment and combination would be thousands of small Spark jobs.  Two trees with the same
``max_features`` and leaf size differ only in where they stop: a tree cut off at depth d, the first m
trees of a forest, and a tree whose nodes below a minimum size stay whole are all read off one
unpruned growth while rows descend.  So a grid of trees x depths x minimum splits x features x leaf
sizes costs one growth per (features, leaf size) and cross-validation run.

A segment of up to ``LOCAL_ROWS`` rows is grown in one task per growth and run, fewer trees at a time the
more rows it has.  To a tree, rows that agree in all bins are one: a larger segment whose rows have up to
``LOCAL_ROWS`` different bins (its cells) adds up weights and weighted labels per tree and cell, and its trees
are grown from these sums, a few in a task.  Any other is cut into chunks of ``CHUNK_ROWS``: every chunk adds up the histograms of
the nodes that still hold more than ``NODE_ROWS`` rows (one row per node and chunk, whatever the number of
rows), the summed histograms decide the split, and nodes that have become small are finished in one task
each.  Parts of chunks give the rows of all trees for that, about ``EMITTED`` rows a task.  So what a task
holds is bounded whatever the size of a segment.

Features are binned at per-segment quantiles and rows are bootstrapped with Poisson(1) weights from
a hash of the row key, so that results do not depend on the partitioning.  Row counts of nodes are
sums of these weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from predio.functions.nulls import holds
from predio.functions.stats import r2
from predio.operators import tree_growth
from predio.operators.moments import complete_rows
from predio.operators.scores import GOOD_SCORE
from predio.operators.segments import MORE_THAN, TEST_SHARE, modelled_rows, split_rows
from predio.operators.splits import hash_folds
from predio.operators.tree_growth import Growth, Held
from predio.scale import settle
from predio.schema import KEY, SEGMENT, TARGET, require_columns

# --- fixed values: the full grids searched for one table and for a segment -----
FULL_TREES = (10, 17, 25, 33, 41, 48, 56, 64, 72, 80)
FULL_DEPTHS = (10, 12, 14, 16)
SEGMENT_DEPTHS = (4, 6, 8)
FULL_FEATURES = ("all", "log2")
FULL_MIN_SPLITS = (2, 4)
FULL_LEAF_ROWS = (1, 2, 3)
# -------------------------------------------------------------------------------
DEPTHS = SEGMENT_DEPTHS
TREES = (10, 20)
FEATURES = ("all",)
MIN_SPLITS = (2,)
LEAF_ROWS = (1,)
FOLDS = 3
BINS = 32
LOCAL_ROWS = 2_000_000  # of a segment, in one task: about 200 bytes each
CHUNK_ROWS, NODE_ROWS = 50_000, 500_000  # of a larger one: in a chunk, and in a node that one task finishes
SLICE, SLICE_ROWS = 16, 800_000  # trees grown at once, and their rows together
EMITTED = 1_000_000  # rows in trees that one task gives, about
PIECE, BLOCK = 200_000, 4096  # rows whose cells are added up at once, and cells that are scored together
SUMS = 4_000_000  # of cells in trees, that one task holds
_DECIDE, _FINISH, _LEAF = -3, -2, -1  # instead of a feature: what a node without a split waits for


def features_per_node(rule: str | int, features: int) -> int:
    """``all``, ``log2`` or a number."""
    if rule == "all":
        return features
    if rule == "log2":
        return max(1, features.bit_length() - 1)
    if isinstance(rule, int) and 1 <= rule <= features:
        return rule
    raise ValueError(f"features per node are 'all', 'log2' or a number up to {features}, not {rule!r}")


@dataclass(frozen=True)
class Grid:
    """The searched values; the first best combination wins, in the order of the fields."""

    trees: tuple[int, ...] = TREES
    depths: tuple[int, ...] = DEPTHS
    features: tuple[str | int, ...] = FEATURES
    leaf_rows: tuple[int, ...] = LEAF_ROWS
    min_splits: tuple[int, ...] = MIN_SPLITS

    def growths(self, features: int, bins: int) -> list[Growth]:
        return [
            Growth(max(self.depths), leaf, features_per_node(rule, features), min(self.min_splits), bins)
            for rule in self.features
            for leaf in self.leaf_rows
        ]

    def __len__(self) -> int:
        """The number of combinations."""
        return len(self.trees) * len(self.depths) * len(self.features) * len(self.leaf_rows) * len(self.min_splits)


FULL_GRID = Grid(FULL_TREES, FULL_DEPTHS, FULL_FEATURES, FULL_LEAF_ROWS, FULL_MIN_SPLITS)
FULL_SEGMENT_GRID = Grid(FULL_TREES, SEGMENT_DEPTHS, FULL_FEATURES, FULL_LEAF_ROWS, FULL_MIN_SPLITS)


@dataclass(frozen=True)
class SegmentForest:
    """One row per segment: its chosen forest as flat arrays.

    ``packed`` has ``roots`` (a place per tree), and per node ``feature`` (-1: a leaf), ``threshold``
    (at most it: to the left), ``left`` (the right child is next to it) and ``value``; ``importances``
    per feature.  A forest has at most trees x 2 ** (depth + 1) nodes, whatever the rows.
    """

    segment: str
    features: list[str]
    packed: DataFrame

    def prediction(self) -> Column:
        """The forest's value of a row that is joined with its packed forest: one expression, all trees."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])

        def step(at, _):
            feature = F.get(F.col("feature"), at)
            right = (F.get(x, feature) > F.get(F.col("threshold"), at)).cast("int")
            return F.when(feature < 0, at).otherwise(F.get(F.col("left"), at) + right)

        def leaf(root):
            return F.get(F.col("value"), F.aggregate(F.col("steps"), root, step))

        total = F.aggregate(F.transform("roots", leaf), F.lit(0.0), lambda a, b: a + b)
        return F.try_divide(total, F.size("roots"))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Score rows by their segment's forest; NULL without a forest or with a missing feature."""
        require_columns(df, [self.segment, *self.features])
        parts = ["roots", "feature", "threshold", "left", "value", "steps"]
        clash = [c for c in df.columns if c in parts]
        if clash:
            raise ValueError(f"rename the columns {clash} before scoring")
        there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.features])
        scored = df.join(self.packed.select(self.segment, *parts), self.segment, "left")
        return scored.withColumn(prediction, F.when(there & F.col("roots").isNotNull(), self.prediction())).select(
            *[c for c in df.columns if c != prediction], prediction
        )

    def importances(self) -> DataFrame:
        """``(segment, feature, importance)``: each tree's gains as shares, averaged over the trees."""
        names = F.array(*[F.lit(c) for c in self.features])
        return self.packed.select(
            self.segment, F.explode(F.arrays_zip(names.alias("feature"), F.col("importances").alias("importance"))).alias("x")
        ).select(self.segment, "x.feature", "x.importance")


def _bin_edges(train: DataFrame, segment: str, features: list[str], bins: int) -> DataFrame:
    """Per segment, the inner bin edges of each feature (mergeable quantile sketches)."""
    probs = [i / bins for i in range(1, bins)]
    return settle(
        train.groupBy(F.col(segment).alias("_segment")).agg(
            F.array(
                *[F.array_distinct(F.percentile_approx(c, probs, 2000)) for c in features]
            ).alias("_edges")
        ),
        "edges",
    )


def _binned(df: DataFrame, edges: DataFrame, segment: str, features: list[str], extra) -> DataFrame:
    """Rows with ``_bins``: for each feature, the number of edges below its value."""

    def bin_of(i):
        return F.size(F.filter(F.col("_edges")[i], lambda edge: edge < F.col(f"_f{i}")))

    bins = F.array(*[bin_of(i).cast("tinyint") for i in range(len(features))])
    values = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    rows = df.select(F.col(segment).alias("_segment"), *extra, *values).join(edges, "_segment")
    kept = [c for c in rows.columns if c != "_edges" and not c.startswith("_f")]
    return rows.select(*kept, bins.alias("_bins"))


def _weight(run: Column, tree: Column) -> Column:
    """The bootstrap weight of a row with ``_key``, as ``tree_growth.weights`` computes it."""
    u = F.shiftrightunsigned(F.xxhash64("_key", run, tree), 11) / F.lit(float(1 << 53))
    return sum((u > p).cast("int") for p in tree_growth.POISSON[1:]) + (u > tree_growth.POISSON[0]).cast("int")


# --- rows in tasks --------------------------------------------------------------


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal groups that take long to work on, though their rows are few, to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(4 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _slice(rows: int) -> int:
    """Trees that are grown at once on so many rows."""
    return max(1, min(SLICE, SLICE_ROWS // max(rows, 1)))


class Rows:
    """Rows of one segment as arrays; the row order does not matter but is made definite."""

    def __init__(self, table: pa.Table, features: int):
        table = table.combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        order = np.lexsort((column("_y"), column("_k")))
        self.k, self.y = column("_k")[order], column("_y")[order]
        self.test, self.fold = column("is_test").astype(bool)[order], column("fold")[order]
        flat = table.column("_bins").combine_chunks()
        flat = pa.concat_arrays([c.flatten() for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten()
        self.bins = flat.to_numpy(zero_copy_only=False).reshape(-1, features)[order]
        self.seed = int(table.column("_seed")[0].as_py()) if len(order) else 0

    def sides(self, run: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows a run trains on and holds out; run ``folds`` holds out the test rows."""
        if run == folds:
            return ~self.test, self.test
        return ~self.test & (self.fold != run), ~self.test & (self.fold == run)


_ROW = ["_segment", "_seed", "_k", "_y", "is_test", "fold", "_bins"]


def _metrics(y: np.ndarray, predicted: np.ndarray) -> tuple[float | None, float | None]:
    """R² and mean absolute error in percent, as the column functions define them."""
    if not len(y) or np.isnan(predicted).any():
        return None, None
    spread = float(((y - y.mean()) ** 2).sum())
    nonzero = y != 0
    error = float(np.abs((predicted[nonzero] - y[nonzero]) / y[nonzero]).mean() * 100) if nonzero.any() else None
    return (float(1 - ((y - predicted) ** 2).sum() / spread) if spread > 0 else None), error


def _score_local(rows: DataFrame, grid: Grid, growths: list[Growth], features: int, folds: int) -> DataFrame:
    """``(_segment, _unit, scores, errors)`` of segments whose rows fit one task; a unit is a growth and run."""
    units = len(growths) * (folds + 1)
    segment_type = rows.schema["_segment"].dataType.simpleString()

    def score(key, table):
        unit = key[1].as_py()
        growth, run = growths[unit // (folds + 1)], unit % (folds + 1)
        data = Rows(table, features)
        del table
        slice_ = _slice(len(data.y))
        train, held = data.sides(run, folds)
        own_bins, own_y, own_k = data.bins[train], data.y[train], data.k[train]
        y_held, held_bins = data.y[held], data.bins[held]
        total = np.zeros((len(grid.depths), len(grid.min_splits), len(y_held)))
        known = np.zeros_like(total)
        scores = np.full((len(grid.trees), len(grid.depths), len(grid.min_splits)), None)
        errors = scores.copy()
        done = 0
        for stop in sorted({*range(slice_, max(grid.trees), slice_), *grid.trees}):
            _, values = tree_growth.grow_slice(
                own_bins, own_y, own_k, range(done, stop), growth, data.seed, run,
                held_bins, grid.depths, grid.min_splits,
            )
            total += np.nansum(values, axis=2)
            known += (~np.isnan(values)).sum(axis=2)
            done = stop
            for i in (i for i, m in enumerate(grid.trees) if m == stop):
                with np.errstate(invalid="ignore"):
                    mean = total / known
                for j in range(len(grid.depths)):
                    for k in range(len(grid.min_splits)):
                        scores[i, j, k], errors[i, j, k] = _metrics(y_held, mean[j, k])
        kind = pa.list_(pa.float64())
        return pa.table(
            [pa.array([key[0].as_py()], key[0].type), pa.array([unit], pa.int32()), pa.array([scores.ravel().tolist()], kind), pa.array([errors.ravel().tolist()], kind)],
            names=["_segment", "_unit", "scores", "errors"],
        )

    run = F.col("_unit") % (folds + 1)
    dealt = rows.select(*_ROW, F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("_unit")).filter((run == folds) | ~F.col("is_test"))
    return _spread(dealt, "_segment", "_unit").groupBy("_segment", "_unit").applyInArrow(score, f"_segment {segment_type}, _unit int, scores array<double>, errors array<double>")


_NODE = "tree int, node bigint, n double, mean double, feature int, cut int, gain double"


def _node_table(key, unit: int, levels: list[tree_growth.Nodes]) -> pa.Table:
    parts = {c: [getattr(x, c) for x in levels] for c in ("tree", "node", "n", "mean", "feature", "cut", "gain")}
    joined = {c: np.concatenate(v) if v else np.empty(0) for c, v in parts.items()}
    size = len(joined["tree"])
    kinds = {"tree": pa.int32(), "node": pa.int64(), "feature": pa.int32(), "cut": pa.int32()}
    columns = [pa.array([key.as_py()] * size, key.type), pa.array(np.full(size, unit), pa.int32())]
    columns += [pa.array(joined[c], kinds.get(c, pa.float64())) for c in parts]
    return pa.table(columns, names=["_segment", "_unit", *parts])


def _nodes_local(rows: DataFrame, choice: DataFrame, growths: list[Growth], features: int, folds: int) -> DataFrame:
    """The nodes of the chosen forests of segments whose rows fit one task, a slice of trees per task."""
    segment_type = rows.schema["_segment"].dataType.simpleString()

    def build(key, table):
        begin = key[1].as_py() * SLICE
        unit, trees, depth, least = (table.column(c)[0].as_py() for c in ("_unit", "trees", "depth", "min_split"))
        data = Rows(table, features)
        g = growths[unit // (folds + 1)]
        g = Growth(depth, g.leaf_rows, g.subset, least, g.bins)
        levels, end, step = [], min(begin + SLICE, trees), _slice(len(data.y))
        for first in range(begin, end, step):
            some = range(first, min(first + step, end))
            levels += tree_growth.grow_slice(data.bins, data.y, data.k, some, g, data.seed, folds, keep=True)[0]
        return _node_table(key[0], unit, levels)

    dealt = rows.filter("NOT is_test").join(choice, "_segment").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("trees") - 1) / SLICE).cast("int")))
    )
    return _spread(dealt, "_segment", "_slice").groupBy("_segment", "_slice").applyInArrow(build, f"_segment {segment_type}, _unit int, {_NODE}")


# --- segments of many rows in few cells --------------------------------------------


def _slices(grid: Grid, cells: int) -> list[tuple[int, int]]:
    """First and last + 1 of the trees that one task grows from sums; every size of a forest ends a slice."""
    step = max(1, min(SLICE, SUMS // cells))
    stops = sorted({*range(step, max(grid.trees), step), *grid.trees})
    return [*zip([0, *stops], stops)]


def _cell_sums(rows: DataFrame, n: int, slices, features: int, folds: int, runs: list[int]) -> DataFrame:
    """``(_segment, _seed, _run, _slice, tree, cells, n, s)``: pieces of cells with the sums of their training rows.

    ``cells`` holds the bins of a piece's cells, ``n`` their weights and ``s`` their weighted labels.  Equal cells stand in
    pieces one after the other, so a cell of many rows is added up in several tasks.
    """
    segment_type = rows.schema["_segment"].dataType.simpleString()
    names = ["_segment", "_seed", "_run", "_slice", "tree", "cells", "n", "s"]

    def added(table: pa.Table):
        data = Rows(table, features)
        cells, place = tree_growth.cells(data.bins)
        packed = np.ascontiguousarray(cells, np.int8).tobytes()
        segment = table.column("_segment")
        for run in runs:
            train, _ = data.sides(run, folds)
            hashed, y, at = tree_growth.hash_int(run, data.k[train].view(np.uint64)), data.y[train], place[train]
            for i, (first, last) in enumerate(slices):
                n, s = [], []
                for tree in range(first, last):
                    w = tree_growth.tree_weights(hashed, tree)
                    n.append(np.bincount(at, w, len(cells)))
                    s.append(np.bincount(at, w * y, len(cells)))
                size = last - first
                offsets = pa.array(np.arange(size + 1, dtype=np.int32) * len(cells))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (n, s)]
                columns = [pa.array([segment[0].as_py()] * size, segment.type), pa.array([data.seed] * size, pa.int64())]
                columns += [pa.array(x, pa.int32()) for x in ([run] * size, [i] * size, range(first, last))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([packed] * size, pa.binary()), *lists], names=names)

    def work(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= PIECE:
                yield from of_segments(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from of_segments(pa.Table.from_batches(held))

    def of_segments(table: pa.Table):
        # Rows are in the order of segments.
        seeds = table.column("_seed").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(seeds)) + 1).tolist(), len(seeds)]
        for low, high in zip(cuts, cuts[1:]):
            yield from added(table.slice(low, high - low))

    keys = ["_seed", "_segment", "_bins", "_k", "_y"]
    spread = rows.select(*_ROW).repartitionByRange(max(1, -(-n // PIECE)), *keys).sortWithinPartitions(*keys)
    schema = f"_segment {segment_type}, _seed bigint, _run int, _slice int, tree int, cells binary, n array<double>, s array<double>"
    return spread.mapInArrow(work, schema)


class CellSums:
    """Pieces of ``_cell_sums`` put together: the cells' bins, and ``n`` and ``s`` as ``[trees, cells]``."""

    def __init__(self, table: pa.Table, features: int):
        packed = table.column("cells").to_pylist()
        self.bins, place = tree_growth.cells(np.frombuffer(b"".join(packed), np.int8).reshape(-1, features))
        tree = table.column("tree").to_numpy()
        self.trees = range(int(tree.min()), int(tree.max()) + 1)
        at = np.repeat(tree.astype(np.int64) - self.trees.start, [len(x) // features for x in packed]) * len(self.bins) + place
        flat = lambda name: pc.list_flatten(table.column(name).combine_chunks()).to_numpy(zero_copy_only=False)
        shape = len(self.trees), len(self.bins)
        self.n, self.s = (np.bincount(at, flat(c), shape[0] * shape[1]).reshape(shape) for c in ("n", "s"))
        self.seed = int(table.column("_seed")[0].as_py())

    def grow(self, growth: Growth, run: int, **options):
        """Levels and values of a few trees at a time, as ``grow_slice`` gives them."""
        step = _slice(len(self.bins))
        for at in range(0, len(self.trees), step):
            own = slice(at, at + step)
            yield tree_growth.grow_sums(self.bins, self.n[own], self.s[own], self.trees[own], growth, self.seed, run, **options)


def _cell_totals(sums: DataFrame, grid: Grid, growths: list[Growth], features: int, folds: int, blocks: int) -> DataFrame:
    """``(_segment, _run, _block, growth, slice, trees, cells, totals)``: what a slice's trees say of a block of cells, added up.

    ``totals`` is ``[depths, min_splits, cells]``; ``trees`` counts the trees that say something.
    """
    segment_type = sums.schema["_segment"].dataType.simpleString()
    names = ["_segment", "_run", "_block", "growth", "slice", "trees", "cells", "totals"]

    def grow(key, table):
        run, part, growth = (k.as_py() for k in key[1:])
        data = CellSums(table, features)
        del table
        total, known = np.zeros((len(grid.depths), len(grid.min_splits), len(data.bins))), 0
        for _, values in data.grow(growths[growth], run, held_bins=data.bins, depths=grid.depths, min_splits=grid.min_splits):
            total += np.nansum(values, axis=2)
            known += int((~np.isnan(values[0, 0, :, 0])).sum())
        block = tree_growth.cell_hash(data.bins) % blocks
        order = np.argsort(block, kind="stable")
        there, starts = np.unique(block[order], return_index=True)
        own = np.split(order, starts[1:])
        size = len(there)
        columns = [pa.array([key[0].as_py()] * size, key[0].type)]
        columns += [pa.array(x, pa.int32()) for x in ([run] * size, there, [growth] * size, [part] * size, [known] * size)]
        columns.append(pa.array([np.ascontiguousarray(data.bins[x], np.int8).tobytes() for x in own], pa.binary()))
        columns.append(pa.array([total[:, :, x].ravel() for x in own], pa.list_(pa.float64())))
        return pa.table(columns, names=names)

    dealt = sums.withColumn("_growth", F.explode(F.sequence(F.lit(0), F.lit(len(growths) - 1))))
    keys = ["_segment", "_run", "_slice", "_growth"]
    schema = f"_segment {segment_type}, _run int, _block int, growth int, slice int, trees int, cells binary, totals array<double>"
    return _spread(dealt, *keys).groupBy(*keys).applyInArrow(grow, schema)


def _score_cells(rows: DataFrame, n: int, cells: int, grid: Grid, growths: list[Growth], features: int, folds: int) -> DataFrame:
    """As ``_score_local``, of segments of ``n`` rows together with up to ``cells`` cells each; errors of the test run only."""
    segment_type = rows.schema["_segment"].dataType.simpleString()
    blocks, slices = -(-cells // BLOCK), _slices(grid, cells)
    totals = _cell_totals(_cell_sums(rows, n, slices, features, folds, [*range(folds + 1)]), grid, growths, features, folds, blocks)
    run = F.when(F.col("is_test"), folds).otherwise(F.col("fold")).alias("_run")
    held = rows.select("_segment", run, F.pmod(F.xxhash64("_bins"), F.lit(blocks)).cast("int").alias("_block"), "_k", "_y", "_bins")
    keys = ["_segment", "_run", "_block"]
    parts = settle(held.groupBy(*keys).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_parts")), "parts")
    part = F.pmod(F.xxhash64("_k", "_y", F.lit("part")), F.col("_parts")).cast("int").alias("_part")
    held = held.join(parts, keys).select(*keys, part, "_y", "_bins")
    dealt = totals.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    wide = len(grid.depths) * len(grid.min_splits)
    at = [slices.index(x) for m in grid.trees for x in slices if x[1] == m]

    def score(key, right, left):
        run, out = key[1].as_py(), []
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], key[0].type), *[pa.array([], t) for t in _JUDGED.values()]], names=["_segment", *_JUDGED])
        flat = pc.list_flatten(right.column("_bins").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int8).reshape(-1, features)
        y, size = right.column("_y").to_numpy(), len(flat)
        growth, part, trees = (left.column(c).to_numpy() for c in ("growth", "slice", "trees"))
        said = [np.frombuffer(x, np.int8).reshape(-1, features) for x in left.column("cells").to_pylist()]
        # Every slice tells of the same cells; a row's place among them is that of its bins in order.
        both, place = tree_growth.cells(np.concatenate([said[0], flat]))
        own = place[len(said[0]) :]
        count = np.bincount(own, minlength=len(both))
        mean = np.divide(np.bincount(own, y, len(both)), count, out=np.zeros(len(both)), where=count > 0)
        within = float(((y - mean[own]) ** 2).sum())
        nonzero = np.flatnonzero(y != 0) if run == folds else np.empty(0, np.int64)
        y_there, own_there = y[nonzero], own[nonzero]
        for g in range(len(growths)):
            total, known = np.zeros((wide, len(both))), 0
            cut = []
            for i in range(len(slices)):
                for row in np.flatnonzero((growth == g) & (part == i)).tolist():
                    total[:, place[: len(said[0])]] += left.column("totals")[row].values.to_numpy().reshape(wide, -1)
                    known += int(trees[row])
                if i in at:
                    with np.errstate(invalid="ignore"):
                        cut.append(total / known if known else np.full_like(total, np.nan))
            for i, m in enumerate(sorted({*grid.trees})):
                for j, p in enumerate(cut[i]):
                    error = float(np.abs((p[own_there] - y_there) / y_there).sum())
                    out += [
                        (g * (folds + 1) + run, k * wide + j, within + float((count * (mean - p) ** 2).sum()), error, len(nonzero))
                        for k in range(len(grid.trees)) if grid.trees[k] == m
                    ]
        columns = [pa.array([key[0].as_py()] * len(out), key[0].type)]
        columns += [pa.array([r[i] for r in out], t) for i, t in enumerate(_JUDGED.values())]
        return pa.table(columns, names=["_segment", *_JUDGED])

    schema = f"_segment {segment_type}, _unit int, at int, residual double, error double, nonzero bigint"
    judged = held.groupBy(*keys, "_part").cogroup(dealt.groupBy(*keys, "_part")).applyInArrow(score, schema)
    judged = judged.groupBy("_segment", "_unit", "at").agg(F.sum("residual").alias("residual"), F.sum("error").alias("error"), F.sum("nonzero").alias("nonzero"))
    spread = rows.groupBy("_segment", run).agg((F.var_pop("_y") * F.count("*")).alias("spread"))
    judged = judged.withColumn("_run", F.col("_unit") % (folds + 1)).join(spread, ["_segment", "_run"])
    number = lambda x: F.when(~F.isnan(x), x)
    one = F.struct(
        "at", F.when(F.col("spread") > 0, number(1 - F.col("residual") / F.col("spread"))).alias("score"),
        number(F.try_divide(F.col("error") * 100, F.col("nonzero"))).alias("error"),
    )
    return judged.groupBy("_segment", "_unit").agg(F.sort_array(F.collect_list(one)).alias("all")).select(
        "_segment", "_unit", F.col("all.score").alias("scores"), F.col("all.error").alias("errors")
    )


_JUDGED = {"_unit": pa.int32(), "at": pa.int32(), "residual": pa.float64(), "error": pa.float64(), "nonzero": pa.int64()}


def _nodes_cells(rows: DataFrame, n: int, cells: int, choice: DataFrame, grid: Grid, growths: list[Growth], features: int, folds: int) -> DataFrame:
    """As ``_nodes_local``, of segments with few cells, a tree per task."""
    segment_type = rows.schema["_segment"].dataType.simpleString()

    def build(key, table):
        unit, depth, least = (table.column(c)[0].as_py() for c in ("_unit", "depth", "min_split"))
        g = growths[unit // (folds + 1)]
        g = Growth(depth, g.leaf_rows, g.subset, least, g.bins)
        levels = [x for grown, _ in CellSums(table, features).grow(g, folds, keep=True) for x in grown]
        return _node_table(key[0], unit, levels)

    sums = _cell_sums(rows, n, _slices(grid, cells), features, folds, [folds]).join(choice, "_segment").filter(F.col("tree") < F.col("trees"))
    return _spread(sums, "_segment", "tree").groupBy("_segment", "tree").applyInArrow(build, f"_segment {segment_type}, _unit int, {_NODE}")


# --- segments of many chunks ------------------------------------------------------


class Descent:
    """The decided nodes of one unit's trees, to send rows down."""

    def __init__(self, table: pa.Table):
        self.tree = table.column("tree").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), self.tree))
        self.tree = self.tree[order]
        self.node, self.feature, self.cut = (table.column(c).to_numpy()[order] for c in ("node", "feature", "cut"))
        self.n, self.mean = table.column("n").to_numpy()[order], table.column("mean").to_numpy()[order]

    def follow(self, tree: int, bins: np.ndarray, held: Held | None = None) -> np.ndarray:
        """Where each row ends among this object's nodes: at one without a split; -1 without any."""
        low, high = np.searchsorted(self.tree, [tree, tree + 1])
        if low == high:
            return np.full(len(bins), -1)
        nodes = self.node[low:high]
        at = np.full(len(bins), low)
        going, depth = np.arange(len(bins)), 0
        while len(going):
            here = at[going]
            if held is not None:  # only nodes whose mean is known
                known = self.feature[here] >= _LEAF
                held.visit(depth, going[known], self.mean[here[known]], self.n[here[known]])
            split = self.feature[here] >= 0
            going, here = going[split], here[split]
            right = bins[going, self.feature[here]] > self.cut[here]
            at[going] = low + np.searchsorted(nodes, self.node[here] * 2 + right)
            depth += 1
        return at


def _by_chunk(rows: DataFrame, nodes: DataFrame, chunks: DataFrame, work, schema: str, parts: int = 1) -> DataFrame:
    """``work(segment, rows, {unit: (Descent, max_depth, min_split)})`` for every part of every chunk of the large segments."""
    dealt = nodes.join(chunks, "_segment").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    dealt = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_k", F.lit("part")), F.lit(parts)).cast("int"))
    keys = ["_segment", "_chunk", "_part"]

    def both(key, left, right):
        units = {}
        numbers = right.column("_unit").to_numpy()
        for unit in np.unique(numbers).tolist():
            own = right.filter(pa.array(numbers == unit))
            units[unit] = (Descent(own), own.column("max_depth")[0].as_py(), own.column("min_split")[0].as_py())
        return work(key[0], left, units)

    return rows.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(both, schema)


def _decide(sums: DataFrame, growths: list[Growth], features: int, bins: int, folds: int, node_rows: int) -> DataFrame:
    """The splits of nodes from the histograms of all chunks, and their children."""
    segment_type = sums.schema["_segment"].dataType.simpleString()

    def decide(key, table):
        segment, unit, tree, node = key[0], *(k.as_py() for k in key[1:4])
        depth, least, seed = (table.column(c)[0].as_py() for c in ("max_depth", "min_split", "seed"))
        total = np.zeros(features * bins * 2)
        for part in table.column("sums").to_pylist():
            total += part
        hn, hs = total.reshape(2, features, 1, bins)
        g = growths[unit // (folds + 1)]
        g = Growth(depth, g.leaf_rows, g.subset, least, bins)
        best = tree_growth.BestSplit(hn[0].sum(axis=1), hs[0].sum(axis=1), g)
        own = np.array([tree]), np.array([node])
        if node.bit_length() - 1 < depth:
            allowed = tree_growth.drawn(g, features, seed, unit % (folds + 1), *own)
            for f in range(features):
                best.offer(f, hn[f], hs[f], allowed)
        feature, cut = int(best.feature[0]), int(best.cut[0])
        out = [(node, best.n[0], best.s[0] / best.n[0], feature, cut, float(best.gain[0]) if feature >= 0 else 0.0)]
        if feature >= 0:
            left = hn[feature, 0, : cut + 1].sum()
            for child, n in ((2 * node, left), (2 * node + 1, best.n[0] - left)):
                out.append((child, 0.0, 0.0, _DECIDE if n > node_rows else _FINISH, 0, 0.0))
        size = len(out)
        columns = [pa.array([segment.as_py()] * size, segment.type), pa.array([unit] * size, pa.int32()), pa.array([tree] * size, pa.int32())]
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
        columns += [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        columns += [pa.array([v] * size, pa.int32()) for v in (depth, least)]
        return pa.table(columns, names=["_segment", "_unit", "tree", "node", "n", "mean", "feature", "cut", "gain", "max_depth", "min_split"])

    return sums.groupBy("_segment", "_unit", "tree", "node").applyInArrow(
        decide, f"_segment {segment_type}, _unit int, {_NODE}, max_depth int, min_split int"
    )


def _top_nodes(rows, chunks, roots, growths, features, bins, folds, node_rows) -> DataFrame:
    """The upper nodes of all trees of large segments, down to those with at most ``node_rows`` rows."""
    segment_type = rows.schema["_segment"].dataType.simpleString()
    schema = f"_segment {segment_type}, _unit int, tree int, node bigint, sums array<double>, max_depth int, min_split int, seed bigint"

    def histograms(segment, table: pa.Table, units) -> pa.Table:
        data = Rows(table, features)
        out = []
        for unit, (descent, depth, least) in units.items():
            run = unit % (folds + 1)
            train, _ = data.sides(run, folds)
            own_bins, y, k = data.bins[train], data.y[train], data.k[train]
            for tree in np.unique(descent.tree[descent.feature == _DECIDE]).tolist():
                w = tree_growth.weights(k, run, tree)
                at = np.where(w > 0, descent.follow(tree, own_bins), -1)
                asked = np.flatnonzero((descent.tree == tree) & (descent.feature == _DECIDE))
                slot = np.searchsorted(asked, at)
                mine = (at >= 0) & (slot < len(asked))
                mine[mine] = asked[slot[mine]] == at[mine]
                slot, w, bin_rows = slot[mine], w[mine], own_bins[mine]
                wy = w * y[mine]
                sums = np.empty((len(asked), 2, features, bins))
                for f in range(features):
                    cell, size = slot * bins + bin_rows[:, f], len(asked) * bins
                    sums[:, 0, f] = np.bincount(cell, w, size).reshape(-1, bins)
                    sums[:, 1, f] = np.bincount(cell, wy, size).reshape(-1, bins)
                for i in np.unique(slot).tolist():
                    out.append((unit, tree, int(descent.node[asked[i]]), sums[i].ravel(), depth, least, data.seed))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array([segment.as_py()] * len(out), segment.type)]
        columns += [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
        return pa.table(columns, names=["_segment", "_unit", "tree", "node", "sums", "max_depth", "min_split", "seed"])

    nodes = settle(roots, "top_nodes")
    while not nodes.filter(F.col("feature") == _DECIDE).isEmpty():  # at most one turn per depth
        sums = _by_chunk(rows, nodes, chunks, histograms, schema)
        decided = _decide(sums, growths, features, bins, folds, node_rows)
        nodes = settle(nodes.filter(F.col("feature") != _DECIDE).unionByName(decided), "top_nodes")
    return nodes


def _entries(rows, nodes, chunks, grid: Grid, features: int, folds: int, held_out: bool, trees: int) -> DataFrame:
    """Rows in ``trees`` trees in all, with the upper node they end at: all that finishing a node needs.

    Held-out rows carry what they met so far: ``value`` and ``going`` per minimum split, ``met`` per
    depth and minimum split (NaN below the node).
    """
    segment_type = rows.schema["_segment"].dataType.simpleString()
    schema = (
        f"_segment {segment_type}, _unit int, tree int, node bigint, feature int, max_depth int, min_split int, seed bigint, k bigint, y double, w double,"
        " bins array<tinyint>, value array<double>, going array<boolean>, met array<double>"
    )
    names = ["_segment", "_unit", "tree", "node", "feature", "max_depth", "min_split", "seed", "k", "y", "w", "bins", "value", "going", "met"]

    def emit(segment, table: pa.Table, units) -> pa.Table:
        data, out = Rows(table, features), []
        lists = lambda m, kind: pa.ListArray.from_arrays(
            pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind)
        )
        for unit, (descent, depth, least) in units.items():
            run = unit % (folds + 1)
            train, held = data.sides(run, folds)
            for tree in np.unique(descent.tree).tolist():
                w = np.where(train, tree_growth.weights(data.k, run, tree), 0.0)
                at = descent.follow(tree, data.bins)
                mine = (at >= 0) & (w > 0) & (descent.feature[np.maximum(at, 0)] == _FINISH)
                state = None
                if held_out:
                    at_held = np.flatnonzero(held & (at >= 0))
                    state = Held(len(at_held), grid.depths, grid.min_splits)
                    descent.follow(tree, data.bins[at_held], state)
                for which, is_held in ((np.flatnonzero(mine), False), (at_held if held_out else np.empty(0, int), True)):
                    size = len(which)
                    if not size:
                        continue
                    nothing = np.zeros((size, 0))
                    value = state.value.T if is_held else nothing
                    going = state.going.T if is_held else nothing.astype(bool)
                    met = nothing
                    if is_held:
                        # Below their node, other rows may have been recorded, but not these.
                        at_depth = np.frexp(descent.node[at[which]])[1] - 1
                        never = np.full_like(state.value, np.nan)
                        met = np.stack([np.where(d < at_depth, state.at.get(d, never), np.nan) for d in grid.depths])
                        met = met.reshape(-1, size).T
                    out.append(
                        pa.table(
                            [
                                pa.array([segment.as_py()] * size, segment.type), pa.array(np.full(size, unit), pa.int32()),
                                pa.array(np.full(size, tree), pa.int32()), pa.array(descent.node[at[which]], pa.int64()),
                                pa.array(descent.feature[at[which]], pa.int32()), pa.array(np.full(size, depth), pa.int32()),
                                pa.array(np.full(size, least), pa.int32()), pa.array(np.full(size, data.seed), pa.int64()),
                                pa.array(data.k[which]), pa.array(data.y[which]), pa.array(np.full(size, -1.0) if is_held else w[which]),
                                lists(data.bins[which].astype(np.int8), pa.int8()), lists(np.ascontiguousarray(value), pa.float64()),
                                lists(np.ascontiguousarray(going), pa.bool_()), lists(np.ascontiguousarray(met), pa.float64()),
                            ],
                            names=names,
                        )
                    )
        if out:
            return pa.concat_tables(out)
        empty = lists(np.zeros((0, 1)), pa.float64())
        kinds = [segment.type, *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([*[pa.array([], t) for t in kinds], pa.array([], pa.list_(pa.int8())), empty, pa.array([], pa.list_(pa.bool_())), empty], names=names)

    return _by_chunk(rows, nodes, chunks, emit, schema, max(1, -(-CHUNK_ROWS * trees // EMITTED)))


def _finish(entries: DataFrame, grid: Grid, growths: list[Growth], features: int, folds: int, held_out: bool) -> DataFrame:
    """Grow the small nodes on; held-out rows give their values, otherwise the nodes are returned."""
    segment_type = entries.schema["_segment"].dataType.simpleString()
    wide = len(grid.depths) * len(grid.min_splits)

    def matrix(table, name, size):
        column = table.column(name).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def finish(key, table):
        segment, unit, tree, node = key[0], *(k.as_py() for k in key[1:4])
        w = table.column("w").to_numpy()
        order = np.lexsort((table.column("y").to_numpy(), table.column("k").to_numpy(), w))
        table, w = table.take(pa.array(order)), w[order]
        depth, least, seed = (table.column(c)[0].as_py() for c in ("max_depth", "min_split", "seed"))
        g = growths[unit // (folds + 1)]
        g = Growth(depth, g.leaf_rows, g.subset, least, g.bins)
        bins, y = matrix(table, "bins", features).astype(np.int64), table.column("y").to_numpy()
        train = np.flatnonzero(w > 0)
        own = (np.array([tree]), np.array([node])) if len(train) else (np.empty(0, np.int64),) * 2
        state, held = None, np.flatnonzero(w < 0)
        if held_out:
            state = Held(len(held), grid.depths, grid.min_splits)
            part = table.take(pa.array(held))
            if len(held):
                state.value, state.going = (matrix(part, c, len(grid.min_splits)).T.copy() for c in ("value", "going"))
                met = matrix(part, "met", wide).T.reshape(len(grid.depths), len(grid.min_splits), -1)
                state.at = {d: met[i] for i, d in enumerate(grid.depths) if not np.isnan(met[i]).all()}
        zero = np.zeros(len(train), np.int64)
        levels = tree_growth.grow(
            bins[train], zero, np.arange(len(train)), w[train], w[train] * y[train], *own, g, seed, unit % (folds + 1),
            state, bins[held], np.zeros(len(held), np.int64), np.arange(len(held)), keep=not held_out,
        )
        if not held_out:
            return _node_table(segment, unit, levels)
        values = state.finish().reshape(wide, -1).T
        size = len(held)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * wide), pa.array(np.ascontiguousarray(values).ravel()))
        return pa.table(
            [
                pa.array([segment.as_py()] * size, segment.type), pa.array(np.full(size, unit), pa.int32()), pa.array(np.full(size, tree), pa.int32()),
                part.column("k").combine_chunks(), part.column("y").combine_chunks(), flat,
            ],
            names=["_segment", "_unit", "tree", "k", "y", "values"],
        )

    schema = f"_segment {segment_type}, _unit int, " + ("tree int, k bigint, y double, values array<double>" if held_out else _NODE)
    return entries.groupBy("_segment", "_unit", "tree", "node").applyInArrow(finish, schema)


def _score_large(rows, chunks, roots, grid: Grid, growths, features, bins, folds, node_rows) -> DataFrame:
    """As ``_score_local``, of segments in several chunks."""
    tops = _top_nodes(rows, chunks, roots, growths, features, bins, folds, node_rows)
    trees = max(grid.trees) * len(growths) * (folds + 1)
    entries = settle(_entries(rows, tops, chunks, grid, features, folds, True, trees), "entries")
    # A held-out row may end at a decided leaf, where nothing is left to grow; those need no task of their own.
    values = _finish(entries.filter(F.col("feature") == _FINISH), grid, growths, features, folds, True)
    wide = len(grid.depths) * len(grid.min_splits)
    met = F.transform("met", lambda x, i: F.when(F.isnan(x), F.get(F.col("value"), i % len(grid.min_splits))).otherwise(x))
    ended = entries.filter((F.col("feature") != _FINISH) & (F.col("w") < 0))
    values = values.unionByName(ended.select("_segment", "_unit", "tree", "k", "y", met.alias("values")))
    places = [(m, at) for m in grid.trees for at in range(wide)]
    means = values.groupBy("_segment", "_unit", "k", "y").agg(
        *[F.avg(F.when(F.col("tree") < m, F.get(F.col("values"), F.lit(at)))).alias(f"p{i}") for i, (m, at) in enumerate(places)]
    )
    error = lambda p: F.avg(F.abs(F.try_divide(F.col(p) - F.col("y"), F.col("y"))) * 100)
    return means.groupBy("_segment", "_unit").agg(
        F.array(*[r2("y", f"p{i}") for i in range(len(places))]).alias("scores"),
        F.array(*[error(f"p{i}") for i in range(len(places))]).alias("errors"),
    )


# --- packing ------------------------------------------------------------------------


def _pack(nodes: DataFrame, edges: DataFrame, segment: str, features: int) -> DataFrame:
    """One row per segment with its trees as flat arrays."""
    segment_type = nodes.schema["_segment"].dataType.simpleString()

    def pack(key, table):
        tree, node = table.column("tree").to_numpy(), table.column("node").to_numpy()
        order = np.lexsort((node, tree))
        tree, node = tree[order].astype(np.int64), node[order]
        feature, threshold, value, gain = (table.column(c).to_numpy()[order] for c in ("feature", "threshold", "mean", "gain"))
        roots = np.flatnonzero(node == 1)
        first = roots[np.searchsorted(tree[roots], tree)]
        # Siblings stand side by side in the order of tree and node.
        inner = np.flatnonzero(feature >= 0)
        left = np.full(len(node), -1, np.int32)
        left[inner] = np.searchsorted(tree << 40 | node, tree[inner] << 40 | 2 * node[inner])
        split = feature >= 0
        gains = np.zeros((len(roots), features))
        np.add.at(gains, (np.searchsorted(roots, first[split]), feature[split]), gain[split])
        whole = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
        importances = shares / shares.sum() if shares.sum() > 0 else shares
        deepest = int(node.max()).bit_length() - 1
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        ints, doubles = pa.int32(), pa.float64()
        return pa.table(
            [
                pa.array([key[0].as_py()], key[0].type), one(roots, ints), one(feature, ints), one(threshold, doubles),
                one(left, ints), one(value, doubles), one(np.arange(deepest), ints), one(importances, doubles),
            ],
            names=[segment, "roots", "feature", "threshold", "left", "value", "steps", "importances"],
        )

    schema = (
        f"`{segment}` {segment_type}, roots array<int>, feature array<int>, threshold array<double>, left array<int>,"
        " value array<double>, steps array<int>, importances array<double>"
    )
    # Tasks get a threshold for each node, not the segment's edges.
    threshold = F.when(F.col("feature") >= 0, F.get(F.get("_edges", F.col("feature")), F.col("cut"))).otherwise(0.0)
    cut = nodes.join(edges, "_segment").select("_segment", "tree", "node", "feature", threshold.alias("threshold"), "mean", "gain")
    return cut.groupBy("_segment").applyInArrow(pack, schema)


# --- the search ---------------------------------------------------------------------


def qualify_segments_forest(
    df: DataFrame, features: list[str], label: str = TARGET, segment: str = SEGMENT,
    more_than: int = MORE_THAN, share: float = TEST_SHARE, trees=TREES, depths=DEPTHS,
    folds: int = FOLDS, leaf_rows=LEAF_ROWS, features_at=FEATURES, min_splits=MIN_SPLITS, bins: int = BINS,
    key: str = KEY, exact: bool = True, local_rows: int = LOCAL_ROWS,
) -> tuple[DataFrame, SegmentForest]:
    """Quality of a searched random forest per large segment, and the forests.

    Trees, depth, features per node, leaf size and minimum split are chosen per segment by
    cross-validated R² (the first best in that order) and scored on the test share.
    """
    if bins > 127:
        raise ValueError("at most 127 bins")
    grid = Grid(tuple(trees), tuple(depths), tuple(features_at), tuple(leaf_rows), tuple(min_splits))
    growths = grid.growths(len(features), bins)
    rows = split_rows(modelled_rows(df, features, label, segment, more_than, key), share, segment, key, exact)
    rows = settle(hash_folds(complete_rows(rows, features, label), folds, key, seed=1), "forest_rows")
    edges = _bin_edges(rows.filter(~F.col("is_test")), segment, features, bins)
    extra = [
        F.xxhash64(segment).alias("_seed"), F.xxhash64(key).alias("_k"), F.col(label).alias("_y"), "is_test",
        F.col("fold").cast("int").alias("fold"),
    ]
    binned = settle(_binned(rows, edges, segment, features, extra), "binned")
    chunk_rows, node_rows = min(local_rows, CHUNK_ROWS), min(local_rows, NODE_ROWS)
    n = F.count("*")
    count = F.when(n > local_rows, F.ceil(n / chunk_rows)).otherwise(1).cast("int")
    sizes = settle(binned.groupBy("_segment").agg(count.alias("_chunks"), n.alias("_n")), "sizes")
    small = binned.join(sizes.filter("_chunks = 1"), "_segment", "left_semi").select(*_ROW)
    chunks = sizes.filter("_chunks > 1")
    any_large = not chunks.isEmpty()
    large = celled = cells = cell_rows = None
    if any_large:
        held = binned.join(chunks, "_segment", "left_semi").select("_segment", "_bins").distinct()
        counts = held.groupBy("_segment").agg(F.count("*").alias("_cells")).filter(F.col("_cells") <= local_rows)
        few = settle(counts.join(chunks, "_segment").select("_segment", "_cells", "_n"), "cells")
        cells, cell_rows = few.agg(F.max("_cells"), F.sum("_n")).first()
        chunks = settle(chunks.join(few, "_segment", "left_anti").drop("_n"), "chunks")
        any_large = not chunks.isEmpty()
    if cells:
        celled = binned.join(few, "_segment", "left_semi").select(*_ROW)
    if any_large:
        spot = F.pmod(F.xxhash64("_k", F.lit("chunk")), F.col("_chunks")).cast("int")
        large = settle(binned.join(chunks, "_segment").withColumn("_chunk", spot).select(*_ROW, "_chunk"), "large")

    scored = _score_local(small, grid, growths, len(features), folds)
    if cells:
        scored = scored.unionByName(_score_cells(celled, cell_rows, cells, grid, growths, len(features), folds))
    if any_large:
        units = F.explode(F.sequence(F.lit(0), F.lit(len(growths) * (folds + 1) - 1)))
        start = chunks.select("_segment", units.alias("_unit"), F.lit(max(grid.trees)).alias("trees"), F.lit(max(grid.depths)).alias("max_depth"), F.lit(min(grid.min_splits)).alias("min_split"))
        scored = scored.unionByName(
            _score_large(large, chunks, _roots(start), grid, growths, len(features), bins, folds, node_rows)
        )
    scored = settle(scored, "scored")
    searched = settle(_searched(scored, grid, folds), "searched")
    quality = searched.select(
        F.col("_segment").alias(segment), "best.score", "best.error", (100 - F.col("best.error")).alias("diff_score"),
        holds(F.col("best.score") >= GOOD_SCORE).alias("Good"), "best.trees", "best.depth", "best.features",
        "best.leaf_rows", "best.min_split", "best.cv_score",
    )

    unit = (F.col("best.growth") * (folds + 1) + folds).cast("int")
    choice = settle(searched.select("_segment", unit.alias("_unit"), "best.trees", "best.depth", "best.min_split"), "choice")
    nodes = _nodes_local(small, choice, growths, len(features), folds)
    if cells:
        nodes = nodes.unionByName(_nodes_cells(celled, cell_rows, cells, choice, grid, growths, len(features), folds))
    if any_large:
        start = chunks.join(choice, "_segment").select("_segment", "_unit", "trees", F.col("depth").alias("max_depth"), "min_split")
        tops = _top_nodes(large, chunks, _roots(start), growths, len(features), bins, folds, node_rows)
        entries = _entries(large, tops, chunks, grid, len(features), folds, False, max(grid.trees))
        below = _finish(entries, grid, growths, len(features), folds, False)
        nodes = nodes.unionByName(below).unionByName(tops.filter(F.col("feature") >= _LEAF).drop("max_depth", "min_split"))
    packed = settle(_pack(settle(nodes, "nodes"), edges, segment, len(features)), "packed")
    return quality, SegmentForest(segment, list(features), packed)


def _roots(start: DataFrame) -> DataFrame:
    """The roots of all trees, to be decided."""
    zero = F.lit(0.0)
    return start.select(
        "_segment", "_unit", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
        F.lit(1).cast("bigint").alias("node"), zero.alias("n"), zero.alias("mean"), F.lit(_DECIDE).alias("feature"),
        F.lit(0).alias("cut"), zero.alias("gain"), "max_depth", "min_split",
    )


def _searched(scored: DataFrame, grid: Grid, folds: int) -> DataFrame:
    """``(_segment, best)``: the combination with the best mean score over the folds, and its test scores.

    The grid is one array per segment, so its size is that of the search, not of the data.
    """
    kinds = [(str(rule), leaf) for rule in grid.features for leaf in grid.leaf_rows]
    sizes = (len(grid.trees), len(grid.depths), len(kinds), len(grid.min_splits))

    def value(values, at):
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    run, growth = F.col("_unit") % (folds + 1), F.floor(F.col("_unit") / (folds + 1)).cast("int")
    by_growth = scored.groupBy("_segment", growth.alias("_growth")).agg(
        F.collect_list(F.when(run < folds, F.col("scores"))).alias("cv"),
        F.max(F.when(run == folds, F.struct("scores", "errors"))).alias("test"),
    )
    per_segment = by_growth.groupBy("_segment").agg(
        F.map_from_entries(F.collect_list(F.struct("_growth", F.struct("cv", "test")))).alias("runs")
    )

    def judged(i):
        """Combination i, counted up in the order of the grid's fields."""
        whole = lambda x: F.floor(x).cast("int")
        split, rest = i % sizes[3], whole(i / sizes[3])
        kind, rest = rest % sizes[2], whole(rest / sizes[2])
        depth, tree = rest % sizes[1], whole(rest / sizes[1])
        at = (tree * sizes[1] + depth) * sizes[3] + split
        own = F.element_at("runs", kind)
        values = F.filter(F.transform(own["cv"], lambda s: F.get(s, at)), lambda v: v.isNotNull())
        mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), F.size(values))
        return F.struct(
            mean.alias("cv_score"), (-i).alias("order"), value(grid.trees, tree).alias("trees"),
            value(grid.depths, depth).alias("depth"), value([k[0] for k in kinds], kind).alias("features"),
            value([k[1] for k in kinds], kind).alias("leaf_rows"), value(grid.min_splits, split).alias("min_split"),
            kind.alias("growth"), F.get(own["test"]["scores"], at).alias("score"),
            F.get(own["test"]["errors"], at).alias("error"),
        )

    every = F.sequence(F.lit(0), F.lit(sizes[0] * sizes[1] * sizes[2] * sizes[3] - 1))
    return per_segment.select("_segment", F.array_max(F.transform(every, judged)).alias("best"))


def search_forest_grid(
    df: DataFrame, features: list[str], label: str = TARGET, key: str = KEY, grid: Grid = FULL_GRID,
    share: float = TEST_SHARE, folds: int = FOLDS, bins: int = BINS, local_rows: int = LOCAL_ROWS,
) -> tuple[DataFrame, SegmentForest]:
    """The full search over one table: its quality in one row, and the forest, under segment ``all``."""
    rows = df.select(key, label, *features).withColumn("_all", F.lit("all"))
    return qualify_segments_forest(
        rows, features, label, "_all", 0, share, grid.trees, grid.depths, folds, grid.leaf_rows, grid.features,
        grid.min_splits, bins, key, False, local_rows,
    )


def search_segments_grid(df: DataFrame, features: list[str], grid: Grid = FULL_SEGMENT_GRID, **options) -> tuple[DataFrame, SegmentForest]:
    """``qualify_segments_forest`` over the full grid of a segment."""
    return qualify_segments_forest(
        df, features, trees=grid.trees, depths=grid.depths, leaf_rows=grid.leaf_rows, features_at=grid.features,
        min_splits=grid.min_splits, **options,
    )
