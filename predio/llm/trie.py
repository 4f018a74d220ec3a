"""The prefix trie of conversations, from their sorted order.

Conversations are sorted by their turns; the conversations under a trie node are then neighbours.
With the lengths of the prefixes that neighbours share (LCPs), the members of a prefix of depth d
at position i reach left and right as far as no LCP on the way is below d.  Every candidate prefix
finds both ends by its own binary search over a sparse table of range minima; there is no stack
and no order among candidates.

Positions are worked on in blocks of a fixed size, each with its own sparse table.  A search that
leaves its block goes on in a table of whole blocks' minima, and in one of those blocks' blocks, so
that no table grows with the data.  Sorting goes by chunks of a fixed number of turns: a
conversation of several chunks is renamed by its chunks' ranks until one chunk is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from predio.llm.ranges import running
from predio.scale import settle

CHUNK = 32  # turns compared at once when sorting
BLOCK = 4096  # positions with a sparse table of their own
_BATCH = 1 << 16  # candidates worked on at once
_END = (1 << 62)


# --- sparse tables ------------------------------------------------------------


class Minima:
    """Range minima of an array: level k holds the minimum of 2**k values from every place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of ``values[first..last]``, ends included: two overlapping stretches."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for level in np.unique(k):
            at = k == level
            table = self.levels[level]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << int(level)) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is below ``least``; the length if there is none."""
        place, n = at.astype(np.int64).copy(), len(self.levels[0])
        for k in reversed(range(len(self.levels))):
            step, table = 1 << k, self.levels[k]
            for _ in range(2 if k + 1 == len(self.levels) else 1):
                fits = place + step <= n
                fits[fits] = table[place[fits]] >= least[fits]
                place[fits] += step
        return place

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to ``at`` whose value is below ``least``; -1 if there is none."""
        place = at.astype(np.int64).copy()
        for k in reversed(range(len(self.levels))):
            step, table = 1 << k, self.levels[k]
            for _ in range(2 if k + 1 == len(self.levels) else 1):
                fits = place - step >= -1
                fits[fits] = table[place[fits] - step + 1] >= least[fits]
                place[fits] -= step
        return place


# --- order and common prefixes ------------------------------------------------


def _ranks(chunks: DataFrame) -> DataFrame:
    """Distinct ``key`` arrays with their ranks."""
    distinct = chunks.groupBy("key").agg(F.lit(1).cast("bigint").alias("one"))
    return settle(running(distinct, None, ["key"], ["one"], "chunk_order").select("key", F.col("before_one").alias("rank")), "ranks")


def _chunked(rows: DataFrame, value: Column, chunk: int) -> DataFrame:
    """``(conv, part, key)``: stretches of ``chunk`` values by ``at``, numbered from 0."""
    part = F.floor(F.col("at") / chunk).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("at", value.alias("v"))))
    return rows.groupBy("conv", part.alias("part")).agg(F.transform(listed, lambda x: x["v"]).alias("key"))


def _ordered(turns: DataFrame, lengths: DataFrame, chunk: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Positions ``(pos, conv, len, lcp)`` of the conversations in order.

    ``turns`` has ``conv``, ``at`` (0, 1, …) and the hashes ``a`` and ``b`` of each turn.
    """
    first = settle(_chunked(turns, F.struct("a", "b"), chunk), "chunks")
    chunks, longest = first, first.agg(F.max("part")).first()[0] or 0
    while longest:
        named = chunks.join(_ranks(chunks), "key").select("conv", F.col("part").alias("at"), "rank")
        chunks = settle(_chunked(named, F.col("rank"), chunk), "chunks")
        longest //= chunk
    keys = lengths.join(chunks.select("conv", "key"), "conv", "left").withColumn("one", F.lit(1).cast("bigint"))
    order = running(keys, None, ["key", "conv"], ["one"], label)
    order = settle(order.select(F.col("before_one").alias("pos"), "conv", "len"), "positions")
    # The prefix shared with the conversation before: up to the first chunk that differs.
    pairs = order.join(order.select((F.col("pos") + 1).alias("pos"), F.col("conv").alias("_before")), "pos").select("conv", "_before")
    before = first.select(F.col("conv").alias("_before"), "part", F.col("key").alias("_key"))
    differs = F.array_position(F.zip_with("key", F.col("_key"), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    same = (
        first.join(pairs, "conv").join(before, ["_before", "part"], "left")
        .select("conv", "part", F.size("key").alias("n"), F.when(F.col("_key").isNull(), 1).otherwise(differs).alias("differs"))
        .withColumn("equal", F.when((F.col("differs") == 0) | (F.col("differs") > F.col("n")), F.lit(None)).otherwise(F.col("differs") - 1))
        .groupBy("conv")
        .agg(F.min(F.col("part") * chunk + F.col("equal")).alias("stop"), F.sum("n").alias("all"))
        .select("conv", F.coalesce("stop", "all").alias("lcp"))
    )
    lcp = F.when(F.col("pos") == 0, F.lit(-1)).otherwise(F.coalesce("lcp", F.lit(0))).cast("bigint")
    return settle(order.join(same, "conv", "left").select("pos", "conv", "len", lcp.alias("lcp")), "lcps")


# --- blocks of positions ------------------------------------------------------


def _block_levels(positions: DataFrame, total: int, block: int) -> list[DataFrame]:
    """Level 0 has ``block`` positions a row, each level above ``block`` rows of the one below.

    Columns ``block``, ``lcps`` and ``convs`` (above level 0: minima of the rows below).
    """
    levels, rows, count = [], positions.select("pos", "lcp", "conv"), total
    while True:
        entries = F.sort_array(F.collect_list(F.struct("pos", "lcp", "conv")))
        level = rows.groupBy(F.floor(F.col("pos") / block).cast("bigint").alias("block")).agg(entries.alias("e"))
        level = level.select("block", F.col("e.lcp").alias("lcps"), F.col("e.conv").alias("convs"))
        levels.append(settle(level, "block_level"))
        count = -(-count // block)
        if count <= 1:
            return levels
        rows = levels[-1].select(F.col("block").alias("pos"), F.array_min("lcps").alias("lcp"), F.array_min("convs").alias("conv"))


def _lists(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column[row].values.to_numpy(zero_copy_only=False).astype(np.int64)


_SEARCH = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("block", "depth", "at", "least", "found")]
)


def _search(queries: DataFrame, level: DataFrame, here: Column, block: int, right: bool) -> DataFrame:
    """One step of searches: from entry ``at`` on, in the row of ``level`` that ``here`` names.

    ``found`` becomes the entry below the depth; without one ``at`` moves on to the entry of the next
    row in the level above.  ``least`` is the smallest conversation passed over (going right).
    """
    joined = queries.withColumn("_row", here.cast("bigint")).join(level.withColumnRenamed("block", "_row"), "_row", "left")
    joined = joined.select("block", "depth", "at", "least", "_row", "lcps", "convs")
    arrow = to_arrow_schema(_SEARCH)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, depths, convs = None, None, None
        for batch in batches:
            out = []
            for i, (b, depth, at, least, row) in enumerate(zip(*[batch.column(j).to_pylist() for j in range(5)])):
                if not batch.column(5)[i].is_valid:  # beyond either end
                    out.append((b, depth, at, least, None))
                    continue
                if row != last:
                    last, depths, convs = row, Minima(_lists(batch, "lcps", i)), Minima(_lists(batch, "convs", i))
                n, start = len(depths.levels[0]), at - row * block
                if not right:
                    place = int(depths.left(np.array([min(start, n - 1)]), np.array([depth]))[0])
                elif start >= n:
                    place = n
                else:
                    place = int(depths.right(np.array([start]), np.array([depth]))[0])
                    if place > start:
                        least = min(least, int(convs.of(np.array([start]), np.array([place - 1]))[0]))
                inside = 0 <= place < n
                out.append((b, depth, at if inside else (row + 1 if right else row - 1), least, row * block + place if inside else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, schema=arrow)

    return joined.mapInArrow(step, _SEARCH)


def _beyond(crossing: DataFrame, levels: list[DataFrame], block: int, right: bool) -> DataFrame:
    """Where prefixes end that reach out of their block: ``(block, depth, end, least)``.

    Going right ``end`` is the last position inside (null: the last of all), going left the first one.
    """
    step = 1 if right else -1
    state = crossing.select(
        "block", "depth", (F.col("block") + step).alias("at"), F.lit(_END).alias("least"), F.lit(None).cast("bigint").alias("found")
    )
    done = None  # (block, depth, at, least, found, level)
    for k in range(1, len(levels)):  # up: entries of level k are rows of level k - 1
        looked = settle(_search(state, levels[k], F.floor(F.col("at") / block), block, right), "up")
        here = looked.filter("found IS NOT NULL").withColumn("level", F.lit(k))
        done = here if done is None else done.unionByName(here)
        state = looked.filter("found IS NULL")
    if done is None:
        return state.select("block", "depth", F.lit(None).cast("bigint").alias("end"), "least")
    beyond = state.select("block", "depth", F.lit(None).cast("bigint").alias("end"), "least")
    for k in reversed(range(1, len(levels))):  # down: into the row of level k - 1 that was found
        mine = done.filter(F.col("level") == k).withColumn("at", F.col("found") * block + (0 if right else block - 1))
        looked = _search(mine.drop("level", "found").withColumn("found", F.lit(None).cast("bigint")), levels[k - 1], F.floor(F.col("at") / block), block, right)
        looked = settle(looked, "down").withColumn("level", F.lit(k - 1))
        done = looked if k == 1 else done.filter(F.col("level") < k).unionByName(looked)
    ends = done.select("block", "depth", (F.col("found") - (1 if right else 0)).alias("end"), "least")
    return ends.unionByName(beyond)


_FOUND = T.StructType(
    [
        T.StructField("kind", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("block", "pos", "depth", "end", "least")],
        T.StructField("ids", T.StringType()),
    ]
)


def _candidates(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(place, depth)`` for every depth in ``low + 1 .. high`` of every place, in bounded batches."""
    places = np.flatnonzero(high > low)
    for start in range(0, len(places), _BATCH):
        some = places[start : start + _BATCH]
        for base in range(0, int((high[some] - low[some]).max()), 64):
            number = np.clip(high[some] - low[some] - base, 0, 64)
            at = np.repeat(some, number)
            within = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            yield at, low[at] + base + 1 + within


def _in_blocks(positions: DataFrame, block: int) -> DataFrame:
    """Everything the blocks find on their own, as rows of ``_FOUND``.

    ``node``: a prefix with several members, first met at ``pos``; ``end`` is its last position and
    ``least`` its smallest conversation so far.  ``parent``: the first position ``end`` of the prefix
    that ``pos`` shares with the conversation before it.  ``ends``: the conversations ``ids`` that end
    at one node, ``end`` its first position.  A null ``end`` lies beyond the block.
    """
    own = positions.withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
    guard = own.filter((F.col("pos") % block == 0) & (F.col("pos") > 0)).withColumn("block", F.col("block") - 1)
    entries = F.sort_array(F.collect_list(F.struct("pos", "conv", "len", "lcp")))
    rows = own.unionByName(guard).groupBy("block").agg(entries.alias("e"))
    rows = rows.select("block", *[F.col(f"e.{c}").alias(c) for c in ("pos", "conv", "len", "lcp")])
    arrow = to_arrow_schema(_FOUND)

    def record(kind, b, pos, depth, end, least, ids=None) -> pa.RecordBatch:
        n = len(pos)
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * n, pa.string()), pa.array(np.full(n, b, np.int64)), pa.array(pos), pa.array(depth),
                nothing if end is None else pa.array(end[0], mask=end[1]), nothing if least is None else pa.array(least),
                pa.nulls(n, pa.string()) if ids is None else pa.array(ids, pa.string()),
            ],
            schema=arrow,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.column(0)[row].as_py()
                pos, conv, length, lcp = (_lists(batch, c, row) for c in ("pos", "conv", "len", "lcp"))
                base = int(pos[0])
                m = min(len(pos), base // block * block + block - base)  # without the guard
                shared, least = Minima(lcp), Minima(conv[:m])
                after = np.append(lcp[1 : m + 1], -1)[:m]  # shared with the next conversation
                for at, depth in _candidates(np.maximum(lcp[:m], 0), after):
                    # The guard's own value decides whether the prefix goes on beyond the block.
                    begin = shared.left(at, depth)
                    last = shared.right(at + 1, depth) - 1
                    mine = begin == at
                    at, depth, last = at[mine], depth[mine], last[mine]
                    out = last >= m
                    inner = np.minimum(last, m - 1)
                    yield record("node", b, base + at, depth, (base + inner, out), least.of(at, inner))
                at = np.flatnonzero(lcp[:m] >= 1)
                if len(at):
                    begin = shared.left(at, lcp[at])
                    yield record("parent", b, base + at, lcp[at], (base + np.maximum(begin, 0), begin < 0), None)
                # Equal conversations stand together, the smallest id first.
                starts = np.flatnonzero(np.concatenate([[True], (lcp[1:m] != length[1:m]) | (length[1:m] != length[: m - 1])]))
                stops = np.append(starts[1:], m)
                begin = shared.left(starts, length[starts])
                begin[length[starts] == 0] = 0
                ids = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(starts.tolist(), stops.tolist())]
                first = np.where(length[starts] == 0, 0, base + np.maximum(begin, 0))
                yield record("ends", b, base + starts, length[starts], (first, (begin < 0) & (length[starts] > 0)), None, ids)

    return rows.mapInArrow(work, _FOUND)


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's comma-joined ids, streamed in order: ``(pos, depth, ends_sha256)``."""
    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("ends_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running_hash, done = None, None, []

        def table():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            for pos, depth, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if node == (pos, depth):
                    running_hash.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, running_hash.hexdigest()))
                node, running_hash = (pos, depth), hashlib.sha256(ids.encode())
            if len(done) > 10000:
                yield table()
        if node is not None:
            done.append((*node, running_hash.hexdigest()))
        if done:
            yield table()

    rows = ends.select("pos", "depth", "block", "ids").repartition("pos", "depth").sortWithinPartitions("pos", "depth", "block")
    return rows.mapInArrow(digest, schema)


# --- the trie -----------------------------------------------------------------


def prefix_trie(turns: DataFrame, conversations: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix: the node's members, parent, children, leaves and savings.

    ``turns`` has ``conv``, ``depth`` (1, 2, …), ``role``, ``text`` and ``words`` (of the text);
    ``conversations`` has every ``conv`` (long, unique, no nulls), those without turns too.  Two turns
    are one if role and text are equal, compared by two 64-bit hashes.  No conversations: no rows.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (root: null); ``n_leaves``
    counts childless nodes in the subtree and ``saved_tokens`` adds up (members - 1) x words over it;
    ``ends_sha256`` is the digest of the members that end here.
    """
    turns = settle(
        turns.select(
            "conv", (F.col("depth") - 1).cast("bigint").alias("at"),
            F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"), F.col("words").cast("bigint").alias("words"),
        ),
        "turns",
    )
    lengths = conversations.select("conv").join(turns.groupBy("conv").agg(F.count("*").alias("len")), "conv", "left")
    lengths = settle(lengths.select("conv", F.coalesce("len", F.lit(0)).cast("bigint").alias("len")), "lengths")
    total, smallest = lengths.agg(F.count("*"), F.min("conv")).first()
    positions = _ordered(turns, lengths, chunk, "conversation_order")
    levels = _block_levels(positions, total, block)
    found = settle(_in_blocks(positions, block), "found")

    # Prefixes that reach out of a block are the same for all who meet them there: one search each.
    out = found.filter("end IS NULL")
    right = settle(_beyond(out.filter("kind = 'node'").select("block", "depth").distinct(), levels, block, True), "ends_right")
    left = settle(_beyond(out.filter("kind <> 'node'").select("block", "depth").distinct(), levels, block, False), "ends_left")
    last = F.lit(total - 1).cast("bigint")
    sides = right.withColumn("node", F.lit(True)).unionByName(left.withColumn("node", F.lit(False)))
    sides = sides.select("block", "depth", "node", F.coalesce("end", last).alias("_end"), F.col("least").alias("_least"))
    rest = (
        out.withColumn("node", F.col("kind") == "node").join(sides, ["block", "depth", "node"])
        .withColumn("end", F.col("_end")).withColumn("least", F.least("least", "_least")).select(*found.columns)
    )
    found = settle(found.filter("end IS NOT NULL").unionByName(rest), "extents")
    shared = found.filter("kind = 'node'").select("pos", "depth", "end", "least")
    parents = found.filter("kind = 'parent'").select("pos", (F.col("depth") + 1).alias("depth"), F.col("end").alias("up"))

    # Every turn beyond what its conversation shares with the one before it is a node of its own.
    own = F.col("at") >= F.greatest("lcp", F.lit(0))
    nodes = turns.join(positions, "conv").filter(own).select("pos", "conv", "len", (F.col("at") + 1).alias("depth"), "words")
    nodes = nodes.join(shared, ["pos", "depth"], "left").join(parents, ["pos", "depth"], "left")
    nodes = settle(
        nodes.select(
            "pos", "depth", "words", "conv",
            F.coalesce("end", "pos").alias("end"),
            F.coalesce("least", "conv").alias("conv_id"),
            F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.coalesce("up", "pos")).cast("bigint").alias("up"),
            (F.col("depth") < F.col("len")).cast("bigint").alias("goes_on"),
        ),
        "nodes",
    )
    root = lengths.limit(1).select(
        F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"),
        F.lit(None).cast("bigint").alias("conv"), last.alias("end"), F.lit(smallest).cast("bigint").alias("conv_id"),
        F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("bigint").alias("goes_on"),
    )
    many = nodes.filter("end > pos OR depth = 0").unionByName(root)

    # In the order of position and depth a subtree is one stretch; a mark ends each position.
    after = F.col("lcp_after")
    following = positions.select((F.col("pos") - 1).alias("pos"), F.col("lcp").alias("lcp_after"))
    leaf = F.when(F.coalesce(after, F.lit(-1)) < F.col("len"), 1).otherwise(0).cast("bigint")
    marks = positions.join(following, "pos", "left").select(
        "pos", F.lit(_END).alias("depth"), F.lit(0).cast("bigint").alias("saving"), leaf.alias("leaf")
    )
    saving = (F.col("end") - F.col("pos")) * F.col("words")
    stretch = many.select("pos", "depth", saving.cast("bigint").alias("saving"), F.lit(0).cast("bigint").alias("leaf"))
    sums = settle(running(marks.unionByName(stretch), None, ["pos", "depth"], ["saving", "leaf"], "preorder"), "sums")
    until = sums.filter(F.col("depth") == _END).select(
        F.col("pos").alias("end"), F.col("before_saving").alias("_saving"), (F.col("before_leaf") + F.col("leaf")).alias("_leaf")
    )
    start = sums.filter(F.col("depth") < _END).select("pos", "depth", "before_saving", "before_leaf")
    children = nodes.groupBy(F.col("up").alias("pos"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("children"))
    many = settle(
        many.join(start, ["pos", "depth"]).join(until, "end").join(children, ["pos", "depth"], "left").select(
            "pos", "depth", "conv_id",
            (F.col("end") - F.col("pos") + 1).alias("n_convs"),
            F.coalesce("children", F.lit(0)).cast("bigint").alias("n_children"),
            (F.col("_leaf") - F.col("before_leaf")).alias("n_leaves"),
            (F.col("_saving") - F.col("before_saving")).alias("saved_tokens"),
        ),
        "many",
    )
    facts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = {"n_convs": F.lit(1), "n_children": F.col("goes_on"), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)}
    every = nodes.select("pos", "depth", "conv", "conv_id", "up", "goes_on").unionByName(root.select("pos", "depth", "conv", "conv_id", "up", "goes_on"))
    above = many.select(F.col("pos").alias("up"), F.col("depth").alias("_above"), F.col("conv_id").alias("_parent")).filter("_above > 0")
    parent = F.when(F.col("depth") == 1, F.lit(smallest)).when(F.col("depth") > 1, F.coalesce("_parent", "conv"))
    digests = _digests(found.filter("kind = 'ends'").drop("pos").withColumnRenamed("end", "pos"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        every.join(many.drop("conv_id"), ["pos", "depth"], "left")
        .withColumn("_above", F.col("depth") - 1)
        .join(above, ["up", "_above"], "left")
        .join(digests, ["pos", "depth"], "left")
        .select(
            "conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"),
            *[F.coalesce(c, one[c]).cast("bigint").alias(c) for c in facts],
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


@dataclass(frozen=True)
class Rebuild:
    """Which turns a conversation takes from the first one of its family."""

    family: int = 20  # ids c - c % family share a head
    heads: int = 4  # the number of turns taken is crc32(c) % heads

    def base(self, conv: Column) -> Column:
        return conv - conv % self.family

    def taken(self, conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % self.heads


def rebuilt_turns(
    df: DataFrame, rule: Rebuild = Rebuild(), conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The turns and conversations for ``prefix_trie``: every conversation starts with its family's head.

    Turns go by ``turn``, nulls first, then role and text; repeated rows are turns of their own; a
    null role or text is empty; rows without a conversation are left out.  A conversation whose own
    turns are all replaced and whose family's first one is absent has no turns.  Texts are hashed and
    their words counted whole.  Other columns are left out, whatever their names.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), content.alias("_text"),
        F.regexp_count(content, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"),
        F.lit(1).cast("bigint").alias("one"),
    )
    # From here on a text is two hashes, which also break ties.
    rows = rows.select(
        "conv", "_turn", "role", "words", "one",
        F.struct(F.xxhash64("_text").alias("x"), F.xxhash64(F.lit("y"), "_text").alias("y")).alias("text"),
    )
    numbered = settle(running(rows, "conv", ["_turn", "role", "text"], ["one"], "own_turns").select("conv", "role", "text", "words", F.col("before_one").alias("no")), "numbered")
    base, taken = rule.base(F.col("conv")), rule.taken(F.col("conv"))
    convs = settle(numbered.filter("no = 0").select("conv", base.alias("base"), taken.alias("taken")), "conversations")
    heads = numbered.filter((F.col("no") < rule.heads - 1) & (F.col("conv") == base)).withColumnRenamed("conv", "base")
    heads = settle(heads, "heads")
    copied = convs.filter("conv <> base").join(heads, "base").filter(F.col("no") < F.col("taken"))
    copied = settle(copied.select("conv", "role", "text", "words", "no"), "copied")
    got = copied.groupBy("conv").agg(F.count("*").alias("got"))
    short = convs.filter("conv <> base").join(got, "conv", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    # Conversations that got fewer turns than they gave up move forward.
    short = settle(short.filter("got < taken").select("conv", (F.col("taken") - F.col("got")).alias("shift")), "short")
    keep = (F.col("conv") == base) | (F.col("no") >= taken)
    own = numbered.filter(keep).join(short, "conv", "left").withColumn("no", F.col("no") - F.coalesce("shift", F.lit(0)))
    turns = own.select("conv", "role", "text", "words", "no").unionByName(copied)
    return turns.withColumn("depth", F.col("no") + 1).drop("no"), convs.select("conv")
