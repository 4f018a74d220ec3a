"""Exact Jaccard join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets of sizes r <= s with a similarity of p % or more differ in at most
H = (100 - p)(r + s) / (100 + p) elements.  Hashing splits the universe of shingles into more
than H segments, so similar sets agree exactly in some segment.  Sizes are cut into bands; a
set is indexed with its band's number of segments, and looks for larger partners in its own
band and in the next one.

* Index: one signature per filled segment, and for the first two segments also the
  signatures with one element deleted.  Empty segments are never signatures.
* Allocation: a set that fills F segments agrees with a similar one in at least F - H of
  them.  Signatures that no other set has cost nothing and use up H; a set whose shared
  signatures are too few is dropped, which counts on its partners offering all their filled
  segments, in the next band too.  Where F <= H, agreement up to one
  element in a filled one of the first two segments makes up for it; a set that even that
  leaves uncovered is compared with every set that shares a shingle.
* Verification: the sets of the remaining candidates are intersected.

Candidates that are linked already, through others, are not compared again: first every set
of a signature is compared with one of them, and only where a signature still joins different
components the pairs between those are compared, so copies never become all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from predio.llm.frames import BROADCAST_ROWS, maybe_broadcast
from predio.llm.words import KEEP_CASE, LOWER, mix, row_blocks, shingles, text_buffers, words
from predio.operators.components import connected_components
from predio.scale import settle

SHINGLE, PERCENT = 5, 80
#: Sets of up to this size have every shingle as a segment of its own.
TINY = 16
BAND = 1.6
#: Segments whose one-deletion neighbourhoods are indexed.
PROMOTED = 2
#: Signatures in more than this share of sampled sets are dealt to several tasks.
HOT_SHARE, HOT_SAMPLE, SALTS = 0.002, 0.01, 64
#: A salt takes the lowest bits of a code, and is mixed into the highest ones of a signature.
SALT_BITS = 7
#: Cells of the sketches; times sets are pruned; turns with one partner per signature.
CELLS, PRUNINGS, ROUNDS = 64, 2, 4
COARSE = 16

_U = np.uint64
_SET, _SEGMENT, _PLACE = _U(0x51ED270B7F652295), _U(0xB492B66FBE98F273), 0x9FB21C651E98DF25


def bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) of each band beyond the tiny sets."""
    out, lo = [], TINY + 1
    while lo <= largest:
        hi = int(lo * BAND)
        differ = (100 - percent) * 2 * hi // (100 + percent)
        out.append((lo, hi, -(-115 * (differ + 1) // 100) + 4))
        lo = hi + 1
    return out


def _sets(column: pa.Array, lower: bool, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows with their sorted distinct shingles and where each row begins."""
    data, at = text_buffers(column)
    for a, b in row_blocks(at):
        _, _, hashes, row = words(data, at, a, b, LOWER if lower else KEEP_CASE)
        found, begin = shingles(hashes, row, k)
        own = [np.unique(found[x:y]) for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]
        yield a, b, np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


def _identity(elements: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; equal sets have equal names (0 for empty ones)."""
    out = np.zeros(len(row) - 1, _U)
    filled = np.flatnonzero(np.diff(row))
    if len(filled):
        out[filled] = mix(np.add.reduceat(mix(elements ^ _SET), row[filled]) + np.diff(row)[filled].astype(_U))
    return out


class Signatures:
    """Signatures of sets, for one threshold."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def differ(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return (100 - self.percent) * (small + large) // (100 + self.percent)

    def __call__(self, elements: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(signature, row, role, shared signatures needed) of all rows, and the uncovered (row, role) pairs."""
        size = np.diff(row)
        table = bands(self.percent, int(size.max(initial=0)) * 100 // self.percent + 1)
        low = np.array([TINY + 1, *[hi + 1 for _, hi, _ in table]])  # where band 1, 2, … begin
        band = np.searchsorted(low, size, "right")
        widest = size * 100 // self.percent
        out = [], [], [], []
        tops = np.array([TINY, *[hi for _, hi, _ in table]])
        for role in (0, 1):
            rows = np.flatnonzero((size > 0) & ((role == 0) | (np.searchsorted(low, widest, "right") > band)))
            target = band[rows] + role
            limit = self.differ(size[rows], np.minimum(tops[target], widest[rows]))
            tiny = target == 0
            if tiny.any():
                self._tiny(elements, row, rows[tiny], limit[tiny], out)
            if (~tiny).any():
                parts = np.array([0, *[m for _, _, m in table]])[target[~tiny]]
                self._band(elements, row, rows[~tiny], limit[~tiny], target[~tiny], parts, role, out)
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)

    def _tiny(self, elements, row, rows, limit, out) -> None:
        size = row[rows + 1] - row[rows]
        at = np.repeat(row[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[0].append(mix(elements[at] + _SEGMENT))
        out[1].append(np.repeat(rows, size))
        out[2].append(np.zeros(len(at), np.int64))
        out[3].append(np.repeat(np.maximum(size - limit, 1), size))

    def _band(self, elements, row, rows, limit, target, parts, role, out) -> None:
        size = row[rows + 1] - row[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        own = elements[np.repeat(row[rows] - (np.cumsum(size) - size), size) + np.arange(len(owner))]
        base = np.concatenate([[0], np.cumsum(parts)])
        part = (mix(own + _SET) % parts[owner].astype(_U)).astype(np.int64) + base[owner]
        order = np.argsort(part, kind="stable")
        part, own, owner = part[order], mix(own[order] ^ _SEGMENT), owner[order]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.append(begin, len(part)))
        total = np.add.reduceat(own, begin)
        line = owner[begin]  # the set of each filled segment
        segment = part[begin] - base[line]
        salt = segment.astype(_U) * _U(_PLACE) + target[line].astype(_U) * _U(0xD1B54A32D192ED03)
        filled = np.bincount(line, minlength=len(rows))
        # In the next band too: the larger set counts on every segment it may share.
        need = np.maximum(filled - limit, 1)
        promoted = segment < PROMOTED
        covered = filled + np.bincount(line[promoted], minlength=len(rows)) > limit
        out[0].append(mix(total + salt))
        out[1].append(rows[line])
        out[2].append(np.full(len(begin), role))
        out[3].append(need[line])
        # One element deleted; in the next band only where the filled segments do not suffice.
        near = promoted & (count > 1) & ((role == 0) | (filled <= limit)[line])
        which = np.repeat(np.arange(len(begin)), np.where(near, count, 0))
        if len(which):
            each = near[np.repeat(np.arange(len(begin)), count)]
            out[0].append(mix(total[which] - own[each] + salt[which]))
            out[1].append(rows[line[which]])
            out[2].append(np.full(len(which), role))
            out[3].append(need[line[which]])
        bare = np.flatnonzero(~covered)
        if len(bare):  # told by needing nothing
            out[0].append(np.zeros(len(bare), _U))
            out[1].append(rows[bare])
            out[2].append(np.full(len(bare), role))
            out[3].append(np.zeros(len(bare), np.int64))


class _Seen:
    """Names met lately in a task, so that copies are sent on once."""

    def __init__(self, most: int = 200_000) -> None:
        self.names, self.most = set(), most

    def new(self, names: np.ndarray) -> np.ndarray:
        if len(self.names) > self.most:
            self.names.clear()
        out = np.zeros(len(names), bool)
        for i, name in enumerate(names.tolist()):
            if name and name not in self.names:
                self.names.add(name)
                out[i] = True
        return out


def _pick(elements: np.ndarray, row: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(row)
    return elements[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])])


def _distinct_sets(batches, lower: bool, k: int, at: int = 0):
    """Names and sets of blocks of rows, without sets that the task has met lately."""
    seen = _Seen()
    for batch in batches:
        for _, _, elements, row in _sets(batch.column(at), lower, k):
            name = _identity(elements, row)
            keep = seen.new(name)
            elements, row = _pick(elements, row, keep)
            yield name[keep], elements, row


def classes(docs: DataFrame, key: str, text: str, k: int, lower: bool) -> DataFrame:
    """``(_key, _print, _n, _class)`` of every row (``_print`` is a hash of the text); rows without a word have size 0 and no class."""

    def run(batches):
        for batch in batches:
            for a, b, elements, row in _sets(batch.column(2), lower, k):
                name = _identity(elements, row)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in batch.columns[:2]], pa.array(np.diff(row)), pa.array(name.view(np.int64), mask=np.diff(row) == 0)],
                    names=["_key", "_print", "_n", "_class"],
                )

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, _print bigint, _n bigint, _class bigint")


def _signatures(texts: DataFrame, percent: int, k: int, lower: bool, hot: np.ndarray) -> DataFrame:
    """``(_sig, _class, _code)`` of all sets; ``_unsalted`` gives the signature and code themselves.

    Both hold the salt, so that one number names a bucket: rows are short and sorted by it alone.
    """

    def run(batches):
        make = Signatures(percent)
        for name, elements, row in _distinct_sets(batches, lower, k):
            if not len(name):
                continue
            signature, owner, role, need = make(elements, row)
            heavy = np.isin(signature, hot) if len(hot) else np.zeros(len(signature), bool)
            own = name[owner]
            heavy |= need == 0
            salt = np.where(heavy, 1 + own % _U(SALTS), _U(0))
            bucket = (signature ^ (salt << _U(64 - SALT_BITS))).view(np.int64)
            code = ((2 * need + role) << SALT_BITS) + salt.astype(np.int64)
            for a in range(0, len(signature), 1 << 16):
                z = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[z]), pa.array(own[z].view(np.int64)), pa.array(code[z])], names=["_sig", "_class", "_code"]
                )

    return texts.mapInArrow(run, "_sig bigint, _class bigint, _code bigint")


def _unsalted(made: DataFrame) -> DataFrame:
    salt = F.col("_code").bitwiseAND((1 << SALT_BITS) - 1)
    return made.select(
        F.col("_sig").bitwiseXOR(F.shiftleft(salt, 64 - SALT_BITS)).alias("_sig"), "_class",
        F.shiftright("_code", SALT_BITS).cast("int").alias("_code"),
    )


def _hot_signatures(texts: DataFrame, percent: int, k: int, lower: bool) -> np.ndarray:
    """Signatures that many sets of a sample have; at most 1 / ``HOT_SHARE`` per signature of a set.

    They only decide which rows are salted, never the result.
    """
    sample = texts.sample(HOT_SAMPLE, seed=1)
    found = settle(_signatures(sample, percent, k, lower, np.empty(0, _U)), "sampled")
    sets = found.select("_class").distinct().count()
    often = found.groupBy("_sig").agg(F.count("*").alias("n")).filter(F.col("n") > max(20, sets * HOT_SHARE))
    return np.sort(np.array([r["_sig"] for r in often.select("_sig").limit(200_000).collect()], np.int64).view(_U))


def _cells(elements: np.ndarray) -> np.ndarray:
    return (mix(elements ^ _U(_PLACE)) % _U(CELLS)).astype(np.int64)


def _texts_of(texts: DataFrame, wanted: DataFrame, prints: DataFrame) -> DataFrame:
    """Those of ``texts`` whose hash is that of a text of a wanted class, by the stored ``(_class, _print)`` of all rows.

    Each wanted class has one at least; all texts are returned where the hashes are too many to be sent to every task.
    """
    chosen = settle(prints.join(wanted, "_class", "left_semi").groupBy("_class").agg(F.min("_print").alias("_print")), "prints")
    if chosen.count() > BROADCAST_ROWS:
        return texts
    return texts.join(F.broadcast(chosen), F.xxhash64("_text") == F.col("_print"), "left_semi")


def _stored_sets(texts: DataFrame, wanted: DataFrame, prints: DataFrame, k: int, lower: bool) -> DataFrame:
    """Once per wanted class its sorted shingles ``_set`` as bytes, their number and a sketch.

    The sketch counts the elements in each of ``CELLS`` cells; two sets differ at least as much as
    their sketches.  For ``prints``, see ``_texts_of``.
    """

    def run(batches):
        for name, elements, row in _distinct_sets(batches, lower, k):
            cut = row.tolist()
            raw = elements.astype("<u8").tobytes()
            owner = np.repeat(np.arange(len(name)), np.diff(row))
            sketch = np.bincount(owner * CELLS + _cells(elements), minlength=len(name) * CELLS).reshape(-1, CELLS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name.view(np.int64)), pa.array([raw[8 * a : 8 * b] for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array(np.diff(row)), pa.array(sketch.astype(np.int32).tolist(), pa.list_(pa.int32())),
                ],
                names=["_class", "_set", "_n", "_sketch"],
            )

    wanted = maybe_broadcast(settle(wanted, "wanted"))
    own = _texts_of(texts, wanted, prints).mapInArrow(run, "_class bigint, _set binary, _n bigint, _sketch array<int>")
    own = own.join(wanted, "_class", "left_semi")
    # Copies met by different tasks: their rows are equal.
    return settle(own.groupBy("_class").agg(*[F.first(c).alias(c) for c in ("_set", "_n", "_sketch")]), "sets")


def _possible(percent: int) -> Column:
    """By sizes, unique shingles and sketches (``_n, _u, _sketch`` and ``_m, _v, _other``), may two sets be similar?"""
    most = (100 - percent) * (F.col("_n") + F.col("_m"))
    apart = F.col("_u") + F.col("_v")
    differ = F.aggregate(F.zip_with("_sketch", "_other", lambda x, y: F.abs(x - y)), apart, lambda t, x: t + x)
    return (
        (most >= (100 + percent) * F.abs(F.col("_n") - F.col("_m")))
        & (most >= (100 + percent) * apart)
        & (most >= (100 + percent) * differ)
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    if not sketched:
        light = sets.select("_class", "_n", "_sketch", F.lit(0).cast("bigint").alias("_u"))
        pairs = pairs.join(light.withColumnRenamed("_class", "b"), "b").join(light.toDF("a", "_m", "_other", "_v"), "a")
        pairs = settle(pairs.filter(_possible(percent)).select("a", "b"), "possible")
    with_b = pairs.join(sets.select(F.col("_class").alias("b"), F.col("_set").alias("_b")), "b")
    full = with_b.join(sets.select(F.col("_class").alias("a"), F.col("_set").alias("_a")), "a")
    return settle(full.select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint"), "links")


def _uniques(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(_class, _n, _sketch, _u)`` of the classes of ``rows``, their unique shingles apart.

    Here every shingle is a segment of its own.  ``_u`` counts those that no other of the sets has,
    and the sketch holds the others only: two sets differ in all their unique shingles, and at least
    as much as their sketches in the others.
    """

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                elements = np.frombuffer(raw.as_buffer(), "<u8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(elements), name)), pa.array(elements.view("<i8")), pa.array(_cells(elements).astype(np.int32))],
                    names=["_class", "_e", "_cell"],
                )

    own = sets.join(rows.select("_class").distinct(), "_class", "left_semi")
    elements = own.select("_class", "_set").mapInArrow(run, "_class bigint, _e bigint, _cell int")
    single = elements.groupBy("_e").agg(F.count("*").alias("_c"), F.min("_class").alias("_class"), F.min("_cell").alias("_cell"))
    cells = single.filter("_c = 1").groupBy("_class", "_cell").agg(F.count("*").cast("int").alias("_c"))
    cells = cells.groupBy("_class").agg(
        F.sum("_c").alias("_u"), F.map_from_entries(F.collect_list(F.struct("_cell", "_c"))).alias("_cells")
    )
    both = own.select("_class", "_n", "_sketch").join(cells, "_class", "left")
    rest = F.transform("_sketch", lambda v, i: v - F.coalesce(F.try_element_at("_cells", i), F.lit(0)))
    return settle(
        both.select(
            "_class", "_n", F.when(F.col("_u").isNull(), F.col("_sketch")).otherwise(rest).alias("_sketch"),
            F.coalesce("_u", F.lit(0)).cast("bigint").alias("_u"),
        ),
        "uniques",
    )


def _alone(uniques: DataFrame, percent: int) -> DataFrame:
    """Classes whose unique shingles are more than similar sets may differ in."""
    return uniques.filter(100 * F.col("_u") > (100 - percent) * F.col("_n")).select("_class")


def _components(links: DataFrame) -> DataFrame:
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return settle(connected_components(settle(nodes, "nodes"), links).toDF("_class", "_component"), "components")


def _named(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Rows with their class's component; a class without a link is one of its own."""
    joined = rows.drop("_component").join(components, "_class", "left")
    return joined.withColumn(
        "_component",
        F.when(F.col("_component").isNull(), F.struct(F.lit(0).alias("k"), F.col("_class").alias("c"))).otherwise(
            F.struct(F.lit(1).alias("k"), F.col("_component").alias("c"))
        ),
    )


def _links(texts: DataFrame, prints: DataFrame, percent: int, k: int, lower: bool) -> DataFrame | None:
    """Components ``(_class, _component)`` of the classes that have links; ``prints`` has every row's class and text hash."""
    hot = _hot_signatures(texts, percent, k, lower)
    made = _signatures(texts, percent, k, lower, hot)
    bucket = Window.partitionBy("_sig")
    made = made.withColumn("_least", F.min("_class").over(bucket)).withColumn("_most", F.max("_class").over(bucket))
    salted = F.col("_code").bitwiseAND((1 << SALT_BITS) - 1) > 0  # uncovered sets too
    shared = made.filter(salted | (F.col("_least") != F.col("_most"))).select("_sig", "_class", "_code")
    # Copies met by different tasks are in one bucket.
    shared = settle(_unsalted(shared.distinct()), "shared")
    uncovered = settle(shared.filter("_code <= 1").select("_class").distinct(), "uncovered")
    shared = shared.filter("_code > 1")
    for _ in range(PRUNINGS):
        # A set with too few shared signatures goes, and then signatures left to one set.
        enough = shared.groupBy("_class", "_code").agg(F.count("*").alias("_n")).filter("_n >= _code div 2")
        shared = shared.join(enough.select("_class", "_code"), ["_class", "_code"], "left_semi")
        alive = shared.groupBy("_sig").agg(F.min("_class").alias("_a"), F.max("_class").alias("_z")).filter("_a < _z")
        shared = settle(shared.join(alive.select("_sig"), "_sig", "left_semi"), "shared")

    # Allocation: a set looks up its cheapest signatures, as many as similarity leaves in doubt.
    costs = shared.groupBy("_sig").agg(F.count("*").alias("_cost"))
    own = Window.partitionBy("_class", "_code")
    ranked = (
        shared.join(costs, "_sig")
        .withColumn("_rank", F.row_number().over(own.orderBy("_cost", "_sig")))
        .withColumn("_n", F.count("*").over(own))
    )
    probes = (F.col("_rank") <= F.col("_n") - F.expr("_code div 2") + 1).alias("_probe")
    rows = settle(ranked.select("_sig", "_class", probes).groupBy("_sig", "_class").agg(F.max("_probe").alias("_probe")), "rows")
    rows = _with_partners(rows, rows)
    checked = None if uncovered.isEmpty() else _by_shingle(texts, uncovered, k, lower)
    if checked is None and rows.isEmpty():
        return None
    wanted = rows.select("_class")
    if checked is not None:
        checked = settle(checked, "checked")
        wanted = wanted.unionByName(checked.select(F.col("a").alias("_class"))).unionByName(checked.select(F.col("b").alias("_class")))
    sets = _stored_sets(texts, wanted.distinct(), prints, k, lower)
    links = _verified(checked, sets, percent) if checked is not None else None
    components = _components(links) if links is not None else None

    # Each set with one other of its signature, while that joins components; another one each round.
    for turn in range(ROUNDS):
        named = _named(rows, components) if components is not None else rows.withColumn("_component", F.struct(F.lit(0).alias("k"), F.col("_class").alias("c")))
        open_rows = _with_partners(rows, named)
        if open_rows.isEmpty():
            return components
        order = F.col("_class") if turn == 0 else F.xxhash64("_sig", "_class", F.lit(turn))
        pivots = open_rows.groupBy("_sig").agg(F.min(F.struct(order.alias("o"), "_class", "_component", "_probe")).alias("_pivot"))
        star = open_rows.join(pivots, "_sig").filter(
            (F.col("_component") != F.col("_pivot._component")) & (F.col("_probe") | F.col("_pivot._probe"))
        )
        star = star.select(F.least("_class", "_pivot._class").alias("a"), F.greatest("_class", "_pivot._class").alias("b")).distinct()
        if checked is not None:
            star = star.join(checked, ["a", "b"], "left_anti")
        star = settle(star, "star")
        checked = star if checked is None else checked.unionByName(star)
        found = _verified(star, sets, percent)
        new = not found.isEmpty()
        links = found if links is None else links.unionByName(found)
        if new:
            components = _components(links)
        elif turn:
            break
        rows = open_rows.drop("_component")
        if turn < 2:
            rows = settle(rows.join(_alone(_uniques(rows, sets), percent), "_class", "left_anti"), "rows")

    # Signatures that still join different components: all pairs between those.
    named = _named(rows, components) if components is not None else rows.withColumn("_component", F.struct(F.lit(0).alias("k"), F.col("_class").alias("c")))
    open_rows = _with_partners(rows, named)
    if open_rows.isEmpty():
        return components
    uniques = _uniques(open_rows, sets)
    # A coarser sketch of few cells, compared first because Spark compiles its plain sum.
    parts = range(0, CELLS, CELLS // COARSE)
    coarse = F.array(*[sum((F.get("_sketch", F.lit(i + j)) for j in range(1, CELLS // COARSE)), F.get("_sketch", F.lit(i))) for i in parts])
    open_rows = settle(open_rows.join(uniques.withColumn("_coarse", coarse), "_class"), "open")
    left = open_rows.select(
        "_sig", F.col("_class").alias("a"), F.col("_component").alias("_p"), F.col("_probe").alias("_asks"), "_n", "_u", "_sketch",
        F.col("_coarse").alias("_x"),
    )
    right = open_rows.select(
        "_sig", F.col("_class").alias("b"), F.col("_component").alias("_q"), F.col("_probe").alias("_wants"),
        F.col("_n").alias("_m"), F.col("_u").alias("_v"), F.col("_sketch").alias("_other"),
        F.col("_coarse").alias("_y"),
    )
    same = (left["_sig"] == right["_sig"]) & (F.col("a") < F.col("b")) & (F.col("_p") != F.col("_q"))
    roughly = sum((F.abs(F.get("_x", F.lit(i)) - F.get("_y", F.lit(i))) for i in range(COARSE)), F.col("_u") + F.col("_v"))
    same &= F.col("_asks") | F.col("_wants")
    same &= (100 - percent) * (F.col("_n") + F.col("_m")) >= (100 + percent) * roughly
    same &= _possible(percent)
    cross = left.join(right, same).select("a", "b").distinct()
    cross = settle(cross.join(checked, ["a", "b"], "left_anti"), "cross")
    if cross.isEmpty():
        return components
    found = _verified(cross, sets, percent, sketched=True)
    return components if found.isEmpty() else _components(links.unionByName(found))


def _with_partners(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of signatures that some set looks up and that hold different components (or sets)."""
    what = "_component" if "_component" in named.columns else "_class"
    alive = named.groupBy("_sig").agg(F.max("_probe").alias("_u"), F.min(what).alias("_p"), F.max(what).alias("_q"))
    alive = alive.filter("_u and _p <> _q").select("_sig")
    return settle(named.join(alive, "_sig", "left_semi"), "rows")


def _by_shingle(texts: DataFrame, uncovered: DataFrame, k: int, lower: bool) -> DataFrame:
    """All pairs of an uncovered class and a class that shares a shingle with it."""

    def run(batches):
        for name, elements, row in _distinct_sets(batches, lower, k):
            own = np.repeat(name, np.diff(row))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(elements.view(np.int64))], names=["_class", "_e"])

    every = texts.mapInArrow(run, "_class bigint, _e bigint")
    own = settle(every.join(uncovered, "_class", "left_semi").distinct(), "uncovered_shingles")
    pairs = every.join(own.withColumnRenamed("_class", "_u"), "_e").filter("_class <> _u")
    return pairs.select(F.least("_class", "_u").alias("a"), F.greatest("_class", "_u").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE, lower: bool = True
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links, of every row.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of distinct ``k``-word
    shingles (A-Z lowered); with fewer words the whole sequence is the only shingle.  Rows without
    words (null, empty or blank texts) link with nothing and are their own component, and repeated
    rows are each returned.  A missing key is passed on and never a component's name unless no other
    is there.  ``_print`` and
    ``_first_print``, hashes of the row's text and of the text that names the component, tell rows apart
    that share a key.  An empty table gives an empty table; other columns are not looked at.  Shingles and sets are told apart by 64-bit hashes.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = settle(classes(docs, key, text, k, lower), "classes")
    components = _links(texts, rows.select("_class", "_print"), percent, k, lower)
    # A missing key comes last.
    name = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_print").alias("print"))
    smallest = rows.filter("_class is not null").groupBy("_class").agg(F.min(name).alias("_least"))
    if components is not None:
        smallest = smallest.join(components, "_class", "left")
        joined = smallest.filter("_component is not null").groupBy("_component").agg(F.min("_least").alias("_all"))
        smallest = smallest.join(joined, "_component", "left").select("_class", F.coalesce("_all", "_least").alias("_least"))
    smallest = settle(smallest, "smallest")
    first = F.when(F.col("_class").isNull(), name).otherwise(F.col("_least"))
    return rows.join(smallest, "_class", "left").select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        first["key"].alias("component_id"),
        "_print",
        first["print"].alias("_first_print"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest key, texts without words all stay.

    Where texts share that key the one of the smallest hash stays, and of repeated rows one.
    """
    found = settle(near_duplicates(docs, key, text, percent), "near_duplicates")
    own = F.col(key).eqNullSafe(F.col("component_id")) & F.col("_print").eqNullSafe(F.col("_first_print"))
    gone = found.filter(~own).select(F.col(key).alias("_key"), "_print").distinct()
    gone = maybe_broadcast(settle(gone, "duplicates"))
    left = docs.join(gone, docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[text]) == F.col("_print")), "left_anti")
    repeated = found.filter("n_shingles > 0").groupBy(key, "_print").agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("_key"), "_print")
    repeated = settle(repeated, "repeated")
    if repeated.isEmpty():
        return left
    again = docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[text]) == F.col("_print"))
    repeated = maybe_broadcast(repeated)
    return left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates([key, text]))
