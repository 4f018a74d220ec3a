"""Clusters of listings by location: k-means and DBSCAN.

DBSCAN on a grid whose cells are at most ``eps`` across:

* All points of a cell are neighbours.  A cell with ``min_samples`` listings is *dense*:
  its points are all core and in one cluster, and no pairs inside it are looked at.
* Points of the other (*sparse*) cells are compared with the points of the cells around
  them.  A sparse cell has fewer than ``min_samples`` points, so this is linear in the
  number of points.  Cells with very many points are salted for this join.
* Two dense cells are one cluster if any two of their points are within ``eps``.  That is
  decided by splitting both cells into ever smaller boxes: pairs of boxes further apart
  than ``eps`` are dropped, a close pair of box representatives decides for "yes".
* Clusters are the connected components of the cells; a border point takes the
  lowest-numbered cluster among its core neighbours; other points are noise, -1.

Equal locations are collapsed first, with their number of listings as weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from predio.functions.geo import EARTH_KM, box_haversine, haversine
from predio.operators.codes import dense_codes
from predio.operators.components import connected_components
from predio.operators.kmeans import CLUSTERS, RESTARTS, KMeansModel, fit_kmeans
from predio.operators.scaling import scale_standard
from predio.scale import settle
from predio.schema import KEY, require_columns

NOISE = -1
# Points of one cell that one task joins; cells with more are salted.
SALT_POINTS = 100_000
# After this many halvings every point is compared by itself.
MAX_LEVEL = 28


def kmeans_fit(
    df: DataFrame, k: int = CLUSTERS, scale: bool = False, lat: str = "lat", lng: str = "lng", seed: int = 42,
    restarts: int = RESTARTS,
) -> tuple[DataFrame, KMeansModel | None]:
    """``df`` with ``cluster`` (0..k-1, the nearest centre; NULL without a location), and the model.

    ``scale`` standardises the coordinates first; the centres are then on that scale.
    """
    require_columns(df, [lat, lng])
    scaled = df.withColumns({"_x": F.col(lat).cast("double"), "_y": F.col(lng).cast("double")})
    if scale:
        scaled = scale_standard(scaled, ["_x", "_y"])
    located = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    points = settle(scaled.filter(located).groupBy("_x", "_y").agg(F.count("*").cast("double").alias("w")), "points")
    model = fit_kmeans(points, ["_x", "_y"], k, restarts, seed)
    cluster = F.when(located, model.nearest(["_x", "_y"])) if model else F.lit(None).cast("int")
    return scaled.withColumn("_cluster", cluster).select(*df.columns, F.col("_cluster").alias("cluster")), model


def kmeans_clusters(
    df: DataFrame, k: int = CLUSTERS, scale: bool = False, lat: str = "lat", lng: str = "lng",
    seed: int = 42, restarts: int = RESTARTS,
) -> DataFrame:
    """Add ``cluster`` in 0..k-1 by the best of ``restarts`` k-means runs; NULL without a location."""
    return kmeans_fit(df, k, scale, lat, lng, seed, restarts)[0]


class _Grid:
    """Cells of angular size at most ``eps`` across; a cell id is ``row << 32 | column``.

    Rows are bands of latitude.  Every row is divided into a whole number of columns, wide
    enough near the poles, so that cells close up around the date line.
    """

    def __init__(self, eps: float):
        self.eps = eps
        self.height = eps / math.sqrt(2) * (1 - 1e-9)
        self.top_row = int(math.pi / self.height)

    def row(self, lat: Column) -> Column:
        return F.floor((lat + math.pi / 2) / self.height)

    def columns(self, row: Column) -> Column:
        """Number of columns of a row: its widest parallel cut into cell widths."""
        low = row * self.height - math.pi / 2
        high = low + self.height
        widest = F.when((low <= 0) & (high >= 0), 1.0).otherwise(
            F.greatest(F.cos(low), F.cos(high))
        )
        return F.greatest(F.ceil(widest * 2 * math.pi / self.height), F.lit(1))

    def cell(self, row: Column, lng: Column) -> Column:
        n = self.columns(row)
        turn = F.pmod(lng + math.pi, F.lit(2 * math.pi)) / (2 * math.pi)
        column = F.least(F.floor(turn * n), n - 1)
        return F.shiftleft(row, 32).bitwiseOR(column)

    def neighbours(self, cells: DataFrame) -> DataFrame:
        """All cell ids ``near`` that may hold points within eps of ``cell``, itself left out."""
        rows = cells.select("cell").withColumn("_r", F.shiftright("cell", 32)).withColumn(
            "_c", F.col("cell").bitwiseAND(F.lit((1 << 32) - 1))
        )
        near_row = F.sequence(
            F.greatest(F.col("_r") - 2, F.lit(0)), F.least(F.col("_r") + 2, F.lit(self.top_row))
        )
        n, m = self.columns(F.col("_r")), self.columns(F.col("_s"))
        # Two points within eps differ by at most asin(sin eps / cos lat) in longitude.
        furthest = F.abs(F.col("_r") * self.height - math.pi / 2) + self.height
        reach = F.when(
            furthest + self.eps < math.pi / 2 - 1e-9,
            F.asin(F.least(math.sin(self.eps) / F.cos(furthest), F.lit(1.0))),
        ).otherwise(math.pi)
        turn = reach / (2 * math.pi) + 1e-12
        first = F.floor((F.col("_c") / n - turn) * m)
        last = F.floor(((F.col("_c") + 1) / n + turn) * m)
        return (
            rows.withColumn("_s", F.explode(near_row))
            .withColumn("_m", m)
            .withColumn("_d", F.explode(F.sequence(first, F.least(last, first + m - 1))))
            .select("cell", F.shiftleft("_s", 32).bitwiseOR(F.pmod("_d", "_m")).alias("near"))
            .filter("near != cell")
            .distinct()
        )


def _dense_links(points: DataFrame, pairs: DataFrame, grid: _Grid, close: float) -> DataFrame:
    """The pairs ``(a, b)`` of dense cells that hold two points within eps of each other."""
    cell_row = F.shiftright("cell", 32)
    turn = F.pmod(F.col("y") + math.pi, F.lit(2 * math.pi)) / (2 * math.pi)
    up = (F.col("x") + math.pi / 2) / grid.height - cell_row  # position in the cell, 0..1
    right = turn * grid.columns(cell_row) - F.col("cell").bitwiseAND(F.lit((1 << 32) - 1))

    def boxes(level: int, active: DataFrame) -> DataFrame:
        side = 1 << level

        def index(position):
            return F.least(F.greatest(F.floor(position * side), F.lit(0)), F.lit(side - 1))

        keys = ["cell", index(up).alias("i"), index(right).alias("j")]
        if level == MAX_LEVEL:  # every point is its own box
            keys += [F.col("x").alias("_x"), F.col("y").alias("_y")]
        return (
            points.join(active, ["cell"], "left_semi")
            .groupBy(*keys)
            .agg(
                F.min("x").alias("lat_min"), F.max("x").alias("lat_max"),
                F.min("y").alias("lng_min"), F.max("y").alias("lng_max"),
                F.min(F.struct("x", "y")).alias("rep"),
            )
        )

    # Undecided pairs of boxes; at level 0 the box of a cell is the cell.
    open_pairs = settle(
        pairs.select(
            F.col("a").alias("a_cell"), F.lit(0).cast("bigint").alias("a_i"),
            F.lit(0).cast("bigint").alias("a_j"),
            F.col("b").alias("b_cell"), F.lit(0).cast("bigint").alias("b_i"),
            F.lit(0).cast("bigint").alias("b_j"),
        ),
        "box_pairs",
    )
    links = []
    for level in range(MAX_LEVEL + 1):
        if open_pairs.isEmpty():
            break
        active = (
            open_pairs.select(F.col("a_cell").alias("cell"))
            .union(open_pairs.select("b_cell"))
            .distinct()
        )
        level_boxes = settle(boxes(level, active).drop("_x", "_y"), "boxes")
        shift = 0 if level == 0 else 1
        found = open_pairs
        for p in ("a_", "b_"):
            side = level_boxes.select(*[F.col(c).alias(p + c) for c in level_boxes.columns])
            side = side.withColumns(
                {p + "pi": F.shiftright(p + "i", shift), p + "pj": F.shiftright(p + "j", shift)}
            )
            found = found.withColumnsRenamed({p + "i": p + "pi", p + "j": p + "pj"}).join(
                side, [p + "cell", p + "pi", p + "pj"]
            )
        rep_distance = haversine(
            F.col("a_rep.x"), F.col("a_rep.y"), F.col("b_rep.x"), F.col("b_rep.y")
        )

        def single(p):
            return (F.col(p + "lat_min") == F.col(p + "lat_max")) & (
                F.col(p + "lng_min") == F.col(p + "lng_max")
            )

        found = settle(
            found.filter(box_haversine("a_", "b_") <= close * (1 + 1e-12)).select(
                "a_cell", "a_i", "a_j", "b_cell", "b_i", "b_j",
                (rep_distance <= close).alias("linked"),
                (single("a_") & single("b_")).alias("final"),
            ),
            "box_pairs",
        )
        linked = found.filter("linked").select("a_cell", "b_cell").distinct()
        links.append(linked.toDF("a", "b"))
        open_pairs = (
            found.filter("not linked and not final")
            .drop("linked", "final")
            .join(linked, ["a_cell", "b_cell"], "left_anti")
        )
    linked = links[0] if links else pairs.select("a", "b").limit(0)
    for more in links[1:]:
        linked = linked.unionByName(more)
    return linked


def dbscan_clusters(
    df: DataFrame, eps_km: float = 1.5, min_samples: int = 5, lat: str = "lat", lng: str = "lng",
    key: str = KEY, salt_points: int = SALT_POINTS,
) -> DataFrame:
    """Add ``cluster`` by DBSCAN with great-circle distances; noise is -1, NULL without a location.

    Coordinates are degrees.  Clusters are numbered by the smallest ``key`` of their core
    listings.
    """
    require_columns(df, [lat, lng, key])
    grid = _Grid(eps_km / EARTH_KM)
    close = math.sin(grid.eps / 2) ** 2  # the haversine of eps
    x, y = F.radians(F.col(lat)), F.radians(F.col(lng))
    cell_of = grid.cell(grid.row(x), y)

    known = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    known &= ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lng).cast("double"))
    located = df.filter(known)
    points = settle(
        located.groupBy(F.col(lat).alias("lat"), F.col(lng).alias("lng"))
        .agg(F.count("*").alias("weight"), F.min(key).alias("first_key"))
        .withColumns({"x": F.radians("lat"), "y": F.radians("lng")})
        .withColumn("cell", grid.cell(grid.row(F.col("x")), F.col("y"))),
        "points",
    )
    cells = settle(
        points.groupBy("cell").agg(
            F.sum("weight").alias("cell_weight"),
            F.count("*").alias("n_points"),
            F.min("first_key").alias("first_key"),
        ),
        "cells",
    )
    dense = cells.filter(F.col("cell_weight") >= min_samples).select("cell")
    sparse_cells = cells.filter(F.col("cell_weight") < min_samples)
    near = grid.neighbours(cells)
    near = settle(
        near.join(cells.select(F.col("cell").alias("near"), "n_points"), "near"), "neighbours"
    )

    # Sparse points (p) against the points (q) of the cells around them.
    sparse = settle(
        points.join(sparse_cells.select("cell", "cell_weight"), ["cell"]),
        "sparse_points",
    )
    salts = F.ceil(F.col("n_points") / salt_points)
    # At most (points / salt_points) cells are salted.
    salted = settle(cells.filter(F.col("n_points") > salt_points).select("cell", salts.alias("_salts")), "salts")
    q = (
        points.join(salted, ["cell"], "left")
        .withColumn("_salt", F.pmod(F.xxhash64("lat", "lng"), F.coalesce("_salts", F.lit(1))))
        .select(
            F.col("cell").alias("q_cell"), "_salt", F.col("x").alias("q_x"), F.col("y").alias("q_y"),
            F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), F.col("weight").alias("q_weight"),
        )
    )
    p = sparse.join(near, "cell").select(
        "lat", "lng", "x", "y", "cell",
        F.col("near").alias("q_cell"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt"),
    )
    within = haversine(F.col("x"), F.col("y"), F.col("q_x"), F.col("q_y")) <= close
    met = p.join(q, ["q_cell", "_salt"]).filter(within)
    # Weight of the neighbours of each sparse point in each cell around it.
    reach = settle(
        met.groupBy("lat", "lng", "cell", "q_cell").agg(F.sum("q_weight").alias("near_weight")),
        "reach",
    )
    around = reach.groupBy("lat", "lng").agg(F.sum("near_weight").alias("around"))
    sparse = settle(
        sparse.join(around, ["lat", "lng"], "left").withColumn(
            "core", F.col("cell_weight") + F.coalesce("around", F.lit(0)) >= min_samples
        ),
        "sparse_points",
    )
    core = sparse.filter("core")
    core_cells = settle(
        dense.withColumn("is_dense", F.lit(True))
        .join(cells.select("cell", "first_key"), "cell")
        .unionByName(
            core.groupBy("cell").agg(F.min("first_key").alias("first_key")).withColumn("is_dense", F.lit(False))
        ),
        "core_cells",
    )

    # Each sparse point's core neighbours in other cells, as (point, its core flag, cell of q).
    flag = sparse.select("lat", "lng", "core")
    to_dense = reach.join(dense.select(F.col("cell").alias("q_cell")), "q_cell", "left_semi").select(
        "lat", "lng", "cell", "q_cell"
    )
    core_q = core.select(
        F.col("cell").alias("q_cell"), F.col("x").alias("q_x"), F.col("y").alias("q_y")
    )
    to_sparse = (
        sparse.join(near, "cell")
        .select("lat", "lng", "x", "y", "cell", F.col("near").alias("q_cell"))
        .join(core_q, "q_cell")
        .filter(within)
        .select("lat", "lng", "cell", "q_cell")
    )
    touches = settle(
        to_dense.unionByName(to_sparse).distinct().join(flag, ["lat", "lng"]), "touches"
    )

    dense_pairs = (
        near.filter("cell < near")
        .select(F.col("cell").alias("a"), F.col("near").alias("b"))
        .join(dense.toDF("a"), "a", "left_semi")
        .join(dense.toDF("b"), "b", "left_semi")
    )
    dense_points = points.join(dense, ["cell"], "left_semi").select("cell", "x", "y")
    links = _dense_links(dense_points, dense_pairs, grid, close).unionByName(
        touches.filter("core").select(F.col("cell").alias("a"), F.col("q_cell").alias("b"))
    )
    components = connected_components(core_cells.select(F.col("cell").alias("node")), links)
    of_cell = components.join(core_cells.withColumnRenamed("cell", "node"), "node")
    numbers = dense_codes(
        of_cell.groupBy("component").agg(F.min("first_key").alias("first_key")),
        ["first_key", "component"],
        "cluster",
    )
    numbered = settle(
        of_cell.join(numbers.select("component", "cluster"), "component").select(
            F.col("node").alias("cell"), "is_dense", "cluster"
        ),
        "numbered",
    )

    # A sparse point follows its own cell if that has a core point (which is within eps),
    # and otherwise the lowest-numbered core cell it touches.  A core point's neighbours
    # are all in its own cluster.
    touched = (
        touches.join(numbered.select(F.col("cell").alias("q_cell"), "cluster"), "q_cell")
        .groupBy("lat", "lng")
        .agg(F.min("cluster").alias("_touched"))
    )
    of_point = settle(
        sparse.select("lat", "lng", "cell", "core")
        .join(numbered.select("cell", F.col("cluster").alias("_own")), "cell", "left")
        .join(touched, ["lat", "lng"], "left")
        .select(
            F.col("lat").alias("_lat"), F.col("lng").alias("_lng"),
            F.coalesce(F.least("_own", "_touched"), F.lit(NOISE)).alias("_of_point"),
        ),
        "of_point",
    )
    of_dense = numbered.filter("is_dense").select(
        F.col("cell").alias("_cell"), F.col("cluster").alias("_of_cell")
    )
    out = df.withColumns(
        {"_cell": cell_of, "_lat": F.col(lat).cast("double"), "_lng": F.col(lng).cast("double")}
    )
    out = out.join(of_dense, ["_cell"], "left").join(of_point, ["_lat", "_lng"], "left")
    return out.select(*df.columns, F.when(known, F.coalesce("_of_cell", "_of_point")).alias("cluster"))
