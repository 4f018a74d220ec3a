"""The registered queries as DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

from itertools import combinations

from predio.schema import HOUSE_FEATURES, OUTLIER_COLUMNS

_LISTINGS = """
listings AS (
  SELECT concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar)) AS sku,
    l_suppkey % 9 AS snapshot_id, l_partkey AS ord1, l_suppkey AS ord2, l_extendedprice AS ord3,
    CASE l_returnflag WHEN 'A' THEN 'Casa' WHEN 'R' THEN 'Departamento' ELSE 'Oficina' END AS tipo_inmueble,
    CASE l_linestatus WHEN 'F' THEN 'Venta' ELSE 'Renta' END AS tipo_oferta,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN n_nationkey = 0 THEN 'Nuevo Vallarta' ELSE n_name END AS colonia,
    CASE l_linestatus WHEN 'F' THEN l_extendedprice * 200 ELSE l_extendedprice * 2 END AS price,
    CASE WHEN l_partkey % 61 = 0 THEN 0.0::double WHEN l_returnflag = 'R' OR l_partkey % 89 = 0 THEN NULL
      ELSE cast(p_size * 10 AS double) END AS m2_terreno,
    CASE WHEN l_partkey % 79 = 0 THEN 0.0::double WHEN l_partkey % 83 = 0 THEN NULL
      ELSE l_quantity * 8 END AS m2_const,
    cast(l_linenumber + l_partkey % 4 - 1 AS double) AS habitaciones,
    cast(l_linenumber + l_suppkey % 5 - 1 AS double) AS banos,
    cast(l_partkey % 4 AS double) AS autos,
    cast(l_linenumber + 2 AS double) AS total_habitaciones,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE cast(p_size AS double) END AS antiguedad,
    CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE p_brand END AS link_img,
    concat('u/', cast(l_orderkey AS varchar)) AS link, 'MXN' AS divisa, s_name AS agent,
    cast(l_shipdate AS varchar) AS fecha_pub, concat('"text":', p_name) AS descripcion,
    p_type AS sub_category, n_name AS ciudad, r_name AS estado,
    string_split(p_name, ' ') AS amenidades,
    20.0::double + s_acctbal / 10000 AS lat, -103.0::double - cast(s_nationkey AS double) / 25 AS lng
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
dedup AS (
  SELECT * EXCLUDE (rn, snapshot_id, ord1, ord2, ord3) FROM (
    SELECT *, row_number() OVER (PARTITION BY sku ORDER BY snapshot_id, ord1, ord2, ord3) AS rn FROM listings
  ) WHERE rn = 1
)"""

# Rows a rule keeps; NULL conditions keep rows under NOT and drop them otherwise.
_RULES = {
    "F1": "colonia IS NOT NULL AND m2_const IS NOT NULL AND habitaciones IS NOT NULL AND banos IS NOT NULL"
    " AND autos IS NOT NULL AND price IS NOT NULL AND link_img IS NOT NULL AND agent IS NOT NULL",
    "F2": "NOT coalesce(tipo_inmueble = 'Casa' AND m2_terreno IS NULL, false)",
    "F3": "coalesce(m2_const > 20 AND m2_const < 5000, false)",
    "F4": "coalesce(price > 100, false)",
    "F5": "NOT coalesce(tipo_oferta = 'Venta' AND price < 100000, false)",
    "F6": "coalesce(price < 100000000, false)",
    "F7": "NOT coalesce(tipo_inmueble = 'Casa' AND m2_terreno <= 50, false)",
    "F8": "NOT coalesce(tipo_inmueble = 'Casa' AND m2_terreno >= 5000, false)",
    "F9": "NOT coalesce(habitaciones = 0 OR banos = 0, false)",
    "F10": "coalesce(banos < 10, false)",
    "F11": "NOT coalesce(tipo_inmueble = 'Departamento' AND habitaciones > 7, false)",
    "F12": "coalesce(habitaciones < 10, false)",
    "F13": "coalesce(autos < 30, false)",
    "F14": "NOT coalesce(autos = 0 AND NOT contains(colonia, 'Vallarta'), false)",
    "F15": "NOT coalesce(tipo_oferta = 'Renta' AND price > 150000, false)",
    "F16": "NOT coalesce(price / nullif(m2_const, 0) > 100000, false)",
    "F17": "NOT coalesce(tipo_inmueble = 'Casa' AND price / nullif(m2_terreno, 0) > 90000, false)",
}

_BAND = """CASE
  WHEN tipo_oferta = 'Venta' AND price < 1000001 THEN 'Interés Social'
  WHEN tipo_oferta = 'Venta' AND price BETWEEN 1000001 AND 3000000 THEN 'Interés Medio'
  WHEN tipo_oferta = 'Venta' AND price BETWEEN 3000001 AND 7000000 THEN 'Residencial'
  WHEN tipo_oferta = 'Venta' AND price BETWEEN 7000001 AND 15000000 THEN 'Residencial Plus'
  WHEN tipo_oferta = 'Venta' AND price > 15000000 THEN 'Premium'
  WHEN tipo_oferta = 'Renta' AND price < 5001 THEN 'Interés Social'
  WHEN tipo_oferta = 'Renta' AND price BETWEEN 5001 AND 10000 THEN 'Interés Medio'
  WHEN tipo_oferta = 'Renta' AND price BETWEEN 10001 AND 15000 THEN 'Residencial'
  WHEN tipo_oferta = 'Renta' AND price BETWEEN 15001 AND 30000 THEN 'Residencial Plus'
  WHEN tipo_oferta = 'Renta' AND price > 30000 THEN 'Premium' END"""

_CLEAN = (
    _LISTINGS
    + f""",
clean AS (
  SELECT sku, tipo_inmueble, tipo_oferta, sub_category, colonia, ciudad, estado, price, m2_terreno, m2_const,
    cast(habitaciones AS smallint) AS habitaciones, cast(banos AS smallint) AS banos,
    cast(autos AS smallint) AS autos, antiguedad, cast(fecha_pub AS timestamp) AS fecha_pub,
    regexp_replace(descripcion, '"text":', '', 'g') AS descripcion, amenidades, lat, lng,
    price / nullif(m2_terreno, 0) AS m2_price, price / nullif(m2_const, 0) AS m2_const_price,
    price / nullif(m2_terreno + m2_const, 0) AS m2_abs_price, {_BAND} AS sector_inmo
  FROM dedup WHERE {" AND ".join(f"({c})" for c in _RULES.values())}
)"""
)
_ZONE = (
    _CLEAN
    + """,
codes AS (
  SELECT colonia, cast(row_number() OVER (ORDER BY colonia) - 1 AS int) AS endocer_colonia
  FROM (SELECT DISTINCT colonia FROM clean)
),
zone AS (
  SELECT clean.*, endocer_colonia FROM clean JOIN codes USING (colonia)
  WHERE tipo_inmueble = 'Casa' AND tipo_oferta = 'Venta'
)"""
)
# Hash split of the zone, about 30 % test rows.
_SPLIT = _ZONE + ", parts AS (SELECT *, ('0x' || substr(md5(sku), 1, 8))::bigint < ceil(0.3 * 4294967296) AS is_test FROM zone)"
_FOLD = "cast(floor(('0x' || substr(md5(sku), 1, 8))::bigint * {k} / 4294967296.0::double) AS int)"
# One-feature least squares on the train rows, and its test predictions.
_OLS = (
    _SPLIT
    + """,
fit AS (
  SELECT regr_slope(price, m2_const) AS b, regr_intercept(price, m2_const) AS a,
    covar_pop(price, m2_const) / (var_pop(m2_const) + 99.0 / count(*)) AS rb,
    avg(price) - covar_pop(price, m2_const) / (var_pop(m2_const) + 99.0 / count(*)) * avg(m2_const) AS ra
  FROM parts WHERE NOT is_test
),
scored AS (SELECT parts.*, a + b * m2_const AS p_ols, ra + rb * m2_const AS p_ridge FROM parts, fit)"""
)
# Exact split, one-feature least squares and quality per large colonia.
_QUALITY = (
    _ZONE
    + """,
big AS (SELECT colonia FROM zone GROUP BY colonia HAVING count(*) > 50),
ranked AS (
  SELECT zone.*, row_number() OVER (PARTITION BY colonia ORDER BY md5(sku))
    <= ceil(count(*) OVER (PARTITION BY colonia) * 0.3::double) AS is_test
  FROM zone WHERE colonia IN (SELECT colonia FROM big)
),
models AS (
  SELECT colonia, regr_slope(price, m2_const) AS b, regr_intercept(price, m2_const) AS a
  FROM ranked WHERE NOT is_test GROUP BY colonia
),
seg AS (
  SELECT sku, colonia, price, a + b * m2_const AS p FROM ranked JOIN models USING (colonia) WHERE is_test
),
quality AS (
  SELECT colonia, 1 - sum((price - p) * (price - p)) / (var_pop(price) * count(*)) AS score,
    avg(abs((p - price) / price) * 100) AS error
  FROM seg GROUP BY colonia
)"""
)


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


def _union(selects) -> str:
    return "\nUNION ALL\n".join(selects)


_LISTING_COLUMNS = """sku, tipo_inmueble, tipo_oferta, sub_category, colonia, ciudad, estado,
  round(price, 2) AS price, m2_terreno, m2_const, habitaciones, banos, autos, total_habitaciones, antiguedad,
  link, link_img, agent, divisa, fecha_pub, descripcion, array_to_string(amenidades, '|') AS amenidades,
  round(lat, 6) AS lat, round(lng, 6) AS lng"""

_CLEAN_TYPES = {
    "sku": ("string", "other"), "tipo_inmueble": ("string", "category"), "tipo_oferta": ("string", "category"),
    "sub_category": ("string", "category"), "colonia": ("string", "category"), "ciudad": ("string", "category"),
    "estado": ("string", "category"), "price": ("double", "numeric"), "m2_terreno": ("double", "numeric"),
    "m2_const": ("double", "numeric"), "habitaciones": ("smallint", "numeric"), "banos": ("smallint", "numeric"),
    "autos": ("smallint", "numeric"), "antiguedad": ("double", "numeric"), "fecha_pub": ("timestamp_ntz", "other"),
    "descripcion": ("string", "other"), "amenidades": ("array<string>", "other"), "lat": ("double", "numeric"),
    "lng": ("double", "numeric"), "m2_price": ("double", "numeric"), "m2_const_price": ("double", "numeric"),
    "m2_abs_price": ("double", "numeric"), "sector_inmo": ("string", "other"),
}
_LISTING_NAMES = [
    "sku", "tipo_inmueble", "tipo_oferta", "sub_category", "colonia", "ciudad", "estado", "price", "m2_terreno",
    "m2_const", "habitaciones", "banos", "autos", "total_habitaciones", "antiguedad", "link", "link_img", "agent",
    "divisa", "fecha_pub", "descripcion", "amenidades", "lat", "lng",
]
AMENITIES = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring",
    "rod", "small", "widget",
]
TRIM_GLOBAL_COLUMNS = ["price", "m2_const_price", "m2_abs_price", "banos"]


def _missing(share: bool) -> str:
    value = "round_even({n} / count(*), 2)" if share else "{n}"
    rows = [
        f"SELECT '{c}' AS \"column\", "
        + value.format(n=f"count(*) FILTER ({c} IS NULL)")
        + " AS missing FROM dedup"
        for c in _LISTING_NAMES
    ]
    return _with(_LISTINGS, f"SELECT * FROM ({_union(rows)}) WHERE missing > 0 ORDER BY missing DESC, \"column\"")


def _skew(select_from: str) -> str:
    cols = ", ".join(f"round(skewness({c}), 6) AS {c}" for c in OUTLIER_COLUMNS)
    return f"SELECT colonia, {cols} FROM {select_from} GROUP BY colonia"


def _trim_by_colonia() -> str:
    stats = ", ".join(
        f"skewness({c}) AS s_{c}, " + ", ".join(
            f"quantile_cont({c}, {q}) AS q{int(q * 100):02d}_{c}" for q in (0.01, 0.05, 0.95, 0.99)
        )
        for c in OUTLIER_COLUMNS
    )
    rules = " OR ".join(
        f"coalesce(s_{c} > 1 AND ({c} <= q01_{c} OR {c} >= q95_{c}), false)"
        f" OR coalesce(s_{c} < -1 AND ({c} <= q05_{c} OR {c} >= q99_{c}), false)"
        for c in OUTLIER_COLUMNS
    )
    return _with(
        _CLEAN + f", stats AS (SELECT colonia, {stats} FROM clean GROUP BY colonia)",
        f"""SELECT colonia, tipo_inmueble, tipo_oferta, round(price, 2) AS price, m2_terreno, m2_const,
        habitaciones, banos, autos, round(lat, 6) AS lat, descripcion
        FROM clean JOIN stats USING (colonia) WHERE NOT ({rules})""",
    )


def _trim_global() -> str:
    ctes, last = _CLEAN, "clean"
    skews = ", ".join(f"skewness({c}) AS s_{c}" for c in TRIM_GLOBAL_COLUMNS)
    ctes += f", skews AS (SELECT {skews} FROM clean)"
    for i, c in enumerate(TRIM_GLOBAL_COLUMNS):
        ctes += (
            f", b{i} AS (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.95) AS hi FROM {last})"
            f", t{i} AS (SELECT x.* FROM {last} x, b{i}, skews"
            f" WHERE coalesce(s_{c} > 1, false) = false OR ({c} > lo AND {c} < hi))"
        )
        last = f"t{i}"
    return _with(
        ctes, f"SELECT sku, round(price, 2) AS price, m2_const, m2_const_price FROM {last}"
    )


def _describe() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}), 0) AS mean,
        round_even(stddev_samp({c}), 0) AS std, round_even(cast(min({c}) AS double), 0) AS min,
        round_even(quantile_cont(cast({c} AS double), 0.25), 0) AS p25,
        round_even(quantile_cont(cast({c} AS double), 0.5), 0) AS p50,
        round_even(quantile_cont(cast({c} AS double), 0.75), 0) AS p75,
        round_even(cast(max({c}) AS double), 0) AS max FROM zone"""
        for c in OUTLIER_COLUMNS
    ]
    return _with(_ZONE, _union(rows))


def _corr() -> str:
    rows = [f"SELECT '{c}' AS a, '{c}' AS b, 1.0::double AS r" for c in OUTLIER_COLUMNS]
    for a, b in combinations(OUTLIER_COLUMNS, 2):
        rows += [f"SELECT '{x}' AS a, '{y}' AS b, round(corr({a}, {b}), 6) AS r FROM clean" for x, y in ((a, b), (b, a))]
    return _with(_CLEAN, _union(rows))


def _profile() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, '{r}' AS role,
        count(*) FILTER ({c} IS NULL) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM clean"""
        for c, (t, r) in _CLEAN_TYPES.items()
    ]
    return _with(_CLEAN, _union(rows))


def _cv(folds: int, alphas: str, table: str) -> str:
    """CTEs giving ``cv(alpha, cv_score)`` of one-feature ridge on ``table`` by hash folds."""
    fold = _FOLD.format(k=folds)
    return f"""
folded AS (SELECT *, {fold} AS fold FROM {table}),
folds AS (SELECT DISTINCT fold AS k FROM folded),
rest AS (
  SELECT k, count(*) AS n, avg(m2_const) AS mx, avg(price) AS my, var_pop(m2_const) AS vx,
    covar_pop(price, m2_const) AS cxy
  FROM folds, folded WHERE fold <> k GROUP BY k
),
fitted AS (
  SELECT k, alpha, cxy / (vx + alpha / n) AS b, my - cxy / (vx + alpha / n) * mx AS a
  FROM rest, (SELECT cast(range AS double) AS alpha FROM range({alphas}))
),
held AS (
  SELECT k, alpha, 1 - sum((price - a - b * m2_const) * (price - a - b * m2_const))
    / (var_pop(price) * count(*)) AS r2
  FROM fitted JOIN folded ON fold = k GROUP BY k, alpha
),
cv AS (SELECT alpha, avg(r2) AS cv_score FROM held GROUP BY alpha)"""


def _three_features() -> str:
    """Least squares on m2_const, banos, autos by Cramer's rule, for CV folds (k) and all (k = -1)."""
    x = ["m2_const", "banos", "autos"]
    cov = ", ".join(
        [f"covar_pop({x[i]}, {x[j]}) AS c{i}{j}" for i in range(3) for j in range(3)]
        + [f"covar_pop({x[i]}, price) AS c{i}y, avg({x[i]}) AS m{i}" for i in range(3)]
    )

    def det(columns):
        a, b, c = columns
        return (
            f"({a}[1] * ({b}[2] * {c}[3] - {b}[3] * {c}[2]) - {b}[1] * ({a}[2] * {c}[3] - {a}[3] * {c}[2])"
            f" + {c}[1] * ({a}[2] * {b}[3] - {a}[3] * {b}[2]))"
        )

    cols = ", ".join(f"[c0{j}, c1{j}, c2{j}] AS v{j}" for j in range(3)) + ", [c0y, c1y, c2y] AS vy"
    betas = ", ".join(
        f"{det([('vy' if i == j else f'v{i}') for i in range(3)])} / {det(['v0', 'v1', 'v2'])} AS b{j}" for j in range(3)
    )
    fold = _FOLD.format(k=10)
    return f"""
split AS (SELECT *, ('0x' || substr(md5(sku), 1, 8))::bigint < ceil(0.2 * 4294967296) AS is_test, {fold} AS fold FROM zone),
ks AS (SELECT DISTINCT fold AS k FROM split UNION ALL SELECT -1),
mom AS (
  SELECT k, avg(price) AS my, {cov} FROM ks, split WHERE NOT is_test AND fold <> k GROUP BY k
),
vec AS (SELECT *, {cols} FROM mom),
coef AS (SELECT k, my, m0, m1, m2, {betas} FROM vec),
pred AS (
  SELECT k, fold, is_test, price,
    my + b0 * (m2_const - m0) + b1 * (banos - m1) + b2 * (autos - m2) AS p
  FROM coef, split
),
cv AS (
  SELECT avg(r2) AS cv_score FROM (
    SELECT 1 - sum((price - p) * (price - p)) / (var_pop(price) * count(*)) AS r2
    FROM pred WHERE k = fold AND NOT is_test GROUP BY k
  )
)"""


_R2 = "1 - sum((price - {p}) * (price - {p})) / (var_pop(price) * count(*))"


def _score_row(position: int, name: str, p: str) -> str:
    def agg(where):
        return (
            f"(SELECT round({_R2.format(p=p)}, 6) FROM scored WHERE {where})",
            f"(SELECT round(avg(({p} - price) / price * 100), 4) FROM scored WHERE {where})",
        )

    train, test = agg("NOT is_test"), agg("is_test")
    return (
        f"SELECT {position} AS position, '{name}' AS model, {train[0]} AS train_score, {train[1]} AS train_error,"
        f" {test[0]} AS test_score, {test[1]} AS test_error,"
        f" (SELECT {_R2.format(p=p)} FROM scored WHERE is_test) AS exact"
    )


def _error_row(name: str, p: str) -> str:
    e = f"abs(({p} - price) / price) * 100"
    return (
        f"SELECT '{name}' AS model, round(avg({e}), 4) AS mean_error, round(stddev_pop({e}), 4) AS std_error,"
        f" round(avg(CASE WHEN {e} <= 7 THEN 1.0 ELSE 0.0 END), 6) AS share_small FROM scored WHERE is_test"
    )


def _dbscan() -> str:
    close = "pow(sin(1.5 / 6371.0088 / 2), 2)"
    return _with(
        _CLEAN
        + f""",
pts AS (
  SELECT lat, lng, radians(lat) AS x, radians(lng) AS y, count(*) AS w, min(sku) AS first_key
  FROM clean GROUP BY lat, lng
),
near AS (
  SELECT p.lat AS lat, p.lng AS lng, q.lat AS qlat, q.lng AS qlng, q.w AS w FROM pts p, pts q
  WHERE pow(sin((p.x - q.x) / 2), 2) + cos(p.x) * cos(q.x) * pow(sin((p.y - q.y) / 2), 2) <= {close}
),
core AS (
  SELECT pts.lat, pts.lng, first_key FROM pts JOIN near ON pts.lat = near.lat AND pts.lng = near.lng
  GROUP BY pts.lat, pts.lng, first_key HAVING sum(near.w) >= 5
),
walk AS (
  SELECT lat, lng, first_key AS root FROM core
  UNION
  SELECT core.lat, core.lng, walk.root FROM walk
  JOIN near ON walk.lat = near.lat AND walk.lng = near.lng
  JOIN core ON core.lat = near.qlat AND core.lng = near.qlng
),
labels AS (SELECT lat, lng, min(root) AS root FROM walk GROUP BY lat, lng),
numbers AS (
  SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM labels)
),
core_labels AS (SELECT lat, lng, cluster FROM labels JOIN numbers USING (root)),
point_labels AS (
  SELECT near.lat, near.lng, min(cluster) AS cluster
  FROM near JOIN core_labels c ON c.lat = near.qlat AND c.lng = near.qlng GROUP BY near.lat, near.lng
)""",
        """SELECT sku, cast(coalesce(cluster, -1) AS int) AS cluster
        FROM clean LEFT JOIN point_labels ON clean.lat = point_labels.lat AND clean.lng = point_labels.lng""",
        recursive=True,
    )


def sql() -> dict[str, str]:
    fold5 = _FOLD.format(k=5)
    removed = " ".join(f"WHEN NOT ({c}) THEN '{r}'" for r, c in _RULES.items())
    quality = "SELECT colonia, round(score, 6) AS score, round(error, 4) AS error," \
        " round(100 - error, 4) AS diff_score, score >= 0.7 AS \"Good\" FROM quality"
    features = ", ".join(HOUSE_FEATURES)
    return {
        "dedup_listings": _with(_LISTINGS, f"SELECT {_LISTING_COLUMNS} FROM dedup"),
        "load_snapshots": _with(_LISTINGS, f"SELECT {_LISTING_COLUMNS} FROM dedup"),
        "add_snapshots": _with(_LISTINGS, f"SELECT {_LISTING_COLUMNS} FROM dedup"),
        "append_snapshots": _with(
            _LISTINGS,
            "SELECT snapshot_id, count(*) AS n, round(sum(price), 2) AS total_price FROM listings GROUP BY snapshot_id",
        ),
        "distinct_types": _with(_LISTINGS, "SELECT DISTINCT tipo_inmueble FROM dedup"),
        "clean_listings": _with(
            _CLEAN,
            """SELECT sku, tipo_inmueble, tipo_oferta, sub_category, colonia, ciudad, estado, round(price, 2) AS price,
            m2_terreno, m2_const, habitaciones, banos, autos, antiguedad,
            strftime(fecha_pub, '%Y-%m-%d %H:%M:%S') AS fecha_pub, descripcion,
            array_to_string(amenidades, '|') AS amenidades, round(lat, 6) AS lat, round(lng, 6) AS lng,
            m2_price, m2_const_price, m2_abs_price, sector_inmo FROM clean""",
        ),
        "rows_removed_per_rule": _with(
            _LISTINGS,
            f"""SELECT rule, count(first_rule) AS removed FROM
            (SELECT unnest({list(_RULES)}) AS rule) LEFT JOIN
            (SELECT CASE {removed} END AS first_rule FROM dedup) ON rule = first_rule GROUP BY rule""",
        ),
        "sector_counts": _with(
            _CLEAN, "SELECT tipo_oferta, sector_inmo, count(*) AS n FROM clean GROUP BY tipo_oferta, sector_inmo"
        ),
        "missing_report_share": _missing(True),
        "missing_report_count": _missing(False),
        "drop_missing_mask_inf": _with(
            _LISTINGS,
            """SELECT sku, CASE WHEN m2_terreno = 0 THEN NULL ELSE price / m2_terreno END AS ratio,
            round(price, 2) AS price, habitaciones, colonia FROM dedup WHERE habitaciones IS NOT NULL
            AND banos IS NOT NULL AND autos IS NOT NULL AND colonia IS NOT NULL""",
        ),
        "filter_casa_venta": _with(
            _ZONE, "SELECT sku, colonia, round(price, 2) AS price, m2_terreno, m2_const, sector_inmo FROM zone"
        ),
        "segment_subset": _with(
            _CLEAN,
            """SELECT sku, colonia, round(price, 2) AS price FROM clean
            WHERE colonia IN ('Nuevo Vallarta', 'NATION_7', 'NATION_12')""",
        ),
        "min_land_rows": _with(
            _ZONE,
            """SELECT sku, colonia, m2_terreno, round(price, 2) AS price FROM zone
            WHERE m2_terreno = (SELECT min(m2_terreno) FROM zone)""",
        ),
        "m2_prices": _with(
            _LISTINGS,
            """SELECT sku, price / m2_terreno AS m2_price, price / m2_const AS m2_const_price,
            price / (m2_terreno + m2_const) AS m2_abs_price FROM dedup
            WHERE tipo_inmueble = 'Casa' AND coalesce(m2_terreno <> 0, true) AND coalesce(m2_const <> 0, true)""",
        ),
        "change_types": _with(
            _LISTINGS,
            """SELECT sku, cast(habitaciones AS tinyint) AS habitaciones, cast(banos AS tinyint) AS banos,
            cast(autos AS tinyint) AS autos, cast(m2_terreno AS float) AS m2_terreno,
            cast(m2_const AS float) AS m2_const FROM dedup""",
        ),
        "column_profile": _profile(),
        "skew_by_colonia": _with(_CLEAN, _skew("clean")),
        "skewed_colonias": _with(
            _CLEAN,
            f"""SELECT colonia FROM clean GROUP BY colonia
            HAVING {" OR ".join(f"coalesce(abs(skewness({c})) > 1, false)" for c in OUTLIER_COLUMNS)}""",
        ),
        "skew_global": _with(
            _CLEAN,
            _union(f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skew FROM clean" for c in OUTLIER_COLUMNS),
        ),
        "quantiles_by_colonia": _with(
            _CLEAN,
            "SELECT colonia, "
            + ", ".join(
                f"round(quantile_cont({c}, {q}), 4) AS {c}_q{int(q * 100):02d}"
                for c in ("price", "m2_const")
                for q in (0.01, 0.05, 0.95, 0.99)
            )
            + " FROM clean GROUP BY colonia",
        ),
        "trim_by_colonia": _trim_by_colonia(),
        "trim_global": _trim_global(),
        "big_segments": _with(
            _ZONE, "SELECT colonia, count(*) AS n FROM zone GROUP BY colonia HAVING count(*) > 50"
        ),
        "small_segments": _with(
            _ZONE, "SELECT colonia, count(*) AS n FROM zone GROUP BY colonia HAVING count(*) <= 50"
        ),
        "segment_count": _with(
            _ZONE,
            "SELECT count(*) AS segments FROM (SELECT colonia FROM zone GROUP BY colonia HAVING count(*) > 50)",
        ),
        "forest_scoring_bounds": _with(
            _ZONE,
            """SELECT colonia, count(*) AS n, count(*) AS n_scored, 0::bigint AS n_outside FROM zone
            GROUP BY colonia HAVING count(*) > 50""",
        ),
        "forest_importance_totals": _with(
            _ZONE, "SELECT colonia, 5 AS n, 1.0::double AS total FROM zone GROUP BY colonia HAVING count(*) > 50"
        ),
        "kmeans_geo_check": _with(
            _CLEAN,
            """SELECT count(*) AS n, least(100, count(DISTINCT (lat, lng)))::int AS centres, 0::bigint AS not_nearest,
            0.0::double AS inertia_off, 0::bigint AS better_restarts FROM clean""",
        ),
        "kmeans_one_centre": _with(
            _CLEAN,
            """SELECT count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng,
            round((var_pop(lat) + var_pop(lng)) * count(*), 2) AS inertia FROM clean""",
        ),
        "ordered_folds": "WITH " + _LISTINGS.replace("* EXCLUDE (rn, snapshot_id, ord1, ord2, ord3)", "*") + """
            SELECT sku, (ntile(3) OVER (ORDER BY snapshot_id, ord1, ord2, ord3, sku) - 1)::int AS fold FROM dedup""",
        "describe_zone": _describe(),
        "corr_matrix": _corr(),
        "encode_colonia": _with(_CLEAN, "SELECT sku, colonia, cast(dense_rank() OVER (ORDER BY colonia) - 1 AS int)"
                                " AS endocer_colonia FROM clean"),
        "code_lookup": _with(_ZONE, "SELECT colonia, endocer_colonia FROM codes WHERE colonia = 'NATION_7'"),
        "encoder_roundtrip": _with(_ZONE, "SELECT colonia, endocer_colonia FROM codes"),
        "dummies": _with(
            _CLEAN,
            """SELECT sku, cast(tipo_oferta = 'Venta' AS int) AS venta, cast(tipo_inmueble = 'Casa' AS int) AS casa,
            cast(tipo_inmueble = 'Oficina' AS int) AS "dummie_Oficina" FROM clean""",
        ),
        "amenities_onehot": _with(
            _CLEAN,
            "SELECT sku, " + ", ".join(f"list_contains(amenidades, '{a}') AS {a}" for a in AMENITIES) + " FROM clean",
        ),
        "model_data": _with(_ZONE, f"SELECT sku, {features}, round(price, 2) AS label FROM zone"),
        "feature_vector": _with(
            _ZONE,
            "SELECT sku, "
            + ", ".join(f"cast({c} AS double) AS f{i}" for i, c in enumerate(HOUSE_FEATURES))
            + ", round(price, 2) AS label FROM zone",
        ),
        "split_counts": _with(
            _CLEAN,
            """SELECT colonia, ('0x' || substr(md5(sku), 1, 8))::bigint < ceil(0.3 * 4294967296) AS is_test, count(*) AS n,
            round(sum(price), 2) AS total_price FROM clean GROUP BY ALL""",
        ),
        "split_null_keys": _with(
            _ZONE + """, keyed AS (SELECT CASE WHEN substr(md5(sku), 32, 1) <> '0' THEN sku END AS key FROM zone),
            hashed AS (SELECT key, ('0x' || substr(md5(coalesce(key, '')), 1, 8))::bigint AS h FROM keyed)""",
            """SELECT key IS NULL AS no_key, h < ceil(0.3 * 4294967296) AS is_test,
            cast(floor(h * 5 / 4294967296.0::double) AS int) AS fold, count(*) AS n FROM hashed GROUP BY ALL""",
        ),
        "split_edges": _with(
            _ZONE + ", hashed AS (SELECT ('0x' || substr(md5(sku), 1, 8))::bigint AS h FROM zone)",
            """SELECT share, count(*) AS n FROM hashed, (SELECT unnest([0.0, 0.5, 0.99999, 1.0])::double AS share)
            WHERE h < ceil(share * 4294967296) GROUP BY share""",
        ),
        "exact_split": _with(
            _CLEAN,
            """SELECT sku, row_number() OVER (PARTITION BY colonia ORDER BY md5(sku))
            <= ceil(count(*) OVER (PARTITION BY colonia) * 0.3::double) AS is_test FROM clean""",
        ),
        "fold_counts": _with(
            _CLEAN, f"SELECT {fold5} AS fold, count(*) AS n, round(sum(price), 2) AS total_price FROM clean GROUP BY ALL"
        ),
        "exact_folds": _with(
            _CLEAN, "SELECT sku, cast(ntile(5) OVER (ORDER BY md5(sku)) - 1 AS int) AS fold FROM clean"
        ),
        "scale_standard": _with(
            _ZONE,
            "SELECT sku, "
            + ", ".join(
                f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
                for c in ("m2_const", "m2_terreno", "autos")
            )
            + " FROM zone",
        ),
        "scale_minmax": _with(
            _ZONE,
            "SELECT sku, "
            + ", ".join(
                f"round(({c} - min({c}) OVER ()) / cast(max({c}) OVER () - min({c}) OVER () AS double), 6) AS {c}"
                for c in ("m2_const", "m2_terreno", "autos")
            )
            + " FROM zone",
        ),
        "ols_by_segment": _with(
            _ZONE,
            """SELECT colonia, count(*) AS n, CASE WHEN count(*) > 2 THEN round(regr_slope(price, m2_const), 4) END AS slope,
            CASE WHEN count(*) > 2 THEN round(regr_intercept(price, m2_const), 2) END AS intercept
            FROM zone GROUP BY colonia""",
        ),
        "ols_report": _with(
            _OLS + ", train AS (SELECT * FROM parts WHERE NOT is_test)," + _cv(5, "0, 1", "train"),
            f"""SELECT round(cv_score, 6) AS cv_score, round(train_score, 6) AS train_score,
            round(test_score, 6) AS test_score, round((cv_score + train_score + test_score) / 3, 6) AS mean_score
            FROM cv, (SELECT {_R2.format(p='p_ols')} AS train_score FROM scored WHERE NOT is_test),
            (SELECT {_R2.format(p='p_ols')} AS test_score FROM scored WHERE is_test)""",
        ),
        "ridge_fixed_alpha": _with(_OLS, "SELECT round(rb, 4) AS slope, round(ra, 2) AS intercept FROM fit"),
        "ridge_search": _with(
            _SPLIT + ", train AS (SELECT * FROM parts WHERE NOT is_test)," + _cv(5, "0, 100", "train"),
            """SELECT alpha, round(cv_score, 6) AS cv_score,
            alpha = (SELECT alpha FROM cv ORDER BY cv_score DESC, alpha LIMIT 1) AS best FROM cv""",
        ),
        "baseline_report": _with(
            _ZONE + "," + _three_features(),
            f"""SELECT round(cv_score, 6) AS cv_score, t.rmse AS train_rmse, t.score AS train_score,
            s.rmse AS test_rmse, s.score AS test_score, s.mean AS error_mean, s.std AS error_std FROM cv,
            (SELECT round(sqrt(avg((price - p) * (price - p))), 2) AS rmse, round({_R2.format(p='p')}, 6) AS score
             FROM pred WHERE k = -1 AND NOT is_test) t,
            (SELECT round(sqrt(avg((price - p) * (price - p))), 2) AS rmse, round({_R2.format(p='p')}, 6) AS score,
             round(avg(price - p), 2) AS mean, round(stddev_pop(price - p), 2) AS std
             FROM pred WHERE k = -1 AND is_test) s""",
        ),
        "segment_quality": _with(_QUALITY, quality),
        "read_result_table": _with(_QUALITY, quality),
        "good_segments": _with(
            _QUALITY, f"SELECT * REPLACE (true AS \"Good\") FROM ({quality}) WHERE score >= 0.02"
        ),
        "good_share": _with(
            _QUALITY, "SELECT round(avg(CASE WHEN score >= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS good_share FROM quality"
        ),
        "first_results": _with(_QUALITY, f"SELECT * FROM ({quality}) ORDER BY colonia LIMIT 5"),
        "segment_error": _with(
            _QUALITY, "SELECT sku, colonia, round(p, 2) AS prediction, round(abs((p - price) / price) * 100, 4)"
            " AS error FROM seg"
        ),
        "error_summary": _with(
            _OLS,
            "SELECT mean_error, std_error, share_small FROM (" + _error_row("Linear", "p_ols") + ")",
        ),
        "error_report": _with(_OLS, _union([_error_row("Linear", "p_ols"), _error_row("Ridge", "p_ridge")])),
        "ensemble_mean": _with(
            _OLS, "SELECT sku, round((p_ols + p_ridge) / 2, 2) AS ensemble FROM scored WHERE is_test"
        ),
        "score_table": _with(
            _OLS + ", board AS (" + _union([_score_row(0, "linear", "p_ols"), _score_row(1, "ridge", "p_ridge")]) + ")",
            "SELECT position, model, train_score, train_error, test_score, test_error,"
            " row_number() OVER (ORDER BY exact DESC NULLS LAST, position) = 1 AS best FROM board",
        ),
        "batch_scoring": _with(_OLS, "SELECT sku, round(price, 2) AS price, round(p_ols, 2) AS prediction FROM scored"),
        "what_if": _with(
            _OLS,
            """SELECT colonia, round(a + b * avg(m2_const), 2) AS prediction FROM zone, fit
            GROUP BY colonia, a, b""",
        ),
        "segment_vs_general": _with(
            _OLS
            + """, own AS (
              SELECT colonia, regr_slope(price, m2_const) AS sb, regr_intercept(price, m2_const) AS sa
              FROM parts WHERE NOT is_test GROUP BY colonia HAVING count(*) > 2
            )""",
            """SELECT sku, colonia, round(sa + sb * m2_const, 2) AS pred_single, round(p_ols, 2) AS pred_general,
            round(abs((sa + sb * m2_const - price) / price) * 100, 4) AS err_single,
            round(abs((p_ols - price) / price) * 100, 4) AS err_general
            FROM scored LEFT JOIN own USING (colonia) WHERE is_test""",
        ),
        "dbscan_geo": _dbscan(),
    }
