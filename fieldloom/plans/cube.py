"""Queries on gridded fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.geometry import affine, affine_projection, scaling, spline, then, translation, warp_weight, weighted_mean
from fieldloom.operators import contour, cube, grid, motion
from fieldloom.operators.spatial import blended, resample
from fieldloom.plans.base import SIDE, CELLS_SQL, LEVELS_SQL, packed, query, table
from fieldloom.sources.grib import expand_row

c = F.col


@query("A-01_grid_bounds", f"WITH {CELLS_SQL} SELECT surface_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1")
def bounds(spark, d):
    return packed(spark, d).select("surface_id", F.array_min("buf").alias("lo"), F.array_max("buf").alias("hi"))


@query("A-02_contour_levels", f"WITH RECURSIVE {LEVELS_SQL} SELECT surface_id, level_no, round(level, 9) AS level FROM levels")
def levels(spark, d):
    return contour.with_levels(packed(spark, d)).select("surface_id", F.posexplode("levels").alias("level_no", "level")).withColumn("level", F.round("level", 9))


@query(
    "F-01_contour_crossings",
    f"""WITH RECURSIVE {LEVELS_SQL},
  e AS (SELECT a.surface_id, 'h' AS edge, a.x, a.y, a.value AS a, b.value AS b FROM cells a JOIN cells b ON a.surface_id = b.surface_id AND a.y = b.y AND b.x = a.x + 1
    UNION ALL SELECT a.surface_id, 'v', a.x, a.y, a.value, b.value FROM cells a JOIN cells b ON a.surface_id = b.surface_id AND a.x = b.x AND b.y = a.y + 1),
  k AS (SELECT e.*, level_no, level, (level - b) / (a - b) AS w FROM e JOIN levels USING (surface_id) WHERE least(a, b) <= level AND level < greatest(a, b))
SELECT surface_id, edge, level_no, count(*) AS n, round(avg(CASE edge WHEN 'h' THEN x + (1 - w) ELSE x END), 6) AS mean_x, round(avg(CASE edge WHEN 'v' THEN y + (1 - w) ELSE y END), 6) AS mean_y
FROM k GROUP BY ALL""",
)
def crossings(spark, d):
    out = contour.crossings(contour.with_levels(packed(spark, d)), ["surface_id"])
    return out.groupBy("surface_id", "edge", "level_no").agg(F.count("*").alias("n"), F.round(F.avg("px"), 6).alias("mean_x"), F.round(F.avg("py"), 6).alias("mean_y"))


@query("G-02_contour_lines")
def lines(spark, d):
    return contour.contour_lines(contour.with_levels(packed(spark, d)), ["surface_id"])


def _doublings(rounds: int) -> str:
    """Pointer doubling, unrolled: each step joins the one before with itself."""
    step = "j{1} AS MATERIALIZED (SELECT a.surface_id, a.level_no, a.id, b.jump, least(a.seed, b.seed) AS seed FROM j{0} a JOIN j{0} b ON a.surface_id = b.surface_id AND a.level_no = b.level_no AND a.jump = b.id)"
    return ", ".join(step.format(k, k + 1) for k in range(rounds))


def _part(p: str, q: str, r: str, pq: str, qr: str, rp: str) -> str:
    """The link through one of a cell's triangles: in where the ground falls around it, out where it rises."""
    return f"SELECT surface_id, level_no, CASE WHEN {p} AND NOT {q} THEN {pq} WHEN {q} AND NOT {r} THEN {qr} ELSE {rp} END AS id, CASE WHEN {q} AND NOT {p} THEN {pq} WHEN {r} AND NOT {q} THEN {qr} ELSE {rp} END AS next FROM s WHERE {p} <> {q} OR {q} <> {r}"


_ROUNDS = 14  # 2^14 is more than the edges of a surface of 64 x 64
_AT = lambda kind, i, j: f"((y + {j}) * {SIDE} + x + {i}) * 4 + {kind}"


@query(
    "G-02_traced_lines",
    f"""WITH RECURSIVE {LEVELS_SQL},
  f AS MATERIALIZED (SELECT * FROM cells), n AS (SELECT surface_id, max(y) + 1 AS ny FROM f GROUP BY 1),
  q AS (SELECT a.surface_id, a.x, a.y, a.value AS a, b.value AS b, c.value AS c, d.value AS d FROM f a JOIN f b ON b.surface_id = a.surface_id AND b.x = a.x + 1 AND b.y = a.y
    JOIN f c ON c.surface_id = a.surface_id AND c.x = a.x + 1 AND c.y = a.y + 1 JOIN f d ON d.surface_id = a.surface_id AND d.x = a.x AND d.y = a.y + 1),
  s AS MATERIALIZED (SELECT q.surface_id, level_no, x, y, a > level AS a, b > level AS b, c > level AS c, d > level AS d FROM q JOIN levels USING (surface_id)),
  k AS MATERIALIZED ({_part("a", "b", "c", _AT(0, 0, 0), _AT(1, 1, 0), _AT(2, 0, 0))} UNION ALL {_part("a", "c", "d", _AT(2, 0, 0), _AT(0, 0, 1), _AT(1, 0, 0))}),
  e AS (SELECT surface_id, level_no, id, next FROM k UNION ALL SELECT surface_id, level_no, next, next FROM k ANTI JOIN (SELECT surface_id, level_no, id AS next FROM k) o USING (surface_id, level_no, next)),
  j0 AS MATERIALIZED (SELECT surface_id, level_no, id, next AS jump, CASE WHEN id % 4 = 0 AND id // 4 // {SIDE} < ny - 1 THEN id END AS seed FROM e JOIN n USING (surface_id)),
  {_doublings(_ROUNDS)},
  tails AS (SELECT surface_id, level_no, id AS jump FROM j0 WHERE id = jump),
  firsts AS (SELECT surface_id, level_no, jump, min(seed) AS first FROM j{_ROUNDS} SEMI JOIN tails USING (surface_id, level_no, jump) GROUP BY ALL),
  m AS (SELECT l.surface_id, l.level_no, l.id, coalesce(first, l.seed) AS line, f.jump IS NULL AS closed FROM j{_ROUNDS} l LEFT JOIN firsts f USING (surface_id, level_no, jump)),
  p AS MATERIALIZED (SELECT m.*, id // 4 % {SIDE} + CASE id % 4 WHEN 0 THEN 1 - (level - b.value) / (a.value - b.value) ELSE 0 END AS px, id // 4 // {SIDE} + CASE id % 4 WHEN 1 THEN 1 - (level - b.value) / (a.value - b.value) ELSE 0 END AS py
    FROM m JOIN levels USING (surface_id, level_no) JOIN f a ON a.surface_id = m.surface_id AND a.x = id // 4 % {SIDE} AND a.y = id // 4 // {SIDE} JOIN f b ON b.surface_id = m.surface_id AND b.x = a.x + (id % 4 <> 1)::INT AND b.y = a.y + (id % 4 <> 0)::INT WHERE id % 4 <> 2 AND line IS NOT NULL),
  h AS (SELECT j.surface_id, j.level_no, j.id, CASE WHEN j.jump % 4 = 2 THEN i.jump ELSE j.jump END AS next FROM j0 j JOIN j0 i ON i.surface_id = j.surface_id AND i.level_no = j.level_no AND i.id = j.jump WHERE j.id % 4 <> 2),
  g AS (SELECT p.surface_id, p.level_no, p.line, p.closed, count(*) AS n, sum(sqrt((o.px - p.px) ** 2 + (o.py - p.py) ** 2)) AS length FROM p JOIN h USING (surface_id, level_no, id) JOIN p o ON o.surface_id = p.surface_id AND o.level_no = p.level_no AND o.id = h.next GROUP BY ALL)
SELECT surface_id, level_no, (row_number() OVER (PARTITION BY surface_id, level_no ORDER BY line) - 1)::INT AS line_no, closed, n + (NOT closed)::INT AS points, round(length, 4) AS length FROM g""",
)
def traced_lines(spark, d):
    """Lines traced on tiles of 16 x 16 cells: closed or open, vertices (an open line has its seed twice) and length."""
    out = contour.contour_lines(contour.with_levels(packed(spark, d)), ["surface_id"], 16).filter("error is null")
    steps = F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.sqrt(F.pow(F.get("xs", i) - F.get("xs", i - 1), 2) + F.pow(F.get("ys", i) - F.get("ys", i - 1), 2)))
    back = F.when(c("closed"), F.sqrt(F.pow(F.element_at("xs", -1) - F.get("xs", F.lit(0)), 2) + F.pow(F.element_at("ys", -1) - F.get("ys", F.lit(0)), 2))).otherwise(0.0)
    length = F.aggregate(F.when(F.size("xs") > 1, steps).otherwise(F.array().cast("array<double>")), back, lambda a, x: a + x)
    return out.select("surface_id", "level_no", "line_no", "closed", F.size("xs").cast("long").alias("points"), F.round(length, 4).alias("length"))


@query(
    "P-17_expand_row",
    """SELECT vec_id, i::INT AS i, round(CASE WHEN i = 100 THEN embedding[64]::DOUBLE ELSE embedding[k + 1]::DOUBLE * (1 - w) + embedding[least(k + 2, 64)]::DOUBLE * w END, 6) AS value FROM
  (SELECT *, p - k AS w FROM (SELECT *, floor(p)::INT AS k FROM (SELECT vec_id, embedding, i, i::DOUBLE / 100 * 63 AS p FROM embeddings, range(0, 101) r(i))))""",
)
def expanded(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", expand_row(c("embedding").cast("array<double>"), F.lit(101)).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("i", "value")).withColumn("value", F.round("value", 6))


@query("P-19_grid_cells", f"WITH {CELLS_SQL} SELECT surface_id, x::INT AS x, count(*) AS n, round(sum(value), 6) AS total, max(y)::INT AS last FROM cells GROUP BY ALL")
def cells(spark, d):
    out = grid.to_cells(packed(spark, d), ["surface_id"])
    return out.groupBy("surface_id", "x").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("y").alias("last"))


@query("D1_pack_and_unpack", f"WITH {CELLS_SQL} SELECT surface_id, 64 AS nx, (max(y) + 1)::INT AS ny, max(value) AS hi, count(*)::INT AS n FROM cells GROUP BY 1")
def repacked(spark, d):
    out = grid.to_packed(grid.to_cells(packed(spark, d), ["surface_id"]), ["surface_id"])
    return out.select("surface_id", "nx", "ny", F.array_max("buf").alias("hi"), F.size("buf").alias("n"))


_HILL = "exp(-((2.0 * x / 100.0::DOUBLE - 1.0 - ({0})) ** 2 + (2.0 * y / 100.0::DOUBLE - 1.0 - ({1})) ** 2) / {2})"


@query(
    "S-12_test_surface",
    f"SELECT x::INT AS x, y::INT AS y, round({_HILL.format(0.5, -0.5, 0.25)} + {_HILL.format(-0.3, 0.75, 0.5625)} + {_HILL.format(-0.7, -0.6, 0.0625)}, 9) AS value FROM range(0, 100) a(x), range(0, 100) b(y)",
)
def surface(spark, d):
    return grid.test_surface(spark).withColumn("value", F.round("value", 9))


_K = "(greatest({0}, 0) ** 3)"
_SPLINE = f"(({_K.format('t + 2')} - 4 * {_K.format('t + 1')} + 6 * {_K.format('t')} - 4 * {_K.format('t - 1')}) / 6)"


@query(
    "G-04_warp_edit",
    f"""WITH {CELLS_SQL}, dims AS (SELECT surface_id, max(y) + 1 AS ny FROM cells GROUP BY 1),
  w AS (SELECT *, CASE WHEN i <= 1500 THEN sqrt(2.718281828::DOUBLE ** (-(i / 500.0::DOUBLE) * (i / 500.0::DOUBLE))) ELSE 0 END AS w FROM
    (SELECT *, floor(((x - 30) ** 2 + (y - 28) ** 2) * 0.5) AS i FROM cells JOIN dims USING (surface_id))),
  g AS (SELECT *, x - (30 - 20) * w AS gx, y - (28 - 20) * w AS gy FROM w),
  n AS (SELECT g.surface_id, g.x, g.y, floor(gx) - 1 + dx AS sx, floor(gy) - 1 + dy AS sy, gx, gy FROM g, range(0, 4) a(dx), range(0, 4) b(dy) WHERE w > 0.005 AND gx >= 0 AND gy >= 0 AND gx < 64 AND gy < ny),
  k AS (SELECT n.surface_id, n.x, n.y, s.value AS v, (sx - gx) ** 2 + (sy - gy) ** 2 AS d2 FROM n JOIN cells s ON n.surface_id = s.surface_id AND n.sx = s.x AND n.sy = s.y),
  m AS (SELECT surface_id, x, y, sum(v * {_SPLINE}) / nullif(sum({_SPLINE}), 0) AS v FROM (SELECT *, sqrt(floor(d2 * 500) / 500) AS t FROM k WHERE d2 <= 4) GROUP BY ALL)
SELECT surface_id, x::INT AS x, y::INT AS y, round(coalesce(m.v, value), 5) + 0.0 AS value FROM cells LEFT JOIN m USING (surface_id, x, y)""",
)
def warped(spark, d):
    out = grid.warp(packed(spark, d), 20.0, 20.0, 30.0, 28.0)
    return grid.to_cells(out, ["surface_id"]).withColumn("value", F.round("value", 5) + 0.0)


@query("P-38_warp_weight", "SELECT o_orderkey, round(CASE WHEN i <= 1500 THEN sqrt(2.718281828::DOUBLE ** (-(i / 500.0::DOUBLE) * (i / 500.0::DOUBLE))) ELSE 0 END, 9) AS weight FROM (SELECT o_orderkey, floor(o_totalprice / 100 * 0.5) AS i FROM orders)")
def weights(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(warp_weight(c("o_totalprice") / 100), 9).alias("weight"))


@query("P-39_spline_kernel", f"SELECT l_orderkey, l_linenumber, round({_SPLINE}, 9) AS k FROM (SELECT l_orderkey, l_linenumber, l_quantity / 25 AS t FROM lineitem)")
def kernel(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(spline(c("l_quantity") / 25), 9).alias("k"))


@query("A-05_weighted_mean", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2) AS mean FROM lineitem GROUP BY ALL")
def weighted(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(weighted_mean(c("l_extendedprice"), c("l_quantity")), 2).alias("mean"))


@query("P-34_georeferenced_cells", f"WITH {CELLS_SQL} SELECT surface_id, round(sum(x * 2.5::DOUBLE - 80), 3) AS lon, round(sum(60 - y * 1.25::DOUBLE), 3) AS lat FROM cells GROUP BY 1")
def georeferenced(spark, d):
    place = then(scaling(2.5, -1.25), translation(-80.0, 60.0))
    x, y = affine(place, c("x"), c("y"))
    out = grid.to_cells(packed(spark, d), ["surface_id"]).select("surface_id", x.alias("lon"), y.alias("lat"))
    return out.groupBy("surface_id").agg(F.round(F.sum("lon"), 3).alias("lon"), F.round(F.sum("lat"), 3).alias("lat"))


@query(
    "P-44_resample",
    f"""WITH {CELLS_SQL} SELECT surface_id AS raster_id, p.x::INT AS x, p.y::INT AS y, value FROM
  (SELECT x, y, trunc((x - 3) / 2.0::DOUBLE) AS sx, trunc((y - 2) / 2.0::DOUBLE) AS sy FROM range(0, 140) a(x), range(0, 140) b(y) WHERE x >= 3 AND y >= 2) p JOIN cells ON cells.x = sx AND cells.y = sy""",
)
def resampled(spark, d):
    place = affine_projection(then(scaling(2.0, 2.0), translation(3.0, 2.0)))
    return resample(packed(spark, d).withColumnRenamed("surface_id", "raster_id"), place, 140, 140)


@query(
    "P-44_blend",
    f"""WITH {CELLS_SQL} SELECT a.surface_id AS raster_id, a.x::INT AS x, a.y::INT AS y, round(CASE WHEN b.value IS NULL THEN a.value ELSE a.value * 0.75 + b.value * 0.25 END, 6) + 0.0 AS value FROM cells a
  LEFT JOIN cells b ON a.surface_id = b.surface_id AND a.x >= 3 AND a.y >= 2 AND b.x = trunc((a.x - 3) / 2.0::DOUBLE) AND b.y = trunc((a.y - 2) / 2.0::DOUBLE)""",
)
def blend(spark, d):
    """Each surface with itself, enlarged, laid over it."""
    rasters = packed(spark, d).withColumnRenamed("surface_id", "raster_id")
    over = resample(rasters, affine_projection(then(scaling(2.0, 2.0), translation(3.0, 2.0))), 64, 64)
    return blended(grid.to_cells(rasters, ["raster_id"]), over, 0.25).withColumn("value", F.round("value", 6) + 0.0)


@query(
    "G-02_line_points",
    f"""WITH RECURSIVE {LEVELS_SQL},
  e AS (SELECT a.surface_id, a.x, a.y, a.value AS a, b.value AS b FROM cells a JOIN cells b ON a.surface_id = b.surface_id AND a.y = b.y AND b.x = a.x + 1)
SELECT e.surface_id, level_no, count(*) AS points FROM e JOIN levels USING (surface_id) WHERE least(a, b) <= level AND level < greatest(a, b) AND abs((level - b) / (a - b) - 0.5) < 0.4999999 AND y < (SELECT max(y) FROM cells c WHERE c.surface_id = e.surface_id) GROUP BY ALL""",
)
def line_points(spark, d):
    """The distinct points that the lines of a level have on horizontal edges above the last row: every seed is on a line."""
    lines_ = contour.contour_lines(contour.with_levels(packed(spark, d)), ["surface_id"]).filter("error is null")
    points = lines_.select("surface_id", "level_no", F.explode(F.arrays_zip("xs", "ys")).alias("p")).filter((c("p.ys") == F.floor("p.ys")))
    ny = packed(spark, d).select("surface_id", "ny")
    # A crossing at a grid point lies on edges of both kinds and is left out on both sides.
    points = points.join(ny, "surface_id").filter(c("p.ys") < c("ny") - 1).filter(F.abs(c("p.xs") - F.floor("p.xs") - 0.5) < 0.4999999)
    return points.select("surface_id", "level_no", "p").distinct().groupBy("surface_id", "level_no").agg(F.count("*").alias("points"))


@query("X1_level_difference", f"WITH {CELLS_SQL} SELECT a.surface_id, round(sum(abs(b.value - a.value)), 5) AS change FROM cells a JOIN cells b ON a.x = b.x AND a.y = b.y WHERE b.surface_id = a.surface_id + 1 GROUP BY a.surface_id")
def difference(spark, d):
    """Extension: the change between neighbouring surfaces, cell by cell, from arrays joined by surface."""
    p = packed(spark, d)
    above = p.select((c("surface_id") - 1).alias("surface_id"), c("buf").alias("next"))
    n = F.least(F.size("buf"), F.size("next"))
    change = F.aggregate(F.zip_with(F.slice("buf", F.lit(1), n), F.slice("next", F.lit(1), n), lambda a, b: F.abs(b - a)), F.lit(0.0), lambda a, x: a + x)
    return p.join(above, "surface_id").select("surface_id", F.round(change, 5).alias("change"))


_PLANES = "p AS (SELECT event_type AS param, user_id AS hpa, date_trunc('day', ts) AS valid, avg(value) AS value FROM events GROUP BY ALL)"


def planes(spark, d):
    """Mean values of events as planes: type is the parameter, user the level, day the valid time."""
    e = table(spark, d, "events")
    return e.groupBy(c("event_type").alias("param"), c("user_id").alias("hpa"), F.date_trunc("day", "ts").alias("valid")).agg(F.avg("value").alias("value"))


@query(
    "E-01_formula_speed",
    f"WITH {_PLANES} SELECT u.hpa, u.valid::TIMESTAMP AS valid, round(sqrt(u.value * u.value + v.value * v.value), 6) AS value FROM p u JOIN p v ON u.hpa = v.hpa AND u.valid = v.valid WHERE u.param = 'click' AND v.param = 'purchase'",
)
def formula_speed(spark, d):
    wind = cube.Cube(planes(spark, d), ("hpa", "valid")).define("speed", "sqrt(click * click + purchase ** 2)")
    return wind.plane("speed").select("hpa", c("valid").cast("timestamp_ntz").alias("valid"), F.round("value", 6).alias("value"))


@query(
    "E-01_formula_ratio",
    f"WITH {_PLANES} SELECT u.hpa, u.valid::TIMESTAMP AS valid, round(abs(u.value - v.value) / nullif(u.value + v.value, 0), 6) AS value FROM p u JOIN p v ON u.hpa = v.hpa AND u.valid = v.valid WHERE u.param = 'click' AND v.param = 'purchase' AND u.hpa >= 3",
)
def formula_ratio(spark, d):
    """A formula of a formula, with a criterion that reaches the scan."""
    shares = cube.Cube(planes(spark, d), ("hpa", "valid")).define("whole", "click + purchase").define("share", "abs(click - purchase) / whole").where(c("hpa") >= 3)
    return shares.plane("share").select("hpa", c("valid").cast("timestamp_ntz").alias("valid"), F.round("value", 6).alias("value"))


@query(
    "E-01_formula_surfaces",
    f"WITH {CELLS_SQL}, b AS (SELECT surface_id % 2 AS side, surface_id // 2 AS pair, x, y, value FROM cells) SELECT u.pair, count(*) AS cells, round(sum(greatest(u.value, -v.value) - 0.5::DOUBLE * v.value), 5) + 0.0 AS total FROM b u JOIN b v ON u.pair = v.pair AND u.x = v.x AND u.y = v.y WHERE u.side = 0 AND v.side = 1 GROUP BY 1",
)
def formula_surfaces(spark, d):
    """Cell by cell over pairs of surfaces."""
    cells = grid.to_cells(packed(spark, d), ["surface_id"])
    rows = cells.select(F.when(c("surface_id") % 2 == 0, "even").otherwise("odd").alias("param"), F.floor(c("surface_id") / 2).alias("pair"), "x", "y", "value")
    out = cube.Cube(rows, ("pair", "x", "y")).define("mixed", "max(even, -odd) - 0.5 * odd").plane("mixed")
    return out.groupBy("pair").agg(F.count("*").alias("cells"), (F.round(F.sum("value"), 5) + 0.0).alias("total"))


_WANTED = [1, 2, 3, 5, 7, 10, 15, 20, 30, 50, 70, 100]


@query(
    "X5_level_completion",
    f"""WITH {_PLANES}, n AS (SELECT param, valid, hpa AS p, value AS v, lead(hpa) OVER o AS q, lead(value) OVER o AS u FROM p WHERE hpa > 0 WINDOW o AS (PARTITION BY param, valid ORDER BY hpa))
SELECT param, valid::TIMESTAMP AS valid, w::INT AS hpa, round(CASE WHEN w = p THEN v ELSE v + (u - v) * (ln(w) - ln(p)) / (ln(q) - ln(p)) END, 6) AS value FROM n, (SELECT unnest({_WANTED}) AS w) WHERE w = p OR w > p AND w < q""",
)
def level_completion(spark, d):
    """Standard levels from the levels that are there, linear in the logarithm of pressure."""
    out = cube.completed(planes(spark, d), _WANTED, ["param", "valid"])
    return out.select("param", c("valid").cast("timestamp_ntz").alias("valid"), "hpa", F.round("value", 6).alias("value"))


_KERNEL = ", ".join(f"({k - 3}, {w!r}::DOUBLE)" for k, w in enumerate(cube.kernel(3, 1.5)))


@query(
    "X6_gaussian_blur",
    f"""WITH {CELLS_SQL}, k(o, w) AS (VALUES {_KERNEL}), f AS MATERIALIZED (SELECT * FROM cells),
  r AS MATERIALIZED (SELECT f.surface_id, f.x - o AS x, f.y, sum(w * value) / sum(w) AS value FROM f, k WHERE f.x - o BETWEEN 0 AND {SIDE - 1} GROUP BY ALL),
  g AS (SELECT r.surface_id, r.x, r.y - o AS y, sum(w * value) / sum(w) AS value FROM r, k GROUP BY ALL)
SELECT g.surface_id, g.x::INT AS x, g.y::INT AS y, round(g.value, 7) + 0.0 AS value FROM g SEMI JOIN f ON f.surface_id = g.surface_id AND f.x = g.x AND f.y = g.y""",
)
def gaussian_blur(spark, d):
    """A separable blur; stretches of 16 cells take a halo along."""
    out = cube.blurred(grid.to_cells(packed(spark, d), ["surface_id"]), ["surface_id"], 3, 1.5, 16)
    return out.withColumn("value", F.round("value", 7) + 0.0)


@query(
    "X7_motion_vectors",
    f"""WITH {CELLS_SQL}, q AS MATERIALIZED (SELECT surface_id, x, y, x // 8 AS tx, y // 8 AS ty, floor(value / 0.001::DOUBLE + 0.5)::BIGINT AS q FROM cells),
  n AS (SELECT surface_id, tx, ty, count(*) AS cells FROM q GROUP BY ALL), d AS (SELECT unnest(range(-3, 4)) AS d),
  s AS (SELECT a.surface_id, a.tx, a.ty, dx.d AS dx, dy.d AS dy, sum((a.q - b.q) * (a.q - b.q))::BIGINT AS squares, count(*) AS cells
    FROM q a, d dx, d dy, q b WHERE b.surface_id = a.surface_id + 1 AND b.x = a.x + dx.d AND b.y = a.y + dy.d GROUP BY ALL),
  r AS (SELECT s.*, row_number() OVER (PARTITION BY surface_id, tx, ty ORDER BY squares, dx * dx + dy * dy, dy, dx) AS no FROM s JOIN n USING (surface_id, tx, ty, cells))
SELECT surface_id::BIGINT AS surface_id, tx::BIGINT AS tx, ty::BIGINT AS ty, dx::INT AS dx, dy::INT AS dy, squares, cells::BIGINT AS cells FROM r WHERE no = 1""",
)
def motion_vectors(spark, d):
    """Block matching between each surface and the next."""
    return motion.motion_vectors(grid.to_cells(packed(spark, d), ["surface_id"]), [], "surface_id", 8, 3, 0.001)
