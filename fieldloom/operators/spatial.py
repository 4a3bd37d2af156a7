"""Spatial joins, segments, labels, regions and layout.

Range joins put both sides on a grid of tiles and join by tile; a pair is reported only in the tile that holds the lower
corner of its overlap, so no distinct follows. Tile sizes are parameters: about the size of a usual item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import polygon_contains, rects_meet
from fieldloom.stored import discard, store

c = F.col


def _tiles(lo: Column, hi: Column, tile: float) -> Column:
    return F.sequence(F.floor(lo / tile).cast("long"), F.floor(hi / tile).cast("long"))


def rect_join(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """Pairs of rectangles (id, x1, y1, x2, y2) that meet: columns a_id, b_id, then both rectangles prefixed."""
    side = lambda df, p: df.select(*[c(k).alias(f"{p}{k}") for k in ("id", "x1", "y1", "x2", "y2")]).withColumn("tx", F.explode(_tiles(c(f"{p}x1"), c(f"{p}x2"), tile))).withColumn("ty", F.explode(_tiles(c(f"{p}y1"), c(f"{p}y2"), tile)))
    both = side(a, "a_").join(side(b, "b_"), ["tx", "ty"])
    here = (F.floor(F.greatest("a_x1", "b_x1") / tile) == c("tx")) & (F.floor(F.greatest("a_y1", "b_y1") / tile) == c("ty"))
    return both.filter(here & rects_meet("a_", "b_")).drop("tx", "ty")


def interval_join(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """Pairs of closed intervals (id, start, stop) that overlap."""
    side = lambda df, p: df.select(*[c(k).alias(f"{p}{k}") for k in ("id", "start", "stop")]).withColumn("t", F.explode(_tiles(c(f"{p}start"), c(f"{p}stop"), tile)))
    both = side(a, "a_").join(side(b, "b_"), "t")
    return both.filter((F.floor(F.greatest("a_start", "b_start") / tile) == c("t")) & (c("a_start") <= c("b_stop")) & (c("b_start") <= c("a_stop"))).drop("t")


def running(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows, one a key, with before: the sum of value over all smaller keys. Rows are dealt out by ranges of the key; only the
    ranges' sums, one row a task, are put in order in one task."""
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = store(rows.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))
    parts = parts.select("_part", F.coalesce(F.sum("_total").over(ahead(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(ahead(Window.partitionBy("_part").orderBy(key))), F.lit(0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(parts), "_part").withColumn("before", c("_base") + c("_inside")).drop("_part", "_inside", "_base")


def interval_rank(a: DataFrame) -> DataFrame:
    """Sorted intervals with the first and last place of each equal start, as a tree's bounds would give them."""
    out = running(a.groupBy("start").agg(F.count("*").alias("n")), "start", "n")
    return out.select("start", "n", c("before").alias("lower"), (c("before") + c("n")).alias("upper"))


def interval_lookup(a: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, lower, upper, equal, inside for probes (probe_id, key) among closed intervals (start, stop): how many starts
    lie below the key, and at or below it; how many are equal to it; how many intervals hold it."""
    changes = [(c("start"), 0, 1, 0), (c("stop"), 0, 0, 1), (c("key"), 1, 0, 0)]
    at = lambda df, k, *n: df.select(k.cast("double").alias("at"), *[F.lit(x).alias(y) for x, y in zip(n, ("asks", "starts", "stops"), strict=True)])
    all_ = at(a, *changes[0]).unionByName(at(a, *changes[1])).unionByName(at(probes, *changes[2]))
    keys = all_.groupBy("at").agg(*[F.sum(k).alias(k) for k in ("asks", "starts", "stops")])
    keys = running(keys, "at", "starts").withColumnRenamed("before", "lower")
    keys = running(keys, "at", "stops").withColumnRenamed("before", "ended").filter("asks > 0")
    out = probes.select("probe_id", c("key").cast("double").alias("at")).join(keys, "at")
    upper = c("lower") + c("starts")
    return out.select("probe_id", "lower", upper.alias("upper"), c("starts").alias("equal"), (upper - c("ended")).alias("inside"))


def sweep_sizes(rects: DataFrame) -> DataFrame:
    """y, active: how many rectangles (y1, y2, both included) a sweep line holds where one or more begin."""
    ends = rects.select(c("y1").alias("y"), F.lit(1).alias("begins"), F.lit(0).alias("ends")).unionByName(rects.select(c("y2").alias("y"), F.lit(0).alias("begins"), F.lit(1).alias("ends")))
    at = ends.groupBy("y").agg(F.sum("begins").alias("begins"), F.sum("ends").alias("ends")).withColumn("net", c("begins") - c("ends"))
    # Those that end here are still held here.
    return running(at, "y", "net").filter("begins > 0").select("y", (c("before") + c("begins")).alias("active"))


def blended(under: DataFrame, over: DataFrame, alpha: float) -> DataFrame:
    """Cells (raster_id, x, y, value) of under, with over's mixed in at a share of alpha where it has any."""
    top = over.select("raster_id", "x", "y", c("value").alias("top"))
    return under.join(top, ["raster_id", "x", "y"], "left").select("raster_id", "x", "y", F.coalesce(c("value") * (1 - alpha) + c("top") * alpha, c("value")).alias("value"))


def point_polygon_join(points: DataFrame, polygons: DataFrame, tile: float, compat: bool = False) -> DataFrame:
    """(point_id, polygon_id) of points (point_id, px, py) in polygons (polygon_id, xs, ys)."""
    p = points.withColumn("tx", F.floor(c("px") / tile).cast("long")).withColumn("ty", F.floor(c("py") / tile).cast("long"))
    box = polygons.select("polygon_id", *[f(k).alias(n) for f, k, n in ((F.array_min, "xs", "x1"), (F.array_min, "ys", "y1"), (F.array_max, "xs", "x2"), (F.array_max, "ys", "y2"))])
    q = box.withColumn("tx", F.explode(_tiles(c("x1"), c("x2"), tile))).withColumn("ty", F.explode(_tiles(c("y1"), c("y2"), tile)))
    # Bounds go to the tiles; a ring's vertices are fetched for the points in its bounds.
    near = p.join(q, ["tx", "ty"]).filter(c("px").between(c("x1"), c("x2")) & c("py").between(c("y1"), c("y2"))).select("point_id", "px", "py", "polygon_id")
    return near.join(polygons.select("polygon_id", "xs", "ys"), "polygon_id").filter(polygon_contains(c("px"), c("py"), c("xs"), c("ys"), compat)).select("point_id", "polygon_id")


def nearest_hit(queries: DataFrame, targets: DataFrame, reach: float = 5.0) -> DataFrame:
    """(query_id, target_id, distance): the nearest target closer than reach; equal distances: the smaller id.
    queries (query_id, qx, qy), targets (target_id, tx, ty).

    Places that have no target within a radius look again with twice the radius, up to reach; the first one is such that
    a square of its side holds about one target. So a place meets few targets however many are within reach. Places that queries
    or targets share count once."""
    held = store(targets.filter("target_id is not null").groupBy("tx", "ty").agg(F.min("target_id").alias("target_id")), "targets")
    n, w, h = held.agg(F.count("*"), F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty")).first()
    thin = max(w or 0.0, h or 0.0) * max(min(w or 0.0, h or 0.0), reach) / max(n, 1)
    # Halves of reach, so that the last radius is reach itself.
    halves = max(0, min(20, math.floor(math.log2(reach / math.sqrt(thin))))) if thin > 0 else 0
    left, found = store(queries.select("qx", "qy").dropna().distinct(), "places"), []
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = F.sqrt((c("qx") - c("tx")) * (c("qx") - c("tx")) + (c("qy") - c("ty")) * (c("qy") - c("ty")))
    for k in range(halves, -1, -1):
        radius = reach / 2**k
        q = left.withColumn("n", F.explode(near)).withColumn("cx", F.floor(c("qx") / radius) + c("n.i")).withColumn("cy", F.floor(c("qy") / radius) + c("n.j"))
        t = held.withColumn("cx", F.floor(c("tx") / radius)).withColumn("cy", F.floor(c("ty") / radius))
        best = q.join(t, ["cx", "cy"]).withColumn("distance", d).filter(c("distance") < radius).groupBy("qx", "qy").agg(F.min(F.struct("distance", "target_id")).alias("m"))
        found.append(store(best, "nearest"))
        if k:
            after = store(left.join(found[-1], ["qx", "qy"], "left_anti"), "places")
            discard(left)
            left = after
    discard(left, held)
    best = queries.join(reduce(DataFrame.unionByName, found), ["qx", "qy"]).groupBy("query_id").agg(F.min("m").alias("m"))
    return best.select("query_id", c("m.target_id").alias("target_id"), c("m.distance").alias("distance"))


def segments(vertices: DataFrame) -> DataFrame:
    """path_id, ring, seq, x1, y1, x2, y2: each vertex joined to the one before; close joins the last to the ring's first."""
    w = Window.partitionBy("path_id", "ring").orderBy("seq")
    out = vertices.withColumn("x1", F.lag("x").over(w)).withColumn("y1", F.lag("y").over(w)).withColumn("fx", F.first("x").over(w)).withColumn("fy", F.first("y").over(w))
    closing = c("cmd") == "close"
    out = out.withColumn("x2", F.when(closing, c("fx")).otherwise(c("x"))).withColumn("y2", F.when(closing, c("fy")).otherwise(c("y")))
    return out.filter(c("cmd") != "move_to").select("path_id", "ring", "seq", "x1", "y1", "x2", "y2")


def path_bounds(vertices: DataFrame, margin: float = 0.0) -> DataFrame:
    box = vertices.filter("cmd <> 'close'").groupBy("path_id").agg(*[f(k).alias(n) for f, k, n in ((F.min, "x", "x1"), (F.min, "y", "y1"), (F.max, "x", "x2"), (F.max, "y", "y2"))])
    box = box.withColumn("cx", (c("x1") + c("x2")) / 2).withColumn("cy", (c("y1") + c("y2")) / 2)
    return box.select("path_id", (c("x1") - margin).alias("x1"), (c("y1") - margin).alias("y1"), (c("x2") + margin).alias("x2"), (c("y2") + margin).alias("y2"), "cx", "cy")


def segment_crossings(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """Strict interior crossings of segments (id, x1, y1, x2, y2): a_id, b_id, ua, ub, x, y; parallels have none."""
    box = lambda df: df.select("id", F.least("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y1"), F.greatest("x1", "x2").alias("x2"), F.greatest("y1", "y2").alias("y2"), F.struct(c("x1").alias("x1"), c("y1").alias("y1"), c("x2").alias("x2"), c("y2").alias("y2")).alias("s"))
    side = lambda df, p: box(df).select(*[c(k).alias(f"{p}{k}") for k in ("id", "x1", "y1", "x2", "y2", "s")]).withColumn("tx", F.explode(_tiles(c(f"{p}x1"), c(f"{p}x2"), tile))).withColumn("ty", F.explode(_tiles(c(f"{p}y1"), c(f"{p}y2"), tile)))
    both = side(a, "a_").join(side(b, "b_"), ["tx", "ty"])
    here = (F.floor(F.greatest("a_x1", "b_x1") / tile) == c("tx")) & (F.floor(F.greatest("a_y1", "b_y1") / tile) == c("ty"))
    both = both.filter(here & rects_meet("a_", "b_"))
    p, q = c("a_s"), c("b_s")
    den = (q.y2 - q.y1) * (p.x2 - p.x1) - (q.x2 - q.x1) * (p.y2 - p.y1)
    ua = ((q.x2 - q.x1) * (p.y1 - q.y1) - (q.y2 - q.y1) * (p.x1 - q.x1)) / F.nullif(den, F.lit(0.0))
    ub = ((p.x2 - p.x1) * (p.y1 - q.y1) - (p.y2 - p.y1) * (p.x1 - q.x1)) / F.nullif(den, F.lit(0.0))
    out = both.withColumn("ua", ua).withColumn("ub", ub).filter("ua > 0 and ua < 1 and ub > 0 and ub < 1")
    return out.select("a_id", "b_id", "ua", "ub", (c("a_s.x1") + c("ua") * (c("a_s.x2") - c("a_s.x1"))).alias("x"), (c("a_s.y1") + c("ua") * (c("a_s.y2") - c("a_s.y1"))).alias("y"))


def _expanded(start: np.ndarray, stop: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for each place from start to stop of each row, in blocks of about size pairs."""
    n = np.maximum(stop - start, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        m = n[at:end]
        row = np.repeat(np.arange(at, end), m)
        yield row, np.arange(len(row)) + np.repeat(start[at:end] - (np.cumsum(m) - m), m)
        at = end


def _crossed(tile: float):
    """A task's part of crossing_sums: the segments of both sides that touch one tile. The tile is cut into strips; in a strip
    both sides are sorted by where they begin, so what overlaps a segment in x and begins after it is one range."""

    def side(t: pa.Table, tx: int, ty: int) -> dict:
        s = {k: t[k].to_numpy() for k in ("x1", "y1", "x2", "y2")}
        for k in "xy":
            s[f"l{k}"], s[f"h{k}"] = np.minimum(s[f"{k}1"], s[f"{k}2"]), np.maximum(s[f"{k}1"], s[f"{k}2"])
        return {**s, "begins": np.floor(s["lx"] / tile) == tx, "above": np.floor(s["ly"] / tile) < ty, "beyond": np.floor(s["hy"] / tile) > ty}

    def run(ta: pa.Table, tb: pa.Table) -> pa.Table:
        value = tb["value"].combine_chunks() if len(tb) else pa.array([], pa.int64())
        known, values = value.is_valid().to_numpy(False).astype(np.int64), value.fill_null(0).to_numpy(False)
        n, ids, some = (np.zeros(len(ta), dtype=np.int64) for _ in range(3))
        if len(ta) and len(tb):
            tx, ty = ta["tx"][0].as_py(), ta["ty"][0].as_py()
            a, b = side(ta, tx, ty), side(tb, tx, ty)
            strips = int(np.clip(tile / max(np.mean(a["hy"] - a["ly"]) / 2, np.mean(b["hy"] - b["ly"]), tile / 64), 1, 64))
            strip = lambda v: np.clip(np.floor((v - ty * tile) * (strips / tile)), 0, strips - 1).astype(np.int64)
            for s in (a, b):
                s["first"], s["last"] = np.where(s["above"], -1, strip(s["ly"])), np.where(s["beyond"], strips - 1, strip(s["hy"]))
            for k in range(strips):
                i, j = (r[np.argsort(s["lx"][r], kind="stable")] for s in (a, b) for r in [np.flatnonzero((s["first"] <= k) & (s["last"] >= k))])
                la, lb = a["lx"][i], b["lx"][j]
                after = _expanded(np.searchsorted(lb, la, "left"), np.searchsorted(lb, a["hx"][i], "right"))
                before = _expanded(np.searchsorted(la, lb, "right"), np.searchsorted(la, b["hx"][j], "right"))
                for p, q in chain(after, ((p, q) for q, p in before)):
                    p, q = i[p], j[q]
                    # A pair counts in the strip and the tile that hold the lower corner of its overlap.
                    ok = (a["ly"][p] <= b["hy"][q]) & (b["ly"][q] <= a["hy"][p]) & (np.maximum(a["first"][p], b["first"][q]) == k) & (a["begins"][p] | b["begins"][q])
                    p, q = p[ok], q[ok]
                    ax, ay, bx, by = a["x1"][p], a["y1"][p], b["x1"][q], b["y1"][q]
                    dx, dy, ex, ey = a["x2"][p] - ax, a["y2"][p] - ay, b["x2"][q] - bx, b["y2"][q] - by
                    with np.errstate(all="ignore"):
                        den = ey * dx - ex * dy
                        ua, ub = (ex * (ay - by) - ey * (ax - bx)) / den, (dx * (ay - by) - dy * (ax - bx)) / den
                        ok = (den != 0) & (ua > 0) & (ua < 1) & (ub > 0) & (ub < 1)
                    p, q = p[ok], q[ok]
                    n += np.bincount(p, minlength=len(n))
                    np.add.at(ids, p, values[q])
                    np.add.at(some, p, known[q])
        met = pa.array(np.flatnonzero(n))
        return pa.Table.from_arrays([ta["id"].take(met), *[pa.array(v).take(met) for v in (n, ids, some)]], ["a_id", "n", "ids", "known"])

    return run


def crossing_sums(a: DataFrame, b: DataFrame, tile: float, most: int = 50_000) -> DataFrame:
    """a_id, n, ids: with how many segments of b each of a (both id, x1, y1, x2, y2) crosses as in segment_crossings, and the sum of
    their ids (longs). Ids that cross nothing are left out; those of several rows are added up. Pairs are counted in the
    task of their tile and never leave it; of a tile with more than most segments a side, a task takes parts of both sides."""
    finite = reduce(Column.__and__, [F.abs(c(k).cast("double")) < float("inf") for k in ("x1", "y1", "x2", "y2")])

    def side(df: DataFrame, *own: Column) -> DataFrame:
        out = df.filter(finite).select(*own, *[c(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")], F.monotonically_increasing_id().alias("row"))
        return reduce(lambda d, k: d.withColumn(f"t{k}", F.explode(_tiles(F.least(f"{k}1", f"{k}2"), F.greatest(f"{k}1", f"{k}2"), tile))), "xy", out)

    left, right = side(a, c("id")), side(b, c("id").cast("long").alias("value"))
    each = left.select("tx", "ty", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select("tx", "ty", F.lit(0).alias("a"), F.lit(1).alias("b")))
    # At most one tile in most rows is such, so these are few.
    hot = each.groupBy("tx", "ty").agg(*[F.ceil(F.sum(k) / most).cast("int").alias(f"{k}_parts") for k in "ab"]).filter("a_parts > 1 or b_parts > 1")
    hot = F.broadcast(store(hot, "hot"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        parts = lambda k: F.greatest(F.coalesce(c(f"{k}_parts"), F.lit(1)), F.lit(1))
        out = df.join(hot, ["tx", "ty"], "left").withColumn(own, F.pmod(c("row"), parts(own)).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), parts(other) - 1))).drop("row", "a_parts", "b_parts")

    keys = ["tx", "ty", "a", "b"]
    kind = left.schema["id"].dataType.simpleString()
    both = dealt(left, "a", "b").groupBy(*keys).cogroup(dealt(right, "b", "a").groupBy(*keys)).applyInArrow(_crossed(tile), f"a_id {kind}, n long, ids long, known long")
    out = both.groupBy("a_id").agg(*[F.sum(k).alias(k) for k in ("n", "ids", "known")])
    return out.select("a_id", "n", F.when(c("known") > 0, c("ids")).alias("ids"))


def text_layout(lines: DataFrame, glyphs: DataFrame) -> DataFrame:
    """line_id, seq, code, x: pen position of each character of lines (line_id, text). glyphs (code, advance): one
    row a code; codes it lacks advance by 0. With faces, lines and glyphs have face and size too, and a line takes the
    glyphs of its own; a face that is not there has no glyphs."""
    face = [k for k in ("face", "size") if k in lines.columns and k in glyphs.columns]
    each = lines.select("line_id", *face, F.posexplode(F.split("text", "")).alias("seq", "ch")).filter("ch <> ''").withColumn("code", F.ascii("ch"))
    each = each.join(glyphs, [*face, "code"], "left")
    w = Window.partitionBy("line_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("line_id", "seq", "code", F.coalesce(F.sum(F.coalesce("advance", F.lit(0.0))).over(w), F.lit(0.0)).alias("x"))


def graticule(spark: SparkSession) -> DataFrame:
    """Ticks of five points along and across each crossing of ten-degree lines: path_id, seq, cmd, lon, lat."""
    lats, lons = F.explode(F.sequence(F.lit(-80), F.lit(80), F.lit(10))), F.explode(F.sequence(F.lit(-180), F.lit(170), F.lit(10)))
    base = spark.range(1).select(lats.alias("lat")).select("lat", lons.alias("lon")).select("lat", "lon", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    out = base.select("lat", "lon", "up", F.posexplode(F.sequence(F.lit(-2), F.lit(2))).alias("seq", "d"))
    place = (c("up") * 17 + (c("lat") + 80) / 10).cast("int") * 36 + ((c("lon") + 180) / 10).cast("int")
    return out.select(place.alias("path_id"), "seq", F.when(c("seq") == 0, "move_to").otherwise("line_to").alias("cmd"), (c("lon") + c("d") * (1 - c("up"))).cast("double").alias("lon"), (c("lat") + c("d") * c("up")).cast("double").alias("lat"))


def limb(spark: SparkSession, projection, radius: float, steps: int = 2000) -> DataFrame:
    """The visible disc's edge in degrees, by longitude, closed far above the map: seq, cmd, lon, lat. steps + 3 rows."""
    t = c("id") * (2 * math.pi / steps) - math.pi
    lon, lat = projection.reverse(F.cos(t) * radius, F.sin(t) * radius)
    edge = spark.range(steps).select(lon.alias("lon"), lat.alias("lat"))
    ends = spark.createDataFrame([(steps, 200.0, 100.0), (steps + 1, -200.0, 100.0)], "seq int, lon double, lat double")
    edge = edge.select((F.row_number().over(Window.orderBy("lon", "lat")) - 1).alias("seq"), "lon", "lat").unionByName(ends)
    close = spark.createDataFrame([(steps + 2, None, None)], "seq int, lon double, lat double")
    return edge.unionByName(close).select("seq", F.when(c("seq") == 0, "move_to").when(c("lon").isNull(), "close").otherwise("line_to").alias("cmd"), "lon", "lat")


def dirty_share(rects: DataFrame, width: float, height: float) -> DataFrame:
    """The share of a width x height screen that rectangles (x1, y1, x2, y2) cover, overlaps counted each time."""
    return rects.agg((F.sum((c("x2") - c("x1")) * (c("y2") - c("y1"))) / (width * height)).alias("share"))


def invalid_region(before: DataFrame, after: DataFrame, front: int = 100) -> DataFrame:
    """Rectangles to draw anew: all active ones (z >= front) of now, and what active ones covered before."""
    active = lambda df: df.filter(c("z") >= front).select("x1", "y1", "x2", "y2")
    return active(after).union(active(before))


def resample(rasters: DataFrame, projection, width: int, height: int) -> DataFrame:
    """raster_id, x, y, value of width x height destination pixels: each is taken back through the projection and reads the
    source pixel it falls in (truncated); pixels from outside are left out. rasters (raster_id, nx, ny, buf): each reads
    its own array, so there is no join."""
    at = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    out = rasters.select("raster_id", "nx", "ny", "buf", at.alias("p")).withColumn("x", (c("p") % width).cast("int")).withColumn("y", F.floor(c("p") / width).cast("int"))
    sx, sy = projection.reverse(c("x").cast("double"), c("y").cast("double"))
    out = out.withColumn("sx", sx.cast("int")).withColumn("sy", sy.cast("int")).filter((sx >= 0) & (sy >= 0) & (c("sx") < c("nx")) & (c("sy") < c("ny")))
    return out.select("raster_id", "x", "y", F.get("buf", c("sy") * c("nx") + c("sx")).alias("value"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one ordered set has and the other lacks; empty if nothing changed. A row's place belongs to it."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))
