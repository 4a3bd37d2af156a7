"""Grids in packed form (one array a surface) and cell form (one row a cell)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.geometry import GAUSS_BASE, GAUSS_LAST, GAUSS_STEPS


def test_surface(spark: SparkSession, w: int = 100, h: int = 100) -> DataFrame:
    """(x, y, value): three Gaussian hills over w x h cells, at x / w and y / h."""
    i, j = F.col("x") / F.lit(float(w)), F.col("y") / F.lit(float(h))
    return spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y")).withColumn("value", surface_value(i, j))


#: Centre and width of the test surface's hills, on coordinates from -1 to 1.
HILLS = ((0.5, -0.5, 0.5), (-0.3, 0.75, 0.75), (-0.7, -0.6, 0.25))


def surface_value(i: Column, j: Column) -> Column:
    x, y = i * 2.0 - 1.0, j * 2.0 - 1.0
    first, *rest = [F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (r * r)) for cx, cy, r in HILLS]
    return sum(rest, first)


def to_cells(packed: DataFrame, keys: list[str], buf: str = "buf") -> DataFrame:
    out = packed.select(*keys, "nx", F.posexplode(buf).alias("_p", "value"))
    return out.select(*keys, (F.col("_p") % F.col("nx")).cast("int").alias("x"), F.floor(F.col("_p") / F.col("nx")).cast("int").alias("y"), "value")


def to_packed(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("_c"))
    return out.select(*keys, "nx", "ny", F.transform("_c", lambda c: c.value).alias("buf"))


def bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def contour_levels(lo: Column, hi: Column) -> Column:
    """Levels from a tenth of the range below to a tenth above, a tenth apart, added up step by step. A flat surface has
    none. A start a hair low can bring a thirteenth step within the end, so up to 14 are tried."""
    span = hi - lo
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.array(lo - span * 0.1), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + span * 0.1)))
    return F.when(span > 0, F.filter(folded, lambda v: v < hi + span * 0.1)).otherwise(F.array().cast("array<double>"))


def horizontal_edges(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, a, b: the values at both ends of each edge from (x, y) to (x + 1, y), without a shuffle."""
    n = F.size("buf")
    at = F.filter(F.sequence(F.lit(0), n - 2), lambda p: (p + 1) % F.col("nx") != 0)
    edges = F.transform(at, lambda p: F.struct((p % F.col("nx")).alias("x"), F.floor(p / F.col("nx")).cast("int").alias("y"), F.get("buf", p).alias("a"), F.get("buf", p + 1).alias("b")))
    return packed.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")


def vertical_edges(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, a, b: the values at both ends of each edge from (x, y) to (x, y + 1), without a shuffle."""
    at = F.filter(F.sequence(F.lit(0), F.size("buf") - 1), lambda p: p + F.col("nx") < F.size("buf"))
    edges = F.transform(at, lambda p: F.struct((p % F.col("nx")).alias("x"), F.floor(p / F.col("nx")).cast("int").alias("y"), F.get("buf", p).alias("a"), F.get("buf", p + F.col("nx")).alias("b")))
    return packed.select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")


#: Squared distances are told apart in steps of 1 / KERNEL_STEPS.
KERNEL_STEPS = 500


def spline_np(t: np.ndarray) -> np.ndarray:
    """The cubic B-spline kernel on arrays."""
    cube = lambda x: np.maximum(x, 0.0) ** 3
    return (cube(t + 2) - 4 * cube(t + 1) + 6 * cube(t) - 4 * cube(t - 1)) / 6


def warp_weight_np(dist2: np.ndarray) -> np.ndarray:
    i = np.floor(dist2 * 0.5)
    return np.where(i <= GAUSS_LAST, np.sqrt(GAUSS_BASE ** -((i / GAUSS_STEPS) ** 2)), 0.0)


def convolved(grid: np.ndarray, px: np.ndarray, py: np.ndarray, kernel=spline_np) -> np.ndarray:
    """Mean of the 4 x 4 cells around each point, weighted by kernel(distance) up to distance 2; cells outside are left
    out, and where no cell counts the result is not a number."""
    ny, nx = grid.shape
    weight, total = np.zeros(px.shape), np.zeros(px.shape)
    for k in range(16):
        x, y = np.floor(px) - 1 + k % 4, np.floor(py) - 1 + k // 4
        d2 = (x - px) ** 2 + (y - py) ** 2
        ok = (x >= 0) & (y >= 0) & (x < nx) & (y < ny) & (d2 <= 4)
        w = np.where(ok, kernel(np.sqrt(np.floor(d2 * KERNEL_STEPS) / KERNEL_STEPS)), 0.0)
        weight += w
        total += w * grid[np.where(ok, y, 0).astype(int), np.where(ok, x, 0).astype(int)]
    return np.divide(total, weight, out=np.full(px.shape, np.nan), where=weight != 0)


def warp(packed: DataFrame, x1: float, y1: float, x2: float, y2: float, kernel=spline_np) -> DataFrame:
    """packed with buf edited: what was at (x1, y1) is dragged to (x2, y2), with a Gaussian reach around the latter.

    Each cell looks at 16 neighbours at a place of its own, which as rows would be a join of 16 times the cells; a surface
    is edited as one array instead, and surfaces are independent.
    """

    def edit(nx: int, ny: int, buf) -> np.ndarray:
        grid = np.asarray(buf, dtype=float).reshape(ny, nx)
        y, x = np.mgrid[0:ny, 0:nx].astype(float)
        w = warp_weight_np((x - x2) ** 2 + (y - y2) ** 2)
        gx, gy = x - (x2 - x1) * w, y - (y2 - y1) * w
        ok = (w > 0.005) & (gx >= 0) & (gy >= 0) & (gx < nx) & (gy < ny)
        moved = convolved(grid, gx, gy, kernel)
        return np.where(ok & ~np.isnan(moved), moved, grid).ravel()

    def run(batches):
        for b in batches:
            done = [edit(nx, ny, buf.values) for nx, ny, buf in zip(b.column("nx").to_pylist(), b.column("ny").to_pylist(), b.column("buf"), strict=True)]
            at = b.schema.get_field_index("buf")
            yield b.set_column(at, "buf", pa.array(done, pa.list_(pa.float64())))

    return packed.mapInArrow(run, packed.schema)
