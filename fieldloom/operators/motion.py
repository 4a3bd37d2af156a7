"""Motion between successive surfaces by block matching.

A surface's cells go to their own block, and as cells of the later surface to every block whose search range they lie in, so
one shuffle by block brings both together and no group holds more than block ** 2 + (block + 2 * reach) ** 2 cells. Blocks
are then compared many at a time: sums over blocks bound the squared difference from below, so most displacements are
passed over without looking at their cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col

#: Values are compared in whole steps of less than this size, so that sums of squares are exact.
LARGEST = 1 << 20
#: Blocks that are compared at once.
AT_ONCE = 512


def displacements(reach: int) -> list[tuple[int, int]]:
    """(dx, dy) in the order in which equals are preferred: the shortest, then the smallest dy, then dx."""
    each = [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1)]
    return sorted(each, key=lambda d: (d[0] ** 2 + d[1] ** 2, d[1], d[0]))


def best_matches(own: np.ndarray, later: np.ndarray, there: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the displacement or -1, sum of squares) for each block. own: (n, block, block) with LARGEST where no cell
    is; later: (n, wide, wide) around it; there: where later has cells."""
    n, block = own.shape[:2]
    has = own < LARGEST
    a, cells = np.where(has, own, 0), has.sum(axis=(1, 2))
    moves = displacements(reach)
    part = lambda x, k, rows: x[rows, reach + moves[k][1] : reach + moves[k][1] + block, reach + moves[k][0] : reach + moves[k][0] + block]
    every = np.arange(n)
    # The squared difference of n cells is at least the squared difference of their sums over n.
    bound = np.full((len(moves), n), np.iinfo(np.int64).max)
    for k in range(len(moves)):
        b = np.where(has, part(later, k, every), 0).sum(axis=(1, 2))
        ok = (part(there, k, every) | ~has).all(axis=(1, 2)) & (cells > 0)
        bound[k, ok] = ((a.sum(axis=(1, 2)) - b) ** 2)[ok]

    def squares(k: int, rows: np.ndarray) -> np.ndarray:
        return (np.where(has[rows], a[rows] - part(later, k, rows), 0) ** 2).sum(axis=(1, 2))

    possible = (bound < np.iinfo(np.int64).max).any(axis=0)
    first = np.argmin(bound, axis=0)
    least = np.full(n, np.iinfo(np.int64).max)
    for k in np.unique(first[possible]):
        rows = np.flatnonzero(possible & (first == k))
        least[rows] = squares(k, rows)
    found = np.full(n, -1)
    for k in range(len(moves)):
        rows = np.flatnonzero(possible & (bound[k] < np.iinfo(np.int64).max) & (bound[k] // np.maximum(cells, 1) <= least))
        cost = squares(k, rows)
        better = (cost < least[rows]) | ((cost == least[rows]) & (found[rows] < 0))
        found[rows[better]], least[rows[better]] = k, cost[better]
    return found, least


def motion_vectors(cells: DataFrame, keys: list[str], frame: str, block: int = 8, reach: int = 3, step: float = 0.001, value: Column | None = None) -> DataFrame:
    """keys, frame, tx, ty, dx, dy (int), squares, cells (long): for each block of each surface (keys, frame: long; cells x, y
    and value) the displacement of at most reach along each axis with the smallest sum of squared differences to the surface
    with the next frame, in steps of the given size. cells is how many cells the block has.

    Defined results. A displacement counts if the later surface has a cell for every cell of the block; a block without any
    gives no row, so the last surface gives none. Values that are null or not finite are not there. Cells given more than once:
    the largest value. Equals: the shortest displacement, then the smallest dy, then dx. An empty table gives no row. Values
    of LARGEST steps or more raise an error.
    """
    if not 0 < block <= 32 or reach < 0:
        raise ValueError("blocks have 1 to 32 cells along an axis: sums of squares beyond that are not exact")
    v = c("value") if value is None else value
    wide = block + 2 * reach
    rows = cells.select(*keys, c(frame).cast("long").alias("_f"), c("x").cast("long").alias("_x"), c("y").cast("long").alias("_y"), v.cast("double").alias("_v"))
    rows = rows.filter(c("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    rows = rows.withColumn("_q", F.floor(c("_v") / F.lit(step) + 0.5).cast("long"))
    tile = lambda x: F.floor(x / block).cast("long")
    own = rows.select(*keys, "_f", tile(c("_x")).alias("tx"), tile(c("_y")).alias("ty"), "_x", "_y", "_q", F.lit(False).alias("_l"))
    reached = lambda name: F.explode(F.sequence(tile(c(name) - reach), tile(c(name) + reach)))
    later = rows.withColumn("_f", c("_f") - 1).withColumn("tx", reached("_x")).withColumn("ty", reached("_y"))
    both = own.unionByName(later.select(*keys, "_f", "tx", "ty", "_x", "_y", "_q", F.lit(True).alias("_l")))
    # Where a cell lies in the window around its block.
    at = ((c("_y") - c("ty") * block + reach) * wide + c("_x") - c("tx") * block + reach).cast("int")
    grouped = both.groupBy(*keys, "_f", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct(c("_l").alias("late"), at.alias("at"), c("_q").alias("q")))).alias("_c"))
    grouped = grouped.filter(F.exists("_c", lambda s: ~s.late) & F.exists("_c", lambda s: s.late))
    plain = [*keys, "_f", "tx", "ty"]
    grouped = grouped.select(*plain, *[c(f"_c.{n}").alias(f"_{n}") for n in ("late", "at", "q")])
    shape = T.StructType([*grouped.schema.fields[: len(plain)], *[T.StructField(n, T.IntegerType()) for n in ("dx", "dy")], T.StructField("squares", T.LongType()), T.StructField("cells", T.LongType())])
    moves = np.array(displacements(reach), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(start, AT_ONCE)
                late, place, q = (b.column(len(plain) + k).flatten().to_numpy(zero_copy_only=False) for k in range(3))
                if len(q) and max(abs(int(q.max())), abs(int(q.min()))) >= LARGEST:
                    raise ValueError(f"values of {LARGEST} steps or more: take larger steps")
                row = np.repeat(np.arange(b.num_rows), np.asarray(b.column(len(plain)).value_lengths()))
                now = np.full((b.num_rows, wide * wide), LARGEST, np.int64)
                then, there = np.zeros_like(now), np.zeros(now.shape, bool)
                now[row[~late], place[~late]] = q[~late]
                then[row[late], place[late]] = q[late]
                there[row[late], place[late]] = True
                square = lambda x: x.reshape(-1, wide, wide)
                inner = square(now)[:, reach : reach + block, reach : reach + block]
                found, least = best_matches(inner, square(then), square(there), reach)
                ok = np.flatnonzero(found >= 0)
                move = moves[found[ok]]
                kept = [b.column(k).take(pa.array(ok)) for k in range(len(plain))]
                more = [pa.array(move[:, 0]), pa.array(move[:, 1]), pa.array(least[ok]), pa.array((inner[ok] < LARGEST).sum(axis=(1, 2)))]
                yield pa.RecordBatch.from_arrays([*kept, *more], [*plain, "dx", "dy", "squares", "cells"])

    return grouped.mapInArrow(run, shape).withColumnRenamed("_f", frame)
