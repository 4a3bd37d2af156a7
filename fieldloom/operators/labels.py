"""Greedy label placement by rounds.

A label is placed if it meets no label placed before it, in order of z; that order makes the rule sequential, but only where
labels are near each other. Each round puts the open labels on tiles, and a label that comes first in every tile it touches
has all its earlier neighbours decided: it is placed, and what it meets is decided against. A tile has one first label at
most, so a round joins each open label with at most one label a tile; pairs of labels are never listed, however many lie on
one spot. Labels with equal bounds stand and fall together: only the first of them takes part. Once few labels are open, chains of
them would still take round after round; a task then goes through each view's last labels one by one.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import rects_meet
from fieldloom.stored import discard, store

c = F.col
BOX = ["x1", "y1", "x2", "y2"]


def _in_turn(left: DataFrame, tile: float) -> DataFrame:
    """placed: the rows of open labels that the sequential rule places. Each view's labels meet in one task."""

    def tiles(lo, hi) -> range:
        a, b = floor(lo / tile), floor(hi / tile)
        return range(a, b + 1) if a <= b else range(a, b - 1, -1)

    def run(view: pa.Table) -> pa.Table:
        held: dict[tuple[int, int], list[tuple]] = {}
        free = []
        for row, *box in zip(*[view.sort_by("turn").column(k).to_pylist() for k in ("row", *BOX)], strict=True):
            x1, y1, x2, y2 = box
            own = list(product(tiles(float(x1), float(x2)), tiles(float(y1), float(y2))))
            if not any(p <= x2 and x1 <= r and q <= y2 and y1 <= s for t in own for p, q, r, s in held.get(t, ())):
                free.append(row)
                for t in own:
                    held.setdefault(t, []).append((x1, y1, x2, y2))
        return pa.table({"placed": pa.array(free, pa.int64())})

    turn = F.row_number().over(Window.partitionBy("view").orderBy("rank")).alias("turn")
    return left.select("view", turn, c("rank.row").alias("row"), *BOX).groupBy("view").applyInArrow(run, "placed long")


def place_labels(jobs: DataFrame, front: int = 100, tile: float = 16.0, few: int = 100_000) -> DataFrame:
    """jobs (view, id, z, x1, y1, x2, y2) with free: whether the label is placed. Passive labels (z < front) come in order of z,
    then id; active ones after all of them, in order of z, then id. Views are independent; their labels need not meet in one
    task before at most few labels are open. tile: about the size of a label.

    Defined results. Bounds that are null or not finite: not placed, and in nobody's way. Null views are one view, null z comes
    first. Repeated rows: one of them is placed at most. Empty table: no row."""
    rows = store(jobs.select("view", "id", "z", *BOX).withColumn("row", F.monotonically_increasing_id()), "labels")
    rank = F.struct(F.coalesce(c("z") >= front, F.lit(False)).alias("active"), "z", "id", "row")
    finite = reduce(lambda a, b: a & b, [F.coalesce(F.abs(c(k).cast("double")) < float("inf"), F.lit(False)) for k in BOX])
    lone = rows.filter(finite).select("view", rank.alias("rank"), *BOX).groupBy("view", *BOX).agg(F.min("rank").alias("rank"))
    left = store(lone, "open")
    span = lambda lo, hi: F.sequence(F.floor(c(lo) / tile).cast("long"), F.floor(c(hi) / tile).cast("long"))
    spread = lambda df: df.withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2")))
    placed = []
    while open_ := left.count():
        if open_ <= few:
            placed.append(store(_in_turn(left, tile), "placed"))
            break
        tiles = spread(left)
        firsts = tiles.groupBy("view", "tx", "ty").agg(F.min(F.struct("rank", *BOX)).alias("m"))
        won = firsts.groupBy("view", "m").agg(F.count("*").alias("tiles")).filter(c("tiles") == F.size(span("m.x1", "m.x2")) * F.size(span("m.y1", "m.y2")))
        won = store(won.select(c("view").alias("a_view"), c("m.rank").alias("a_rank"), *[c(f"m.{k}").alias(f"a_{k}") for k in BOX]), "placed")
        near = won.withColumn("ax", F.explode(span("a_x1", "a_x2"))).withColumn("ay", F.explode(span("a_y1", "a_y2")))
        others = tiles.select("view", "tx", "ty", "rank", *[c(k).alias(f"b_{k}") for k in BOX])
        met = others.join(near, c("view").eqNullSafe(c("a_view")) & (c("tx") == c("ax")) & (c("ty") == c("ay"))).filter(rects_meet("a_", "b_") | (c("rank") == c("a_rank")))
        after = store(left.join(met.select(c("rank.row").alias("gone")).distinct(), c("rank.row") == c("gone"), "left_anti"), "open")
        discard(left)
        left = after
        placed.append(won.select(c("a_rank.row").alias("placed")))
    discard(left)
    if not placed:
        return rows.select("view", "id", "z", *BOX, F.lit(False).alias("free"))
    out = rows.join(reduce(DataFrame.unionAll, placed), c("row") == c("placed"), "left")
    return out.select("view", "id", "z", *BOX, c("placed").isNotNull().alias("free"))
