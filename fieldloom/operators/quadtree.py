"""Region quadtrees built level by level, and range joins on tiles that split where the data are dense.

A node holds what it is given until it has more than SPILL items; then it hands all of them on, each to the quarter that
strictly contains it, and keeps for good what no quarter contains. So of n items given in order, the last n modulo SPILL + 1
stay, and all before are handed on in the same order: a level follows from counts and the last few items of each node,
both partial aggregates, and no insertion is ever replayed. Nodes with many items are split so, level by level; the subtree
below a node with few is grown in one task by the same rule, so the rounds follow the number of items and not the depth.

Joins use leaves instead: places are counted by Morton prefix, prefixes with more than `most` places are split, and both
sides are dealt to the leaves they touch by descending through the split prefixes. A hot spot is split until it is thin; a
huge rectangle goes to the leaves that exist and not to every tile of a fixed grid.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import rects_meet
from fieldloom.operators.dominance import rect_sums
from fieldloom.stored import discard, store

c = F.col
BOX = ["x1", "y1", "x2", "y2"]
#: Items that a node keeps before it splits, and the deepest level that may split.
SPILL, DEEPEST = 10, 40
#: Items of the largest subtree that one task grows.
MOST = 50_000


def _quarter(i: int, box: str = "n") -> list[Column]:
    """Bounds of a node's quarter: the lower bit moves right, the higher one down."""
    x1, y1, x2, y2 = (c(f"{box}{k}") for k in BOX)
    cx, cy = (x1 + x2) * 0.5, (y1 + y2) * 0.5
    return [cx if i & 1 else x1, cy if i & 2 else y1, x2 if i & 1 else cx, y2 if i & 2 else cy]


def _grown(spill: int, deepest: int):
    """A task's part of build: the whole subtree below one node, from its items in order. Gives items with their node, and the
    nodes themselves with item null."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        t = t.take(pc.sort_indices(t["pos"]))
        box = [pc.cast(t[f"b{k}"], pa.float64()) for k in BOX]
        known = ~np.logical_or.reduce([v.is_null().to_numpy() for v in box])
        x1, y1, x2, y2 = (v.to_numpy() for v in box)
        names, depth = np.array([t["node"][0].as_py()], dtype=object), t["depth"][0].as_py()
        bounds = np.array([[t[f"n{k}"][0].as_py() for k in BOX]])
        at, node = np.arange(len(t)), np.zeros(len(t), dtype=np.int64)
        held, tree = [], []
        while len(at):
            n = np.bincount(node, minlength=len(names))
            split = (n > spill) & (depth < deepest)
            by = np.argsort(node, kind="stable")
            at, node = at[by], node[by]
            place = np.arange(len(at)) - (np.cumsum(n) - n)[node]
            on = split[node] & (place < (n - n % (spill + 1))[node])
            left, top, right, low = bounds[node].T
            cx, cy = (left + right) * 0.5, (top + low) * 0.5
            quarter = np.full(len(at), -1)
            for i in (3, 2, 1, 0):
                q = (cx if i & 1 else left, cy if i & 2 else top, right if i & 1 else cx, low if i & 2 else cy)
                # Not a number is above all numbers, as it is in SQL.
                inside = ~(x1[at] <= q[0]) & (x2[at] < q[2]) & ~(y1[at] <= q[1]) & (y2[at] < q[3])
                quarter[on & known[at] & inside] = i
            stays = quarter < 0
            held.append((at[stays], names[node[stays]], on[stays]))
            tree.append((names, np.full(len(names), depth), n, split, bounds))
            kids, index = np.unique((node * 4 + quarter)[~stays], return_inverse=True)
            up, q = kids // 4, kids % 4
            mid = (bounds[:, :2] + bounds[:, 2:]) * 0.5
            bits = np.stack([q & 1, q >> 1], axis=1).astype(bool)
            bounds = np.concatenate([np.where(bits, mid[up], bounds[up, :2]), np.where(bits, bounds[up, 2:], mid[up])], axis=1)
            names = names[up] + np.array(list("0123"), dtype=object)[q] if len(q) else names[:0]
            at, node, depth = at[~stays], index, depth + 1
        rows, of, big = (np.concatenate(x) for x in zip(*held, strict=True))
        names, depths, n, split, bounds = (np.concatenate(x) for x in zip(*tree, strict=True))
        items, none = t["item"].combine_chunks(), lambda k, kind: pa.nulls(k, kind)
        both = lambda a, b: pa.concat_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a, b])
        i, j = len(rows), len(names)
        out = [
            both(items.take(pa.array(rows)), none(j, items.type)), pa.array(np.concatenate([of, names]), pa.string()), both(pa.array(big), none(j, pa.bool_())),
            both(none(i, pa.int32()), pa.array(depths, pa.int32())), *[both(none(i, pa.float64()), pa.array(np.ascontiguousarray(bounds[:, k]))) for k in range(4)],
            both(none(i, pa.int64()), pa.array(n, pa.int64())), both(none(i, pa.bool_()), pa.array(split)),
        ]
        return pa.Table.from_arrays(out, ["item", "node", "big", "depth", *[f"n{k}" for k in BOX], "n", "split"])

    return run


def build(items: DataFrame, bounds: tuple[float, float, float, float], order: list[str], spill: int = SPILL, deepest: int = DEEPEST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """nodes (node, depth, nx1, ny1, nx2, ny2, n items given, split, held) that were given items, and placed (items with node
    and big: kept for good). items (id, x1, y1, x2, y2, ...) are inserted by order. A node is named by the quarters that
    lead to it. All of an empty tree's tables are empty. Both stored. Nodes given more than most items are split level by
    level; the subtree below any other is grown in one task."""
    most = max(most, spill)
    rows = items.withColumn("row", F.monotonically_increasing_id())
    when = F.struct(*order, "row")
    shape = ["node", *[f"n{k}" for k in BOX]]
    box = [c(k).alias(f"b{k}") for k in BOX]
    now = store(rows.select(F.struct(*items.columns).alias("item"), *box, when.alias("at"), F.lit("").alias("node"), *[F.lit(float(v)).alias(f"n{k}") for k, v in zip(BOX, bounds, strict=True)]), "given")
    keep, used, nodes, placed, small = now.columns, [now], [], [], []
    for depth in range(deepest + 2):
        large = store(now.groupBy(*shape).agg(F.count("*").alias("n")).filter(c("n") > most), "large")
        used.append(large)
        if not large.limit(1).count():
            small.append(now.select(*keep, F.lit(depth).alias("depth")))
            break
        # Only the last few of a node's items are looked at, and partial limits keep all others from being shuffled.
        late = now.join(large.select("node"), "node").select("node", "at", F.row_number().over(Window.partitionBy("node").orderBy(c("at").desc())).alias("back")).filter(c("back") <= spill)
        late = late.groupBy("node").agg(F.array_sort(F.collect_list("at")).alias("late"))
        stay = (c("n") % (spill + 1)).cast("int")
        splits = (c("n") > spill) & F.lit(depth < deepest)
        level = store(large.join(late, "node").select(*shape, "n", splits.alias("split"), F.when(stay > 0, F.get("late", F.size("late") - stay)).alias("since")), "nodes")
        both = now.join(level.select("node", "split", "since"), "node", "left")
        quarter = F.coalesce(*[F.when((c("bx1") > q[0]) & (c("bx2") < q[2]) & (c("by1") > q[1]) & (c("by2") < q[3]), F.lit(i)) for i, q in ((i, _quarter(i)) for i in range(4))])
        on = c("split") & F.coalesce(c("at") < c("since"), F.lit(True))
        moved = store(both.withColumn("on", on).withColumn("quarter", F.when(c("on"), quarter)).select(*keep, "on", "quarter"), "moved")
        used += [level, moved]
        small.append(moved.filter("on is null").select(*keep, F.lit(depth).alias("depth")))
        placed.append(moved.filter("on is not null and quarter is null").select("item", "node", c("on").alias("big")))
        nodes.append(level.select(*shape, "n", "split", F.lit(depth).alias("depth")))
        inner = F.array(*[F.struct(*[v.alias(f"n{k}") for k, v in zip(BOX, _quarter(i), strict=True)]) for i in range(4)])
        now = moved.filter("quarter is not null").withColumn("inner", F.get(inner, c("quarter"))).select("item", *[f"b{k}" for k in BOX], "at", F.concat("node", c("quarter").cast("string")).alias("node"), "inner.*")
    left = reduce(DataFrame.unionByName, small)
    left = left.select("item", *[f"b{k}" for k in BOX], *shape, "depth", F.row_number().over(Window.partitionBy("node").orderBy("at")).alias("pos"))
    kinds = f"item {left.schema['item'].dataType.simpleString()}, node string, big boolean, depth int, {', '.join(f'n{k} double' for k in BOX)}, n long, split boolean"
    grown = store(left.groupBy("node").applyInArrow(_grown(spill, deepest), kinds), "grown")
    own = grown.filter("n is null").select("item", "node", "big")
    all_placed = store(reduce(DataFrame.unionByName, [own, *placed]).select("item.*", "node", "big"), "placed")
    held = all_placed.groupBy("node").agg(F.count("*").alias("held"))
    own = grown.filter("n is not null").select(*shape, "n", "split", "depth")
    table = reduce(DataFrame.unionByName, [own, *nodes]).join(held, "node", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    done = store(table.select("node", "depth", *[f"n{k}" for k in BOX], "n", "split", "held"), "tree")
    discard(grown, *used)
    return done, all_placed


def statistics(nodes: DataFrame) -> DataFrame:
    """node_count and size: nodes but for the root (each split makes four), and items."""
    return nodes.agg((F.count_if("split") * 4).alias("node_count"), F.coalesce(F.sum("held"), F.lit(0)).alias("size"))


def descend(queries: DataFrame, splits: DataFrame, bounds: tuple[float, float, float, float], depth: int, leaves: bool = False) -> DataFrame:
    """queries (id, x1, y1, x2, y2, ...) with each node (and its bounds nx1 ...) they meet on their way down through the nodes of
    splits (node), the root always; leaves: only those that are not split. depth: of the deepest split."""
    at = queries.withColumn("node", F.lit(""))
    for k, v in zip(BOX, bounds, strict=True):
        at = at.withColumn(f"n{k}", F.lit(float(v)))
    seen = []
    for _ in range(depth + 2):
        found = at.join(splits.select("node", F.lit(True).alias("open")), "node", "left")
        seen.append(found.filter("open is null").drop("open") if leaves else found.drop("open"))
        kids = F.array(*[F.struct(F.concat("node", F.lit(str(i))).alias("node"), *[v.alias(f"n{k}") for k, v in zip(BOX, _quarter(i), strict=True)]) for i in range(4)])
        down = found.filter("open").withColumn("kid", F.explode(kids)).select(*queries.columns, "kid.*")
        at = down.filter(rects_meet("", "n"))
    return reduce(DataFrame.unionByName, seen)


def candidates(nodes: DataFrame, placed: DataFrame, queries: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """query_id, candidates, hits: items in the nodes that each query (id, x1, y1, x2, y2) visits, and those that meet it. A
    query visits the root and every node that it meets, as it meets those above it too; so both are counted as sums over
    rectangles, and neither visits nor pairs are listed. bounds: the root's, which every query visits wherever it lies."""
    inner = nodes.filter("node <> '' and held > 0").select("held", *[c(f"n{k}").alias(k) for k in BOX])
    below, met = rect_sums(queries, inner, ("held",)), rect_sums(queries, placed)
    out = queries.groupBy("id").agg(F.count("*").alias("times")).join(F.broadcast(nodes.filter("node = ''").select(c("held").alias("top"))))
    out = out.join(below.select("id", "held"), "id", "left").join(met.select("id", c("n").alias("hits")), "id", "left")
    seen = c("times") * c("top") + F.coalesce("held", F.lit(0))
    return out.select(c("id").alias("query_id"), seen.alias("candidates"), F.coalesce("hits", F.lit(0)).alias("hits"))


def thick(places: DataFrame, bounds: tuple[float, float, float, float], most: int, deepest: int = 16) -> tuple[DataFrame, int]:
    """splits (node) for places (x, y): the prefixes, up to deepest quarters long, with more than most places; and the length of
    the longest. Counts of a level are added up from those of the level below."""
    x1, y1, x2, y2 = bounds
    side = 1 << deepest
    cell = lambda v, lo, hi: F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((c(v) - lo) / (hi - lo) * side))).cast("long")
    counts = places.select(cell("x", x1, x2).alias("i"), cell("y", y1, y2).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    counts = store(counts, "cells")
    found, longest = [], -1
    bit = lambda k: (F.shiftright(c("i"), k) % 2 + 2 * (F.shiftright(c("j"), k) % 2)).cast("string")
    for depth in range(deepest - 1, -1, -1):
        up = store(counts.groupBy(F.shiftright("i", 1).alias("i"), F.shiftright("j", 1).alias("j")).agg(F.sum("n").alias("n")), "cells")
        discard(counts)
        counts = up
        name = F.concat(F.lit(""), *[bit(k) for k in range(depth - 1, -1, -1)])
        over = up.filter(c("n") > most).select(name.alias("node"))
        if longest >= 0 or over.limit(1).count():
            longest = max(longest, depth)
            found.append(store(over, "splits"))
    discard(counts)
    empty = places.sparkSession.createDataFrame([], "node string")
    return (reduce(DataFrame.unionByName, found) if found else empty), longest


def adaptive_rect_join(a: DataFrame, b: DataFrame, most: int = 1000) -> DataFrame:
    """Pairs of rectangles (id, x1, y1, x2, y2) that meet: a_id, b_id and both rectangles prefixed. Tiles are split where more
    than most of both sides' lower corners lie; a pair is reported in the leaf of its overlap's lower corner."""
    both = a.select(*BOX).unionByName(b.select(*BOX))
    ends = both.agg(*[f(k).cast("double") for f, k in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))]).first()
    low, high = (ends[0] or 0.0, ends[1] or 0.0), (ends[2] or 0.0, ends[3] or 0.0)
    # A little beyond the last corner, so that half-open leaves hold every corner.
    size = max(high[0] - low[0], high[1] - low[1], 1.0) * 1.0001
    bounds = (low[0], low[1], low[0] + size, low[1] + size)
    splits, longest = thick(both.select(c("x1").alias("x"), c("y1").alias("y")), bounds, most)
    deal = lambda df: descend(df.select("id", *BOX), splits, bounds, longest, leaves=True)
    side = lambda df, p: deal(df).select("node", *[c(k).alias(f"{p}{k}") for k in ("id", *BOX)])
    left = deal(a).select("node", "nx1", "ny1", "nx2", "ny2", *[c(k).alias(f"a_{k}") for k in ("id", *BOX)])
    pairs = left.join(side(b, "b_"), "node").filter(rects_meet("a_", "b_"))
    x, y = F.greatest("a_x1", "b_x1"), F.greatest("a_y1", "b_y1")
    here = (x >= c("nx1")) & (x < c("nx2")) & (y >= c("ny1")) & (y < c("ny2"))
    return pairs.filter(here).drop("node", "nx1", "ny1", "nx2", "ny2")
