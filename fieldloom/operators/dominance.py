"""Counts, sums and minima over range joins whose pairs are never listed.

What meets a rectangle is what begins at or before its end, without what ends before its beginning, in x and in y: four sums
over points that lie below a corner. Such a sum is taken over the powers of two that make up the corner's rank in x; in each
block of ranks the points at or below the corner in y are added up along y. So the work follows the distinct corners, times
the logarithm of the distinct x, however many pairs there are. Blocks are dealt out by ranges of y as well: a block may
fill any number of tasks, and only one row a task is carried on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import rects_meet
from fieldloom.stored import discard, store

c = F.col
BOX = ["x1", "y1", "x2", "y2"]
PROBE = ["kind", "x", "y", "below_x", "below_y"]


def _totals(sums: list[str], mins: list[str], of=lambda k: c(k)) -> list[Column]:
    return [F.sum(of(k)).alias(k) for k in sums] + [F.min(of(k)).alias(k) for k in mins]


def _along(rows: DataFrame, block: list[str], order: list[str], sums: list[str], mins: list[str]) -> DataFrame:
    """rows with sums and mins over the rows of the same block up to each, in order. Rows are dealt out by ranges; a block that
    goes on from range to range carries one row a range. Stored."""
    dealt = store(rows.repartitionByRange(*block, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy(*block).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *block).agg(*_totals(sums, mins), F.lit(True).alias("_begun"))
    carried = [f(k).over(before).alias(f"_so_far_{k}") for f, ks in ((F.sum, sums), (F.min, mins)) for k in ks]
    # Only the first block of a range can have begun before it.
    parts = parts.select("_part", *block, F.max("_begun").over(before).alias("_begun"), *carried).filter("_begun").drop("_begun")
    inside = Window.partitionBy("_part", *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.select(*[k for k in dealt.columns if k not in (*sums, *mins)], *[f(k).over(inside).alias(k) for f, ks in ((F.sum, sums), (F.min, mins)) for k in ks])
    out = out.join(F.broadcast(parts), ["_part", *block], "left")
    both = lambda k: F.coalesce(c(k), F.lit(0)) + F.coalesce(c(f"_so_far_{k}"), F.lit(0))
    names = [k for k in rows.columns if k not in (*sums, *mins)]
    done = store(out.select(*names, *[both(k).alias(k) for k in sums], *[F.least(k, f"_so_far_{k}").alias(k) for k in mins]), "along")
    discard(dealt)
    return done


def dominated(points: DataFrame, probes: DataFrame, sums: list[str], mins: list[str] = ()) -> DataFrame:
    """probes (kind, x, y, below_x, below_y), each once, with the sums (of longs) and mins over the points (kind, x, y, ...) of
    its kind that have neither a larger x nor a larger y; below_x, below_y: smaller ones only. Probes above no x are left out."""
    sums, mins = list(sums), list(mins)
    points = store(points.dropna(subset=["x", "y"]).groupBy("kind", "x", "y").agg(*_totals(sums, mins)), "points")
    probes = store(probes.select(*PROBE).dropna().distinct(), "probes")
    held = points.select("kind", "x", F.lit(1).alias("upto")).unionByName(probes.select("kind", "x", F.lit(0).alias("upto")))
    held = held.groupBy("kind", "x").agg(F.max("upto").cast("long").alias("upto"))
    ranks = _along(held.withColumn("here", c("upto")), ["kind"], ["x"], ["upto"], [])
    levels = F.sequence(F.lit(0), F.lit(max(0, (ranks.agg(F.max("upto")).first()[0] or 0).bit_length() - 1)))
    up = lambda k: F.call_function("shiftright", c(k), c("level"))
    # A rank's bits name the blocks before it; all of them have even numbers.
    given = points.join(ranks, ["kind", "x"]).withColumn("rank", c("upto") - 1).withColumn("level", F.explode(levels)).withColumn("block", up("rank")).filter("block % 2 = 0")
    given = given.groupBy("kind", "level", "block", "y").agg(*_totals(sums, mins))
    asked = probes.join(ranks, ["kind", "x"]).withColumn("rank", c("upto") - F.when(c("below_x"), c("here")).otherwise(0))
    asked = asked.withColumn("level", F.explode(levels)).withColumn("block", up("rank") - 1).filter("block >= 0 and block % 2 = 0")
    nothing = [F.lit(None).cast(t).alias(k) for k, t in given.dtypes if k in (*sums, *mins)]
    types = dict(probes.dtypes)
    rows = given.select("kind", "level", "block", "y", F.lit(1).alias("turn"), *[F.lit(None).cast(types[k]).alias(k) for k in ("x", "below_x", "below_y")], *sums, *mins)
    rows = rows.unionByName(asked.select("kind", "level", "block", "y", F.when(c("below_y"), 0).otherwise(2).alias("turn"), "x", "below_x", "below_y", *nothing))
    out = _along(rows, ["kind", "level", "block"], ["y", "turn"], sums, mins).filter("turn <> 1")
    return out.groupBy(*PROBE).agg(*_totals(sums, mins))


def _corners(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], *keep: str) -> DataFrame:
    """rows by the four kinds of corner: x and y are the first one's, or the second one's if the kind's bit is set."""
    kinds = [F.struct(F.lit(k).alias("kind"), c((second if k & 1 else first)[0]).alias("x"), c((second if k & 2 else first)[1]).alias("y"), F.lit(bool(k & 1)).alias("below_x"), F.lit(bool(k & 2)).alias("below_y"), F.lit((1, -1, -1, 1)[k]).alias("turn")) for k in range(4)]
    return rows.select(*keep, F.explode(F.array(*kinds)).alias("k")).select(*keep, "k.*")


def rect_sums(queries: DataFrame, items: DataFrame, values: tuple[str, ...] = (), sign: str | None = None) -> DataFrame:
    """id, n and the sums of values (longs) over the items (x1, y1, x2, y2, values) that meet each of queries (id, x1, y1, x2,
    y2), both with x1 <= x2 and y1 <= y2; others meet nothing. Ids that meet nothing are left out; those of several rows are
    added up, each row times its sign."""
    right = (c("x1") <= c("x2")) & (c("y1") <= c("y2"))
    real = lambda df: df.withColumns({k: c(k).cast("double") for k in BOX}).filter(right)
    sums = ["n", *values]
    held = real(items).groupBy(*BOX).agg(F.count("*").alias("n"), *[F.sum(c(k).cast("long")).alias(k) for k in values])
    points = _corners(held, ("x1", "y1"), ("x2", "y2"), *sums).select("kind", "x", "y", *sums)
    own = real(queries).groupBy("id", *BOX).agg(F.sum(c(sign) if sign else F.lit(1)).alias("times"))
    own = store(own, "asked")
    probes = _corners(own.select(*BOX).distinct(), ("x2", "y2"), ("x1", "y1"), *BOX)
    found = probes.join(dominated(points, probes, sums), PROBE).groupBy(*BOX).agg(*[F.sum(c("turn") * c(k)).alias(k) for k in sums])
    return own.join(found, BOX).groupBy("id").agg(*[F.sum(c("times") * c(k)).alias(k) for k in sums]).filter("n <> 0")


def interval_sums(asked: DataFrame, held: DataFrame, sums: tuple[str, ...] = (), mins: tuple[str, ...] = ()) -> DataFrame:
    """id, n, the sums (of longs) and mins over the closed intervals held (start, stop, ...) that overlap each of asked (id, start,
    stop). Ids that overlap nothing are left out; those of several rows count each."""
    real = lambda df, x, y: df.withColumn("x", c(x).cast("double")).withColumn("y", -c(y).cast("double")).withColumn("kind", F.lit(0))
    points = real(held, "start", "stop").select("kind", "x", "y", F.lit(1).cast("long").alias("n"), *[c(k).cast("long").alias(k) for k in sums], *mins)
    probes = real(asked, "stop", "start").select("id", "kind", "x", "y", F.lit(False).alias("below_x"), F.lit(False).alias("below_y"))
    found = dominated(points, probes, ["n", *sums], list(mins)).filter("n > 0")
    return probes.join(found, PROBE).groupBy("id").agg(*_totals(["n", *sums], list(mins)))


def contained_counts(windows: DataFrame, items: DataFrame, tile: float) -> DataFrame:
    """id, n: how many items (x1, y1, x2, y2) lie strictly inside each of windows (id, x1, y1, x2, y2); none: no row.

    What meets a window is inside it or meets its edges. An item narrower and lower than the window cannot reach two opposite
    edges, so it meets edges in one stretch: one edge more than corners. Windows no larger than the largest item are
    compared with the items that begin in them, equal ones once."""
    right = (c("x1") <= c("x2")) & (c("y1") <= c("y2"))
    size = items.filter(right).agg(F.max(c("x2") - c("x1")).alias("_w"), F.max(c("y2") - c("y1")).alias("_h"))
    asked = windows.select("id", *BOX).filter(right).join(F.broadcast(size))
    large = (c("x2") - c("x1") > c("_w")) & (c("y2") - c("y1") > c("_h"))
    xs, ys = ("x1", "x2"), ("y1", "y2")
    edges = [("x1", y, "x2", y) for y in ys] + [(x, "y1", x, "y2") for x in xs]
    pieces = [(1, tuple(BOX)), *[(-1, e) for e in edges], *[(1, (x, y, x, y)) for x in xs for y in ys]]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("sign"), *[c(v).alias(k) for k, v in zip(BOX, p, strict=True)]) for n, p in pieces]))
    counted = rect_sums(asked.filter(large).select("id", parts.alias("p")).select("id", "p.*"), items, sign="sign")
    cell = lambda k: F.floor(c(k) / tile).cast("long")
    small = asked.filter(~large).select("id", *[c(k).alias(f"a_{k}") for k in BOX])
    boxes = small.select(*[f"a_{k}" for k in BOX]).distinct()
    for k in "xy":
        boxes = boxes.withColumn(f"t{k}", F.explode(F.sequence(cell(f"a_{k}1"), cell(f"a_{k}2"))))
    own = items.filter(right).groupBy(*BOX).agg(F.count("*").alias("n")).select("n", *[c(k).alias(f"b_{k}") for k in BOX])
    own = own.withColumn("tx", cell("b_x1")).withColumn("ty", cell("b_y1"))
    inside = reduce(Column.__and__, [c(f"a_{k}1") < c(f"b_{k}1") for k in "xy"] + [c(f"a_{k}2") > c(f"b_{k}2") for k in "xy"])
    pairs = boxes.join(own, ["tx", "ty"]).filter(inside & rects_meet("a_", "b_")).groupBy(*[f"a_{k}" for k in BOX]).agg(F.sum("n").alias("n"))
    listed = small.join(pairs, [f"a_{k}" for k in BOX]).select("id", "n")
    return counted.unionByName(listed).groupBy("id").agg(F.sum("n").alias("n"))


def index_statistics(items: DataFrame, queries: DataFrame, tile: float) -> DataFrame:
    """query_id, candidates, hits: how many items (x1, y1, x2, y2) share a tile with each of queries (id, x1, y1, x2, y2), and
    how many meet it."""
    tiles = lambda df: df.withColumns({k: F.floor(c(k) / tile).cast("double") for k in BOX})
    near, met = rect_sums(tiles(queries), tiles(items)), rect_sums(queries, items)
    return near.select(c("id").alias("query_id"), c("n").alias("candidates")).join(met.select(c("id").alias("query_id"), c("n").alias("hits")), "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
