"""Contours of packed grids: crossings of levels and edges as columns, and lines traced from them.

Every crossing comes from native expressions over a surface's own array. Lines are traced on tiles: a tile links its own
crossings and hands on pieces, whose order along their line comes from pointer doubling over pieces. Neither a surface nor
a line need fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geometry import edge_contains, edge_weight
from fieldloom.operators.grid import contour_levels, horizontal_edges, vertical_edges
from fieldloom.stored import discard, store

#: What an edge's kind (horizontal, vertical, diagonal) adds to its first corner.
ENDS = ((1, 0), (0, 1), (1, 1))
#: Cells on the side of a tile.
SIDE = 128


def with_levels(packed: DataFrame) -> DataFrame:
    """packed with its contour levels, from its own least and greatest value."""
    return packed.withColumn("levels", contour_levels(F.array_min("buf"), F.array_max("buf")))


def crossings(packed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edge, x, y, level_no, level, px, py: where each level crosses each horizontal and vertical edge. A level
    list is a few numbers, so each edge filters it and explodes what is left; there is no join."""
    own = [*keys, "levels"]
    out = None
    for kind, edges in (("h", horizontal_edges(packed, own)), ("v", vertical_edges(packed, own))):
        hit = F.filter(F.transform("levels", lambda v, i: F.struct(i.alias("level_no"), v.alias("level"))), lambda s: edge_contains(F.col("a"), F.col("b"), s.level))
        each = edges.select(*keys, F.lit(kind).alias("edge"), "x", "y", "a", "b", F.explode(hit).alias("s")).select(*keys, "edge", "x", "y", "s.*", edge_weight(F.col("a"), F.col("b"), F.col("s.level")).alias("w"))
        px = F.col("x") + (1 - F.col("w")) if kind == "h" else F.col("x").cast("double")
        py = F.col("y") + (1 - F.col("w")) if kind == "v" else F.col("y").cast("double")
        each = each.select(*keys, "edge", "x", "y", "level_no", "level", px.alias("px"), py.alias("py"))
        out = each if out is None else out.unionByName(each)
    return out


def cut_tiles(packed: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """Tiles of side x side cells: keys, levels, width and height (of the surface), x0, y0, nx, ny, buf. Neighbouring tiles share
    their border's grid points."""
    out = packed.select(*keys, "levels", F.col("nx").cast("int").alias("width"), F.col("ny").cast("int").alias("height"), "buf")
    at = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - 2, F.lit(0)), F.lit(side)))
    out = out.select("*", at("height").alias("y0")).select("*", at("width").alias("x0"))
    out = out.withColumn("nx", F.least(F.lit(side + 1), F.col("width") - F.col("x0"))).withColumn("ny", F.least(F.lit(side + 1), F.col("height") - F.col("y0")))
    rows = F.transform(F.sequence(F.col("y0"), F.col("y0") + F.col("ny") - 1), lambda y: F.slice("buf", y * F.col("width") + F.col("x0") + 1, F.col("nx")))
    return out.withColumn("buf", F.flatten(rows))


def tile_levels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """tiles (without levels) with the contour levels of their whole surfaces."""
    ends = tiles.groupBy(*keys).agg(F.min(F.array_min("buf")).alias("lo"), F.max(F.array_max("buf")).alias("hi"))
    return tiles.join(ends.select(*keys, contour_levels(F.col("lo"), F.col("hi")).alias("levels")), keys)


def chains(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u -> v, of which no two begin or end alike: the first link of each one's chain, and its place there. A ring's
    chain begins at its least u. Pointers are doubled, so rounds follow the logarithm of the longest chain."""
    n = len(u)
    order = np.argsort(u)
    after = order[np.minimum(np.searchsorted(u, v, sorter=order), n - 1)]
    linked = np.flatnonzero(u[after] == v)
    before = np.full(n, -1)
    before[after[linked]] = linked
    jump, least = before.copy(), u.copy()
    while (live := np.flatnonzero(jump >= 0)).size:
        met, far = np.minimum(least[live], least[jump[live]]), jump[jump[live]]
        same = (met == least[live]).all() and (far >= 0).all()
        least[live], jump[live] = met, far
        if same:
            before[live[u[live] == least[live]]] = -1
            break
    head, place = np.where(before < 0, np.arange(n), before), (before >= 0).astype(int)
    while (place[head] > 0).any():
        place, head = place + place[head], head[head]
    return head, place


def tile_pieces(buf: np.ndarray, levels: list[float], x0: int, y0: int, width: int, height: int) -> Iterator[tuple]:
    """(level_no, level, piece, next, n, seed, seed_at, down, whole, xs, ys) of the stretches of lines that run through one tile.

    Each cell has two triangles, left of its diagonal and right of it; a level that crosses one edge of a triangle crosses one
    more. A line goes from the one to the other with the higher ground on one side, so every edge that it crosses has
    one way on and one way back. A piece is named by the first edge it crosses; the piece of the next tile begins with
    the edge that this one ends at, and next names it. next is null at the surface's border and the piece itself if a
    ring lies in the tile. Points are crossings of horizontal and vertical edges. seed is the least horizontal edge above
    the surface's last row; down: the line crosses it downwards. whole: the piece is all of its line."""
    ny, nx = buf.shape
    y, x = np.mgrid[y0 : y0 + ny - 1, x0 : x0 + nx - 1]
    name = lambda kind, i, j: ((y + j) * width + x + i) * 4 + kind
    top, right, left, bottom, across = name(0, 0, 0), name(1, 1, 0), name(1, 0, 0), name(0, 0, 1), name(2, 0, 0)
    border = lambda kind, i, j: kind == 0 and (j == 0 or j == height - 1) or kind == 1 and (i == 0 or i == width - 1)
    place_of = lambda edge: (edge & 3, (edge >> 2) % width, (edge >> 2) // width)
    for k, level in enumerate(levels):
        high = buf > level
        a, b, c, d = high[:-1, :-1], high[:-1, 1:], high[1:, 1:], high[1:, :-1]
        u, v = [], []
        for p, q, r, pq, qr, rp in ((a, b, c, top, right, across), (a, c, d, across, bottom, left)):
            crossed = ~((p == q) & (q == r))
            # Around a triangle the ground falls at one crossed edge, where the line comes in, and rises at the other.
            u.append(np.where(p & ~q, pq, np.where(q & ~r, qr, rp))[crossed])
            v.append(np.where(~p & q, pq, np.where(~q & r, qr, rp))[crossed])
        u, v = np.concatenate(u), np.concatenate(v)
        if not len(u):
            continue
        head, place = chains(u, v)
        order = np.lexsort((place, head))
        u, v, head = u[order], v[order], u[head[order]]
        starts = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(u)], strict=True):
            nodes, last = u[s:e], v[e - 1]
            ends = border(*place_of(last))
            whole = bool(last == nodes[0] or ends and border(*place_of(nodes[0])))
            nodes = np.r_[nodes, last] if ends and last != nodes[0] else nodes
            piece, nodes = int(nodes[0]), nodes[nodes & 3 != 2]
            kind, i, j = place_of(nodes)
            dx, dy = 1 - kind, kind
            p, q = buf[j - y0, i - x0], buf[j - y0 + dy, i - x0 + dx]
            w = 1 - (level - q) / (p - q)
            seeds = np.flatnonzero((kind == 0) & (j < height - 1))
            at = int(seeds[nodes[seeds].argmin()]) if len(seeds) else None
            seed = None if at is None else int(nodes[at])
            yield k, level, piece, None if ends else int(last), len(nodes), seed, at, None if at is None else bool(p[at] > q[at]), whole, i + w * dx, j + w * dy


def line_pieces(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level_no, level, piece, next, n, seed, seed_at, down, whole, xs, ys, error: what lines there are in each tile by itself. A
    tile without all its values gives a row with an error. Stored: one scan of the tiles."""
    rows = tiles.select(*keys, "width", "height", "x0", "y0", "nx", "ny", "buf", "levels")
    shape = ", ".join(f"{n} {t}" for n, t in rows.select(*keys).dtypes) + ", level_no int, level double, piece long, next long, n int, seed long, seed_at int, down boolean, whole boolean, xs array<double>, ys array<double>, error string"
    floats = pa.list_(pa.float64())
    kinds = {"level_no": pa.int32(), "level": pa.float64(), "piece": pa.int64(), "next": pa.int64(), "n": pa.int32(), "seed": pa.int64(), "seed_at": pa.int32(), "down": pa.bool_(), "whole": pa.bool_(), "xs": floats, "ys": floats, "error": pa.string()}

    def found(width, height, x0, y0, nx, ny, buf, levels) -> Iterator[tuple]:
        if not buf.is_valid or buf.values.null_count or len(buf) != nx * ny:
            yield (*[None] * 11, "cells are missing")
        elif nx > 1 and ny > 1:
            for p in tile_pieces(buf.values.to_numpy().reshape(ny, nx), levels or [], x0, y0, width, height):
                yield (*p, None)

    def run(batches):
        names = ("width", "height", "x0", "y0", "nx", "ny", "levels")
        for b in batches:
            for k in range(b.num_rows):
                own = {c: b.column(b.schema.get_field_index(c))[k].as_py() for c in names}
                rows = list(found(buf=b.column(b.schema.get_field_index("buf"))[k], **own))
                repeated = b.select(keys).take(pa.array([k] * len(rows), pa.int32()))
                data = {c: repeated.column(i) for i, c in enumerate(keys)}
                yield pa.RecordBatch.from_pydict(data | {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})

    return store(rows.mapInArrow(run, shape), "pieces")


def doubled(links: DataFrame, by: list[str], gather: dict[str, Column], rings: bool) -> DataFrame:
    """links (by, id, jump, and what gather names) after pointer doubling along jump: each round a row takes in what its jump's
    row has gathered (theirs_<name>) and jumps as far again, until all jumps are null or, with rings, only rings are left
    and nothing changes. Each round is one stored equality join."""
    names = list(gather)
    left = None
    while True:
        theirs = links.select(*[F.col(k).alias(f"their_{k}") for k in [*by, "id", "jump", *names]])
        both = links.join(theirs, [*[F.col(k) == F.col(f"their_{k}") for k in by], F.col("jump") == F.col("their_id")], "left")
        moved = both.select(*by, "id", F.col("their_jump").alias("jump"), *[v.alias(n) for n, v in gather.items()], *[F.col(n).alias(f"old_{n}") for n in names])
        now = store(moved, "doubled")
        differs = F.lit(False)
        for n in names:
            differs = differs | ~F.col(n).eqNullSafe(F.col(f"old_{n}"))
        open_, changed = now.agg(F.count("jump"), F.count_if(differs)).first()
        if hasattr(links, "stored_at"):
            discard(links)
        path = now.stored_at
        links = now.drop(*[f"old_{n}" for n in names])
        links.stored_at = path
        if not open_ or rings and open_ == left and not changed:
            return links
        left = open_


def joined_pieces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with the line each belongs to: seed (which names the line within its level), closed, start (its first point's
    place along the line), total (points of the line), at (the seed's place) and down. Lines without a seed are left out,
    as they are by a search from horizontal edges."""
    by = [*keys, "level_no"]
    fine = pieces.filter(F.col("error").isNull())
    # Most lines of rough ground lie in one tile: these are complete as they are.
    alone = fine.filter("whole and seed is not null").select(*by, "level", "seed", F.col("next").isNotNull().alias("closed"), F.col("n").cast("long").alias("total"), F.lit(0).cast("long").alias("start"), F.col("seed_at").cast("long").alias("at"), "down", "xs", "ys")
    split = fine.filter("not whole").withColumnRenamed("piece", "id")
    links = split.select(*by, "id", F.col("next").alias("jump"), "seed", F.when(F.col("next").isNull(), F.col("id")).alias("tail"))
    gather = {"seed": F.least("seed", "their_seed"), "tail": F.coalesce("tail", "their_tail")}
    found = doubled(links, by, gather, rings=True)
    tails = found.filter("tail is not null").groupBy(*by, "tail").agg(F.min("seed").alias("first"))
    found = found.withColumn("closed", F.col("tail").isNull()).join(tails, [*by, "tail"], "left").select(*by, "id", "closed", F.coalesce("first", "seed").alias("line"))
    parts = split.select(*by, "id", "next", "n", "seed", "seed_at", "down").join(found, [*by, "id"]).filter("line is not null")
    parts = store(parts, "parts")
    # A ring is opened before the piece that holds its seed.
    firsts = parts.filter("seed = line").select(*by, "line", F.col("id").alias("opens"), F.col("seed_at").alias("offset"), F.col("down").alias("downward"))
    cut = parts.select(*by, "line", "closed", "id", "next", "n").join(firsts, [*by, "line"])
    links = cut.select(*by, "id", F.when(~F.col("closed") | (F.col("next") != F.col("opens")), F.col("next")).alias("jump"), F.col("n").cast("long").alias("rest"))
    ranked = doubled(links, by, {"rest": F.col("rest") + F.coalesce("their_rest", F.lit(0))}, rings=False)
    ranked = store(ranked.select(*by, "id", "rest").join(cut, [*by, "id"]), "ranked")
    totals = ranked.groupBy(*by, "line").agg(F.sum("n").alias("total"), F.max(F.when(F.col("id") == F.col("opens"), F.col("rest"))).alias("ahead"))
    ranked = ranked.join(totals, [*by, "line"]).select(*by, "id", F.col("line").alias("seed"), "closed", "total", (F.col("total") - F.col("rest")).alias("start"), (F.col("total") - F.col("ahead") + F.col("offset")).alias("at"), F.col("downward").alias("down"))
    # Points are fetched once, when all else is known.
    return alone.unionByName(split.select(*by, "id", "level", "xs", "ys").join(ranked, [*by, "id"]).drop("id"))


def line_vertices(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level_no, level, seed, closed, seq, x, y: a row a vertex, in the order of a trace that goes down from the seed. A
    closed line begins at its seed. An open one is that trace reversed and then the one upwards, so it has its seed
    twice. A line's rows need not meet in one task."""
    out = parts.select(*keys, "level_no", "level", "seed", "closed", "total", "start", "at", "down", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    ahead = F.when(F.col("down"), F.col("start") + F.col("i") - F.col("at")).otherwise(F.col("at") - F.col("start") - F.col("i"))
    ring = F.array(F.pmod(ahead, F.col("total")))
    # Ahead of the seed (downwards) come the points from the far end on, then the seed twice, then those behind it.
    reach = F.when(F.col("down"), F.col("total") - 1 - F.col("at")).otherwise(F.col("at"))
    line = F.when(ahead > 0, F.array(reach - ahead)).when(ahead < 0, F.array(reach + 1 - ahead)).otherwise(F.array(reach, reach + 1))
    return out.withColumn("seq", F.explode(F.when(F.col("closed"), ring).otherwise(line))).select(*keys, "level_no", "level", "seed", "closed", "seq", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def in_order(v: Column) -> Column:
    """An array along a whole line, in the order of line_vertices; at and down are columns."""
    at = F.col("at")
    before, upto, since, after = F.slice(v, F.lit(1), at), F.slice(v, F.lit(1), at + 1), F.slice(v, at + 1, F.size(v) - at), F.slice(v, at + 2, F.greatest(F.size(v) - at - 1, F.lit(0)))
    ring = F.when(F.col("down"), F.concat(since, before)).otherwise(F.concat(F.reverse(upto), F.reverse(after)))
    line = F.concat(upto, since)
    return F.when(F.col("closed"), ring).when(F.col("down"), F.reverse(line)).otherwise(line)


def traced(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The vertices of all contour lines of surfaces cut into tiles (see cut_tiles), and a row with an error, and else nulls, for
    each tile without all its values."""
    pieces = line_pieces(tiles, keys)
    out = line_vertices(joined_pieces(pieces, keys), keys).withColumn("error", F.lit(None).cast("string"))
    return out.unionByName(pieces.filter("error is not null").select(*keys, "error"), allowMissingColumns=True)


def contour_lines(packed: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """keys, level_no, level, line_no, closed, xs, ys, error: one row a line, numbered within its level by seed. packed has
    levels. Surfaces with null cells give a row with an error. Lines longer than a row can hold: use traced."""
    odd = F.col("buf").isNull() | F.exists("buf", lambda v: v.isNull()) | (F.size("buf") != F.col("nx") * F.col("ny"))
    parts = joined_pieces(line_pieces(cut_tiles(packed.filter(~odd), keys, side), keys), keys)
    # One shuffle, of arrays: the numbers need a level's lines together anyway.
    whole = parts.repartition(*keys, "level_no").groupBy(*keys, "level_no", "level", "seed", "closed").agg(F.array_sort(F.collect_list(F.struct("start", "xs", "ys"))).alias("p"), F.first(F.col("at").cast("int")).alias("at"), F.first("down").alias("down"))
    number = F.row_number().over(Window.partitionBy(*keys, "level_no").orderBy("seed")) - 1
    lines = whole.select(*keys, "level_no", "level", number.alias("line_no"), "closed", in_order(F.flatten("p.xs")).alias("xs"), in_order(F.flatten("p.ys")).alias("ys"), F.lit(None).cast("string").alias("error"))
    return lines.unionByName(packed.filter(odd).select(*keys, F.lit("cells are missing").alias("error")), allowMissingColumns=True)
