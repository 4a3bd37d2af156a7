"""Grids, contours, clipping, labels and joins as properties and against brute force."""

import math
import random
import time

from pyspark.sql import functions as F

from fieldloom.operators import clip, contour, grid, labels
from fieldloom.operators import spatial as s


def hills(spark):
    return grid.to_packed(grid.test_surface(spark).withColumn("surface_id", F.lit("a")), ["surface_id"]).cache()


def test_surface_and_levels(spark):
    p = contour.with_levels(hills(spark))
    r = p.first()
    assert abs(min(r.buf) - 0.02016899987722955) < 1e-12 and abs(max(r.buf) - 1.032495728775562) < 1e-12 and abs(sum(r.buf) - 4820.027209491546) < 1e-6
    assert abs(r.buf[5050] - 0.44882270461429796) < 1e-12 and len(r.levels) == 12
    got = {(x.edge, x.level_no): x["count"] for x in contour.crossings(p, ["surface_id"]).groupBy("edge", "level_no").count().collect()}
    assert [got.get(("h", k), 0) for k in range(12)] == [0, 0, 86, 170, 203, 246, 220, 186, 158, 128, 88, 0]
    assert [got.get(("v", k), 0) for k in range(12)] == [0, 0, 66, 123, 165, 187, 193, 165, 141, 115, 88, 0]


def test_lines(spark):
    p = contour.with_levels(hills(spark))
    lines = contour.contour_lines(p, ["surface_id"]).orderBy("level_no", "line_no").collect()
    sizes: dict = {}
    for r in lines:
        sizes.setdefault(r.level_no, []).append(f"{len(r.xs)}{'*' * r.closed}")
    want = {2: "80 18 57", 3: "141 14 65 77", 4: "136 30 114* 91", 5: "336 98*", 6: "174* 86* 154", 7: "146* 72* 134", 8: "122* 60* 118", 9: "96* 48* 100", 10: "32* 64* 80*"}
    assert {k: sorted(v) for k, v in sizes.items()} == {k: sorted(v.split()) for k, v in want.items()}
    # Every crossing is on a line, and lines hold nothing else.
    seen = {(r.level_no, round(x, 9), round(y, 9)) for r in lines for x, y in zip(r.xs, r.ys, strict=True)}
    assert seen == {(r.level_no, round(r.px, 9), round(r.py, 9)) for r in contour.crossings(p, ["surface_id"]).collect()}


def test_cells_round_trip_and_flat_grid(spark):
    p = spark.createDataFrame([("a", 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("flat", 2, 2, [1.0] * 4)], "surface_id string, nx int, ny int, buf array<double>")
    back = {r.surface_id: tuple(r) for r in grid.to_packed(grid.to_cells(p, ["surface_id"]), ["surface_id"]).collect()}
    assert back == {r.surface_id: tuple(r) for r in p.collect()}
    assert contour.contour_lines(contour.with_levels(p.filter("surface_id = 'flat'")), ["surface_id"]).count() == 0


def test_warp_keeps_far_cells(spark):
    p = hills(spark)
    a, b = p.first().buf, grid.warp(p, 20.0, 20.0, 24.0, 20.0).first().buf
    far = [k for k in range(10000) if (k % 100 - 24) ** 2 + (k // 100 - 20) ** 2 > 3001]
    assert all(a[k] == b[k] for k in far) and abs(b[2024] - a[2020]) < 0.05 and a != b


def area(ring):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_clip():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    moved = [(x + 1.5, y + 2.5) for x, y in square]
    assert [area(r) for r in clip.clip_rings(square, moved)] == [2.5 * 1.5]
    assert clip.clip_rings(square, [(1.0, 1.0), (2.0, 1.0), (1.5, 2.0)]) == [[(1.0, 1.0), (2.0, 1.0), (1.5, 2.0)]]
    assert clip.clip_rings(square, [(9.0, 9.0), (10.0, 9.0), (9.5, 10.0)]) == []
    comb = [(-1.0, 1.0), (5.0, 1.0), (5.0, 3.5), (-1.0, 3.5), (-1.0, 3.0), (4.5, 3.0), (4.5, 1.5), (-1.0, 1.5)]
    assert sorted(area(r) for r in clip.clip_rings(square, comb)) == [2.0, 2.0]
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([(cx + rng.uniform(2, 6) * math.cos(t), cy + rng.uniform(2, 6) * math.sin(t)) for t in (k * math.pi / 4 for k in range(8))] for cx, cy in ((0, 0), (rng.uniform(-5, 5), rng.uniform(-5, 5))))
        rings = clip.clip_rings(a, b)
        for _ in range(200):
            p = (rng.uniform(-8, 8), rng.uniform(-8, 8))
            assert (sum(clip.inside(p, r) for r in rings) % 2 == 1) == (clip.inside(p, a) and clip.inside(p, b))
    assert clip.clip_line([(-1.0, 2.0), (2.0, 2.0), (2.0, 9.0)], square) == [[(0.0, 2.0), (2.0, 2.0), (2.0, 4.0)]]


def test_too_few_points_are_an_error(spark):
    sq = [0.0, 4.0, 4.0, 0.0], [0.0, 0.0, 4.0, 4.0]
    df = spark.createDataFrame([(1, *sq, *sq), (2, *sq, None, None)], "id int, axs array<double>, ays array<double>, bxs array<double>, bys array<double>")
    assert [r.error for r in clip.clip_pairs(df, ["id"]).orderBy("id").collect()] == [None, "too few points"]


def test_labels_match_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(v, k, rng.randrange(120), x := rng.uniform(-100, 300), y := rng.uniform(-100, 300), x + rng.uniform(0, 90), y + rng.uniform(0, 40)) for v in range(3) for k in range(80)]
    got = {(r.view, r.id): r.free for r in labels.place_labels(spark.createDataFrame(rows, "view int, id int, z int, x1 double, y1 double, x2 double, y2 double")).collect()}
    placed: dict = {}
    for v, k, _z, x1, y1, x2, y2 in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        free = not any(x1 <= b[2] and b[0] <= x2 and y1 <= b[3] and b[1] <= y2 for b in placed.get(v, ()))
        assert got[v, k] == free
        if free:
            placed.setdefault(v, []).append((x1, y1, x2, y2))


def test_limb(spark):
    from fieldloom.functions import geometry as m

    rows = s.limb(spark, m.orthographic(), m.EARTH).orderBy("seq").collect()
    assert len(rows) == 2003 and rows[0].cmd == "move_to" and rows[-1].cmd == "close" and all(a.lon <= b.lon for a, b in zip(rows[:1999], rows[1:2000], strict=True))
    assert all(r.lon != 0 or r.lat != 0 for r in rows[:2000])


def test_missing_cells_become_error_rows(spark):
    p = spark.createDataFrame([("a", 2, 2, [1.0, None, 2.0, 3.0], [1.5]), ("b", 2, 2, [0.0, 1.0, 0.0, 1.0], [0.5]), ("c", 2, 2, None, [0.5])], "surface_id string, nx int, ny int, buf array<double>, levels array<double>")
    got = {r.surface_id: r for r in contour.contour_lines(p, ["surface_id"]).collect()}
    assert got["a"].error == got["c"].error == "cells are missing" and got["b"].error is None and got["b"].xs == [0.5, 0.5, 0.5]


def test_touching_rings():
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    total = lambda a, b: round(sum(area(r) for r in clip.clip_rings(a, b)), 6)
    assert total(square, square) == 16
    for dx, dy, want in ((4, 0, 0), (2, 0, 8), (0, 4, 0), (4, 4, 0), (1, 1, 9)):
        assert total(square, [(x + dx, y + dy) for x, y in square]) == want
    inner = [(0.0, 1.0), (2.0, 1.0), (2.0, 3.0), (0.0, 3.0)]
    assert total(square, inner) == total(inner, square) == 4 and sorted(clip.clip_rings(square, inner)[0]) == sorted(inner)
    corner = [(0.0, 0.0), (2.0, 2.0), (0.0, 4.0)]
    assert total(square, corner) == 4


def test_nearest_among_crowds(spark):
    """Crowds, lone targets, ties, copies and places out of reach, against all pairs; then so many within reach that pairs of all
    would be 400 million."""
    rng = random.Random(11)
    targets = [(k, rng.choice((0.0, 40.0)) + rng.random() * 0.2, rng.random() * 0.2) for k in range(200)] + [(900 + k, 10.0 * k, 30.0) for k in range(5)] + [(7, 3.0, 3.0), (6, 3.0, 3.0), (990, None, 1.0)]
    asked = [(k, rng.uniform(-7, 47), rng.uniform(-3, 36)) for k in range(200)] + [(500, 3.0, 4.0), (501, 5.0, 30.0), (502, 5.0, 30.0), (503, None, 0.0), (504, 3.0, 3.0), (200, 0.0, 0.0)]
    df = lambda rows, p, i: spark.createDataFrame(rows, f"{i} long, {p}x double, {p}y double")
    got = {r.query_id: (r.distance, r.target_id) for r in s.nearest_hit(df(asked, "q", "query_id"), df(targets, "t", "target_id")).collect()}
    want: dict = {}
    for q, qx, qy in asked:
        near = [(d, t) for t, tx, ty in targets if None not in (qx, tx) and (d := math.sqrt((qx - tx) * (qx - tx) + (qy - ty) * (qy - ty))) < 5]
        want |= {q: min(near)} if near else {}
    assert got == want
    begun, crowd = time.monotonic(), lambda p, i, by: spark.range(20_000).select(F.col("id").alias(i), (F.col("id") % 141 / 100 + by).alias(f"{p}x"), (F.floor(F.col("id") / 141) / 100).alias(f"{p}y"))
    out = s.nearest_hit(crowd("q", "query_id", 0.001), crowd("t", "target_id", 0.0))
    assert out.filter("query_id = target_id").count() == out.count() == 20_000 and time.monotonic() - begun < 30


def test_crossing_sums_are_those_of_all_pairs(spark):
    """Long segments among short ones, copies, nulls and crowded tiles that several tasks share."""
    import random

    from fieldloom.operators import spatial

    rng = random.Random(5)

    def strokes(n, first):
        out = []
        for k in range(n):
            x, y, size = rng.randint(-40, 90), rng.randint(-40, 90), 150 if k % 20 == 0 else 25
            out.append((first + k, float(x), float(y), x + rng.randint(-size, size) + 0.5, y + rng.randint(-size, size) - 0.25))
        return out + out[:5] + [(first + 7, None, 1.0, 2.0, 3.0), (None, 0.0, 0.0, 50.0, 51.0)]

    shape = "id long, x1 double, y1 double, x2 double, y2 double"
    a, b = (spark.createDataFrame(strokes(n, first), shape) for n, first in ((300, 1000), (350, 5000)))
    pairs = spatial.segment_crossings(a, b, 32.0).select("a_id", "b_id").collect()
    want: dict = {}
    for p in pairs:
        n, ids, known = want.get(p.a_id, (0, 0, 0))
        want[p.a_id] = n + 1, ids + (p.b_id or 0), known + (p.b_id is not None)
    assert len(pairs) > 500
    for most in (50_000, 7):
        got = {r.a_id: (r.n, r.ids) for r in spatial.crossing_sums(a, b, 32.0, most).collect()}
        assert got == {k: (n, ids if known else None) for k, (n, ids, known) in want.items()}


def test_paths_are_dealt_into_tasks_of_fixed_size(spark, tmp_path, monkeypatch):
    """Twice the vertices: twice the tasks, not larger ones; and windows over paths do not shuffle again."""
    from fieldloom.plans import QUERIES, space

    lines = "SELECT id DIV 4 AS l_orderkey, CAST(id % 4 AS INT) AS l_linenumber, CAST(id * 7 % 50 AS DOUBLE) AS l_quantity, CAST(id % 11 AS DOUBLE) / 100 AS l_discount FROM range({})"
    for n in (2000, 4000):
        spark.sql(lines.format(n)).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
    want = sorted(map(tuple, QUERIES["W-06_edge_events"](spark, f"{tmp_path}/4000").collect()))
    monkeypatch.setattr(space, "TASK_VERTICES", 100, raising=False)
    dealt = [QUERIES["W-06_edge_events"](spark, f"{tmp_path}/{n}") for n in (2000, 4000)]
    assert [df.rdd.getNumPartitions() for df in dealt] == [20, 40]
    assert sorted(map(tuple, dealt[1].collect())) == want and len(want) == 3000


def test_chains_of_labels_end_without_a_round_a_label(spark, monkeypatch):
    """A chain in which each label waits for the one before, null views, null z and bounds the wrong way round."""
    import random

    from fieldloom.operators import labels

    rng = random.Random(9)
    rows = [("chain", i, 0, i * 1.0, 0.0, i + 1.0, 1.0) for i in range(40)]
    for i in range(200):
        x, y = rng.randint(-20, 20) / 2, rng.randint(-20, 20) / 2
        rows.append((rng.choice(["a", "b", None]), 100 + i, rng.choice([None, 1, 2, 100, 101]), x, y, x + rng.choice([0.0, 1.5, 4.0, -1.0]), y + rng.choice([0.0, 2.0, 5.0])))
    jobs = spark.createDataFrame(rows, "view string, id long, z int, x1 double, y1 double, x2 double, y2 double")
    made, plain = [], labels.store
    monkeypatch.setattr(labels, "store", lambda df, label: made.append(label) or plain(df, label))
    order = lambda df: sorted(map(repr, df.collect()))
    quick = order(labels.place_labels(jobs, tile=2.0))
    assert made.count("placed") == 1
    made.clear()
    assert order(labels.place_labels(jobs, tile=2.0, few=0)) == quick and made.count("placed") > 10
    made.clear()
    assert order(labels.place_labels(jobs, tile=2.0, few=60)) == quick and made.count("placed") > 1
