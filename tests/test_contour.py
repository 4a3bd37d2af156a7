"""Contour lines: tiles of any size give the lines of a sequential walk."""

import random

from fieldloom.operators import contour


def walked(buf, nx, ny, level):
    """[(closed, points)] in order of seeds, walking from edge to edge through shared triangles."""
    crossed = lambda e: min(buf[e[0]], buf[e[1]]) <= level < max(buf[e[0]], buf[e[1]])
    triangles: dict = {}
    for y in range(ny - 1):
        for x in range(nx - 1):
            a, b, c, d = (x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)
            for t in (((a, b), (b, c), (a, c)), ((a, c), (d, c), (a, d))):
                edges = [e for e in t if crossed(e)]
                for e in edges:
                    triangles.setdefault(e, []).append([f for f in edges if f != e][0])
    point = lambda e: tuple(p + (1 - (level - buf[e[1]]) / (buf[e[0]] - buf[e[1]])) * (q - p) for p, q in zip(*e, strict=True))
    flat = lambda e: e[0][0] == e[1][0] or e[0][1] == e[1][1]
    seen, out = set(), []

    def walk(seed, on):
        path, last, at = [seed], seed, on
        while at is not None and at != seed:
            path.append(at)
            last, at = at, next((f for f in triangles[at] if f != last), None)
        return path, at == seed

    for y in range(ny - 1):
        for x in range(nx - 1):
            seed = ((x, y), (x + 1, y))
            if seed not in triangles or seed in seen:
                continue
            below = lambda f: max(f[0][1], f[1][1]) > y  # noqa: E731, B023
            down, up = (next((f for f in triangles[seed] if below(f) == side), None) for side in (True, False))
            path, closed = walk(seed, down)
            if not closed:
                path = path[::-1] + walk(seed, up)[0]
            seen.update(path)
            out.append((closed, [point(e) for e in path if flat(e)]))
    return out


def test_tiles_and_walks_agree(spark):
    rng = random.Random(11)
    surfaces = []
    for k, (nx, ny) in enumerate([(17, 13), (24, 24), (2, 2), (5, 40), (3, 2)]):
        rough = [rng.choice([0.0, 1.0, 2.0, 3.0]) if k % 2 else rng.gauss(0, 1) for _ in range(nx * ny)]
        surfaces.append((k, nx, ny, rough))
    surfaces.append((9, 9, 9, [float((x - 4) ** 2 + (y - 4) ** 2) for y in range(9) for x in range(9)]))
    df = contour.with_levels(spark.createDataFrame(surfaces, "k int, nx int, ny int, buf array<double>"))
    levels = {r.k: r.levels for r in df.collect()}
    want = {(k, n, i): (closed, points) for k, nx, ny, buf in surfaces for n, level in enumerate(levels[k]) for i, (closed, points) in enumerate(walked({(p % nx, p // nx): v for p, v in enumerate(buf)}, nx, ny, level))}
    assert sum(c for c, _ in want.values()) > 10
    for side in (3, 8, 64):
        got = {(r.k, r.level_no, r.line_no): (r.closed, list(zip(r.xs, r.ys, strict=True))) for r in contour.contour_lines(df, ["k"], side).collect()}
        assert got.keys() == want.keys()
        for key, (closed, points) in want.items():
            assert got[key][0] == closed and len(got[key][1]) == len(points), key
            assert all(abs(a - b) < 1e-9 for p, q in zip(got[key][1], points, strict=True) for a, b in zip(p, q, strict=True)), key


def test_tiles_given_as_such(spark):
    """A surface that only exists as tiles: levels come from all of them; a tile with a null cell gives an error row."""
    buf = [[float((x * 7 + y * 13) % 11) for x in range(9)] for y in range(9)]
    tile = lambda x0, y0: (1, 9, 9, x0, y0, 5, 5, [buf[y][x] for y in range(y0, y0 + 5) for x in range(x0, x0 + 5)])
    rows = [tile(x0, y0) for x0 in (0, 4) for y0 in (0, 4)]
    shape = "k int, width int, height int, x0 int, y0 int, nx int, ny int, buf array<double>"
    tiles = contour.tile_levels(spark.createDataFrame(rows, shape), ["k"])
    whole = contour.with_levels(spark.createDataFrame([(1, 9, 9, sum(buf, []))], "k int, nx int, ny int, buf array<double>"))
    plain = sorted((r.level_no, len(r.xs), r.closed) for r in contour.contour_lines(whole, ["k"]).collect())
    lines: dict = {}
    for r in contour.traced(tiles, ["k"]).collect():
        assert r.error is None
        lines.setdefault((r.level_no, r.seed, r.closed), []).append(r.seq)
    assert all(sorted(v) == list(range(len(v))) for v in lines.values())
    assert sorted((k[0], len(v), k[2]) for k, v in lines.items()) == plain
    broken = [(*r[:7], [None, *r[7][1:]]) if r[3:5] == (0, 0) else r for r in rows]
    got = contour.traced(contour.tile_levels(spark.createDataFrame(broken, shape), ["k"]), ["k"])
    assert got.filter("error is not null").count() == 1 and got.filter("x is not null").count() > 0


def test_only_lines_that_leave_their_tile_are_put_in_order(spark, monkeypatch):
    """Rings within a tile, and open lines from border to border of a surface of one tile, take no part in doubling."""
    seen = []
    plain = contour.doubled

    def watched(links, *args, **kw):
        seen.append((links.count(), links.columns))
        return plain(links, *args, **kw)

    monkeypatch.setattr(contour, "doubled", watched)
    rng = random.Random(3)
    bump = [float((x - 4) ** 2 + (y - 4) ** 2) for y in range(9) for x in range(9)]
    rough = [rng.gauss(0, 1) for _ in range(49)]
    df = contour.with_levels(spark.createDataFrame([(1, 9, 9, bump), (2, 7, 7, rough)], "k int, nx int, ny int, buf array<double>"))
    order = lambda rows: sorted((r.k, r.level_no, r.line_no, r.closed, tuple(r.xs), tuple(r.ys)) for r in rows)
    one = order(contour.contour_lines(df, ["k"], 64).collect())
    assert {r[3] for r in one} == {False, True} and [n for n, _ in seen] == [0, 0]
    seen.clear()
    cut = order(contour.contour_lines(df, ["k"], 3).collect())
    pieces = contour.line_pieces(contour.cut_tiles(df, ["k"], 3), ["k"])
    assert 0 < seen[0][0] < pieces.count() and not {"xs", "ys"} & set(seen[0][1])
    assert len(cut) == len(one)
    for a, b in zip(one, cut, strict=True):
        assert a[:4] == b[:4] and all(abs(p - q) < 1e-9 for i in (4, 5) for p, q in zip(a[i], b[i], strict=True))
