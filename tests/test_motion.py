"""Motion vectors: planted shifts are recovered, and plain loops over all displacements agree."""

import random

import pytest

from fieldloom.operators.motion import displacements, motion_vectors

SHAPE = "series string, frame long, x long, y long, value double"


def brute(rows, block, reach, step):
    """{(series, frame, tx, ty): (dx, dy, squares, cells)} by trying every displacement of every block."""
    q = {}
    for s, f, x, y, v in rows:
        if v is not None and v == v and abs(v) != float("inf"):
            k = (s, f, x, y)
            q[k] = max(q.get(k, -(10**9)), int((v / step + 0.5) // 1))
    blocks = {}
    for s, f, x, y in q:
        blocks.setdefault((s, f, x // block, y // block), []).append((x, y))
    out = {}
    for (s, f, tx, ty), cells in blocks.items():
        best = None
        for k, (dx, dy) in enumerate(displacements(reach)):
            pairs = [(q[s, f, x, y], q.get((s, f + 1, x + dx, y + dy))) for x, y in cells]
            if all(b is not None for _, b in pairs):
                cost = sum((a - b) ** 2 for a, b in pairs)
                best = min(best or (cost, k), (cost, k))
        if best:
            out[s, f, tx, ty] = (*displacements(reach)[best[1]], best[0], len(cells))
    return out


def found(spark, rows, *args):
    got = motion_vectors(spark.createDataFrame(rows, SHAPE), ["series"], "frame", *args).collect()
    out = {(r.series, r.frame, r.tx, r.ty): (r.dx, r.dy, r.squares, r.cells) for r in got}
    assert len(out) == len(got)
    return out


def test_planted_shifts(spark):
    rng = random.Random(2)
    whole = {(x, y): rng.uniform(-5, 5) for x in range(-20, 60) for y in range(-20, 60)}
    path = [(0, 0), (2, -1), (-1, 2), (0, 5)]
    rows = [("a", f, x, y, whole[x - dx, y - dy]) for f, (dx, dy) in enumerate(path) for x in range(32) for y in range(32)]
    got = found(spark, rows, 8, 4, 0.001)
    inner = {k: v for k, v in got.items() if 0 < k[2] < 3 and 0 < k[3] < 3}
    moves = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:])]  # noqa: B905
    assert len(inner) == 12 and all(v == (*moves[k[1]], 0, 64) for k, v in inner.items())


@pytest.mark.parametrize("block, reach", [(4, 2), (3, 0), (5, 3)])
def test_matches_brute_force(spark, block, reach):
    """Flat stretches (ties), cells that are missing, null, not finite or given twice, coordinates below zero, frames missing."""
    rng = random.Random(block)
    rows = [(s, f, x, y, float(rng.randint(0, 3))) for s in ("a", "b", None) for f in (0, 1, 2, 5) for x in range(-6, 9) for y in range(-5, 7) if s is not None or f < 2]
    rows = [r for r in rows if rng.random() > 0.03]
    rows = [(*r[:4], rng.choice([None, float("nan"), float("inf"), r[4]])) if rng.random() < 0.02 else r for r in rows]
    rows += [(*r[:4], r[4] and r[4] - 1) for r in rows[:50]]
    got = found(spark, rows, block, reach, 1.0)
    assert got == brute(rows, block, reach, 1.0) and len(got) > 10


def test_odd_input(spark):
    assert found(spark, [], 8, 3, 1.0) == {}
    assert found(spark, [("a", 0, 0, 0, 1.0)], 8, 3, 1.0) == {}
    with pytest.raises(ValueError):
        found(spark, [("a", 0, 0, 0, 1.0)], 33, 3, 1.0)
    with pytest.raises(Exception, match="larger steps"):
        found(spark, [("a", f, 0, 0, 1e9) for f in (0, 1)], 8, 3, 1.0)
