"""Formulas, completed levels, blur and the interval index against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import cube
from fieldloom.operators.interval_index import IntervalIndex


def test_formulas(spark, tmp_path):
    rows = [("u", 1, 3.0), ("v", 1, 4.0), ("u", 2, 1.0), ("v", 2, 0.0), ("u", 3, 5.0), ("w", 1, -1.0)]
    spark.createDataFrame(rows, "param string, k int, value double").write.parquet(str(tmp_path / "rows"))
    c = cube.Cube(spark.read.parquet(str(tmp_path / "rows")), ("k",)).define("speed", "sqrt(u * u + v ** 2)").define("r", "speed / v + min(u, 2)")
    assert {r.k: r.value for r in c.plane("speed").collect()} == {1: 5.0, 2: 1.0}
    assert {r.k: r.value for r in c.plane("r").collect()} == {1: 3.25, 2: None}
    assert {r.param: r.n for r in c.where(F.col("k") < 2).catalog().collect()} == {"u": 1, "v": 1, "w": 1}
    plan = c.where(F.col("k") >= 2).plane("speed")._jdf.queryExecution().executedPlan().toString()
    # Each scan reads one parameter and only what the criteria leave.
    assert plan.count("EqualTo(param,u)") == 1 and plan.count("EqualTo(param,v)") == 1 and "EqualTo(param,w)" not in plan and plan.count("GreaterThanOrEqual(k,2)") == 2
    for bad in ("u + ", "u if v else 1", "open('x')", "u.v"):
        with pytest.raises((ValueError, SyntaxError)):
            c.define("bad", bad).plane("bad")
    with pytest.raises(ValueError, match="by itself"):
        c.define("a", "b + 1").define("b", "a")


def test_completed_levels(spark):
    rows = [("a", 1000, 10.0), ("a", 500, 20.0), ("a", 850, None), ("a", 250, 0.0), ("b", 700, 1.0)]
    got = {(r.k, r.hpa): r.value for r in cube.completed(spark.createDataFrame(rows, "k string, hpa int, value double"), [1000, 850, 700, 500, 300, 100], ["k"]).collect()}
    at = lambda p: 20.0 + (10.0 - 20.0) * math.log(p / 500) / math.log(2)
    want = {("a", 1000): 10.0, ("a", 850): at(850), ("a", 700): at(700), ("a", 500): 20.0, ("a", 300): 20.0 * math.log(300 / 250) / math.log(2), ("b", 700): 1.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_blur(spark):
    """Borders, gaps and stretches shorter than the kernel."""
    rng = random.Random(1)
    cells = {(x, y): rng.random() for x in range(-3, 11) for y in range(7) if rng.random() < 0.9}
    df = spark.createDataFrame([("s", x, y, v) for (x, y), v in cells.items()] + [("s", 50, 50, None)], "s string, x int, y int, value double")
    w = cube.kernel(2, 1.1)

    def once(held, dx, dy):
        out = {}
        for x, y in held:
            near = [(w[k + 2], held[p]) for k in range(-2, 3) if (p := (x + k * dx, y + k * dy)) in held]
            out[x, y] = sum(a * b for a, b in near) / sum(a for a, _ in near)
        return out

    want = once(once(cells, 1, 0), 0, 1)
    for tile in (2, 5, 64):
        got = {(r.x, r.y): r.value for r in cube.blurred(df, ["s"], 2, 1.1, tile).collect()}
        assert (set(got) - set(want), set(want) - set(got)) == (set(), set())
        assert [(tile, k, got[k], v) for k, v in sorted(want.items()) if got[k] != pytest.approx(v)] == []


def test_interval_index(spark):
    rng = random.Random(7)
    index, held = IntervalIndex(spark, share=2.0, tile=8.0), {}
    shape = "seq int, op string, id int, start double, stop double"
    merged = 0
    for size in (30, 8, 6, 12):
        batch = []
        for seq in range(size):
            id_, op, start = rng.randrange(40), rng.choice(["insert", "insert", "erase"]), float(rng.randrange(100))
            stop = start + rng.choice([0, 3, 30, -1])
            batch.append((seq, op, id_, start, stop))
            if op == "insert" and start <= stop:
                held[id_] = (start, stop)
            else:
                held.pop(id_, None)
        rng.shuffle(batch)
        index.apply(spark.createDataFrame([*batch, (0, "insert", None, 1.0, 2.0)], shape))
        merged += bool(index.deltas)
        assert {r.id: (r.start, r.stop) for r in index.live().collect()} == held
    assert merged and index.base is not None
    asked = [(k, float(k * 9), float(k * 9 + 5)) for k in range(12)]
    got = sorted((r.a_id, r.b_id) for r in index.in_range(spark.createDataFrame(asked, "id int, start double, stop double")).collect())
    assert got == sorted((k, i) for k, a, b in asked for i, (s, e) in held.items() if s <= b and a <= e)
    index.erase(spark.createDataFrame([(i,) for i in list(held)[:3]], "id int"))
    index.insert(spark.createDataFrame([(99, 1.0, 2.0)], "id int, start double, stop double"))
    left = {i: v for i, v in list(held.items())[3:]} | {99: (1.0, 2.0)}
    assert {r.id for r in index.find(spark.createDataFrame([(99,), (99,), (list(held)[0],)], "id int")).collect()} == {99}
    index.compact()
    assert {r.id: (r.start, r.stop) for r in index.live().collect()} == left and not index.deltas
    r = index.bounds(spark.createDataFrame([(0, 50.0)], "probe_id int, key double")).first()
    assert (r.lower, r.inside) == (sum(s < 50 for s, _ in left.values()), sum(s <= 50 <= e for s, e in left.values()))
    assert IntervalIndex(spark).live().count() == 0
