"""Whitening against a plain computation."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from fieldloom.llm import whitening
from fieldloom.llm.queries import QUERIES


def plain(vectors, most=16):
    """{(row number, component): (n, deviation, |whitened|, explained)} of usable vectors of one length."""
    y = [[int(np.floor(64 * float(e))) + 1_000_000 for e in v] for v in vectors]
    fit = [list(t) for t in {tuple(v) for v in y}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    c = np.array([[(n * v[i] - s[i]) / n for i in range(d)] for v in fit])
    e, w = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:most]
    out = {}
    for k, v in enumerate(y):
        off = [n * v[i] - s[i] for i in range(d)]
        p = np.array([o / n for o in off]) @ w[:, order]
        for j, at in enumerate(order):
            out[k, j + 1] = (n, sum(o * o for o in off), abs(p[j]) / np.sqrt(e[at]), e[at] / e.sum())
    return out


def check(got, want, ids):
    assert len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[ids[r.vec_id], r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-7)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def test_query(spark):
    got = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect()
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    usable = [(i, v) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    check(got, plain([v for _, v in usable]), {i: k for k, (i, _) in enumerate(usable)})


def test_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20)).tolist()
    base[7] = list(base[3])
    base[8] = [1e4, *base[8][1:]]
    short = rng.normal(size=(9, 3)).tolist()
    broken = [None, [], [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] + [0.0] * 19, [1e30] + [0.0] * 19]
    rows = [(k, v, "x") for k, v in enumerate(base + short)] + [(1000 + k, v, "y") for k, v in enumerate(broken)] + [(5, base[5], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g string").repartition(5)
    got = whitening.whiten(df).collect()
    big = [r for r in got if r.vec_id < 60]
    assert len(big) == 61 * 16 and {r.n for r in big} == {59}
    want = plain(base)
    seen = {(r.vec_id, r.component): r for r in big}
    assert all(seen[k].deviation == v[1] and abs(seen[k].whitened) == pytest.approx(v[2], rel=1e-6, abs=1e-6) for k, v in want.items())
    check([r for r in got if r.vec_id >= 60], plain(short), {60 + k: k for k in range(9)})


def test_flat_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in got] == [(1, 0, 0.0, 1.0)] * 6
    assert whitening.whiten(df.filter("vec_id > 5")).collect() == []


def test_tiles_and_blocks(spark):
    """Tile widths and block heights change nothing but the last bits."""
    rng = np.random.default_rng(4)
    m = rng.integers(-90, 90, size=(500, 37))
    df = spark.createDataFrame([(37, v) for v in m.tolist()], "g int, y array<long>").repartition(3)
    totals = whitening.sums(df, "y")
    c = m - m.mean(0)
    for width, height in ((16, 64), (5, 7), (64, 4096)):
        blocks = whitening.store(whitening.column_blocks(df, "y", width, height), "b")
        got = {(r.i, r.j): r.v for r in whitening.tiled_covariance(blocks, totals, width).collect()}
        want = c.T @ c / 500
        assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-9) for i in range(37) for j in range(i, 37))
