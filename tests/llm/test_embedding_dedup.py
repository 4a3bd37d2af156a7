"""Embedding near-dedup against brute force."""

import numpy as np
import pytest

from fieldloom.llm import embedding_dedup as ed
from fieldloom.llm.embedding_dedup import Codes, encode, near_embeddings, rotation, unit_rows


def brute(ids, x, threshold=0.95):
    ok = [k for k, v in enumerate(x) if v is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    u = np.array([x[k] for k in ok], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    links, label = [0] * len(ids), list(ids)
    for a, k in enumerate(ok):
        links[k] = int(near[a].sum()) - 1
    while True:
        new = list(label)
        for a, k in enumerate(ok):
            new[k] = min(label[ok[b]] for b in np.flatnonzero(near[a]))
        if new == label:
            return sorted(zip(ids, links, label, [i == c for i, c in zip(ids, label, strict=True)], strict=True))
        label = new


def vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    out = [b + s * rng.standard_normal(16) for b in base for s in (0, 0.02, 0.05, 0.08)[: rng.integers(1, 5)]]
    out += [base[0] + 0.03 * rng.standard_normal(16) for _ in range(40)] + [base[1]] * 15 + [3 * base[2], -base[2]]
    out = [[float(np.float32(a)) for a in v] for v in out]
    return [*out, None, [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0] * 3]


@pytest.mark.parametrize("block", [1024, 8])
def test_matches_brute_force(spark, block):
    x = vectors()
    ids = [7 * k + 3 for k in range(len(x))]
    rows = spark.createDataFrame([(i, v, 5, "z") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, n int, v string")
    plain = [None if v is None or None in v else v for v in x]
    got = sorted(tuple(r) for r in near_embeddings(rows, tables=40, block=block).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == brute(ids, plain)


def test_estimates_are_unbiased_and_bounded():
    x = np.random.default_rng(1).standard_normal((400, 64)) * 10.0 ** np.arange(-200, 200)[:, None]
    c, every = Codes(*encode(x, rotation(64))), np.arange(400)
    u = unit_rows(x)
    error = c.estimates(every, every) - u @ u.T
    np.fill_diagonal(error, 0)
    assert abs(error.mean()) < 2e-3 and (np.abs(error) <= (c.bound + c.rounding)[:, None]).mean() > 0.99


def test_links_need_double_precision(spark):
    """Pairs a hair above and below the threshold, which single precision cannot tell apart."""
    a = np.array([1.0, *[0.0] * 15])
    at = lambda c: [c, float(np.sqrt(1 - c * c)), *[0.0] * 14]
    rows = [(1, a.tolist()), (2, at(0.95 + 1e-12)), (3, (-a).tolist()), (4, [-y for y in at(0.95 - 1e-12)])]
    got = {r.vec_id: r.n_links for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tables=60).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_null_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b, c, d = (v.tolist() for v in rng.standard_normal((4, 16)))
    close = [x + 1e-4 for x in a]
    rows = [(None, a), (None, a), (5, b), (5, c), (5, c), (9, close), (9, d), (None, d), (None, [float(x) for x in range(16)]), (None, [float(x) for x in range(16)]), (5, None), (None, None)]
    got = [tuple(r) for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(None, 2, 9, False), (None, 2, 9, False), (9, 2, 9, True), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (9, 1, 9, True), (None, 1, 9, False), (None, 1, None, True), (None, 1, None, False), (5, 0, 5, True), (None, 0, None, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_and_all_invalid(spark):
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert near_embeddings(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().kept


def pairs_at(cosine, n, d=64, seed=6):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a.astype(np.float32), (cosine * a + np.sqrt(1 - cosine**2) * b).astype(np.float32)


@pytest.mark.parametrize("bits", [6, 10, 12, 15, 17, 20])
def test_pairs_at_the_threshold_meet_at_every_size(bits):
    normals = ed.planes(64, bits, ed.tables_for(ed.THRESHOLD, bits))
    x, y = (encode(v.astype(float), rotation(64))[2] for v in pairs_at(0.95, 20000))
    met = (ed.table_keys(x, normals) == ed.table_keys(y, normals)).any(axis=1).mean()
    assert met >= ed.RECALL - 0.001 and len(normals) <= ed.MOST_TABLES


@pytest.mark.parametrize("bits", [12, 20])
def test_own_parameters_match_brute_force_at_many_bits(spark, bits):
    # Enough pairs that a few misses, each of a chance of one in a thousand, stay below the bound.
    n = 2000
    x = np.concatenate(pairs_at(0.9505, n))
    points = spark.createDataFrame([(k, 1, 64, len(x), [float(a) for a in v]) for k, v in enumerate(x)], "id long, n long, d int, size long, v array<double>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T >= ed.THRESHOLD, 1))}
    got = {tuple(sorted((r.a, r.b))) for r in ed.bucket_links(points, bits).filter("b is not null").collect()}
    assert len(want) == n and got <= want and len(got) >= 0.995 * n


def test_keys_do_not_depend_on_the_batch():
    x, normals = encode(pairs_at(0.95, 300)[0].astype(float), rotation(64))[2], ed.planes(64, 20, 30)
    whole = ed.table_keys(x, normals)
    assert all((ed.table_keys(x[k : k + 1], normals[:7]) == whole[k, :7]).all() for k in range(300))


@pytest.mark.parametrize("threshold", [0.999, 0.95, 0.8, 0.5, 0.0])
def test_low_thresholds_take_fewer_bits(threshold):
    assert all(ed.tables_for(threshold, ed.bits_for(n, threshold)) <= ed.MOST_TABLES for n in (1, 1000, 10**6, 10**9, 10**12))


def test_default_parameters_match_brute_force(spark):
    """Clusters of 64 numbers as the table's, no parameter of the operator changed: every link of brute force is found."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 64))
    x = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0.0, 0.1, 0.2, 0.25, 0.3)])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= ed.THRESHOLD
    got = {r.vec_id: r.n_links for r in near_embeddings(rows).collect()}
    want = {k: int(n) - 1 for k, n in enumerate(near.sum(axis=1))}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.998 * sum(want.values()) > 1000


def test_each_length_is_searched_by_itself(spark):
    x = vectors()
    short = [[float(np.float32(a)) for a in v] for v in (0.5 * np.array([1, 2, 3.0]), [1, 2, 3.0], [3, -2, 1.0])]
    rows = [*enumerate(x), *[(1000 + k, v) for k, v in enumerate(short)], (2000, [1.0] * 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_embeddings(table, tables=40).collect()}
    plain = [None if v is None or None in v else v for v in x]
    want = {i: rest for i, *rest in brute(list(range(len(x))), plain)}
    # The odd [1, 1, 1] at the end of x has the short vectors' length: it comes near to [1, 2, 3] at 0.93 only.
    assert {i: list(got[i]) for i in want} == want
    assert [got[1000 + k] for k in range(3)] == [(1, 1000, True), (1, 1000, False), (0, 1002, True)] and got[2000] == (0, 2000, True)
