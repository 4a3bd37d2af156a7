"""SimHash near-dedup against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from fieldloom.llm.simhash import FEW, Grids, fingerprint, grid_links, grids_for, near_duplicates, popcounts, steps


def brute_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def reach(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        a, b = label[a], label[b]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [*out, None, "", " \n", "One", "ONE", "a b", "É é", out[0], out[0].upper()]


def test_fingerprint():
    for t in texts():
        assert fingerprint(t) == brute_print(t)


def test_spark_hash_agrees(spark):
    from pyspark.sql import functions as F

    x = "ä b c d"
    assert spark.range(1).select(F.xxhash64(F.lit(x))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(x.encode(), 42)


def flipped(rng, a, most):
    b = a.copy()
    for _ in range(most):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    return b


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = flipped(rng, a, 4)
    manhattan = np.abs(popcounts(a).astype(int) - popcounts(b)).sum(axis=1)
    assert (manhattan == np.bitwise_count(steps(a) ^ steps(b))).all() and (manhattan <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 5])
@pytest.mark.parametrize("count", [10, FEW])
def test_close_pairs_meet_in_a_cell(most, count):
    rng = np.random.default_rng(most)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = flipped(rng, a, most)
    grids = grids_for(count, most)
    (ca, pa, qa), (cb, pb, qb) = grids.cells(a), grids.cells(b)
    rows = len(ca) / len(a)
    assert rows < (35 if count < FEW else 300)
    for k in range(300):
        x, y = dict(zip(ca[pa == k], qa[pa == k], strict=True)), dict(zip(cb[pb == k], qb[pb == k], strict=True))
        assert any(c in y and not (x[c] and y[c]) for c in x)


def test_both_grids_match_brute_force(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    bits = np.unique(np.concatenate([a, flipped(rng, a, 2), flipped(rng, a, 4), flipped(rng, a, 6)]))
    want = reach(len(bits), [(int(i), int(j)) for i, j in np.argwhere(np.triu(np.bitwise_count(bits[:, None] ^ bits[None]) <= 4, 1))])
    points = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "bits long")
    at = {int(x): k for k, x in enumerate(bits.view(np.int64))}
    for grids in (Grids(3, 1), Grids(8, 4)):
        found = grid_links(points, grids=grids).collect()
        assert reach(len(bits), [(at[r.a], at[r.b]) for r in found]) == want


def rows_and_want(rows):
    prints = [brute_print(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = reach(len(rows), pairs)
    names = {c: min((i for (i, _), x in zip(rows, label, strict=True) if x == c and i is not None), default=None) for c in label}
    return sorted(((i, p, names[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=repr)


def test_matches_brute_force(spark):
    rows = [(10 + k, t) for k, t in enumerate(texts())]
    found = near_duplicates(spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, bits int"))
    assert sorted(((r.doc_id, r.bits % (1 << 64), r.component_id) for r in found.collect()), key=repr) == rows_and_want(rows)


def test_null_and_repeated_ids(spark):
    t = texts()
    rows = [(None, t[0]), (None, t[0]), (None, "a text of its own that nobody else has"), (5, t[0]), (5, t[3]), (5, t[3]), (7, t[3]), (5, "quite another one"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "doc_id long, text string, component_id string, kept int")
    out = near_duplicates(docs, docs.columns)
    assert out.columns == ["doc_id", "text", "component_id", "kept", "bits", "component_id_", "kept_"]
    got = out.collect()
    assert sorted(((r.doc_id, r.bits % (1 << 64), r.component_id_) for r in got), key=repr) == rows_and_want(rows)
    classes = {brute_print(x) for _, x in rows}
    assert sum(r.kept_ for r in got) == len(classes) and all(r.kept == 1 and r.component_id == "c" for r in got)


def test_large_cells_are_dealt_over_blocks(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    bits = {c ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 3))}) for c in centres for _ in range(150)}
    bits = sorted(bits)
    signed = [(b - (1 << 64) if b >> 63 else b,) for b in bits]
    found = grid_links(spark.createDataFrame(signed, "bits long"), block=16).collect()
    at = {b: k for k, b in enumerate(bits)}
    assert reach(len(bits), [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in found]) == reach(len(bits), [(a, b) for a in range(len(bits)) for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= 4])


def test_a_long_text(spark):
    rows = [(1, "word and other " * 100_000), (2, "word and other " * 100_000 + "end")]
    assert {r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
