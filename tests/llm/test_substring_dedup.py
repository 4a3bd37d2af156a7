"""Substring dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from fieldloom.llm.common import store
from fieldloom.llm.substring_dedup import FingerprintIndex, add_batch, cleaned, substring_dedup, text_key

SHAPE = "doc_id long, text string, h string, uid long"


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = [f"w{k}é" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, other = text(60), text(36)
    rows = [(k, text(rng.randint(0, 120))) for k in range(40)]
    rows += [(100 + k, f"{text(20)}\t{shared}\n{text(rng.randint(0, 50))}") for k in range(25)]
    rows += [(200, other + " " + text(9)), (201, text(7) + " " + other), (202, "ai " * 90), (203, shared[: len(shared) // 2]), (204, None), (205, ""), (206, " \n ")]
    rows += [(300, text(5000) + " " + shared), (301, rows[3][1]), (302, rows[3][1]), (303, "x y " * 40), (304, text(80)), (304, text(80))]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SHAPE)
    for batches in (1, 3):
        got = sorted((tuple(r) for r in substring_dedup(docs, batches=batches).collect()), key=repr)
        assert got == brute(rows, 35)


def test_kept_text_is_returned(spark):
    rows = corpus()
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, 35)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SHAPE)).count() == 0


def keyed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", text_key(F.col("text")))


def test_runs_are_compacted(spark):
    docs = keyed(spark, corpus()).cache()
    index = FingerprintIndex(spark)
    for k in range(5):
        index.add(docs.filter(f"doc_id % 5 = {k}"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    whole = FingerprintIndex(spark)
    hits = {r.h: r.n for r in whole.add(docs).collect()}
    counts: Counter = Counter()
    for level in index.levels:
        for run in level:
            counts.update({r.h: r.n for r in run.collect()})
    assert {h for h, n in counts.items() if n >= 2} == set(hits)


def test_runs_are_joined_in_place(spark):
    """A new run meets the earlier ones bucket by bucket: no exchange between the scans and the joins."""
    index = FingerprintIndex(spark, buckets=4)
    for k in range(2):
        index.add(keyed(spark, corpus()).filter(f"doc_id % 2 = {k}"))
    a = index.levels[1][0]
    plan = a.join(a.select("h", F.col("n").alias("m")).hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_a_later_session_adds_its_batch(spark, tmp_path):
    rows = corpus()
    first, second = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    old, new = keyed(spark, first), keyed(spark, second)
    index = FingerprintIndex(spark, str(tmp_path / "index"))
    before = add_batch(index, old)
    again = FingerprintIndex.open(spark.newSession(), str(tmp_path / "index"))
    again.spark = spark
    now = add_batch(again, new, old)
    starts = before.unionByName(now).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.max("rows").alias("rows"))
    got = cleaned(old.unionByName(new), store(starts, "starts")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 35)
    # The batch's own texts are right without what the earlier batch had found.
    mine = cleaned(new, now).collect()
    ids = {r[0] for r in second}
    assert sorted((tuple(r) for r in mine), key=repr) == sorted((r for r in brute(rows, 35) if r[0] in ids), key=repr)


def test_null_and_repeated_ids(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t) for k, (i, t) in enumerate(corpus())]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 35)


def test_words_that_fool_polynomial_hashes_stay_apart(spark):
    """Thue-Morse words of 1024 letters collide in every polynomial hash modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
