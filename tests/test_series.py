"""As-of interpolation and the event store against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators.series import EventStore, asof_interpolated

START = datetime.datetime(2020, 1, 1)


def test_asof(spark):
    """One key with most rows, over many ranges; ties, gaps, probes outside and beside."""
    rng = random.Random(8)
    samples = [("a", START + datetime.timedelta(seconds=rng.randrange(5000)), rng.random()) for _ in range(300)]
    samples += [("b", START, 1.0), ("b", START + datetime.timedelta(seconds=100), 3.0), ("b", START, 2.0), ("b", None, 1.0), ("b", START + datetime.timedelta(seconds=50), None), (None, START, 7.0)]
    probes = [(k, rng.choice(["a", "a", "a", "b", "c"]), START + datetime.timedelta(seconds=rng.randrange(-300, 5300))) for k in range(300)]
    probes += [(900, "b", START), (901, "b", None), (902, None, START), (903, "b", START + datetime.timedelta(seconds=25)), (903, "b", START + datetime.timedelta(seconds=25))]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_interpolated(spark.createDataFrame(samples, "key string, at timestamp_ntz, value double"), spark.createDataFrame(probes, "probe_id int, key string, at timestamp_ntz")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(probes)
    held: dict = {}
    for key, at, v in samples:
        if key and at and v is not None:
            held.setdefault(key, {}).setdefault(at, []).append(v)
    for r in got:
        own = {t: sum(v) / len(v) for t, v in held.get(r.key, {}).items()} if r.at else {}
        low, high = max((t for t in own if t <= r.at), default=None), min((t for t in own if t >= r.at), default=None)
        assert (r.before, r.after) == (low, high)
        if low is None or high is None:
            assert r.value is None
        else:
            want = own[low] if low == high else own[low] + (own[high] - own[low]) * ((r.at - low) / (high - low))
            assert r.value == pytest.approx(want)


def test_asof_frames_only_grow(spark):
    """A frame that reaches to the end of its partition is gone through anew for each row: a key of n rows would take n squared."""
    rows = spark.range(4).select(F.lit("a").alias("key"), F.lit(START).cast("timestamp_ntz").alias("at"), F.lit(1.0).alias("value"))
    plan = asof_interpolated(rows, rows.select(F.lit(1).alias("probe_id"), "key", "at"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_event_store(spark):
    rng = random.Random(9)
    events = [(rng.randrange(12), v, rng.choice(["set", "set", "remove"]), rng.random()) for v in range(1, 60)]
    kept = EventStore(spark.createDataFrame(events, "uid int, version long, type string, value double"), 13)
    assert sorted(kept.snapshots) == [13, 26, 39, 52, 65]
    assert [kept.nearest(v) for v in (0, 12, 13, 40, 59)] == [None, None, 13, 39, 52]
    for v in (0, 1, 13, 14, 38, 59, 1000):
        want: dict = {}
        for uid, version, type_, value in events:
            if version <= v:
                want.pop(uid, None) if type_ == "remove" else want.update({uid: (version, value)})
        assert {r.uid: (r.version, r.value) for r in kept.state(v).collect()} == want
    # What is read beside the snapshot are the events since, and no more.
    assert kept.events.filter((F.col("version") <= 45) & (F.col("version") > kept.nearest(45))).count() == 6
    kept.close()
