"""Scalars, rules and geometry against plain Python."""

import math
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import binary as b
from fieldloom.functions import geometry as m
from fieldloom.functions import grammar as g


def test_bytes(spark):
    rng = random.Random(1)
    rows = [(bytes(rng.randrange(256) for _ in range(n)),) for n in (0, 3, 4, 11, 40)]
    df = spark.createDataFrame(rows, "d binary")
    d = F.col("d")
    for n in (1, 7, 12, 16, 23, 25):
        got = [r[0] for r in df.select(b.bit_fields(d, n)).collect()]
        whole = ["".join(f"{x:08b}" for x in r[0]) for r in rows]
        assert got == [[int(w[k : k + n], 2) for k in range(0, len(w) - n + 1, n)] for w in whole]
    got = df.select(b.unsigned(d, 1, 3), b.sign_magnitude(d, 0, 2), b.set_bits(d)).collect()
    for (x,), (u, s, ones) in zip(rows, got, strict=True):
        assert u == (int.from_bytes(x[1:4], "big") if len(x) >= 4 else None) and ones == int.from_bytes(x, "big").bit_count()
        assert s == (None if len(x) < 2 else (lambda v: 32768 - v if v >= 32768 else v)(int.from_bytes(x[:2], "big")))


def test_fields_take_time_by_length(spark):
    """Half a megabyte in one text: a copy of it for each field would be 30 GB and more."""
    data = random.Random(2).randbytes(500_001)
    digits = data.hex()
    df = spark.createDataFrame([(data,), (b"",), (None,)], "d binary").repartition(1)
    begun = time.monotonic()
    sums = df.select(*[b.array_sum(x).alias(k) for k, x in (("a", b.fields(F.col("d"), 2)), ("b", b.bit_fields(F.col("d"), 12)))], b.ones(b.all_bits(F.col("d"))).alias("c")).collect()
    assert time.monotonic() - begun < 30
    want = sum(int.from_bytes(data[k : k + 2], "big") for k in range(0, 500_000, 2)), sum(int(digits[k : k + 3], 16) for k in range(0, 1_000_000, 3)), int.from_bytes(data, "big").bit_count()
    assert {want, (0, 0, 0)} <= set(map(tuple, sums))


@pytest.mark.parametrize(("word", "value"), [(0x42640000, 100.0), (0xC276A000, -118.625), (0x41100000, 1.0), (0, 0.0)])
def test_hex_float(spark, word, value):
    assert spark.createDataFrame([(struct.pack(">I", word),)], "d binary").select(b.hex_float(F.col("d"), 0)).first()[0] == value


def test_warp_weight(spark):
    want = {0: 1.0, 100: 0.9950124791935224, 1000: 0.6065306597638469, 3001: 0.011108996546684367, 3002: 0.0}
    got = {r.d: r.w for r in spark.createDataFrame([(k,) for k in want], "d int").select("d", m.warp_weight(F.col("d")).alias("w")).collect()}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_rules_are_possessive_and_ordered(spark):
    text = "aaab the then 2024-01 x"
    df = spark.createDataFrame([(text,)], "t string")
    one = lambda rule: df.select(rule.all(F.col("t"))).first()[0]
    assert one(g.seq(g.star(g.char("a")), g.char("a"))) == []
    assert one(g.choice(g.literal("the"), g.literal("then"))) == ["the", "the"]
    assert one(g.seq(g.choice(g.literal("the"), g.literal("then")), g.char(" "))) == ["the "]
    assert one(g.repeat(g.char("a"), 1, 2)) == ["aa", "a"] and one(g.seq(g.opt(g.char("a")), g.char("b"))) == ["ab"]
    assert one(g.advance_until(g.char("-"))) == ["aaab the then 2024-"] and one(g.seq(g.repeat(g.digit, 2), g.end)) == []
    date = g.seq(g.capture(1, g.seq(g.capture(2, g.repeat(g.digit, 4)), g.char("-"))), g.capture(3, g.plus(g.digit)))
    assert df.select(*[date.search(F.col("t"), i) for i in (1, 2, 3)]).first() == ("2024-", "2024", "01")
    assert list(g.walk(date, text)) == [(1, 14, 19), (2, 14, 18), (3, 19, 21)]
    spans = df.select(g.plus(g.between("a", "z")).spans(F.col("t"))).first()[0]
    assert [text[s.start : s.finish] for s in spans] == ["aaab", "the", "then", "x"]


def test_polygon_modes(spark):
    pts = {(0.0, 1.0): (True, True), (3.0, 1.0): (False, False), (1.0, 1.0): (True, True), (0.0, 0.0): (True, False)}
    xs, ys = F.array(*map(F.lit, (0.0, 2.0, 0.0, -2.0))), F.array(*map(F.lit, (2.0, 0.0, -2.0, 0.0)))
    df = spark.createDataFrame(list(pts), "x double, y double")
    got = df.select("x", "y", m.polygon_contains(F.col("x"), F.col("y"), xs, ys).alias("a"), m.polygon_contains(F.col("x"), F.col("y"), xs, ys, compat=True).alias("b")).collect()
    assert {(r.x, r.y): (r.a, r.b) for r in got} == pts


def test_projection_round_trip(spark):
    o = m.orthographic() | m.affine_projection(m.then(m.scaling(1e-3, -1e-3), m.translation(400.0, 300.0)))
    df = spark.createDataFrame([(float(lon), float(lat)) for lon in range(-60, 80, 20) for lat in range(-20, 80, 20)], "lon double, lat double")
    x, y = o.forward(F.col("lon"), F.col("lat"))
    lon, lat = o.reverse(F.col("x"), F.col("y"))
    seen = lambda lon, lat: math.sin(math.radians(lat)) * 0.5 + math.cos(math.radians(lat)) * math.cos(math.radians(lon - 10)) * math.cos(math.radians(30)) > 0.01
    for r in df.withColumn("x", x).withColumn("y", y).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert not seen(r.lon, r.lat) or (abs(r.a - r.lon) < 1e-6 and abs(r.b - r.lat) < 1e-6)
