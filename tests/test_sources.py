"""Framing, bulletins, fields, shapes, images and streams; bad input becomes rows, not failures."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import files, grib, gts
from fieldloom.streaming.framing import counters


def stream(rng):
    out = b""
    for _ in range(30):
        kind, body = rng.choice(gts.TYPES), b"\x01" + bytes(rng.randrange(32, 127) for _ in range(rng.randint(0, 300)))
        out += bytes(rng.randrange(256) for _ in range(rng.choice([0, 0, 5, 40]))) + b"%08d" % len(body) + kind + body + rng.choice([b"", gts.PAD])
    return out + rng.choice([b"", b"tail", b"00009999AN\x01never ends", b"0000"])


def test_chunks_do_not_matter():
    rng = random.Random(1)
    for _ in range(40):
        data = stream(rng)
        whole = gts.split(data)
        assert [a[3] for a in whole[:-1]] == [b[2] for b in whole[1:]] and whole[0][2] == 0 and whole[-1][3] == len(data)
        for chunk in (1, 7, 1000):
            got = gts.split(data, chunk)
            merged = []
            for r in got:  # a run of junk may be told in parts
                if merged and r[0] == merged[-1][0] == "junk":
                    merged[-1] = ("junk", None, merged[-1][2], r[3])
                else:
                    merged.append(r)
            assert merged == whole


def test_data_source(spark, tmp_path):
    data = stream(random.Random(2))
    (tmp_path / "a.gts").write_bytes(data)
    spark.dataSource.register(gts.GtsDataSource)
    got = spark.read.format("gts").option("paths", str(tmp_path / "a.gts")).option("chunk", 64).load()
    assert counters(got).first().bytes == len(data)
    assert b"".join(r.bytes for r in got.orderBy("start").collect()) == data


def field(spark, pir, ni, raw, **other):
    row = {"param": 11, "level_flg": 100, "level": 500, "hours": 6, "bits": 12, "scale": -3, "word": 0x42640000, "scale10": 1} | other
    n = lambda k: F.lit(row[k])
    pirs = F.array(*map(F.lit, pir)) if pir else F.lit(None).cast("array<int>")
    when = F.to_timestamp(F.lit("1999-12-31 18:00:00"))
    made = grib.encode(n("param"), n("level_flg"), n("level"), when, n("hours"), tuple(F.lit(v) for v in (60000, -30000, -170000, 90000)), F.lit(ni), pirs, F.array(*[F.lit(v).cast("long") for v in raw]), row["bits"], n("scale"), n("word"), n("scale10"))
    return bytes(spark.range(1).select(made).first()[0])


def decode(spark, data, **kw):
    return grib.decode_surfaces(spark.createDataFrame([(data,)], "message binary"), **kw).first()


def test_field_round_trip(spark):
    raw = [1, 4000, 17, 0, 9, 4095, 8]
    r = decode(spark, field(spark, [3, 4], 5, raw))
    v = [(x / 8 + 100) / 10 for x in raw]
    assert r.error is None and (r.nx, r.ny) == (5, 2)
    want = [v[0], (v[0] + v[1]) / 2, v[1], (v[1] + v[2]) / 2, v[2], v[3], v[3] * 0.25 + v[4] * 0.75, (v[4] + v[5]) / 2, v[5] * 0.75 + v[6] * 0.25, v[6]]
    assert all(abs(a - b) < 1e-9 for a, b in zip(r.buf, want, strict=True))
    assert r.param.type == "temperature" and r.level.hpa1 == 500 and str(r.valid.start) == "2000-01-01 00:00:00" and (r.area.top, r.area.bottom, r.area.left) == (60000.0, -30000.0, -170000.0)
    plain = field(spark, None, 3, range(6))
    assert decode(spark, plain).buf == pytest.approx([(x / 8 + 100) / 10 for x in range(6)]) and decode(spark, plain, compat=True).error == "no points in row"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda d: b"GRIC" + d[4:], "bad magic"), (lambda d: d[:8] + b"\0\0\x1d" + d[11:], "product section is not 28 bytes"), (lambda d: d[:15] + b"\xc0" + d[16:], "bitmap"), (lambda d: d[:15] + b"\0" + d[16:], "no grid section"),
        (lambda d: d[:41] + b"\x05" + d[42:], "projection"), (lambda d: d[:16] + b"\x63" + d[17:], "parameter"), (lambda d: d[:17] + b"\x01" + d[18:], "level"), (lambda d: d[:28] + b"\x0a" + d[29:], "time range"),
        (lambda d: d[:-6], "truncated"), (lambda d: d[:20], "no grid section"), (lambda d: b"", "bad magic"),
    ],
)
def test_refused_fields(spark, change, error):
    r = decode(spark, change(field(spark, [3, 4], 5, range(7))))
    assert r.buf is None and (r.error == error or r.error == "truncated")


def test_compat_parameter(spark):
    data = field(spark, [2], 2, [1, 2], param=33)
    assert decode(spark, data).param.code == 33 and decode(spark, data, compat=True).param.code == 34


def test_messages_by_length(spark):
    inner = field(spark, [2], 2, [0x373, 0x737], bits=12)
    df = spark.createDataFrame([(b"xGRIB" + b"\0\0\xff" + inner + b"GRIB" + inner[:9],)], "body binary")
    assert [bytes(r.message) for r in gts.gribs(df).collect()] == [inner]


def test_shapes_and_attributes(spark, tmp_path):
    pts = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0), (9.0, 9.0), (9.0, 8.0), (8.0, 8.0), (9.0, 9.0)]
    body = struct.pack("<i4d2i2i", 5, 0, 0, 9, 9, 2, 8, 0, 4) + b"".join(struct.pack("<2d", *p) for p in pts)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    got = files.shape_vertices(files.read_files(spark, str(tmp_path / "a.shp"))).orderBy("ring", "seq").collect()
    assert [(r.ring, r.cmd) for r in got] == [(k, c) for k in (0, 1) for c in ("move_to", "line_to", "line_to", "close")] and [(r.x, r.y) for r in got] == pts
    fields = [(b"NAME", b"C", 8, 0), (b"POP", b"N", 6, 0), (b"GDP", b"N", 7, 2)]
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 32 + 32 * 3 + 1, 22) + b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" " + b"Peru    " + b"    33" + b"   2.50" + b" " + b"Chad    " + b"      " + b"*******")
    rows = files.shape_attributes(files.read_files(spark, str(tmp_path / "a.dbf"))).orderBy("id", "name").collect()
    assert [(r.id, r.name, r.attr.i, r.attr.d, r.attr.s) for r in rows] == [(0, "GDP", None, 2.5, None), (0, "NAME", None, None, "Peru"), (0, "POP", 33, None, None), (1, "NAME", None, None, "Chad")]


def test_png(spark):
    rng = random.Random(3)
    w, h = 5, 6
    pixels = [[rng.randrange(256) for _ in range(3 * w)] for _ in range(h)]
    lines, before = b"", [0] * (3 * w)
    for k, row in enumerate(pixels):
        kind = k % 5
        a, b, c = [0, 0, 0, *row[:-3]], before, [0, 0, 0, *before[:-3]]
        paeth = [min((x, y, z), key=lambda v, p=x + y - z: abs(p - v)) for x, y, z in zip(a, b, c, strict=True)]
        guess = [[0] * len(row), a, b, [(x + y) // 2 for x, y in zip(a, b, strict=True)], paeth][kind]
        lines += bytes([kind, *[(x - y) & 255 for x, y in zip(row, guess, strict=True)]])
        before = row
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    rows = files.png_images(spark.createDataFrame([("a", data), ("b", b"no")], "path string, content binary")).orderBy("path").collect()
    assert bytes(rows[0].rgba) == b"".join(bytes([*row[3 * x : 3 * x + 3], 255]) for row in pixels for x in range(w)) and rows[1].error == "not a PNG"


def test_sections_with_a_bitmap_and_a_rotated_grid(spark):
    plain = field(spark, None, 3, range(6))
    gds = bytearray(plain[36:68])
    gds[5], gds[2] = 10, 42
    gds += (0x800000 | 30000).to_bytes(3, "big") + (15000).to_bytes(3, "big") + bytes(4)
    bms = (9).to_bytes(3, "big") + bytes([5]) + bytes(2) + bytes([0b10110111, 0b01000000, 0b01100000])
    data = plain[:15] + b"\xc0" + plain[16:36] + bytes(gds) + bms + plain[68:]
    r = grib.decode_sections(spark.createDataFrame([(data,)], "message binary")).first()
    assert (r.gds.type, r.gds.pole_lat, r.gds.pole_lon, r.gds.pir) == (10, -30000, 15000, None) and r.end_ok
    assert r.bms.bits == [int(c) for c in f"{0b101101110100000001100000:024b}"][:19] and r.bds.bits == 12
    r = grib.decode_sections(spark.createDataFrame([(plain[:30],)], "message binary")).first()
    assert r.gds.ni is None and not r.end_ok


def test_strict_frames():
    body = b"\x01abc"
    frame = b"%08dZ9" % len(body) + body
    data = b"junk!" + frame + gts.PAD + frame + b"!!" + frame[:-1]
    got = gts.strict_runs(data)
    assert [(k, t, data[a:b]) for k, t, a, _, b in got] == [("bad", None, b"junk!"), ("frame", "Z9", frame + gts.PAD), ("frame", "Z9", frame), ("bad", None, b"!!" + frame[:-1])]
    assert gts.strict_runs(b"") == [] and b"".join(data[a:b] for *_, a, _, b in got) == data


def test_a_frame_that_claims_much_is_not_copied_again_and_again():
    import time

    data = b"00000000AN" + b"09000000AN\x01" + b"x" * 8_999_999
    began = time.monotonic()
    got = gts.split(data, 1000)
    assert time.monotonic() - began < 3 and got[-1][0] == "frame" and got[-1][3] == len(data)


def test_folders_and_patterns(spark, tmp_path):
    for n in ("a.gts", "b.gts", "c.txt"):
        (tmp_path / n).write_bytes(b"%08dAN\x01" % 1 + n.encode() * 5)
    read = lambda p: {r.path.rsplit("/", 1)[1] for r in spark.read.format("gts").option("paths", p).load().collect()}
    spark.dataSource.register(gts.GtsDataSource)
    assert read(f"{tmp_path}/*.gts") == {"a.gts", "b.gts"} and read(str(tmp_path)) == {"a.gts", "b.gts", "c.txt"}


def test_cut_off_files_become_error_rows(spark):
    shp = bytes(100) + struct.pack(">2i", 1, 10) + struct.pack("<i2d", 1, 3.0, 4.0) + struct.pack(">2i", 2, 10) + struct.pack("<i", 1)
    rows = files.shape_vertices(spark.createDataFrame([("a", shp), ("b", b"short"), ("c", None)], "path string, content binary")).orderBy("path", "error").collect()
    assert [(r.path, r.x, r.error) for r in rows] == [("a", 3.0, None), ("a", None, "record 1 is cut off"), ("b", None, "no file header"), ("c", None, "no file header")]
    dbf = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 65, 5) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([4, 0]) + bytes(14) + b"\r" + b" Peru" + b" Ch"
    rows = files.shape_attributes(spark.createDataFrame([("a", dbf), ("b", dbf[:40]), ("c", b"")], "path string, content binary")).orderBy("path", "id").collect()
    assert [(r.path, r.attr and r.attr.s, r.error is None) for r in sorted(rows, key=lambda r: (r.path, r.error is not None))] == [("a", "Peru", True), ("a", None, False), ("b", None, False), ("c", None, False)]
    png = b"\x89PNG\r\n\x1a\n"
    assert [r.error for r in files.png_images(spark.createDataFrame([("a", png), ("b", png + b"\0\0")], "path string, content binary")).orderBy("path").collect()][0] == "no image header"


def test_head_fields_of_any_lawful_length(spark):
    from pyspark.sql import functions as F

    from fieldloom.sources import gts

    heads = [b"01\r\r\nSADL01 EDZW 010203\r\r\n", b"000123\r\r\nSADL01 EDZW 010203 RRA\r\r\n", b"SADL01 EDZW 010203\r\r\n", b"1\r\r\nSADL01 EDZW 010203\r\r\n", b"123\r\r\nSADL0X EDZW 010203\r\r\n", b"123\r\r\nSADL01 ED1W 010203\r\r\n"]
    rows = [(str(k), bytearray(b"%08d" % (len(h) + 6) + b"BI" + b"\x01\r\r\n" + h + b"xx")) for k, h in enumerate(heads)]
    got = gts.bulletins(gts.frames(spark.createDataFrame(rows, "path string, content binary"))).orderBy("path").select("csn", "ttaaii", "bbb", F.decode("body", "ISO-8859-1")).collect()
    assert [tuple(r) for r in got] == [("01", "SADL01", None, "xx"), ("000123", "SADL01", "RRA", "xx"), (None, "SADL01", None, "xx"), *[(None, None, None, None)] * 3]


def test_report_kinds_hold_at_the_beginning_only(spark):
    from fieldloom.sources import gts

    texts = ["STAFF meets METAR=", "UUAA 61001 1=\r\nUUBB 2=\r\nXX 3=", "LFFF  SIGMET 2 VALID=\nmore=", " AAXX 01004 03772 1=\n03773 2=\nrest", "TAF\nAMD EGLL 1=\nEGKK 2=", "TAF EGLL 1=EGKK 2=", "METAR EGLL 1=\nEGKK 2=", "AAXX 03772 x", None]
    got = gts.reports(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id", "no").select("id", "kind", "header", "report").collect()
    assert [tuple(r) for r in got] == [
        (1, "TEMP", None, "UUAA 61001 1="), (1, "TEMP", None, "UUBB 2="), (2, "SIGMET", None, "LFFF SIGMET 2 VALID="), (3, "SYNOP", "AAXX 01004", "AAXX 01004 03772 1="), (3, "SYNOP", "AAXX 01004", "AAXX 01004 03773 2="),
        (4, "TAF AMD", "TAF AMD", "TAF AMD EGLL 1="), (4, "TAF AMD", "TAF AMD", "TAF AMD EGKK 2="), (5, "TAF", "TAF", "TAF EGLL 1="), (6, "METAR", None, "EGLL 1="), (6, "METAR", None, "EGKK 2="),
    ]


def test_batches_are_bounded_by_bytes(spark):
    """Runs and vertices leave a task in batches of a few megabytes, however many rows come in at once."""
    import pyarrow as pa

    from fieldloom.sources import files, gts

    schema = pa.schema([("n", pa.int64()), ("bytes", pa.binary())])
    got = list(gts.batched(((k, bytes(1000)) for k in range(100)), schema, size=10_000))
    assert max(b.nbytes for b in got) < 15_000 and [x for b in got for x in b.column(0).to_pylist()] == list(range(100))
    assert list(gts.batched((), schema)) == []
    frame = b"%08dAN" % 1_000_000 + b"\x01" + bytes(999_999)
    dumps = spark.createDataFrame([(str(k), frame * 3) for k in range(4)], "path string, content binary").coalesce(1)
    for f in (gts.frames, gts.strict_frames):
        assert f(dumps).count() == 12
    assert files.shape_vertices(dumps).filter("error is not null").count() == 4
