"""Queries on bytes, bulletins, packed fields and parsing rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import binary as b
from fieldloom.functions import grammar as g
from fieldloom.functions.events import parse_events
from fieldloom.plans.base import query, table
from fieldloom.sources import grib, gts
from fieldloom.streaming.framing import counters

c = F.col
#: Documents as hexadecimal digits, for the twins.
HEX = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents)"


def field_sql(step: int, digits: int) -> str:
    return f"w AS (SELECT doc_id, CAST('0x' || substr(h, k * {step} + 1, {digits}) AS BIGINT) AS v FROM h, LATERAL (SELECT unnest(range(0, length(h) // {digits})) AS k))"


def bytes_of(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(c("text"), F.lit("")).cast("binary").alias("data"))


def holding(spark, d, n):
    """Those of at least n bytes. A filter on the size of an array of fields would make the array twice."""
    return bytes_of(spark, d).filter(F.octet_length("data") >= n)


@query("P-01_big_endian", f"WITH {HEX}, {field_sql(8, 8)} SELECT doc_id, count(*)::INT AS n, sum(v)::BIGINT AS total FROM w GROUP BY 1")
def big_endian(spark, d):
    out = holding(spark, d, 4).select("doc_id", b.fields(c("data"), 4).alias("w"))
    return out.select("doc_id", F.size("w").alias("n"), b.array_sum(c("w")).alias("total"))


@query("P-02_sign_magnitude", f"WITH {HEX}, {field_sql(4, 4)} SELECT doc_id, sum(CASE WHEN v >= 32768 THEN 32768 - v ELSE v END)::BIGINT AS total, count(*) FILTER (WHERE v >= 32768) AS negative FROM w GROUP BY 1")
def signed(spark, d):
    out = holding(spark, d, 2).select("doc_id", F.transform(b.fields(c("data"), 2), lambda v: b.sign_magnitude_of(v, 2)).alias("w"))
    return out.select("doc_id", b.array_sum(c("w")).alias("total"), F.size(F.filter("w", lambda x: x < 0)).cast("long").alias("negative"))


@query(
    "P-03_hex_float",
    f"""WITH {HEX}, {field_sql(8, 8)} SELECT doc_id, max(f) AS hi, min(f) AS lo FROM
  (SELECT doc_id, (CASE WHEN v >> 31 > 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * (v & 16777215)::DOUBLE * 2.0::DOUBLE ** (4 * (((v >> 24) & 127) - 64) - 24) AS f FROM w) GROUP BY 1""",
)
def floats(spark, d):
    out = holding(spark, d, 4).select("doc_id", F.transform(b.fields(c("data"), 4), b.hex_float_of).alias("f"))
    return out.select("doc_id", F.array_max("f").alias("hi"), F.array_min("f").alias("lo"))


@query("P-04_bit_fields", f"WITH {HEX}, {field_sql(3, 3)} SELECT doc_id, count(*)::INT AS n, sum(v)::BIGINT AS total FROM w GROUP BY 1")
def bit_fields(spark, d):
    out = holding(spark, d, 2).select("doc_id", b.bit_fields(c("data"), 12).alias("w"))
    return out.select("doc_id", F.size("w").alias("n"), b.array_sum(c("w")).alias("total"))


@query("P-16_unpack_and_scale", f"WITH {HEX}, {field_sql(3, 3)} SELECT doc_id, (2.0::DOUBLE ** -3 * max(v) + -16.0) * 10.0::DOUBLE ** -2 AS hi FROM w GROUP BY 1")
def scaled(spark, d):
    out = holding(spark, d, 2).select("doc_id", b.bit_fields(c("data"), 12).alias("w"))
    return out.select("doc_id", b.decimal_scaled(b.unpacked(F.array_max("w"), F.lit(-3), F.lit(-16.0)), F.lit(2)).alias("hi"))


@query("A-08_set_bits", "SELECT doc_id, bit_count(encode(coalesce(text, ''))::BIT)::BIGINT AS bits FROM documents")
def set_bits(spark, d):
    return bytes_of(spark, d).select("doc_id", b.set_bits(c("data")).alias("bits"))


@query("P-05_bounded_reads", "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) < 100 + 4 THEN 'past the end' END AS error, CASE WHEN strlen(coalesce(text, '')) >= 104 THEN CAST('0x' || substr(hex(encode(coalesce(text, ''))), 201, 8) AS BIGINT) END AS value FROM documents")
def bounded_reads(spark, d):
    return bytes_of(spark, d).select("doc_id", b.underflow(c("data"), 100, 4).alias("error"), b.unsigned(c("data"), 100, 4).alias("value"))


@query("S-01_read_files", "SELECT 'PAR1' AS opening, count(*) AS files FROM (SELECT 1)")
def whole_files(spark, d):
    from fieldloom.sources.files import read_files

    return read_files(spark, f"{d}/region.parquet").groupBy(F.decode(F.expr("substring(content, 1, 4)"), "ISO-8859-1").alias("opening")).agg(F.count("*").alias("files"))


@query("S-15_format_bits", "SELECT o_orderkey, lpad(bin(o_custkey), 24, '0') AS bits FROM orders")
def bits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", b.format_bits(c("o_custkey"), 24).alias("bits"))


@query("A-07_points_in_rows", "SELECT l_orderkey, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def points(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(c("l_linenumber").cast("long")).alias("total"))


# --- packed fields ---------------------------------------------------------------------------------------------------

#: Numbers of 12 bits in steps of 1/128 from -16: the reference word is -16 as a base-16 float.
STEP, LOW, LOW_WORD, BITS = 7, -16.0, 0xC2100000, 12


def raw_of(vector):
    """The packed numbers of a vector."""
    return F.transform(vector, lambda v: F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((v.cast("double") - LOW) * (1 << STEP) + 0.5))).cast("long"))


def messages(spark, d):
    """Each vector as one message: four rows of 16 points that unfold to 31."""
    rows = table(spark, d, "embeddings").withColumn("raw", raw_of(c("embedding")))
    code = F.get(F.array(*map(F.lit, (7, 11, 52, 33, 34))), (c("vec_id") % 5).cast("int"))
    level = F.get(F.array(*map(F.lit, (100, 6, 7))), (c("vec_id") % 3).cast("int"))
    when = F.timestamp_seconds(F.lit(946684800) + c("vec_id") * 3600)
    area = (c("vec_id") % 90 * 1000, -(c("vec_id") % 90) * 1000, F.lit(-180000), F.lit(179000))
    made = grib.encode(code, level, c("vec_id") % 1000, when, c("vec_id") % 24, area, F.lit(31), F.array_repeat(F.lit(16), 4), c("raw"), BITS, F.lit(-STEP), F.lit(LOW_WORD), F.lit(0))
    return rows.select("vec_id", made.alias("message"))


@query(
    "P-15_decode_fields",
    f"""WITH r AS (SELECT vec_id, i, (greatest(0, least({(1 << BITS) - 1}, floor((embedding[i + 1]::DOUBLE + 16) * 128 + 0.5))) / 128 - 16) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)),
  e AS (SELECT a.vec_id, 2 * (a.i % 16) AS x, a.i // 16 AS y, a.v FROM r a UNION ALL SELECT a.vec_id, 2 * (a.i % 16) + 1, a.i // 16, a.v * 0.5 + b.v * 0.5 FROM r a JOIN r b ON a.vec_id = b.vec_id AND b.i = a.i + 1 WHERE a.i % 16 < 15)
SELECT vec_id, x::INT AS x, y::INT AS y, round(v, 6) + 0.0 AS value FROM e""",
)
def decoded(spark, d):
    out = grib.surface_cells(grib.decode_surfaces(messages(spark, d)), ["vec_id"])
    return out.withColumn("value", F.round("value", 6) + 0.0)


@query(
    "P-20_decode_criteria",
    """SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'geopotential_height' WHEN 1 THEN 'temperature' WHEN 2 THEN 'relative_humidity' ELSE 'generic' END AS param,
  CASE vec_id % 5 WHEN 3 THEN 33 WHEN 4 THEN 34 END AS code, CASE vec_id % 3 WHEN 0 THEN 'isobaric' WHEN 1 THEN 'max_wind' ELSE 'tropopause' END AS level,
  CASE WHEN vec_id % 3 = 0 THEN (vec_id % 1000)::INT END AS hpa, TIMESTAMP '2000-01-01' + to_hours(vec_id + vec_id % 24) AS valid,
  (vec_id % 90 * 1000)::DOUBLE AS top, (-(vec_id % 90) * 1000)::DOUBLE AS bottom FROM embeddings""",
)
def criteria(spark, d):
    out = grib.decode_surfaces(messages(spark, d))
    return out.select("vec_id", c("param.type").alias("param"), c("param.code").alias("code"), c("level.type").alias("level"), c("level.hpa1").alias("hpa"), c("valid.start").cast("timestamp_ntz").alias("valid"), c("area.top").alias("top"), c("area.bottom").alias("bottom"))


@query("P-07_decode_sections", "SELECT vec_id, 28::BIGINT AS pds_len, 40::BIGINT AS gds_len, 107::BIGINT AS bds_len, 31::BIGINT AS ni, 4::BIGINT AS nj, 64::BIGINT AS packed, -7::BIGINT AS scale, -16.0::DOUBLE AS reference, true AS end_ok FROM embeddings")
def decoded_sections(spark, d):
    out = grib.decode_sections(messages(spark, d))
    return out.select("vec_id", c("pds.len").alias("pds_len"), c("gds.len").alias("gds_len"), c("bds.len").alias("bds_len"), c("gds.ni").alias("ni"), c("gds.nj").alias("nj"), b.array_sum(c("gds.pir")).alias("packed"), c("bds.scale").alias("scale"), c("bds.fref").alias("reference"), "end_ok")


@query(
    "P-24_decode_without_rows",
    f"SELECT vec_id, (i % 16)::INT AS x, (i // 16)::INT AS y, round((greatest(0, least({(1 << BITS) - 1}, floor((embedding[i + 1]::DOUBLE + 16) * 128 + 0.5))) / 128 - 16), 6) + 0.0 AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)",
)
def decoded_without_rows(spark, d):
    """Each vector as a message of four rows of 16 points, without a list of points in row."""
    made = grib.encode(F.lit(11), F.lit(100), F.lit(500), F.timestamp_seconds(F.lit(946684800)), F.lit(0), (F.lit(1), F.lit(0), F.lit(0), F.lit(1)), F.lit(16), F.lit(None).cast("array<int>"), raw_of(c("embedding")), BITS, F.lit(-STEP), F.lit(LOW_WORD), F.lit(0))
    out = grib.decode_surfaces(table(spark, d, "embeddings").select("vec_id", made.alias("message")))
    return grib.surface_cells(out.filter("error is null"), ["vec_id"]).withColumn("value", F.round("value", 6) + 0.0)


@query("P-26_decode_grid", f"SELECT vec_id, 31::INT AS nx, 4::INT AS ny, 124::INT AS n, round(max(greatest(0, least({(1 << BITS) - 1}, floor((v::DOUBLE + 16) * 128 + 0.5))) / 128 - 16), 6) AS hi FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def decoded_grid(spark, d):
    out = grib.decode_surfaces(messages(spark, d))
    return out.select("vec_id", "nx", "ny", F.size("buf").alias("n"), F.round(F.array_max("buf"), 6).alias("hi"))


@query("P-09_rotated_grid", "SELECT vec_id, 10::BIGINT AS type, -(vec_id % 90000)::BIGINT AS pole_lat, (vec_id % 1000)::BIGINT AS pole_lon, (vec_id % 90 * 1000)::BIGINT AS la1 FROM embeddings")
def rotated(spark, d):
    """The grid section of each message, made a rotated one."""
    rows = messages(spark, d).withColumn("gds", F.expr("substring(message, 37, 40)"))
    head = F.concat(F.unhex(F.lit("00002A0021" + "0A")), F.expr("substring(gds, 7, 26)"))
    poles = F.unhex(F.concat(grib.signed_hex(-(c("vec_id") % 90000), 3), grib.signed_hex(c("vec_id") % 1000, 3), F.lit("00000000")))
    got = rows.select("vec_id", grib.decode_gds(F.concat(head, poles), F.lit(0)).alias("g"))
    return got.select("vec_id", "g.type", "g.pole_lat", "g.pole_lon", "g.la1")


@query("P-11_bitmap", "SELECT doc_id, (strlen(text) * 8 - 3)::INT AS n, 3::BIGINT AS unused, bit_count(encode(text)::BIT)::BIGINT AS bits FROM (SELECT doc_id, coalesce(text, '') || '@' AS text FROM documents)")
def bitmap(spark, d):
    """The bytes of each text, and one more (64) whose last three bits are not used, as a bitmap."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("@")).cast("binary").alias("data"))
    section = F.concat(F.unhex(F.concat(grib.hex_of(F.octet_length("data") + 6, 3), F.lit("03"), F.lit("0000"))), c("data"))
    got = rows.select("doc_id", grib.decode_bms(section, F.lit(0)).alias("m"))
    counted = b.let(c("m.bits"), lambda x: F.struct(F.size(x).alias("n"), b.ones(x).alias("bits")))
    return got.select("doc_id", c("m.unused_bits").alias("unused"), counted.alias("k")).select("doc_id", "k.n", "unused", "k.bits")


@query("S-15_section_text", "SELECT vec_id, 'pds param ' || [7, 11, 52, 33, 34][vec_id % 5 + 1] || chr(10) || 'pds level_flg ' || [100, 6, 7][vec_id % 3 + 1] AS shown, 52::INT AS lines FROM embeddings")
def section_text(spark, d):
    rows = grib.decode_sections(messages(spark, d))
    text = rows.select("vec_id", grib.section_text(rows).alias("t"))
    return text.select("vec_id", F.regexp_extract("t", r"pds param \d+\npds level_flg \d+", 0).alias("shown"), F.size(F.split("t", "\n")).alias("lines"))


# --- framed bulletins ------------------------------------------------------------------------------------------------


def dumps(spark, d):
    """Twenty documents a dump: each a bulletin in a frame, every third frame padded, every fourth after junk."""
    docs = table(spark, d, "documents")
    head = F.concat(F.lit("\x01\r\r\n"), F.lpad((c("doc_id") % 1000).cast("string"), 3, "0"), F.lit("\r\r\nSADL"), F.lpad((c("doc_id") % 100).cast("string"), 2, "0"), F.lit(" EDZW "), F.lpad((c("doc_id") % 1000000).cast("string"), 6, "0"), F.when(c("doc_id") % 2 == 0, " RRA").otherwise(""), F.lit("\r\r\n"))
    body = F.concat(head, F.coalesce("text", F.lit("")), F.lit("\x03")).cast("binary")
    type_ = F.get(F.array(*[F.lit(t.decode()) for t in gts.TYPES]), (c("doc_id") % 5).cast("int"))
    frame = F.concat(F.when(c("doc_id") % 4 == 0, F.lit("some junk between frames")).otherwise("").cast("binary"), F.when(c("doc_id") % 3 == 0, gts.frame(type_, body, True)).otherwise(gts.frame(type_, body)))
    rows = docs.select(F.floor(c("doc_id") / 20).alias("dump"), "doc_id", frame.alias("f")).groupBy("dump").agg(F.array_sort(F.collect_list(F.struct("doc_id", "f"))).alias("f"))
    content = F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x.f)), ""))
    return rows.select(c("dump").cast("string").alias("path"), content.alias("content"))


_FRAMES = """WITH f AS (SELECT doc_id // 20 AS dump, doc_id, 10 + strlen(coalesce(text, '')) + 1 + 31 + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 8 ELSE 0 END AS n,
  ['AN', 'BI', 'FX', '00', '01'][doc_id % 5 + 1] AS type FROM documents)"""


@query("S-04_split_frames", f"{_FRAMES} SELECT dump::VARCHAR AS path, 'frame' AS kind, type, count(*) AS runs, sum(n)::BIGINT AS bytes FROM f GROUP BY ALL UNION ALL SELECT dump::VARCHAR, 'junk', NULL, count(*), (24 * count(*))::BIGINT FROM f WHERE doc_id % 4 = 0 GROUP BY ALL")
def split_frames(spark, d):
    runs = gts.frames(dumps(spark, d))
    return runs.groupBy("path", "kind", "type").agg(F.count("*").alias("runs"), F.sum(c("finish") - c("start")).alias("bytes"))


@query("S-03_strict_frames", f"{_FRAMES} SELECT dump::VARCHAR AS path, 'frame' AS kind, type, count(*) AS runs, sum(n)::BIGINT AS bytes FROM f GROUP BY ALL UNION ALL SELECT dump::VARCHAR, 'bad', NULL, count(*), (24 * count(*))::BIGINT FROM f WHERE doc_id % 4 = 0 GROUP BY ALL")
def strict_frames(spark, d):
    runs = gts.strict_frames(dumps(spark, d))
    return runs.groupBy("path", "kind", "type").agg(F.count("*").alias("runs"), F.sum(c("finish") - c("start")).alias("bytes"))


@query("T-02_chunked_counters", f"{_FRAMES} SELECT count(*) AS frames, count(*) FILTER (WHERE doc_id % 4 = 0) AS junk, (sum(n) + 24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS bytes, (24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS junk_bytes FROM f")
def chunked(spark, d):
    """Fed a thousand bytes at a time, as a stream is."""
    return counters(gts.frames(dumps(spark, d), chunk=1000))


@query(
    "S-05_bulletin_heads",
    """SELECT (doc_id // 20)::VARCHAR AS path, lpad((doc_id % 1000)::VARCHAR, 3, '0') AS csn, 'SADL' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS ttaaii, 'EDZW' AS cccc, lpad((doc_id % 1000000)::VARCHAR, 6, '0') AS yygggg,
  CASE WHEN doc_id % 2 = 0 THEN 'RRA' END AS bbb, count(*) AS n, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY ALL""",
)
def heads(spark, d):
    out = gts.bulletins(gts.frames(dumps(spark, d)))
    return out.groupBy("path", "csn", "ttaaii", "cccc", "yygggg", "bbb").agg(F.count("*").alias("n"), F.sum(F.octet_length("body").cast("long")).alias("bytes"))


@query("S-06_find_messages", "SELECT (vec_id // 10)::VARCHAR AS path, count(*) AS messages, (sum(187))::BIGINT AS bytes FROM embeddings GROUP BY ALL")
def find_messages(spark, d):
    """Messages that stand one after the other in a file, with text between."""
    rows = messages(spark, d).withColumn("x", F.concat(F.lit("noise GRI ").cast("binary"), c("message")))
    files = rows.groupBy(F.floor(c("vec_id") / 10).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("f"))
    files = files.select("path", F.unhex(F.array_join(F.transform("f", lambda r: F.hex(r.x)), "")).alias("content"))
    return gts.gribs(files, "content").groupBy("path").agg(F.count("*").alias("messages"), F.sum(F.octet_length("message").cast("long")).alias("bytes"))


@query("S-18_find_or_scan", "SELECT (vec_id // 10)::VARCHAR AS path, count(*) FILTER (WHERE vec_id % 3 > 0) AS by_length, count(*) AS found FROM embeddings GROUP BY ALL")
def find_or_scan(spark, d):
    """Every third message claims a wrong length: its own end is found by scanning only. Between messages stand a false opening
    and an end without one."""
    rows = messages(spark, d)
    wrong = F.concat(F.expr("substring(message, 1, 4)"), F.unhex(F.lit("000030")), F.expr("substring(message, 8)"))
    rows = rows.withColumn("x", F.concat(F.lit("7777 GRI ").cast("binary"), F.when(c("vec_id") % 3 == 0, wrong).otherwise(c("message"))))
    files = rows.groupBy(F.floor(c("vec_id") / 10).cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("f"))
    files = files.select("path", F.unhex(F.array_join(F.transform("f", lambda r: F.hex(r.x)), "")).alias("content"))
    count = lambda n, **how: gts.gribs(files, "content", **how).groupBy("path").agg(F.count("*").alias(n))
    return files.select("path").join(count("by_length"), "path", "left").join(count("found", or_scan=True), "path", "left").select("path", F.coalesce("by_length", F.lit(0)).alias("by_length"), "found")


@query(
    "S-09_attributes",
    """SELECT c_nationkey::VARCHAR AS path, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS id, c_custkey::INT AS key, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 100000 / 100)::DOUBLE END AS balance FROM customer""",
)
def shape_attributes(spark, d):
    """A dBASE file a nation, a record a customer; some segments are blank and some balances are stars."""
    from fieldloom.sources import files

    rows = table(spark, d, "customer")
    k = c("c_custkey")
    money = F.lpad(F.format_string("%d.%02d", F.floor(k % 100000 / 100).cast("long"), (k % 100).cast("long")), 9, " ")
    record = F.concat(F.lit(" "), F.lpad(k.cast("string"), 8, " "), F.rpad(F.when(k % 4 > 0, c("c_mktsegment")).otherwise(""), 12, " "), F.when(k % 5 > 0, money).otherwise("*" * 9))
    data = rows.groupBy(c("c_nationkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r")))).alias("r"))
    field = lambda name, kind, size, places: name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([size, places]) + bytes(14)
    fields = field("KEY", b"N", 8, 0) + field("SEGMENT", b"C", 12, 0) + field("BALANCE", b"N", 9, 2)
    head = F.concat(F.lit("03010101"), little(F.size("r")), F.lit((32 + len(fields) + 1).to_bytes(2, "little").hex() + (30).to_bytes(2, "little").hex() + "00" * 20 + fields.hex() + "0d"))
    made = data.select("path", F.unhex(F.concat(head, F.hex(F.array_join(F.transform("r", lambda x: x.r), "")))).alias("content"))
    wide = files.attributes_wide(files.shape_attributes(made), ["KEY", "SEGMENT", "BALANCE"])
    return wide.select("path", "id", c("KEY.i").alias("key"), c("SEGMENT.s").alias("segment"), c("BALANCE.d").alias("balance"))


def double_hex(n):
    """The bytes of a whole number from 0 to 2^20 as a double, least first."""
    e = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-9).cast("int")
    high = (F.lit(1023) + e).cast("long") * (1 << 20) + (n * F.pow(F.lit(2.0), 20 - e)).cast("long") - (1 << 20)
    h = F.lpad(F.hex(high), 8, "0")
    return F.when(n == 0, F.lit("0" * 16)).otherwise(F.concat(F.lit("0" * 8), F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def little(n):
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


@query("S-08_shape_vertices", "SELECT c_nationkey::VARCHAR AS path, (row_number() OVER w - 1)::INT AS id, k::INT AS seq, CASE k WHEN 0 THEN 'move_to' WHEN 3 THEN 'close' ELSE 'line_to' END AS cmd, (c_custkey + CASE WHEN k IN (1, 2) THEN 5 ELSE 0 END)::DOUBLE AS x, (c_custkey % 90 + CASE WHEN k = 2 THEN 7 ELSE 0 END)::DOUBLE AS y FROM customer, range(0, 4) r(k) WINDOW w AS (PARTITION BY c_nationkey, k ORDER BY c_custkey)")
def shape_vertices(spark, d):
    """A shapefile a nation, a triangle a customer."""
    from fieldloom.sources import files

    k = c("c_custkey")
    corners = [(k, k % 90), (k + 5, k % 90), (k + 5, k % 90 + 7), (k, k % 90)]
    body = F.concat(F.lit("05000000" + "0" * 64), little(F.lit(1)), little(F.lit(4)), little(F.lit(0)), *[double_hex(v) for xy in corners for v in xy])
    record = F.concat(F.lpad(F.hex(k), 8, "0"), F.lpad(F.hex((F.length(body) / 4).cast("long")), 8, "0"), body)
    rows = table(spark, d, "customer").groupBy(c("c_nationkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", record.alias("r")))).alias("r"))
    made = rows.select("path", F.unhex(F.concat(F.lit("0" * 200), F.array_join(F.transform("r", lambda x: x.r), ""))).alias("content"))
    return files.shape_vertices(made).filter("error is null").select("path", "id", "seq", "cmd", "x", "y")


@query("S-10_png_pixels", "SELECT vec_id::VARCHAR AS path, 8::INT AS width, 8::INT AS height, sum(3 * (floor(abs(v::DOUBLE) * 50)::INT % 256) + 255)::BIGINT AS total FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id")
def png_pixels(spark, d):
    """Each vector as a gray image of 8 x 8, stored without compression."""
    from fieldloom.sources import files

    pixel = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 50) % 256).cast("long"))
    raw = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.concat(F.array(F.lit(0).cast("long")), F.slice("p", r * 8 + 1, F.lit(8)))))
    sums = F.aggregate("raw", F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, x: F.struct(((s.a + x) % 65521).alias("a"), ((s.b + s.a + x) % 65521).alias("b")))
    octets = F.array_join(F.transform("raw", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    packed = F.concat(F.lit("7801" + "01" + "4800" + "B7FF"), octets, F.lpad(F.hex("sums.b"), 4, "0"), F.lpad(F.hex("sums.a"), 4, "0"))
    chunk = lambda kind, body: F.concat(F.lpad(F.hex((F.length(body) / 2).cast("long")), 8, "0"), F.hex(F.lit(kind)), body, F.lit("0" * 8))
    image = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.lit("00000008" + "00000008" + "0800000000")), chunk("IDAT", packed), chunk("IEND", F.lit("")))
    rows = table(spark, d, "embeddings").select("vec_id", pixel.alias("p")).select("vec_id", raw.alias("raw")).withColumn("sums", sums)
    got = files.png_images(rows.select(c("vec_id").cast("string").alias("path"), F.unhex(image).alias("content"))).filter("error is null")
    octet = lambda i: F.conv(F.substring(F.hex("rgba"), i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return got.select("path", "width", "height", b.array_sum(F.transform(F.sequence(F.lit(0), F.lit(255)), octet)).alias("total"))


@query(
    "S-07_split_reports",
    """WITH t AS (SELECT conv_id, conv_id % 8 AS k, ['TAF AMD', 'TAF', 'METAR', 'AAXX 12/04', 'BBXX', 'UUBB', 'EDZW SIGMET', 'STAFF'][conv_id % 8 + 1] AS opening, string_agg(replace(coalesce(text, ''), '=', '') || '=', chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY ALL),
  s AS (SELECT conv_id, k, opening, list_transform(string_split(t, '=')[:-2], lambda r: trim(regexp_replace(r, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS r FROM t),
  e AS (SELECT conv_id, k, opening, unnest(CASE WHEN k IN (5, 6) THEN r[:1] ELSE r END) AS r FROM s WHERE k < 7)
SELECT conv_id, ['TAF AMD', 'TAF', 'METAR', 'SYNOP', 'SHIP', 'TEMP', 'SIGMET'][k + 1] AS kind, CASE WHEN k IN (0, 1, 3, 4) THEN opening END AS header, count(*) AS reports, sum(length(r) + 1 + CASE WHEN k = 2 THEN 0 ELSE length(opening) + 1 END)::BIGINT AS chars FROM e GROUP BY ALL""",
)
def split_reports(spark, d):
    """Bulletins of seven kinds, and some that only seem to begin like one."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    opening = F.get(F.array(*map(F.lit, ("TAF AMD", "TAF", "METAR", "AAXX 12/04", "BBXX", "UUBB", "EDZW SIGMET", "STAFF"))), (c("conv_id") % 8).cast("int"))
    text = F.concat(opening, F.lit(" "), F.array_join(F.transform("t", lambda r: F.concat(F.replace(F.coalesce(r.text, F.lit("")), F.lit("="), F.lit("")), F.lit("="))), "\n"))
    out = gts.reports(turns.select("conv_id", text.alias("text")))
    return out.groupBy("conv_id", "kind", "header").agg(F.count("*").alias("reports"), F.sum(F.length("report").cast("long")).alias("chars"))


#: Lines with words in them; the first branch always takes a word and then fails.
LINES = ["capture", 1, ["seq", ["opt", ["re", " +"]], ["plus", ["seq", ["or", ["seq", ["capture", 3, ["re", r"[^ \n]+"]], ["re", r"[^ \n]"]], ["capture", 2, ["re", r"[^ \n]+"]]], ["opt", ["re", " +"]]]]]]


def _line_events(name: str, key: str, text: str) -> str:
    return f"""WITH d AS (SELECT {key} AS id, {text} AS t FROM {name}),
  w AS (SELECT id, unnest(regexp_extract_all(t, '[^ \\n]+')) AS m, unnest(regexp_split_to_array(t, '[^ \\n]+')[:-2]) AS p, unnest(range(len(regexp_extract_all(t, '[^ \\n]+')))) AS k FROM d),
  ws AS (SELECT id, count(*) AS words, sum(pos)::BIGINT AS word_starts FROM (SELECT id, sum(length(p)) OVER o + coalesce(sum(length(m)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w WINDOW o AS (PARTITION BY id ORDER BY k)) GROUP BY 1),
  l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d),
  lp AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k) - 1 AS finish FROM l),
  lw AS (SELECT *, sum(len(regexp_extract_all(line, '[^ \\n]+'))) OVER (PARTITION BY id ORDER BY k) AS upto, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS n FROM lp WHERE regexp_matches(line, '[^ ]')),
  ls AS (SELECT id, count(*) AS lines, sum(finish)::BIGINT AS line_finishes, sum(upto + n)::BIGINT AS line_places FROM lw GROUP BY 1)
SELECT id, lines, words, word_starts, line_finishes, line_places FROM ls JOIN ws USING (id)"""


def _line_sums(rows):
    is_, at = (lambda i: c("e") == i), (lambda i, k: F.sum(F.when(c("e") == i, c(k)).otherwise(0).cast("long")))
    found = parse_events(rows, "t", LINES).withColumnRenamed("id", "e").withColumnRenamed("key", "id")
    return found.groupBy("id").agg(F.count_if(is_(1)).alias("lines"), F.count_if(is_(2)).alias("words"), at(2, "start").alias("word_starts"), at(1, "finish").alias("line_finishes"), at(1, "seq").alias("line_places")).filter("lines > 0")


@query("X-16_nested_events", _line_events("documents", "doc_id", "coalesce(text, '')"))
def nested_events(spark, d):
    """Words within lines: spans, and the order in which captures are completed; events of failed branches are taken back."""
    return _line_sums(table(spark, d, "documents").select(c("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("t")))


@query("X-16_page_events", _line_events("pages", "page_id", "coalesce(html, '')"))
def page_events(spark, d):
    return _line_sums(table(spark, d, "pages").select(c("page_id").alias("key"), F.coalesce("html", F.lit("")).alias("t")))


#: A frame whose body, as long as its head says, is a bulletin with any text.
BULLETIN = ["seq", ["re", "\x01\r\r\n"], ["capture", 2, ["re", "[0-9]{2,6}"]], ["re", "\r\r\n"], ["capture", 3, ["re", "[A-Za-z]{4}[0-9]{2}"]], ["re", " [A-Za-z]{4} [0-9]{6}(?: [A-Za-z]{3})?\r\r\n"], ["capture", 4, ["rest"]]]
FRAME = lambda body: ["capture", 1, ["bounded", ["re", "[0-9]{8}"], ["re", "AN|BI|FX|00|01"], body]]


@query(
    "S-03_bounded_bodies",
    """SELECT (doc_id // 20)::VARCHAR AS path, count(*) AS frames, sum(3)::BIGINT AS csn, sum(6)::BIGINT AS heads, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bodies, sum(10 + strlen(coalesce(text, '')) + 1 + 31 + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END)::BIGINT AS bytes FROM documents GROUP BY 1""",
)
def bounded_bodies(spark, d):
    """Frames whose bodies are parsed by a grammar given as an argument, within the length that each head says."""
    found = parse_events(dumps(spark, d).select("path", g.latin1(c("content")).alias("t")), "t", FRAME(BULLETIN))
    size = lambda i: F.sum(F.when(c("id") == i, c("finish") - c("start")).otherwise(0).cast("long"))
    return found.groupBy("path").agg(F.count_if(c("id") == 1).alias("frames"), size(2).alias("csn"), size(3).alias("heads"), size(4).alias("bodies"), size(1).alias("bytes"))


# --- rules -----------------------------------------------------------------------------------------------------------

_LETTERS, _DIGITS = g.plus(g.between("a", "z")), g.plus(g.digit)
URL = g.seq(g.capture(1, _LETTERS), g.literal("://"), g.capture(2, g.advance_if_not(g.one_of("/"))), g.opt(g.capture(3, g.seq(g.char("/"), g.star(g.any_char)))))


@query("X-16_capture_url", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(url)::INT AS n FROM pages")
def urls(spark, d):
    u = c("url")
    return table(spark, d, "pages").select("page_id", URL.search(u, 1).alias("scheme"), URL.search(u, 2).alias("host"), F.length("url").alias("n"))


#: Name, rule, and its twin for an engine that backtracks otherwise but has nothing to go back for here.
RULES = {
    "plus": (_DIGITS, "[0-9]+"),
    "choice": (g.choice(g.literal("the"), g.literal("of"), g.literal("and")), "the|of|and"),
    "sequence": (g.seq(g.upper, _LETTERS), "[A-Z][a-z]+"),
    "repeat": (g.repeat(g.between("a", "z"), 3), "[a-z]{3}"),
    "repeat_range": (g.repeat(g.between("a", "z"), 2, 5), "[a-z]{2,5}"),
    "opt": (g.seq(g.literal("e"), g.opt(g.literal("r"))), "er?"),
    "star": (g.seq(g.literal("t"), g.star(g.literal("h"))), "th*"),
    "advance": (g.advance_if_not(g.char("\n")), "[^\n]+"),
    "set": (g.plus(g.one_of("aeiou")), "[aeiou]+"),
    "until": (g.advance_until(g.char(" ")), "[^ ]+ "),
    "nothing": (g.seq(g.nothing, g.literal("in"), g.nothing), "in"),
    "ending": (g.seq(g.any_char, g.end), "(?s:.)$"),
}


@query("X-06_rule_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INT AS {k}" for k, (_, p) in RULES.items()) + " FROM documents WHERE text IS NOT NULL")
def rule_counts(spark, d):
    t = c("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", *[F.size(r.all(t)).alias(k) for k, (r, _) in RULES.items()])


LOOK_AHEAD = "SELECT {0}, length({1}) - length(replace({1}, 't', '')) - (length({1}) - length(replace({1}, 'th', ''))) // 2 AS rejected, (length({1}) - length(replace({1}, 'th', ''))) // 2 AS required FROM {2} WHERE {1} IS NOT NULL"


def looked_ahead(rows, id_, text):
    """How often t stands without h after it, and with it: the twin counts by lengths, as it has no look-ahead."""
    t = c(text)
    return rows.filter(t.isNotNull()).select(id_, F.size(g.seq(g.char("t"), g.reject(g.char("h"))).all(t)).cast("long").alias("rejected"), F.size(g.seq(g.char("t"), g.require(g.char("h"))).all(t)).cast("long").alias("required"))


@query("X-13_look_ahead", LOOK_AHEAD.format("doc_id", "text", "documents"))
def look_ahead(spark, d):
    return looked_ahead(table(spark, d, "documents"), "doc_id", "text")


@query("X-13_look_ahead_all", LOOK_AHEAD.format("page_id", "html", "pages"))
def look_ahead_all(spark, d):
    """The same rules over raw pages."""
    return looked_ahead(table(spark, d, "pages"), "page_id", "html")


@query("X-10_spans", "SELECT doc_id, count(*) AS n, sum(s)::BIGINT AS starts FROM (SELECT doc_id, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS s, k, max(k) OVER (PARTITION BY doc_id) AS last FROM (SELECT doc_id, unnest(string_split(text, ',')) AS p, generate_subscripts(string_split(text, ','), 1) AS k FROM documents)) WHERE k < last GROUP BY 1")
def spans(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.explode(g.char(",").spans(c("text"))).alias("s"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(c("s.start").cast("long")).alias("starts"))


@query("X-21_event_text", "SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN length(text) > 60 THEN left(text, 30) || ' ... ' || right(text, 30) ELSE text END, '[ \\t\\n\\x0B\\f\\r]', ' ', 'g'), '[^\\x20-\\x7e]', '*', 'g') AS shown FROM documents")
def shown(spark, d):
    return table(spark, d, "documents").select("doc_id", g.event_text(c("text")).alias("shown"))
