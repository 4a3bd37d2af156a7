"""GRIB edition 1 on columns: section decoding, level, parameter, time and area maps, unpacking, and an encoder.

Sections decode as columns, by offsets; values are unpacked as arrays in Arrow batches. Where a message cannot be decoded,
error says why and the values are null; nothing fails a whole job. Section constants follow the public
specification of the format.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.binary import as_int, bit_fields, hex_float_of, let, sign_magnitude, unsigned

MISSING_COUNT = 0xFFFF
HAS_GDS, HAS_BMS = 0x80, 0x40


def with_offsets(messages: DataFrame, data: str) -> DataFrame:
    """messages with the byte offsets of the sections, each null where the one before is; one column builds on another,
    so that no offset is computed twice."""
    b, c = F.col(data), F.col
    out = messages.withColumn("_pds", F.lit(8)).withColumn("_flag", unsigned(b, F.lit(15), 1)).withColumn("_next", (unsigned(b, F.lit(8), 3) + 8).cast("int"))
    for name, bit in (("gds", HAS_GDS), ("bms", HAS_BMS)):
        here = c("_flag").bitwiseAND(F.lit(bit)) > 0
        out = out.withColumn(f"_{name}", F.when(here, c("_next"))).withColumn("_len", unsigned(b, c("_next"), 3))
        out = out.withColumn("_next", F.when(here, c("_next") + c("_len")).otherwise(c("_next")).cast("int"))
    out = out.withColumn("_bds", c("_next")).withColumn("_len", unsigned(b, c("_bds"), 3))
    return out.withColumn("_end", (c("_bds") + c("_len")).cast("int")).drop("_flag", "_next", "_len")


def decode_ids(data: Column) -> Column:
    return F.struct(unsigned(data, 4, 3).alias("len"), unsigned(data, 7, 1).alias("edition"), (F.substring(data, 1, 4) == F.lit(b"GRIB")).alias("magic_ok"))


#: Name, offset, bytes in the product section.
PDS_FIELDS = (
    ("len", 0, 3), ("table_version", 3, 1), ("center", 4, 1), ("model", 5, 1), ("grid", 6, 1), ("db_flag", 7, 1), ("param", 8, 1), ("level_flg", 9, 1), ("level2", 10, 2),
    ("year", 12, 1), ("month", 13, 1), ("day", 14, 1), ("hour", 15, 1), ("minute", 16, 1), ("tunit", 17, 1), ("tunit_0", 18, 1), ("tunit_1", 19, 1), ("tr_flg", 20, 1),
    ("avg", 21, 2), ("missing", 23, 1), ("century", 24, 1), ("subcenter", 25, 1),
)


def decode_pds(data: Column, at: Column) -> Column:
    fields = [unsigned(data, at + o, n).alias(k) for k, o, n in PDS_FIELDS]
    return F.struct(*fields, sign_magnitude(data, at + 26, 2).alias("scale10"))


def decode_gds(data: Column, at: Column) -> Column:
    """Latitude-longitude (type 0) and rotated (type 10) grids; pir: points in each row, where the section lists them."""
    ni, nj = unsigned(data, at + 6, 2), unsigned(data, at + 8, 2)
    nv, pv, kind = unsigned(data, at + 3, 1), unsigned(data, at + 4, 1), unsigned(data, at + 5, 1)
    real_ni, real_nj = F.when(ni == MISSING_COUNT, nj).otherwise(ni), F.when(nj == MISSING_COUNT, ni).otherwise(nj)
    listed = (pv != 255) & (nv == 0)
    pir = F.when(listed & (real_nj > 0), F.transform(F.sequence(F.lit(0), (real_nj - 1).cast("int")), lambda k: unsigned(data, at + (pv - 1).cast("int") + 2 * k, 2)))
    rotated = lambda c: F.when(kind == 10, c)
    return F.struct(
        unsigned(data, at, 3).alias("len"), nv.alias("nv"), pv.alias("pv"), kind.alias("type"), real_ni.alias("ni"), real_nj.alias("nj"),
        sign_magnitude(data, at + 10, 3).alias("la1"), sign_magnitude(data, at + 13, 3).alias("lo1"), unsigned(data, at + 16, 1).alias("res_flags"),
        sign_magnitude(data, at + 17, 3).alias("la2"), sign_magnitude(data, at + 20, 3).alias("lo2"), unsigned(data, at + 23, 2).alias("di"), unsigned(data, at + 25, 2).alias("dj"),
        unsigned(data, at + 27, 1).alias("scan_mode"), rotated(sign_magnitude(data, at + 32, 3)).alias("pole_lat"), rotated(sign_magnitude(data, at + 35, 3)).alias("pole_lon"), pir.alias("pir"),
    )


def decode_bms(data: Column, at: Column) -> Column:
    """The bitmap's bits; only a bitmap that follows (predetermined number 0) is accepted."""
    n = ((unsigned(data, at, 3) - 6) * 8 - unsigned(data, at + 3, 1)).cast("int")
    bits = bit_fields(F.substring(data, at + 7, (unsigned(data, at, 3) - 6).cast("int")), 1, n)
    return F.struct(unsigned(data, at, 3).alias("len"), unsigned(data, at + 3, 1).alias("unused_bits"), unsigned(data, at + 4, 2).alias("table"), F.when(unsigned(data, at + 4, 2) == 0, bits).alias("bits"))


def decode_bds(data: Column, at: Column) -> Column:
    flags, size, ref = unsigned(data, at + 3, 1), unsigned(data, at, 3), unsigned(data, at + 6, 4)
    return F.struct(
        size.alias("len"), F.shiftright(flags, 4).alias("flg"), flags.bitwiseAND(F.lit(15)).alias("unused_bits"), sign_magnitude(data, at + 4, 2).alias("scale"),
        ref.alias("ref"), hex_float_of(ref).alias("fref"), unsigned(data, at + 10, 1).alias("bits"), F.substring(data, at + 12, (size - 11).cast("int")).alias("buf"),
    )


def decode_sections(messages: DataFrame, data: str = "message") -> DataFrame:
    """messages with ids, pds, gds, bms, bds and end_ok. Offsets are made a column first, so each is computed once."""
    b = F.col(data)
    out = with_offsets(messages, data)
    o = lambda k: F.col(f"_{k}")
    out = out.withColumn("ids", decode_ids(b)).withColumn("pds", decode_pds(b, o("pds"))).withColumn("gds", F.when(o("gds").isNotNull(), decode_gds(b, o("gds"))))
    out = out.withColumn("bms", F.when(o("bms").isNotNull(), decode_bms(b, o("bms")))).withColumn("bds", decode_bds(b, o("bds")))
    return out.withColumn("end_ok", F.coalesce(F.substring(b, o("end") + 1, F.lit(4)) == F.lit(b"7777"), F.lit(False))).drop("_pds", "_gds", "_bms", "_bds", "_end")


def param_of(code: Column, compat: bool = False) -> Column:
    """Parameter codes 7, 11, 52, 33 and 34; compat: 33 is read as 34."""
    generic = F.when(code == 33, F.lit(34) if compat else F.lit(33)).otherwise(code).cast("int")
    none = F.lit(None).cast("string")
    make = lambda kind, c, unit: F.struct(F.lit(kind).alias("type"), c.alias("code"), unit.alias("unit"))
    nil = F.lit(None).cast("int")
    return F.when(code == 7, make("geopotential_height", nil, F.lit("m"))).when(code == 11, make("temperature", nil, F.lit("K"))).when(code == 52, make("relative_humidity", nil, F.lit("%"))).when(code.isin(33, 34), make("generic", generic, none))


def level_of(kind: Column, value: Column) -> Column:
    make = lambda name, order, hpa: F.struct(F.lit(name).alias("type"), F.lit(order).alias("ord"), hpa.cast("int").alias("hpa1"), F.lit(None).cast("int").alias("hpa2"))
    nil = F.lit(None)
    return F.when(kind == 100, make("isobaric", 3, value)).when(kind == 6, make("max_wind", 2, nil)).when(kind == 7, make("tropopause", 1, nil))


def valid_of(pds: Column) -> Column:
    """An instant (time range 0), in hours; 1: the reference time; 4: from the first to the second forecast hour."""
    run = F.make_timestamp((pds["century"] - 1) * 100 + pds["year"], pds["month"], pds["day"], pds["hour"], pds["minute"], F.lit(0))
    plus = lambda hours: run + F.make_interval(hours=hours.cast("int"))
    make = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("start"), b.alias("finish"))
    none = F.lit(None).cast("timestamp")
    return F.when(pds["tunit"] != 1, None).when(pds["tr_flg"] == 0, make("instant", plus(pds["tunit_0"]), none)).when(pds["tr_flg"] == 1, make("instant", run, none)).when(pds["tr_flg"] == 4, make("range", plus(pds["tunit_0"]), plus(pds["tunit_1"])))


def area_of(gds: Column) -> Column:
    """Corners as coded, unscaled."""
    return F.struct(gds["la1"].cast("double").alias("top"), gds["la2"].cast("double").alias("bottom"), gds["lo1"].cast("double").alias("left"), gds["lo2"].cast("double").alias("right"))


def expand_row(row: Column, n: Column) -> Column:
    """A row of m values stretched to n by linear interpolation; the last is the row's last."""

    def stretched(row: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: at(row, F.size(row), i))

    def at(row: Column, m: Column, i: Column) -> Column:
        p = i.cast("double") / (n - 1) * (m - 1)
        k = F.floor(p).cast("int")
        w = p - k
        inside = F.get(row, k) * (1 - w) + F.get(row, F.least(k + 1, m - 1)) * w
        return F.when(i == n - 1, F.get(row, m - 1)).otherwise(inside)

    return F.when((F.size(row) > 0) & (n > 0), let(row, stretched))


def _signed(data: bytes) -> int:
    if not data:
        raise Refused("truncated")
    v, top = int.from_bytes(data, "big"), 1 << (8 * len(data) - 1)
    return top - v if v >= top else v


class Refused(ValueError):
    """A message whose values this engine does not decode."""


def parse(data: bytes, compat: bool = False) -> tuple[dict, dict, np.ndarray]:
    """Product fields, grid fields and row-major values of a message."""
    if data[:4] != b"GRIB":
        raise Refused("bad magic")
    pds = {k: int.from_bytes(data[8 + o : 8 + o + n], "big") for k, o, n in PDS_FIELDS} | {"scale10": _signed(data[34:36])}
    if pds["len"] != 28:
        raise Refused("product section is not 28 bytes")
    at = 8 + pds["len"]
    if not pds["db_flag"] & HAS_GDS:
        raise Refused("no grid section")
    g = data[at:]
    size, nv, pv, kind = int.from_bytes(g[:3], "big"), g[3], g[4], g[5]
    if kind not in (0, 10):
        raise Refused("projection")
    ni, nj = int.from_bytes(g[6:8], "big"), int.from_bytes(g[8:10], "big")
    ni, nj = nj if ni == MISSING_COUNT else ni, ni if nj == MISSING_COUNT else nj
    gds = {"ni": ni, "nj": nj, "la1": _signed(g[10:13]), "lo1": _signed(g[13:16]), "la2": _signed(g[17:20]), "lo2": _signed(g[20:23])}
    pir = [int.from_bytes(g[pv - 1 + 2 * k : pv + 1 + 2 * k], "big") for k in range(nj)] if pv != 255 and nv == 0 else None
    at += size
    if pds["db_flag"] & HAS_BMS:
        raise Refused("bitmap")
    b = data[at:]
    size = int.from_bytes(b[:3], "big")
    if len(b) < size + 4 or size < 11 or b[size : size + 4] != b"7777":
        raise Refused("truncated")
    if b[3] >> 4:
        raise Refused("packing")
    scale, word, bits = _signed(b[4:6]), int.from_bytes(b[6:10], "big"), b[10]
    if bits > 25:
        raise Refused("more than 25 bits")
    if pir is None and compat:
        raise Refused("no points in row")
    n = sum(pir) if pir is not None else ni * nj
    if n * bits > (size - 11) * 8:
        raise Refused("truncated")
    flat = np.unpackbits(np.frombuffer(b, np.uint8, size - 11, 11))[: n * bits].reshape(n, bits)
    raw = flat @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)) if bits else np.zeros(n, np.int64)
    reference = (-1.0 if word >> 31 else 1.0) * (word & 0xFFFFFF) * 2.0 ** (4 * ((word >> 24 & 127) - 64) - 24)
    values = (2.0**scale * raw + reference) * 10.0 ** -pds["scale10"]
    if pir is not None:
        rows = np.split(values, np.cumsum(pir)[:-1])
        values = np.concatenate([stretch(r, ni) for r in rows]) if ni and len(rows) else values[:0]
    return pds, gds, values


def stretch(row: np.ndarray, n: int) -> np.ndarray:
    """expand_row on arrays."""
    if not len(row):
        raise Refused("a row without points")
    p = np.arange(n) / max(1, n - 1) * (len(row) - 1)
    k = np.floor(p).astype(int)
    w = p - k
    out = row[k] * (1 - w) + row[np.minimum(k + 1, len(row) - 1)] * w
    out[-1] = row[-1]
    return out


_PDS = ("param", "level_flg", "level2", "year", "month", "day", "hour", "minute", "tunit", "tunit_0", "tunit_1", "tr_flg", "century", "scale10")
_GDS = ("ni", "nj", "la1", "lo1", "la2", "lo2")


def decode_surfaces(messages: DataFrame, data: str = "message", compat: bool = False) -> DataFrame:
    """messages with param, level, valid, area, nx, ny, buf (row-major values) and error. Bits are unpacked as arrays in
    Arrow batches; what the fields mean is column expressions. compat: only messages with points in row have values, and
    parameter 33 reads as 34."""

    def run(batches):
        for b in batches:
            out: dict = {"pds": [], "gds": [], "buf": [], "error": []}
            for x in b.column(b.schema.get_field_index(data)):
                try:
                    row = (*parse(x.as_py() or b"", compat), None)
                except (Refused, IndexError) as e:
                    row = (None, None, None, str(e) if isinstance(e, Refused) else "truncated")
                out["pds"].append(row[0] and {k: row[0][k] for k in _PDS})
                out["gds"].append(row[1] and {k: row[1][k] for k in _GDS})
                out["buf"].append(row[2])
                out["error"].append(row[3])
            kinds = {"pds": pa.struct([(k, pa.int64()) for k in _PDS]), "gds": pa.struct([(k, pa.int64()) for k in _GDS]), "buf": pa.list_(pa.float64()), "error": pa.string()}
            for k, kind in kinds.items():
                b = b.append_column(k, pa.array(out[k], kind))
            yield b

    ints = lambda names: T.StructType([T.StructField(k, T.LongType()) for k in names])
    shape = T.StructType([*messages.schema.fields, T.StructField("pds", ints(_PDS)), T.StructField("gds", ints(_GDS)), T.StructField("buf", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    out = messages.mapInArrow(run, shape)
    pds = F.col("pds")
    out = out.withColumn("param", param_of(pds["param"], compat)).withColumn("level", level_of(pds["level_flg"], pds["level2"])).withColumn("valid", valid_of(pds)).withColumn("area", area_of(F.col("gds")))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("param").isNull(), "parameter").when(F.col("level").isNull(), "level").when(F.col("valid").isNull(), "time range")
    out = out.withColumn("error", why).withColumn("buf", F.when(F.col("error").isNull(), F.col("buf")))
    return out.withColumn("nx", F.col("gds.ni").cast("int")).withColumn("ny", F.col("gds.nj").cast("int")).drop("pds", "gds")


def surface_cells(surfaces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, value of the packed grids, row-major."""
    out = surfaces.filter("buf is not null").select(*keys, "nx", F.posexplode("buf").alias("_p", "value"))
    return out.select(*keys, (F.col("_p") % F.col("nx")).cast("int").alias("x"), F.floor(F.col("_p") / F.col("nx")).cast("int").alias("y"), "value")


def hex_of(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def signed_hex(value: Column, n: int) -> Column:
    v = value.cast("long")
    return hex_of(F.when(v < 0, (1 << (8 * n - 1)) - v).otherwise(v), n)


def encode(param: Column, level_flg: Column, level: Column, when: Column, hours: Column, area: tuple, ni: Column, pir: Column, raw: Column, bits: int, scale: Column, ref_word: Column, scale10: Column) -> Column:
    """A message with points in row (or none where pir is null): the twin of decode_surfaces, for writers and tests."""
    rows = F.size(pir)
    nj = F.when(pir.isNotNull(), rows).otherwise((F.size(raw) / ni).cast("int"))
    century = F.floor((F.year(when) - 1) / 100) + 1
    pds = F.concat(
        hex_of(F.lit(28), 3), F.lit("02620000"), F.lit("80"), hex_of(param, 1), hex_of(level_flg, 1), hex_of(level, 2), hex_of(F.year(when) - (century - 1) * 100, 1), hex_of(F.month(when), 1),
        hex_of(F.dayofmonth(when), 1), hex_of(F.hour(when), 1), hex_of(F.minute(when), 1), F.lit("01"), hex_of(hours, 1), F.lit("0000000000"), hex_of(century, 1), F.lit("00"), signed_hex(scale10, 2),
    )
    top, bottom, left, right = area
    listed = F.coalesce(F.array_join(F.transform(pir, lambda p: hex_of(p, 2)), ""), F.lit(""))
    gds = F.concat(
        hex_of(32 + F.length(listed) / 2, 3), F.lit("00"), F.when(pir.isNotNull(), F.lit("21")).otherwise(F.lit("FF")), F.lit("00"), hex_of(ni, 2), hex_of(nj, 2), signed_hex(top, 3), signed_hex(left, 3), F.lit("80"),
        signed_hex(bottom, 3), signed_hex(right, 3), F.lit("FFFFFFFF"), F.lit("00"), F.lit("00000000"), listed,
    )
    stream = F.array_join(F.transform(raw, lambda v: F.lpad(F.bin(v), bits, "0")), "")
    unused = F.pmod(-F.size(raw) * bits, F.lit(8))
    octet = lambda t, k: F.lpad(F.conv(F.substring(t, k * 8 - 7, F.lit(8)), 2, 16), 2, "0")
    size = F.ceil(F.size(raw) * bits / 8).cast("int")
    packed = let(F.rpad(stream, size * 8, "0"), lambda t: F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: octet(t, k)), ""))
    bds = F.concat(hex_of(11 + size, 3), hex_of(unused, 1), signed_hex(scale, 2), hex_of(ref_word, 4), hex_of(F.lit(bits), 1), packed)
    total = 8 + 28 + 32 + F.length(listed) / 2 + 11 + size + 4
    return F.unhex(F.concat(F.hex(F.lit("GRIB")), hex_of(total, 3), F.lit("01"), pds, gds, bds, F.hex(F.lit("7777"))))


def section_text(decoded: DataFrame) -> Column:
    """A message's sections as lines of name and value, for display: decode_sections() rows."""
    shown = lambda part, skip=(): [F.concat(F.lit(f"{part} {f.name} "), F.coalesce(F.col(part)[f.name].cast("string"), F.lit("-"))) for f in decoded.schema[part].dataType.fields if f.name not in skip]
    return F.array_join(F.array(*shown("ids"), *shown("pds"), *shown("gds", ("pir",)), *shown("bms", ("bits",)), *shown("bds", ("buf",))), "\n")
