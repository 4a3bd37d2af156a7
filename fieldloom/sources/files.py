"""Whole files, shapefiles with attributes, and PNG images, from binary columns that Spark's own readers fill.

A file that cannot be read becomes a row with an error text and no values; what was read of it before is told too.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.gts import batched


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): files of any store that Spark reads, one row each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: What the decoders raise on bytes that are cut off or make no sense.
BAD = (ValueError, struct.error, IndexError, zlib.error)


def _shapes(data: bytes):
    """(record id, shape type, rings) of the public .shp layout: points, polylines and polygons."""
    at, number = 100, 0
    if len(data) < 100:
        raise ValueError("no file header")
    while at < len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        if size < 4 or at + 8 + size > len(data):
            raise ValueError(f"record {number} is cut off")
        body = data[at + 8 : at + 8 + size]
        kind = struct.unpack("<i", body[:4])[0]
        rings = []
        if kind == 1:
            rings = [[struct.unpack("<2d", body[4:20])]]
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            rings = [list(map(tuple, xy[a:b].tolist())) for a, b in zip(starts, starts[1:], strict=False)]
        yield number, kind, rings
        number, at = number + 1, at + 8 + size


def shape_vertices(files: DataFrame) -> DataFrame:
    """(path, id, ring, seq, cmd, x, y, error): a ring's first vertex moves, its last closes polygons; other vertices draw."""

    def found(path, content):
        try:
            for id_, kind, rings in _shapes(content or b""):
                for r, ring in enumerate(rings):
                    for k, (x, y) in enumerate(ring):
                        last = kind == 5 and k == len(ring) - 1 and k > 0
                        yield path, id_, r, k, "move_to" if k == 0 else "close" if last else "line_to", x, y, None
        except BAD as e:
            yield path, None, None, None, None, None, None, str(e)

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())
        schema = pa.schema(list(zip(("path", "id", "ring", "seq", "cmd", "x", "y", "error"), kinds, strict=True)))
        return batched((row for b in batches for p, c in zip(b.column(0), b.column(1), strict=True) for row in found(p.as_py(), c.as_py())), schema)

    return files.select("path", "content").mapInArrow(run, "path string, id int, ring int, seq int, cmd string, x double, y double, error string")


def _attributes(data: bytes):
    """(record, field, kind, text) of the public dBASE layout; blank values are left out."""
    if len(data) < 32:
        raise ValueError("no file header")
    records, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        kind, size, decimals = chr(data[at + 11]), data[at + 16], data[at + 17]
        fields.append((name, {"C": "s"}.get(kind, "i" if kind == "N" and not decimals else "d" if kind in "NF" else "s"), size))
        at += 32
    for r in range(records):
        p = head + r * width + 1
        if p - 1 + width > len(data):
            raise ValueError(f"record {r} is cut off")
        for name, kind, size in fields:
            text = data[p : p + size].decode("latin-1").strip()
            p += size
            if text and not (kind != "s" and set(text) == {"*"}):
                yield r, name, kind, text


def shape_attributes(files: DataFrame) -> DataFrame:
    """(path, id, name, attr: struct<i, d, s>, error) in long form; a null attribute has no row."""

    def found(path, content):
        try:
            for x in _attributes(content or b""):
                yield path, *x, None
        except BAD as e:
            yield path, None, None, None, None, str(e)

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
        schema = pa.schema(list(zip(("path", "id", "name", "kind", "text", "error"), kinds, strict=True)))
        return batched((row for b in batches for p, c in zip(b.column(0), b.column(1), strict=True) for row in found(p.as_py(), c.as_py())), schema)

    out = files.select("path", "content").mapInArrow(run, "path string, id int, name string, kind string, text string, error string")
    value = lambda k, t: F.when(F.col("kind") == k, F.col("text").cast(t)).alias(k)
    return out.select("path", "id", "name", F.when(F.col("error").isNull(), F.struct(value("i", "int"), value("d", "double"), value("s", "string"))).alias("attr"), "error")


def attributes_wide(attributes: DataFrame, names: list[str]) -> DataFrame:
    """path, id and a column (struct<i, d, s>) for each name: one row a record that has any of them."""
    own = attributes.filter(F.col("error").isNull()).groupBy("path", "id")
    return own.agg(*[F.first(F.when(F.col("name") == n, F.col("attr")), ignorenulls=True).alias(n) for n in names])


def decode_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA bytes of an 8-bit gray or RGB image, alpha full."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    if head is None:
        raise ValueError("no image header")
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or color not in (0, 2) or interlaced:
        raise ValueError("only 8-bit gray or RGB without interlacing")
    step = 3 if color == 2 else 1
    raw, line = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step), np.zeros(w * step, np.int64)
    rows = []
    for r in raw:
        kind, x = int(r[0]), r[1:].astype(np.int64)
        if kind == 2:
            x = (x + line) & 255
        elif kind in (1, 3, 4):
            for i in range(len(x)):
                a, c = (x[i - step], line[i - step]) if i >= step else (0, 0)
                b = line[i]
                if kind == 4:
                    p = a + b - c
                    add = min((a, b, c), key=lambda v: (abs(p - v)))
                else:
                    add = a if kind == 1 else (a + b) // 2
                x[i] = (x[i] + add) & 255
        line = x
        rows.append(x)
    pixels = np.array(rows, np.uint8).reshape(h, w, step)
    rgba = np.concatenate([np.repeat(pixels, 3, axis=2) if step == 1 else pixels, np.full((h, w, 1), 255, np.uint8)], axis=2)
    return w, h, rgba.tobytes()


def png_images(files: DataFrame) -> DataFrame:
    """(path, width, height, rgba, error)."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append((p, *decode_png(c or b""), None))
                except BAD as e:
                    rows.append((p, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["path", "width", "height", "rgba", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, rgba binary, error string")
