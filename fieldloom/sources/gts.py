"""Framed bulletin streams: frames of eight length digits and two type characters, bulletins in them, fields in those.

One incremental splitter serves files (a Python data source, one task a file, because a frame's place depends on the
frames before it), binary columns and streams. Everything after framing is regular expressions on columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fieldloom.functions import grammar as g

#: Frame types, and what a bulletin begins and ends with.
TYPES = (b"AN", b"BI", b"FX", b"00", b"01")
START, FINISH, PAD = b"\x01", b"\x03", b"00000000"
#: Bytes that must follow before a byte can be called junk.
LOOK_AHEAD = 16
HEAD = re.compile(rb"(\d{8})(" + b"|".join(TYPES) + rb")\x01")
SPAN = "struct<kind:string,type:string,start:long,finish:long>"


class Splitter:
    """Splits a byte stream into runs of junk and frames, as bytes arrive; finish() takes the rest as it is.

    offset: where the run that is not yet told begins. skipped: its bytes that are junk for sure and are not held. Bytes
    that arrive are only looked at once a frame that has begun is complete, so no byte is copied again and again.
    """

    def __init__(self, offset: int = 0, held: bytes = b"", skipped: int = 0):
        self.offset, self.parts, self.skipped = offset, [held], skipped
        self.size, self.need = len(held), 0

    @property
    def held(self) -> bytes:
        return b"".join(self.parts)

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[str, str | None, int, int]]:
        """(kind, type, start, finish) in order of place; kind is frame or junk."""
        self.parts.append(data)
        self.size += len(data)
        if self.size < self.need and not last:
            return
        buf, base, start, at, need = self.held, self.offset + self.skipped, self.offset, 0, 0
        while True:
            m = HEAD.search(buf, at)
            if not m:
                # A head may begin in the last bytes that are not yet all there.
                at = len(buf) if last else max(at, len(buf) - LOOK_AHEAD + 1)
                break
            end = m.start() + 10 + int(m[1])
            waits = not last and end + len(PAD) > len(buf)
            if end > len(buf) and not waits:  # only at the end: the frame's length is wrong
                at = m.start() + 1
                continue
            if base + m.start() > start:
                yield "junk", None, start, base + m.start()
                start = base + m.start()
            if waits:
                at, need = m.start(), end + len(PAD) - m.start()
                break
            if buf[end : end + len(PAD)] == PAD:
                end += len(PAD)
            yield "frame", m[2].decode(), start, base + end
            start, at = base + end, end
        if last and start < base + len(buf):
            yield "junk", None, start, base + len(buf)
            start = base + len(buf)
        self.offset, self.skipped, self.parts, self.size, self.need = start, base + at - start, [buf[at:]], len(buf) - at, need


def split(data: bytes, chunk: int | None = None) -> list[tuple[str, str | None, int, int]]:
    """All runs of a buffer, fed whole or in chunks; both give the same runs."""
    s, out = Splitter(), []
    step = chunk or max(1, len(data))
    for at in range(0, len(data), step):
        out += s.feed(data[at : at + step])
    return out + list(s.feed(b"", last=True))


#: Bytes of one batch of runs that leaves a task, and of the small files that one task reads.
BATCH, GROUP = 4 << 20, 8 << 20


def batched(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about size bytes, counting 64 a row and what its last value, if bytes, holds."""
    out, held = [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        out.append(row)
        held += 64 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
        if held >= size:
            yield made()
            out, held = [], 0
    if out:
        yield made()


RUNS = pa.schema([("path", pa.string()), ("no", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("start", pa.int64()), ("finish", pa.int64()), ("bytes", pa.binary())])


def frames(dumps: DataFrame, path: str = "path", content: str = "content", chunk: int | None = None) -> DataFrame:
    """(path, no, kind, type, start, finish, bytes) for each run of each row's content."""

    def found(batches):
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                name, data = p.as_py(), c.as_py() or b""
                for no, (kind, type_, start, finish) in enumerate(split(data, chunk)):
                    yield name, no, kind, type_, start, finish, data[start:finish]

    def run(batches):
        return batched(found(batches), RUNS)

    return dumps.select(F.col(path).cast("string").alias("path"), content).mapInArrow(run, "path string, no int, kind string, type string, start long, finish long, bytes binary")


#: A frame of the strict grammar, wherever it may begin.
STRICT = re.compile(rb"(?=(\d{8})([0-9A-Za-z]{2}))")


def strict_runs(data: bytes) -> list[tuple[str, str | None, int, int, int]]:
    """(kind, type, start, body finish, finish) by the strict grammar: eight digits, two letters or digits of any type, a body
    of just the indicated length, eight zeros or not. Where no such frame begins a bad run goes on until one does."""
    out, at, bad = [], 0, 0
    for m in STRICT.finditer(data):
        body = m.start() + 10 + int(m[1])
        if m.start() < at or body > len(data):
            continue
        if m.start() > bad:
            out.append(("bad", None, bad, m.start(), m.start()))
        at = bad = body + len(PAD) if data[body : body + len(PAD)] == PAD else body
        out.append(("frame", m[2].decode(), m.start(), body, at))
    return [*out, ("bad", None, bad, len(data), len(data))] if bad < len(data) else out


def strict_frames(dumps: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, no, kind, type, start, finish, body) by the strict grammar; a bad run's bytes are its body."""

    def found(batches):
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                name, data = p.as_py(), c.as_py() or b""
                for no, (kind, type_, start, body, finish) in enumerate(strict_runs(data)):
                    yield name, no, kind, type_, start, finish, data[start + 10 * (kind == "frame") : body]

    def run(batches):
        return batched(found(batches), pa.schema([*list(RUNS)[:-1], ("body", pa.binary())]))

    return dumps.select(F.col(path).cast("string").alias("path"), content).mapInArrow(run, "path string, no int, kind string, type string, start long, finish long, body binary")


_EOL = g.plus(g.one_of("\r\n"))
_BLANK = g.plus(g.char(" "))
#: Capture ids of the bulletin head.
CSN, TTAAII, CCCC, YYGGGG, BBB = 1, 2, 3, 4, 5
HEADER = g.seq(
    g.char("\x01"), _EOL, g.opt(g.seq(g.capture(CSN, g.repeat(g.digit, 2, 6)), g.star(g.char(" ")), _EOL)),
    g.capture(TTAAII, g.seq(g.repeat(g.alpha, 4), g.repeat(g.digit, 2))), _BLANK, g.capture(CCCC, g.repeat(g.alpha, 4)), _BLANK, g.capture(YYGGGG, g.repeat(g.digit, 6)),
    g.opt(g.seq(_BLANK, g.capture(BBB, g.repeat(g.alpha, 3)))), g.star(g.char(" ")), _EOL,
)


def bulletins(found: DataFrame) -> DataFrame:
    """frames() rows of kind frame with the bulletin's head fields and body; fields are null where no head is found."""
    body = F.expr("substring(bytes, 11)")
    text = g.latin1(body)
    field = lambda id_: F.nullif(HEADER.search(text, id_), F.lit(""))
    start = F.length(F.regexp_extract(text, HEADER.regex, 0))
    out = found.filter("kind = 'frame'").withColumn("csn", field(CSN)).withColumn("ttaaii", field(TTAAII)).withColumn("cccc", field(CCCC)).withColumn("yygggg", field(YYGGGG)).withColumn("bbb", field(BBB))
    finish = F.when(text.endswith(PAD.decode()), F.length(text) - len(PAD)).otherwise(F.length(text))
    content = F.substring(body, start + 1 + F.instr(text, "\x01") - 1, finish - start)
    return out.withColumn("body", F.when(F.col("ttaaii").isNotNull(), content))


def gribs(rows: DataFrame, data: str = "body", by_length: bool = True, or_scan: bool = False) -> DataFrame:
    """Explodes the GRIB messages in a binary column: grib_no and message. by_length: a message ends where its length field
    says, and only if 7777 stands there; or_scan: else at the first 7777, which without by_length holds always."""

    def find(x: bytes | None) -> list[bytes]:
        out, at = [], 0
        while x and (at := x.find(b"GRIB", at)) >= 0:
            if by_length:
                end = at + int.from_bytes(x[at + 4 : at + 7], "big")
                ok = end >= at + 12 and x[end - 4 : end] == b"7777"
            if not by_length or or_scan and not ok:
                end = x.find(b"7777", at) + 4
                ok = end > 3
            if ok:
                out.append(x[at:end])
            at = end if ok else at + 4
        return out

    def run(batches):
        for b in batches:
            yield b.append_column("messages", pa.array([find(x.as_py()) for x in b.column(b.schema.get_field_index(data))], pa.list_(pa.binary())))

    from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

    shape = StructType([*rows.schema.fields, StructField("messages", ArrayType(BinaryType()))])
    out = rows.mapInArrow(run, shape)
    return out.select(*[c for c in rows.columns], F.posexplode("messages").alias("grib_no", "message"))


#: Report kinds in the order tried: how a bulletin's text begins, whether that is a header of each report, and how a report goes
#: on from there or from the report before it.
REPORTS = {
    "SYNOP": (r"AAXX\s+[0-9/]{5}", True, r"\s+[^=]*+="),
    "SHIP": ("BBXX", True, r"\s+[^=]*+="),
    "TAF AMD": (r"TAF\s+AMD", True, r"\s+[^=]*+="),
    "TAF": ("TAF", True, r"\s+[^=]*+="),
    "METAR": ("METAR|SPECI", False, r"\s*[^=]*+="),
    "TEMP": ("", False, r"\s*(?:TT|UU)(?:AA|BB)\s+[^=]*+=|\s*TT(?:CC|DD)\s+[^=]*+="),
    "SIGMET": ("", False, r"\A\s*[A-Z]{4}\s+SIGMET[^=]*+="),
}


def reports(rows: DataFrame, text: str = "text") -> DataFrame:
    """Splits report bulletins at '=': one row a report with no, kind, header and report. A kind holds if the text begins (after
    white space) as it says and one report at least follows. Headers (AAXX and time, BBXX, TAF, TAF AMD) are in
    each report of the bulletin; METAR and SPECI are not. Reports end with '='; what follows the last is no report."""
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    joined = lambda before: lambda r: F.concat(before, plain(r))
    found = []
    for kind, (opening, shared, report) in REPORTS.items():
        begins = rf"\A\s*({opening})"
        rest = F.substring(F.col(text), F.length(F.regexp_extract(text, begins, 0)) + 1, F.length(text)) if opening else F.col(text)
        each = F.regexp_extract_all(rest, F.lit(rf"\G(?:{report})"), F.lit(0))
        header = plain(F.regexp_extract(text, begins, 1)) if shared else F.lit(None).cast("string")
        before = F.concat(header, F.lit(" ")) if shared else F.lit("")
        full = F.transform(each, joined(before))
        found.append(F.when(F.col(text).rlike(begins) & (F.size(each) > 0), F.struct(F.lit(kind).alias("kind"), header.alias("header"), full.alias("reports"))))
    out = rows.withColumn("_found", F.coalesce(*found)).filter("_found is not null")
    return out.select(*rows.columns, "_found.kind", "_found.header", F.posexplode("_found.reports").alias("no", "report"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def grouped(items: list, sizes: list[int], most: int = GROUP, opening: int = 1 << 16) -> list[list]:
    """Items one after the other in groups of about most bytes; opening one costs as much as reading so many bytes."""
    out, held = [], most
    for item, size in zip(items, sizes, strict=True):
        if held + size + opening > most:
            out.append([])
            held = 0
        out[-1].append(item)
        held += size + opening
    return out


def _files(path: str) -> list[tuple[str, int | None]]:
    """A file, the files of a folder, or those of its folder that a pattern names, with their sizes; null: not there."""
    from fnmatch import fnmatch

    from pyarrow import fs

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    where, plain = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    folder, _, name = plain.rpartition("/")
    if any(x in name for x in "*?["):
        found = [x for x in where.get_file_info(fs.FileSelector(folder or ".")) if x.is_file and fnmatch(x.base_name, name)]
    elif (info := where.get_file_info(plain)).type == fs.FileType.Directory:
        found = [x for x in where.get_file_info(fs.FileSelector(plain)) if x.is_file and x.base_name[0] not in "._"]
    else:
        return [(path, info.size)]
    return sorted((path[: len(path) - len(plain)] + x.path if scheme else x.path, x.size) for x in found)


class GtsReader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for p in options.get("paths", options.get("path", "")).split(",") if p for f in _files(p)]
        self.chunk = int(options.get("chunk", 1 << 20))

    def partitions(self):
        # A file is read by one task, and small files share a task.
        return [_Files(g) for g in grouped([p for p, _ in self.files], [n or 0 for _, n in self.files])]

    def read(self, partition):
        return batched((run for p in partition.paths for run in self.runs(p)), RUNS)

    def runs(self, name: str) -> Iterator[tuple]:
        where, path = _opened(name)
        s, no, held, base = Splitter(), 0, [], 0
        with where.open_input_stream(path) as f:
            while True:
                data, buf = f.read(self.chunk), None
                held.append(data)
                for kind, type_, start, finish in s.feed(data, last=not data):
                    buf = b"".join(held) if buf is None else buf
                    yield name, no, kind, type_, start, finish, buf[start - base : finish - base]
                    no += 1
                if buf is not None:
                    held, base = [buf[s.offset - base :]], s.offset
                if not data:
                    return


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, ends: bool):
        self.path, self.start, self.stop, self.ends = path, start, stop, ends


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


class ChunkReader(DataSourceStreamReader):
    """Bytes of growing files. The offset is the byte position reached in each file, and whether its end has been told: a query
    that starts again goes on at the byte where it stopped, and any task may read any range anew."""

    #: Bytes of one task's range, a whole number of chunks.
    RANGE = 64 << 20

    def __init__(self, options):
        self.paths = options.get("paths", options.get("path", ""))
        self.chunk = int(options.get("chunk", 1 << 20))
        self.closed = options.get("closed", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for f, size in [f for p in self.paths.split(",") if p for f in _files(p)]:
            if size is not None:
                out[f] = [size, self.closed]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        step = max(1, self.RANGE // self.chunk) * self.chunk
        out: list[_Range] = []
        for path, (size, closed) in end.items():
            at, told = start.get(path, (0, False))
            cuts = [*range(at, size, step), size] if size > at else [at, at]
            ranges = list(zip(cuts, cuts[1:], strict=False))
            for k, (a, b) in enumerate(ranges):
                ends = closed and not told and k + 1 == len(ranges)
                if b > a or ends:
                    out.append(_Range(path, a, b, ends))
        # Small ranges share a task.
        return [g[0] if len(g) == 1 else _Ranges(g) for g in grouped(out, [r.stop - r.start for r in out], min(GROUP, step))]

    def read(self, partition: _Range | _Ranges):
        for r in getattr(partition, "ranges", [partition]):
            yield from self.chunks(r)

    def chunks(self, partition: _Range) -> Iterator[tuple]:
        where, plain = _opened(partition.path)
        at = partition.start
        if partition.stop > at:
            with where.open_input_file(plain) as f:
                f.seek(at)
                while at < partition.stop:
                    data = f.read(min(self.chunk, partition.stop - at))
                    if not data:
                        raise OSError(f"{partition.path} has become shorter")
                    yield partition.path, at, data
                    at += len(data)
        if partition.ends:
            yield partition.path, at, None

    def commit(self, end: dict) -> None:
        """Nothing is kept for the past: files stay as they are."""


class ChunkDataSource(DataSource):
    """spark.readStream.format("gts_chunks").option("paths", "a,b/*.bin,folder").load(): feed (the file), seq (the byte position)
    and data of files that may grow between triggers. With option closed they do not: data null then tells a file's end."""

    @classmethod
    def name(cls):
        return "gts_chunks"

    def schema(self):
        return "feed string, seq long, data binary"

    def streamReader(self, schema):
        return ChunkReader(self.options)


def write_dumps(dumps: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """Writes each row's content as a file of folder, named by path, and returns how many. Files appear whole: a task that is
    repeated writes them anew under another name first."""

    def run(batches):
        import uuid

        where, plain = _opened(folder)
        where.create_dir(plain, recursive=True)
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                hidden = f"{plain}/.{uuid.uuid4().hex}"
                with where.open_output_stream(hidden) as f:
                    f.write(data.as_py() or b"")
                where.move(hidden, f"{plain}/{name.as_py()}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return dumps.select(F.col(path).cast("string"), content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class GtsDataSource(DataSource):
    """spark.read.format("gts").option("paths", "a,b/*.bin,folder").load(): runs of framed dumps, a task a file, in memory
    bounded by the longest run."""

    @classmethod
    def name(cls):
        return "gts"

    def schema(self):
        return "path string, no int, kind string, type string, start long, finish long, bytes binary"

    def reader(self, schema):
        return GtsReader(self.options)


def frame(type_: Column, body: Column, padded: bool = False) -> Column:
    """The bytes of one frame, for writers and tests."""
    out = F.concat(F.lpad(F.octet_length(body).cast("string"), 8, "0").cast("binary"), type_.cast("binary"), body)
    return F.concat(out, F.lit(PAD.decode()).cast("binary")) if padded else out
