"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is rotated by a seeded orthonormal matrix, once; its code holds the signs, its correction factor f the inner
product of the vector with its code. For another rotated vector q, <code, q> / f estimates the inner product without
bias, within BOUND * sqrt((1 - f^2) / f^2 / (D - 1)) at the chosen confidence. Codes, factors and the rotated vector in
steps of 1/127 of its greatest component (one byte each) are stored, and only they go to the buckets; the rounding is added
to the bound. Vectors meet in tables of seeded planes, drawn anew for each table: a key bit is the side of a plane, so a
pair at an angle a shares a bucket of k bits with the chance (1 - a / pi) ** k in each table, independently, and as many
tables are taken as bring a pair at the threshold to RECALL at the bits in use.

A bucket decides from the codes which of its points have a pair whose upper confidence bound reaches the threshold. Only for
those points the vectors are fetched, and their undecided pairs are computed exactly, in double precision, each pair in the
first table where it meets. A bucket with more than BLOCK vectors is dealt over its pairs of blocks. Equal vectors are one
point with a weight. What leaves a task is linear in its rows: points, link counts and a spanning set of links.

Defined results. Null, zero, or null or non-finite components: no links, its own component, kept. Vectors of different lengths
never link; each length is searched by itself, with as many bits as its vectors ask for. Each row gives one row: repeated
vec_id rows count as vectors of their own, a null vec_id counts as a link and is named by its class (null where the class
has no vec_id, of which then one row is kept). Other columns are ignored. Empty table: no row. The search is approximate:
a pair at the threshold shares a table with a chance of RECALL or more at every size, a closer pair with a greater one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, join_hot, named_components, store
from fieldloom.llm.simhash import Links

THRESHOLD, TABLES, BOUND, BLOCK, SEED = 0.95, 20, 3.0, 1024, 5
#: Vectors in a bucket, about, as a power of two; a table has between LEAST_BITS and MOST_BITS bits.
LOAD, LEAST_BITS, MOST_BITS = 5, 6, 20
#: The chance of a pair at the threshold to meet, and the tables that may be taken for it; bits give way beyond them.
RECALL, MOST_TABLES = 0.999, 64
#: Steps of a rotated component, from 0 to its vector's greatest.
STEPS = 127


@lru_cache(4)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthonormal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row is divided by its greatest component first, so no square is too large or too small."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is stored of vectors (n x d): sign bits (packed), factors, rotated components in steps, and the step's size."""
    turned = unit_rows(x) @ turn.T
    size = np.abs(turned).max(axis=1) / STEPS
    q = np.rint(turned / size[:, None]).astype(np.int8)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1]), q, size


class Codes:
    """Codes of a bucket's points, with what estimates need."""

    def __init__(self, bits: np.ndarray, f: np.ndarray, q: np.ndarray, size: np.ndarray):
        d = q.shape[1]
        self.f, self.q, self.size = f, q, size
        self.signs = np.where(np.unpackbits(bits, axis=1, count=d), 1, -1).astype(np.float32)
        self.near = q.astype(np.float32) * size[:, None].astype(np.float32)
        # The estimate's spread, and what rounding all components by half a step can add to it.
        self.bound = BOUND * np.sqrt(np.maximum(0, 1 - f**2) / f**2 / max(1, d - 1))
        self.rounding = BOUND * size.max(initial=0) / math.sqrt(12) / f + 1e-5

    def estimates(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of rows with columns."""
        return (self.signs[rows] @ self.near[columns].T) / (math.sqrt(self.q.shape[1]) * self.f[rows, None]).astype(np.float32)

    def undecided(self, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (in rows, in columns) of the pairs whose upper bound reaches the threshold."""
        return np.nonzero(self.estimates(rows, columns) + (self.bound + self.rounding)[rows, None].astype(np.float32) >= threshold)


def tables_for(threshold: float, bits: int, recall: float = RECALL) -> int:
    """So many tables of so many bits bring pairs at the threshold together with at least the chance recall."""
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log1p(-met)) if met > 0 else 1 << 30


def bits_for(count: int, threshold: float = THRESHOLD) -> int:
    """Bits of a key for so many vectors: fewer where the threshold would ask for too many tables."""
    bits = min(MOST_BITS, max(LEAST_BITS, round(math.log2(count)) - LOAD))
    while bits and tables_for(threshold, bits) > MOST_TABLES:
        bits -= 1
    return bits


@lru_cache(4)
def planes(d: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Normals of each table's planes, whole numbers (tables x bits x d); fewer tables have the same first ones."""
    return np.rint(np.random.default_rng(seed + 1).standard_normal((tables, bits, d)) * (1 << 12))


def table_keys(q: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The bucket of each stored vector (n x d, steps) in each table. Sums of whole numbers are exact, so a vector has the
    same keys wherever they are computed."""
    tables, bits, d = normals.shape
    on = (q.astype(np.float64) @ normals.reshape(-1, d).T > 0).reshape(len(q), tables, bits)
    return (on.astype(np.int64) << np.arange(bits)).sum(axis=2)


def vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def raw(column, kind) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def by_length(b: pa.RecordBatch):
    lengths = np.asarray(b.column("d"))
    for d in np.unique(lengths).tolist():
        yield d, b.take(pa.array(np.flatnonzero(lengths == d)))


CODE = "code binary, f double, q binary, step double"


def codes_of(points: DataFrame) -> DataFrame:
    """points (id, n, d, size, v) with code, f, q and step in v's place."""

    def run(batches):
        for b in batches:
            for d, part in by_length(b):
                bits, f, q, step = encode(vectors(part.column("v")), rotation(d))
                names = ("id", "n", "d", "size")
                rows = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_pydict({k: part.column(k) for k in names} | {"code": rows(bits), "f": f, "q": rows(q), "step": step})

    return points.select("id", "n", "d", "size", "v").mapInArrow(run, f"id long, n long, d int, size long, {CODE}")


KEYS = ["d", "t", "key", "i", "j"]


def by_bucket(batches, one):
    """Calls one on the rows of each bucket (or pair of blocks), which come sorted, a few thousand rows at a time."""

    def done(table: pa.Table):
        arrays = [np.asarray(table.column(k)) for k in KEYS]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in arrays])
        edge = np.flatnonzero(new)
        return pa.concat_batches([one(table.slice(a, b - a)) for a, b in zip(edge, [*edge[1:], table.num_rows], strict=True)])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < 1 << 13:
            continue
        table = pa.Table.from_batches(held)
        same = np.logical_and.reduce([np.asarray(table.column(k)) == table.column(k)[-1].as_py() for k in KEYS])
        end = table.num_rows if same.all() else int(np.argmin(same[::-1]))
        if end < table.num_rows:
            yield done(table.slice(0, table.num_rows - end))
            held = table.slice(table.num_rows - end).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def bucket_links(points: DataFrame, bits: int | None = None, threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """points (id, n, d, size, v: array<double>), distinct vectors with weights, of length d as size of them are. Rows
    (a, b, links): links of a found in one task (b null), or a link of a spanning set (links null). tables: the least
    number of tables. bits: of all keys, instead of those that size asks for. Stored."""
    codes = store(codes_of(points), "codes")

    def drawn(d: int, size: int) -> np.ndarray:
        k = bits_for(size, threshold) if bits is None else bits
        return planes(d, k, max(tables, tables_for(threshold, k)))

    def spread(batches):
        for b in batches:
            for d, part in by_length(b):
                keys = table_keys(raw(part.column("q"), np.int8), drawn(d, part.column("size")[0].as_py()))
                n, t = keys.shape
                at = pa.array(np.repeat(np.arange(n), t))
                yield pa.RecordBatch.from_pydict({"id": part.column("id").take(at), "d": part.column("d").take(at), "t": np.tile(np.arange(t, dtype=np.int32), n), "key": keys.ravel()})

    dealt = store(codes.select("id", "d", "size", "q").mapInArrow(spread, "id long, d int, t int, key long"), "dealt")
    shared = dealt.groupBy("d", "t", "key").count().filter("count > 1")
    shared = store(shared.select("d", "t", "key", "count", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "buckets")
    rows = join_hot(dealt, shared, ["d", "t", "key"], F.col("id"), "count").join(codes.drop("d"), "id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = ["id", "n", "size", "code", "f", "q", "step"]
    rows = rows.select("d", "t", "key", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), F.expr("own > x").alias("far"), *own)

    def undecided(table: pa.Table):
        """The bucket's ids, and pairs of places in it that the codes leave open and no earlier table has, a part at a time."""
        size, t, i, j = (table.column(k)[0].as_py() for k in ("size", "t", "i", "j"))
        far, q = np.asarray(table.column("far")), raw(table.column("q"), np.int8)
        codes = Codes(raw(table.column("code"), np.uint8), np.asarray(table.column("f")), q, np.asarray(table.column("step")))
        met = table_keys(q, drawn(q.shape[1], size)[:t])
        a, b = (np.flatnonzero(~far), np.flatnonzero(far)) if i != j else (np.arange(len(q)),) * 2
        step = max(1, (1 << 18) // max(1, len(b)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            x, y = codes.undecided(part, b, threshold)
            x, y = part[x], b[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for c in range(0, len(x), 1 << 16):
                p, r = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                new = ~(met[p] == met[r]).any(axis=1)
                yield p[new], r[new]

    def open_points(table: pa.Table) -> pa.RecordBatch:
        some = np.zeros(table.num_rows, bool)
        for p, r in undecided(table):
            some[p] = some[r] = True
        return pa.RecordBatch.from_pydict({k: pa.array(np.asarray(table.column(k))[some], kind) for k, kind in kinds})

    def exact(table: pa.Table) -> pa.RecordBatch:
        ids, weight, v = np.asarray(table.column("id")), np.asarray(table.column("n")), unit_rows(vectors(table.column("v")))
        links, count = Links(len(ids)), np.zeros(len(ids), np.int64)
        for p, r in undecided(table):
            near = np.einsum("ij,ij->i", v[p], v[r]) >= threshold
            p, r = p[near], r[near]
            count += np.bincount(p, weight[r], len(ids)).astype(np.int64) + np.bincount(r, weight[p], len(ids)).astype(np.int64)
            links.add(p, r)
        least, some = links.least(), np.flatnonzero(count)
        at = np.flatnonzero(least != np.arange(len(ids)))
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[least[at]], pa.int64())])
        n = pa.concat_arrays([pa.array(count[some], pa.int64()), pa.nulls(len(at), pa.int64())])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([ids[some], ids[at]]), pa.int64()), "b": b, "links": n})

    shape = "d int, t int, key long, i int, j int, far boolean, id long"
    kinds = [("d", pa.int32()), ("t", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("far", pa.bool_()), ("id", pa.int64())]
    left = store(rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(lambda x: by_bucket(x, open_points), shape), "open")
    fetched = left.join(codes.drop("d"), "id").join(points.select("id", "v"), "id")
    found = store(fetched.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(lambda x: by_bucket(x, exact), "a long, b long, links long"), "found")
    discard(codes, dealt, shared, left)
    return found


def near_embeddings(table: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id: long, embedding: array of numbers)."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = store(table.select("vec_id", F.when(good, v).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # A row's number stands for it: ids may be null or repeat.
    ids = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row")
    points = rows.filter("v is not null").groupBy("v").agg(F.min("row").alias("node"), F.min(ids).alias("least"), F.count("*").alias("n"))
    points = store(points.withColumn("d", F.size("v")), "points")
    sizes = store(points.groupBy("d").agg(F.count("*").alias("size"), F.count("*").alias("rows")), "sizes")
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes.limit(1).count():
        return alone(rows)
    sized = join_hot(points.select(F.col("node").alias("id"), "n", "d", "v"), sizes, ["d"], F.col("id"), "rows")
    found = bucket_links(sized, None, threshold, tables, block)
    classes = named_components(points.select("node", "least"), found.filter("b is not null").select("a", "b").distinct(), "least")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    each = points.join(links, points.node == links.a, "left").join(classes.select("node", "first"), "node")
    each = store(each.select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first"), "named")
    own = join_hot(rows.filter("v is not null"), each, ["v"], F.col("row"), "n")
    # The second test is for a null vec_id: it holds for one row of a class without any vec_id, and for none elsewhere.
    kept = F.coalesce(F.col("vec_id") == F.col("first.vec_id"), F.col("row") == F.col("first.row"))
    return own.select("vec_id", "n_links", F.col("first.vec_id").alias("component_id"), kept.alias("kept")).unionByName(alone(rows.filter("v is null")))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, which the search finds but for a chance of one in a thousand at the threshold and less above it.
OP4_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT r, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {THRESHOLD} ELSE false END),
  reached AS (SELECT r, vec_id AS name FROM v UNION SELECT links.a, reached.name FROM reached JOIN links ON links.b = reached.r),
  c AS (SELECT r, min(name) AS component_id FROM reached GROUP BY 1), n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
