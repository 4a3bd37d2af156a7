"""Whitening of embeddings by a tiled covariance.

Vectors are cut into row-blocks of a few thousand rows and column-blocks of WIDTH dimensions. A pair of column-blocks is a tile;
each tile gets its two column-blocks of every row-block by one equality join on (row-block, tile), multiplies them, and the
products are added up tile by tile, first inside each task. Only d x d sums, whatever the number of rows, meet in the one
group that assembles the matrix and takes its eigenvectors.

Components become whole numbers, x = floor(SCALE * component) + SHIFT, so sums over the fit list (each distinct x vector once)
are exact; blocks hold x - SHIFT in as few bytes as it needs. Entries are centred as (n * x - S) / n, exact up to the
division, before they are multiplied. The same tiles give the covariance of the whitened fit list, whose largest
departure from the identity is reported.

Defined results. A vector that is null or holds null, non-finite or unrepresentable components (64 times their size 2^43 or more) is left out. Each
length of vectors is whitened by itself; empty vectors have no components and so no rows. A component without variance
is not whitened: its whitened value is 0 and identity_error then is 1. Repeated rows and null or repeated ids: each row
its own results, once in the fit list. Rows count alike whatever their other columns, which are left out. deviation is null
where it does not fit a long. Empty table: no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, store

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a column-block and rows of a row-block.
WIDTH, ROWS = 16, 4096
#: Below this share of the largest eigenvalue a component counts as having no variance.
FLAT = 1e-12
#: Components are taken if SCALE times their size stays below this.
MOST = 1 << 43
_KINDS = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}


def whole_numbers(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(vec_id, g, y: array<long>) of the usable vectors: g is the length, y is x - SHIFT."""
    v = F.col(vector).cast("array<double>")
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * SCALE) < float(MOST))
    out = vectors.filter((F.size(vector) > 0) & F.forall(v, fine)).select(F.col(id_).alias("vec_id"), v.alias("v"))
    return out.select("vec_id", F.size("v").alias("g"), F.transform("v", lambda e: F.floor(e * SCALE).cast("long")).alias("y"))


def _matrices(groups: pa.Array, values: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each group of a batch with the places of its rows and their values as a matrix."""
    g = groups.to_numpy(zero_copy_only=False)
    for one in np.unique(g).tolist():
        at = np.flatnonzero(g == one)
        flat = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield one, at, flat.reshape(len(at), -1)


def column_blocks(rows: DataFrame, column: str, width: int = WIDTH, height: int = ROWS) -> DataFrame:
    """(g, d, block, tile, rows, kind, data): the values of column (an array, of one length d in each group g) of at most
    height rows in width dimensions, row by row. The result should be stored, so that a block's number always means the
    same rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[np.ndarray]] = {}
        base, made = TaskContext.get().partitionId() << 32, 0

        def cut(g: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal made
            m = np.concatenate(parts)
            out = []
            for t in range(0, m.shape[1], width):
                part = m[:, t : t + width]
                if part.dtype.kind == "i":
                    most = max(int(part.max()), -int(part.min()) - 1)
                    part = part.astype(_KINDS[next(b for b in (1, 2, 4, 8) if most < 1 << (8 * b - 1))])
                out.append((g, m.shape[1], base + made, t // width, len(m), part.dtype.str, part.tobytes()))
            made += 1
            return pa.RecordBatch.from_pydict(dict(zip(shape.names, map(list, zip(*out, strict=True)), strict=True)), schema=shape)

        for b in batches:
            for g, _, m in _matrices(b.column(0), b.column(1)):
                for at in range(0, len(m), height):
                    held.setdefault(g, []).append(m[at : at + height])
                    if sum(map(len, held[g])) >= height:
                        yield cut(g, held.pop(g))
        for g, parts in held.items():
            yield cut(g, parts)

    shape = pa.schema([("g", pa.int32()), ("d", pa.int32()), ("block", pa.int64()), ("tile", pa.int32()), ("rows", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
    return rows.select("g", column).mapInArrow(run, "g int, d int, block long, tile int, rows int, kind string, data binary")


def sums(rows: DataFrame, column: str) -> DataFrame:
    """(g, n, s): how many rows each group has, and their sums by dimension."""
    each = rows.select("g", F.posexplode(column).alias("i", "v")).groupBy("g", "i").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    return each.groupBy("g").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r.s).alias("s"))


def _off(n: int, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """n * m - s, exact for whole numbers of any size."""
    if m.dtype.kind == "i":
        wide = m.size and n * max(int(m.max()), -int(m.min())) >= 1 << 61
        m = m.astype(object) if wide else m.astype("i8")
    return n * m - s


def tiled_covariance(blocks: DataFrame, totals: DataFrame, width: int = WIDTH) -> DataFrame:
    """(g, i, j, v), tiles on and above the diagonal: covariances (divisor n) of what column_blocks holds; totals (g, n, s) are
    its sums, one row a group."""
    part = lambda p: [F.col(k).alias(f"{p}_{k}") for k in ("kind", "data")]
    last = F.ceil(F.col("d") / width).cast("int") - 1
    left = blocks.select("g", "block", "rows", F.col("tile").alias("p"), F.explode(F.sequence("tile", last)).alias("q"), *part("a"))
    right = blocks.select("g", "block", F.explode(F.sequence(F.lit(0), "tile")).alias("p"), F.col("tile").alias("q"), *part("b"))
    both = left.join(right, ["g", "block", "p", "q"]).join(F.broadcast(totals), "g")
    of = lambda t: F.slice("s", F.col(t) * width + 1, F.lit(width))
    both = both.select("g", "p", "q", "rows", "a_kind", "a_data", "b_kind", "b_data", "n", of("p").alias("a_s"), of("q").alias("b_s"))

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}

        def centred(r: dict, side: str) -> np.ndarray:
            m = np.frombuffer(r[f"{side}_data"], r[f"{side}_kind"]).reshape(r["rows"], -1)
            return (_off(r["n"], m, np.array(r[f"{side}_s"])) / r["n"]).astype(float)

        for b in batches:
            for k in range(b.num_rows):
                r = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}
                key, product = (r["g"], r["p"], r["q"]), centred(r, "a").T @ centred(r, "b") / r["n"]
                kept[key] = kept[key] + product if key in kept else product
        for (g, p, q), m in kept.items():
            i, j = (x.ravel() for x in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, g, "i4")), pa.array((p * width + i).astype("i4")), pa.array((q * width + j).astype("i4")), pa.array(m.ravel())], names=["g", "i", "j", "v"])

    return both.mapInArrow(multiply, "g int, i int, j int, v double").groupBy("g", "i", "j").agg(F.sum("v").alias("v"))


def eigen(entries: DataFrame, totals: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(g, values, shares, vectors, n, s): the most largest eigenvalues of each matrix, their shares of the trace, and unit
    vectors one after the other. One task a group, of d x d entries."""

    def solve(t: pa.Table) -> pa.Table:
        i, j, v = (t[k].to_numpy() for k in ("i", "j", "v"))
        d = int(j.max()) + 1
        m = np.zeros((d, d))
        m[i, j] = v
        m[j, i] = v
        e, w = np.linalg.eigh(m)
        keep = np.argsort(-e, kind="stable")[:most]
        e, w, trace = np.maximum(e[keep], 0.0), w[:, keep].T, float(np.trace(m))
        shares = e / trace if trace > 0 else np.zeros(len(e))
        return pa.table({"g": pa.array([t["g"][0].as_py()], pa.int32()), "values": [e.tolist()], "shares": [shares.tolist()], "vectors": [w.ravel().tolist()]})

    found = entries.groupBy("g").applyInArrow(solve, "g int, values array<double>, shares array<double>, vectors array<double>")
    return found.join(F.broadcast(totals), "g")


def projected(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(vec_id, g, deviation, w): the whitened components of rows (vec_id, g, y), and their distance from the mean. model has
    one row a group, of d x COMPONENTS numbers."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for g, at, y in _matrices(column["g"], column["y"]):
                n, s, e, v = (column[k][int(at[0])].as_py() for k in ("n", "s", "values", "vectors"))
                e, v = np.array(e), np.array(v).reshape(-1, y.shape[1])
                off = _off(n, y, np.array(s))
                fits = (off.astype(float) ** 2).sum(1) < 2.0**62
                deviation = (np.where(fits[:, None], off, 0) ** 2).sum(1).astype("i8")
                flat = e <= FLAT * e[0]
                w = (off / n).astype(float) @ v.T * np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, e)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype="i4")), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([column["vec_id"].take(pa.array(at)), pa.array(np.full(len(w), g, "i4")), pa.array(deviation, mask=~fits), lists], names=["vec_id", "g", "deviation", "w"])

    both = rows.join(F.broadcast(model), "g").select("vec_id", "g", "y", "n", "s", "values", "vectors")
    kind = dict(rows.dtypes)["vec_id"]
    return both.mapInArrow(run, f"vec_id {kind}, g int, deviation long, w array<double>")


def whiten(vectors: DataFrame, vector: str = "embedding", id_: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    rows = whole_numbers(vectors, vector, id_)
    fit = store(rows.select("g", "y").distinct(), "fit")
    totals = store(sums(fit, "y"), "totals")
    blocks = store(column_blocks(fit, "y"), "blocks")
    model = store(eigen(tiled_covariance(blocks, totals), totals, components), "eigen")
    discard(blocks)
    # The whitened fit list goes through the same tiles.
    seen = store(projected(fit.withColumn("vec_id", F.lit(0).cast("long")), model).select("g", "w"), "whitened")
    blocks = store(column_blocks(seen, "w"), "blocks")
    off = F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    worst = tiled_covariance(blocks, store(sums(seen, "w"), "totals")).groupBy("g").agg(F.max(off).alias("identity_error"))
    facts = store(model.select("g", "n", "shares").join(worst, "g"), "facts")
    discard(blocks, fit, seen)
    each = F.posexplode(F.arrays_zip("w", "shares")).alias("k", "r")
    out = projected(rows, model).join(F.broadcast(facts), "g").select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("r.w").alias("whitened"), F.col("r.shares").alias("explained"), "identity_error")


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
