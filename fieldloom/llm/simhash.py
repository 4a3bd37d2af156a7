"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints, so all links lie within Manhattan distance MOST. The range join runs on
grids over some of the axes: the axes are dealt to groups, and a grid takes a choice of the groups. What two vectors
within MOST differ by is spread over all groups, so in some grid they differ by no more than the grid's reach, 0 or 1. A
point is stored in its own cell of each grid and, at reach 1, also asks the neighbour cells one step up an axis; the lower
of two neighbours asks for the upper. In a cell the Manhattan bound over all axes comes first and the Hamming distance
decides. Equal fingerprints are one point.

Three groups with reach 1 need about 28 rows a point and have cells of 16 bits; from FEW points on, whose cells would grow
too full, eight groups of which four must be equal need 70 rows and have cells of 24 bits. Both are exact, so the links
are the same.

Defined results. Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: one shingle
of them all. Each row gives one row: repeated rows get equal results, a null doc_id is named by its class like any other
(null where the class has no doc_id), and rows that share a doc_id are linked by their own texts. Other columns are
ignored. An empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import discard, fresh, in_parts, join_hot, named_components, store

SHINGLE, SEED, MOST = 4, 42, 4
#: Axes of the embedding and values of each: counts of two-bit segments.
AXES, COUNTS = 32, 3
#: Distinct fingerprints from which on a grid of smaller cells pays.
FEW = 1 << 22
#: Points of a cell that are compared with each other in one task.
BLOCK = 2048
#: Pairs that are compared at once.
PAIRS = 1 << 19


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    n = max(1, len(words) - shingle + 1)
    start, stop = (end - size)[:n].tolist(), (end[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(start, stop, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, carried: list[str], bits: str = "bits", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns carried of docs (text: string) and bits (long), one row for each row of docs."""
    text = fresh(carried, "text")[0]
    rows = docs.select(*carried, docs["text"].alias(text))

    def run(batches):
        for b in in_parts(batches):
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(b.num_columns - 1)], np.uint64)
            kept = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64), pa.int64())], [*b.schema.names[:-1], bits])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(bits, T.LongType())]))


def popcounts(bits: np.ndarray) -> np.ndarray:
    """The embedding: bit counts of each fingerprint's segments, from the lowest bits on."""
    flat = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(bits), 8), axis=1, bitorder="little")
    return flat.reshape(len(bits), AXES, 64 // AXES).sum(axis=2, dtype=np.uint8)


def steps(bits: np.ndarray) -> np.ndarray:
    """The embedding with each count as a run of ones (00, 01, 11), so that bits that differ are Manhattan distance."""
    low = np.uint64(0x5555555555555555)
    a, b = bits & low, (bits >> np.uint64(1)) & low
    return (a | b) | ((a & b) << np.uint64(1))


class Grids:
    """Grids over choices of some of the groups of axes, which find all pairs within most and reach in one of them."""

    def __init__(self, groups: int, chosen: int, most: int = MOST):
        parts = np.array_split(np.arange(AXES), groups)
        self.axes = [np.concatenate([parts[g] for g in own]) for own in combinations(range(groups), chosen)]
        # The least that a spread of most over the groups leaves to the chosen ones that differ least.
        self.reach = max(sum(sorted(spread)[:chosen]) for spread in spreads(most, groups))
        if self.reach > 1:
            raise ValueError("cells more than one step away are not asked")

    def cells(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, point, asks): where each point is stored, and which cells it asks besides; no two grids share a cell."""
        counts = popcounts(bits).astype(np.int64)
        cell, point, asks = [], [], []
        every = np.arange(len(bits))
        for k, axes in enumerate(self.axes):
            unit = COUNTS ** np.arange(len(axes), dtype=np.int64)
            own = counts[:, axes] @ unit + k * COUNTS ** (max(map(len, self.axes)))
            cell.append(own)
            point.append(every)
            asks.append(np.zeros(len(bits), bool))
            if self.reach:
                at, axis = np.nonzero(counts[:, axes] < COUNTS - 1)
                cell.append(own[at] + unit[axis])
                point.append(at)
                asks.append(np.ones(len(at), bool))
        return np.concatenate(cell), np.concatenate(point), np.concatenate(asks)


def spreads(total: int, parts: int, least: int = 0):
    """The ways to write total as so many numbers in rising order, each at least least."""
    if parts == 1:
        yield [total]
        return
    for x in range(least, total // parts + 1):
        for rest in spreads(total - x, parts - 1, x):
            yield [x, *rest]


def grids_for(count: int, most: int = MOST) -> Grids:
    return Grids(2 * most, most, most) if most and count >= FEW else Grids(most // 2 + 1, 1, most)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For points 0..n-1 the smallest point that the links (i, j) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Links:
    """Links between rows of a chunk, kept as a spanning set of bounded size."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.parts.append((i, j))
        self.held += len(i)
        if self.held > max(1 << 20, 2 * self.n):
            least = self.least()
            at = np.flatnonzero(least != np.arange(self.n))
            self.parts, self.held = [(at, least[at])], len(at)

    def least(self) -> np.ndarray:
        return spanning(np.concatenate([np.zeros(0, np.int64), *[i for i, _ in self.parts]]), np.concatenate([np.zeros(0, np.int64), *[j for _, j in self.parts]]), self.n)


def links_within(bits: np.ndarray, group: np.ndarray, two: np.ndarray, far: np.ndarray, asks: np.ndarray, most: int) -> np.ndarray:
    """For each row the smallest row that links inside its group reach. Rows are sorted by group, far, asks. two: the group
    compares its near rows with its far ones only; elsewhere all rows are near. Two rows that only ask are not compared."""
    n = len(bits)
    links, unary = Links(n), steps(bits)
    if not n:
        return links.least()
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(edge, n))
    total = lambda x: np.repeat(np.add.reduceat(x.astype(np.int64), edge), size)
    end, near = np.repeat(edge + size, size), np.repeat(edge + size, size) - total(far)
    rows = np.arange(n)
    start = np.where(two, near, rows + 1)
    count = np.where(~asks, end - start, np.where(two, total(far & ~asks), 0))
    count[far] = 0
    upto = np.cumsum(count)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        own = count[at:stop]
        i = np.repeat(rows[at:stop], own)
        j = np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[at:stop], own)
        ok = np.bitwise_count(unary[i] ^ unary[j]) <= most
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(bits[i] ^ bits[j]) <= most
        links.add(i[ok], j[ok])
        at = stop
    return links.least()


def grid_links(points: DataFrame, most: int = MOST, grids: Grids | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of points (bits: long, distinct, stored) within most bits.

    A cell with more than block rows is dealt over its pairs of blocks, each a group of its own.
    """
    grids = grids or grids_for(points.count(), most)

    def spread(batches):
        for b in batches:
            bits = np.asarray(b.column("bits")).view(np.uint64)
            for at in range(0, len(bits), 4096):
                part = bits[at : at + 4096]
                cell, point, asks = grids.cells(part)
                yield pa.RecordBatch.from_pydict({"cell": cell, "asks": asks, "bits": part[point].view(np.int64)})

    dealt = store(points.select("bits").mapInArrow(spread, "cell long, asks boolean, bits long"), "dealt")
    # A cell that holds no point, or whose only point nobody asks for, has nothing to compare.
    shared = dealt.groupBy("cell").agg(F.count("*").alias("count"), F.count_if(~F.col("asks")).alias("held")).filter("count > 1 and held > 0")
    shared = store(shared.select("cell", "count", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "cells")
    # A point goes to the tasks (i, j), i <= j, of its block.
    rows = join_hot(dealt, shared, ["cell"], F.col("bits"), "count", merge=True)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("bits", F.lit(7)), F.col("blocks")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys, order = ["cell", "i", "j"], ["far", "asks"]
    rows = rows.select("cell", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), F.expr("own > x").alias("far"), "asks", "bits")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            arrays = [np.asarray(table.column(k)) for k in keys]
            new = np.zeros(table.num_rows, bool)
            for x in arrays:
                new[1:] |= x[1:] != x[:-1]
            bits = np.asarray(table.column("bits")).view(np.uint64)
            least = links_within(bits, np.cumsum(new), arrays[1] != arrays[2], *[np.asarray(table.column(k)) for k in order], most)
            at = np.flatnonzero(least != np.arange(len(bits)))
            return pa.RecordBatch.from_pydict({"a": bits[at].view(np.int64), "b": bits[least[at]].view(np.int64)})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 1 << 15:
                continue
            table = pa.Table.from_batches(held)
            last = [np.asarray(table.column(k)) for k in keys]
            end = int(np.argmin(np.logical_and.reduce([x == x[-1] for x in last])[::-1]))
            cut = table.num_rows - end if end else 0
            if cut:
                yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    found = store(rows.mapInArrow(compare, "a long, b long").distinct(), "grid")
    discard(dealt, shared)
    return found


def near_duplicates(docs: DataFrame, carried: list[str] | None = None, most: int = MOST, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns carried (doc_id, where none are named) with bits, component_id (the smallest doc_id that links within
    most differing bits reach) and kept (true for one row of each component, one with the smallest doc_id), for each row
    of docs. Where a carried column has one of these names, ours has an underscore more."""
    carried = ["doc_id"] if carried is None else carried
    bits, row, name = fresh([*carried, "component_id", "kept"], "bits", "row", "name")
    own = fingerprints(docs.withColumn(name, F.col("doc_id")), [*carried, name], bits, shingle, seed)
    own = store(own.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    ids = F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("name"), F.col(row).alias("row"))
    points = own.groupBy(F.col(bits).alias("node")).agg(F.min(ids).alias("least"), F.count("*").alias("n"))
    points = store(points, "points")
    found = grid_links(points.select(F.col("node").alias("bits")), most)
    named = store(named_components(points, found, "least").select(F.col("node").alias(bits), F.col("first").alias("least"), "n"), "named")
    component, kept, least = fresh([*carried, bits, row, name], "component_id", "kept", "least")
    out = join_hot(own, named.withColumnRenamed("least", least), [bits], F.col(row), "n")
    return out.select(*carried, bits, F.col(f"{least}.name").alias(component), (F.col(row) == F.col(f"{least}.row")).alias(kept))


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
