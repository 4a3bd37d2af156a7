"""An index of closed intervals that takes insertions and erasures: one base run and some delta runs, merged when read.

Each batch of operations becomes a run of its own, in which only the last operation on each id is kept; an erasure is a
tombstone. What is live are the base's intervals whose id no delta names, and the last insertion of each id that the deltas
name; so a read never groups the base, it only takes the ids of the deltas out. Once the deltas hold more than a share of
the base they are folded into a new base. Runs are immutable; a batch that fails leaves the runs as they were.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.dominance import interval_sums
from fieldloom.operators.spatial import interval_join, interval_lookup
from fieldloom.stored import discard, store

c = F.col


class IntervalIndex:
    def __init__(self, spark: SparkSession, share: float = 0.25, tile: float = 64.0):
        """share: of the base's rows that deltas may have before they are folded in. tile: about the length of an interval."""
        self.spark, self.share, self.tile = spark, share, tile
        self.base: DataFrame | None = None
        self.base_rows = 0
        self.deltas: list[DataFrame] = []
        self.delta_rows = 0

    def apply(self, operations: DataFrame) -> None:
        """operations (seq, op, id, start, stop): insert (again, to move an interval) or erase, in order of seq within the batch.
        Intervals with a null bound, or that end before they start, are erased; null ids are left out."""
        bad = c("op").eqNullSafe("erase") | c("start").isNull() | c("stop").isNull() | (c("start") > c("stop"))
        last = operations.filter("id is not null").groupBy("id").agg(F.max(F.struct("seq", F.coalesce(bad, F.lit(True)).alias("gone"), "start", "stop")).alias("o"))
        run = store(last.select("id", "o.gone", c("o.start").cast("double").alias("start"), c("o.stop").cast("double").alias("stop"), F.lit(len(self.deltas)).alias("run")), "run")
        self.deltas.append(run)
        self.delta_rows += run.count()
        if self.delta_rows > self.share * self.base_rows:
            self.compact()

    def insert(self, items: DataFrame) -> None:
        self.apply(items.select(F.lit(0).alias("seq"), F.lit("insert").alias("op"), "id", "start", "stop"))

    def erase(self, ids: DataFrame) -> None:
        nothing = F.lit(None).cast("double")
        self.apply(ids.select(F.lit(0).alias("seq"), F.lit("erase").alias("op"), "id", nothing.alias("start"), nothing.alias("stop")))

    def _recent(self) -> DataFrame | None:
        """The last operation of each id that deltas name."""
        if not self.deltas:
            return None
        if len(self.deltas) == 1:
            return self.deltas[0]
        rows = reduce(DataFrame.unionByName, self.deltas)
        return rows.groupBy("id").agg(F.max(F.struct("run", "gone", "start", "stop")).alias("o")).select("id", "o.gone", "o.start", "o.stop")

    def live(self) -> DataFrame:
        """(id, start, stop) as of now."""
        recent = self._recent()
        if recent is None:
            return self.base if self.base is not None else self.spark.createDataFrame([], "id long, start double, stop double")
        inserted = recent.filter("not gone").select("id", "start", "stop")
        return inserted if self.base is None else self.base.join(recent.select("id"), "id", "left_anti").unionByName(inserted)

    def compact(self) -> None:
        """Base and deltas as one sorted base; the old runs go once it is written."""
        whole = store(self.live().repartitionByRange("start", "id").sortWithinPartitions("start", "id"), "base")
        discard(*self.deltas, *([self.base] if self.base is not None else []))
        self.base, self.base_rows, self.deltas, self.delta_rows = whole, whole.count(), [], 0

    def find(self, ids: DataFrame) -> DataFrame:
        """The live intervals of ids (id)."""
        return self.live().join(ids.select("id").distinct(), "id")

    def in_range(self, asked: DataFrame) -> DataFrame:
        """Pairs (a_id, b_id) of asked intervals (id, start, stop) and live ones that overlap them."""
        return interval_join(asked, self.live(), self.tile)

    def sums_in_range(self, asked: DataFrame) -> DataFrame:
        """id, n, ids: how many live intervals overlap each asked one (id, start, stop), and the sum of their ids; no pairs are
        listed."""
        return interval_sums(asked, self.live().withColumn("ids", c("id")), ("ids",))

    def bounds(self, probes: DataFrame) -> DataFrame:
        """probe_id, lower, upper, equal, inside for probes (probe_id, key): places among the sorted starts, and holders."""
        return interval_lookup(self.live(), probes)
