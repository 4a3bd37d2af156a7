"""Series in order of time: as-of interpolation, and stores of events that know their state as of any version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.stored import discard, store

c = F.col


def asof_interpolated(samples: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, key, at, before, after, value for probes (probe_id, key, at) among samples (key, at, value): the times of the
    last sample at or before each probe and the first at or after it, and the value on the line between them.

    Samples and probes are dealt out together by ranges of (key, time), so one key may fill any number of tasks. Each task
    finds neighbours among its own rows; a range's first and last sample of each key are carried on to the ranges where
    that key has none on one side.

    Defined results. Samples of one key and time count as their mean; null values are no samples. Outside the samples one time
    and the value are null. A probe without a time or key has only nulls. Repeated probes: each its own row."""
    means = samples.filter("key is not null and at is not null and value is not null").groupBy("key", "at").agg(F.avg("value").alias("value"))
    nothing = F.lit(None)
    both = probes.select("key", "at", "probe_id", F.lit(True).alias("asks"), nothing.cast("double").alias("value"))
    both = both.unionByName(means.select("key", "at", nothing.cast(dict(probes.dtypes)["probe_id"]).alias("probe_id"), F.lit(False).alias("asks"), c("value").cast("double")))
    rows = store(both.repartitionByRange("key", "at").withColumn("part", F.spark_partition_id()), "dealt")
    sample = F.when(~c("asks"), F.struct("at", "value"))
    # Rows of one time are peers: a sample at a probe's own time is on both sides of it.
    # Both ways the frame only grows from row to row; one that shrinks would be gone through anew for each row.
    upto = lambda order: F.last(sample, True).over(Window.partitionBy("part", "key").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = rows.withColumn("low", upto(c("at").asc())).withColumn("high", upto(c("at").desc())).filter("asks")
    ends = rows.filter(~c("asks")).groupBy("key", "part").agg(F.min(F.struct("at", "value")).alias("first"), F.max(F.struct("at", "value")).alias("last"))
    asked = rows.filter("asks").select("key", "part").distinct()
    # One row for each key and range that holds it.
    halo = asked.join(ends, ["key", "part"], "full")
    along = lambda k, order: F.last(k, True).over(Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    halo = halo.select(c("key").alias("k"), c("part").alias("p"), along("last", c("part").asc()).alias("carried"), along("first", c("part").desc()).alias("coming"))
    out = inside.join(halo, (c("key") == c("k")) & (c("part") == c("p")), "left").withColumn("low", F.coalesce("low", "carried")).withColumn("high", F.coalesce("high", "coming"))
    span, gone = (F.timestamp_diff("MICROSECOND", c("low.at"), x).cast("double") for x in (c("high.at"), c("at")))
    value = F.when(span == 0, c("low.value")).otherwise(c("low.value") + (c("high.value") - c("low.value")) * gone / span)
    none = c("at").isNull()
    blank = lambda x: F.when(~none, x)
    return out.select("probe_id", "key", "at", blank(c("low.at")).alias("before"), blank(c("high.at")).alias("after"), blank(value).alias("value"))


class EventStore:
    """Events (uid, version, type, value), each a version of its own, with snapshots of the state every so many versions.

    A snapshot holds each uid's last event up to its version, removals too, and is made from the one before and the events
    since, so each event is folded once. The state as of any version is folded from the nearest snapshot before and the
    events after it alone."""

    def __init__(self, events: DataFrame, every: int):
        if every < 1:
            raise ValueError("every must be 1 or more")
        self.every = every
        block = F.floor((c("version") - 1) / every).cast("long")
        folded = events.filter("version is not null").withColumn("block", block)
        path = store(folded.repartition("block"), "events")
        self.events = path
        blocks = sorted(r.block for r in path.select("block").distinct().collect())
        self.snapshots: dict[int, DataFrame] = {}
        state = None
        for b in blocks:
            last = self._fold(path.filter(c("block") == b).select("uid", "version", "type", "value"))
            state = store(last if state is None else self._fold(state.unionByName(last)), "snapshot")
            self.snapshots[(b + 1) * every] = state

    @staticmethod
    def _fold(events: DataFrame) -> DataFrame:
        last = events.groupBy("uid").agg(F.max(F.struct("version", "type", "value")).alias("e"))
        return last.select("uid", "e.version", "e.type", "e.value")

    def nearest(self, version: int) -> int | None:
        """The version of the last snapshot at or before version."""
        return max((v for v in self.snapshots if v <= version), default=None)

    def state(self, version: int) -> DataFrame:
        """uid, version, value: what each uid that is there has as of version, and since which one."""
        near = self.nearest(version)
        later = self.events.filter((c("version") <= version) & (c("version") > (near or 0)) & (c("block") >= (near or 0) // self.every))
        rows = later.select("uid", "version", "type", "value")
        if near is not None:
            rows = rows.unionByName(self.snapshots[near])
        return self._fold(rows).filter("type is null or type <> 'remove'").select("uid", "version", "value")

    def states(self, versions: list[int]) -> DataFrame:
        """as_of, uid, version, value for each of versions."""
        return reduce(DataFrame.unionByName, [self.state(v).withColumn("as_of", F.lit(v).cast("long")) for v in versions]).select("as_of", "uid", "version", "value")

    def close(self) -> None:
        discard(self.events, *self.snapshots.values())
