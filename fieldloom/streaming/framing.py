"""Streams: incremental framing keyed by feed, change events, ticks and replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.sources.gts import Splitter


class FrameProcessor(StatefulProcessor):
    """Per feed: the bytes not yet split and where they lie in the stream, the next number, and chunks that came too early.
    by_bytes: chunks are numbered by the byte position they begin at, and not one after the other."""

    def __init__(self, by_bytes: bool = False):
        self.by_bytes = by_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "offset long, held binary, skipped long, next long")
        self.early = handle.getMapState("early", "seq long", "data binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        offset, held, skipped, next_ = self.state.get() if self.state.exists() else (0, b"", 0, 0)
        splitter = Splitter(offset, bytes(held), skipped)
        # A trigger's rows come in several batches, in any order.
        waiting = {int(r.seq): None if r.data is None else bytes(r.data) for pdf in rows for r in pdf.itertuples()}
        out = []

        def follow(seq: int):
            if seq in waiting:
                return True, waiting.pop(seq)
            if self.early.exists() and self.early.containsKey((seq,)):
                data = self.early.getValue((seq,))[0]
                self.early.removeKey((seq,))
                return True, None if data is None else bytes(data)
            return False, None

        while True:
            here, data = follow(next_)
            if not here:
                break
            next_ += (len(data) if data else data is None) if self.by_bytes else 1
            out += splitter.feed(b"" if data is None else data, last=data is None)
        for seq, data in waiting.items():
            if seq > next_:
                self.early.updateValue((seq,), (data,))
        self.state.update((splitter.offset, splitter.held, splitter.skipped, next_))
        kinds = {"kind": object, "type": object, "start": "int64", "finish": "int64"}
        yield pd.DataFrame({"feed": pd.Series([key[0]] * len(out), dtype=object), **{k: pd.Series([x[i] for x in out], dtype=t) for i, (k, t) in enumerate(kinds.items())}})

    def close(self) -> None:
        pass


def stream_frames(chunks: DataFrame, by_bytes: bool = False) -> DataFrame:
    """(feed, kind, type, start, finish) of a stream of (feed, seq, data). Chunks are taken in order of seq, from 0 without
    gaps, in whatever order they arrive; data null ends a feed, and what it still holds is told. by_bytes: seq is the byte
    position of a chunk, as the source gts_chunks has it. Needs the RocksDB state store."""
    return chunks.groupBy("feed").transformWithStateInPandas(FrameProcessor(by_bytes), "feed string, kind string, type string, start long, finish long", "append", "none")


def counters(runs: DataFrame) -> DataFrame:
    """Frames, junk runs and bytes, in all."""
    size = F.col("finish") - F.col("start")
    return runs.agg(F.count_if(F.col("kind") == "frame").alias("frames"), F.count_if(F.col("kind") == "junk").alias("junk"), F.sum(size).alias("bytes"), F.sum(F.when(F.col("kind") == "junk", size).otherwise(0)).alias("junk_bytes"))


def ticks(spark: SparkSession, per_second: int = 17) -> DataFrame:
    """A tick about every 60 ms: (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def on_change(stream: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Calls notify once a trigger with all changes since the last one: many events, one notice."""
    return stream.writeStream.foreachBatch(lambda df, n: notify(df, n) if not df.isEmpty() else None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def dash_offset(elapsed_ms: Column) -> Column:
    """Offset of moving dashes after so many milliseconds: 0.020 a millisecond, starting anew at 20."""
    return F.pmod(elapsed_ms * 0.020, F.lit(20.0))


def replay(events: DataFrame) -> DataFrame:
    """State after all events (uid, seq, type, value) in order: the last value of each uid that was not removed last."""
    last = events.groupBy("uid").agg(F.max(F.struct("seq", "type", "value")).alias("e"))
    return last.filter(F.col("e.type") != "remove").select("uid", F.col("e.value").alias("value"))
