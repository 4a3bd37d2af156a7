"""Queries on streams: each runs its stream over what is there, and returns what it wrote."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from fieldloom.plans.base import query, table
from fieldloom.plans.binary import _FRAMES, dumps
from fieldloom.sources import gts
from fieldloom.streaming.framing import counters, on_change, stream_frames

c = F.col
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def shared_folder(spark) -> str:
    """A new folder that driver and executors share: below the session's own, or a temporary one if they are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='fieldloom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


@contextmanager
def streaming_store(spark):
    """The state store that stateful operators need, for the streams inside."""
    before = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@query("T-01_stream_frames", f"{_FRAMES} SELECT count(*) AS frames, count(*) FILTER (WHERE doc_id % 4 = 0) AS junk, (sum(n) + 24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS bytes, (24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS junk_bytes FROM f")
def streamed_frames(spark, d):
    """Dumps as feeds of a thousand bytes a chunk, split with state as they arrive; the twin knows what was put in."""
    folder, step = shared_folder(spark), 1000
    feeds = dumps(spark, d).select(c("path").alias("feed"), "content", F.ceil(F.octet_length("content") / step).cast("int").alias("n"))
    rows = feeds.select("feed", F.posexplode(F.transform(F.sequence(F.lit(0), c("n")), lambda k: F.when(k < c("n"), F.substring("content", k * step + 1, F.lit(step))))).alias("seq", "data"))
    rows.select("feed", c("seq").cast("long").alias("seq"), "data").write.parquet(f"{folder}/chunks")
    with streaming_store(spark):
        chunks = spark.readStream.schema("feed string, seq long, data binary").parquet(f"{folder}/chunks")
        out = stream_frames(chunks).writeStream.format("parquet").option("path", f"{folder}/frames").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return counters(spark.read.schema("feed string, kind string, type string, start long, finish long").parquet(f"{folder}/frames"))


@query("S-02_dump_source", f"{_FRAMES} SELECT count(*) AS frames, count(*) FILTER (WHERE doc_id % 4 = 0) AS junk, (sum(n) + 24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS bytes, (24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS junk_bytes FROM f")
def dump_source(spark, d):
    """Dumps written as files and read back as a table by the data source."""
    folder = shared_folder(spark)
    gts.write_dumps(dumps(spark, d), folder)
    spark.dataSource.register(gts.GtsDataSource)
    return counters(spark.read.format("gts").option("paths", folder).load())


@query("T-01_stream_source", f"{_FRAMES} SELECT count(*) AS frames, count(*) FILTER (WHERE doc_id % 4 = 0) AS junk, (sum(n) + 24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS bytes, (24 * count(*) FILTER (WHERE doc_id % 4 = 0))::BIGINT AS junk_bytes FROM f")
def stream_source(spark, d):
    """Dumps written as files that grow: the first 60 in 100 bytes of each are there when the stream runs first, the rest when it
    starts again from its checkpoint, in the middle of a frame for nearly all of them."""
    folder, whole = shared_folder(spark), dumps(spark, d)
    spark.dataSource.register(gts.ChunkDataSource)
    part = F.substring("content", F.lit(1), F.ceil(F.octet_length("content") * 0.6).cast("int"))
    with streaming_store(spark):
        for rows, closed in ((whole.select("path", part.alias("content")), "false"), (whole, "true")):
            gts.write_dumps(rows, f"{folder}/dumps")
            chunks = spark.readStream.format("gts_chunks").option("paths", f"{folder}/dumps").option("chunk", 4096).option("closed", closed).load()
            out = stream_frames(chunks, by_bytes=True).writeStream.format("parquet").option("path", f"{folder}/frames").option("checkpointLocation", f"{folder}/state")
            out.trigger(availableNow=True).start().awaitTermination()
    return counters(spark.read.schema("feed string, kind string, type string, start long, finish long").parquet(f"{folder}/frames"))


@query("T-03_change_notices", "SELECT count(*) AS changes, 1::BIGINT AS notices FROM events")
def change_notices(spark, d):
    """Many changes that are there at once make one notice."""
    folder = shared_folder(spark)
    events = table(spark, d, "events").select("event_id")
    events.write.parquet(f"{folder}/events")
    tell = lambda df, n: df.agg(F.count("*").alias("n")).write.mode("append").parquet(f"{folder}/notices")
    q = on_change(spark.readStream.schema(events.schema).parquet(f"{folder}/events"), tell, f"{folder}/state")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("n long").parquet(f"{folder}/notices").agg(F.sum("n").alias("changes"), F.count("*").alias("notices"))
