"""Streams end as batches do."""

import random

from pyspark.sql import functions as F

from fieldloom.sources.gts import frames
from fieldloom.streaming.framing import counters, on_change, replay, stream_frames


def dump(rng):
    out = b""
    for _ in range(12):
        body = b"\x01" + bytes(rng.randrange(32, 127) for _ in range(rng.randint(0, 200)))
        out += b"junk of some length here"[: rng.choice([0, 20])] + b"%08d" % len(body) + rng.choice([b"AN", b"BI"]) + body
    return out


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    feeds = {f"f{k}": dump(rng) for k in range(3)}
    rows = [(f, k, d[k * 100 : k * 100 + 100]) for f, d in feeds.items() for k in range(len(d) // 100 + 1)]
    rows += [(f, len(d) // 100 + 1, None) for f, d in feeds.items()]
    # Chunks arrive in any order, over two triggers.
    rng.shuffle(rows)
    half = len(rows) // 2
    shape = "feed string, seq long, data binary"
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    chunks = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream_frames(chunks).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = frames(spark.createDataFrame(list(feeds.items()), "path string, content binary"))
    key = lambda df, f: sorted((r[0], r.type, r.start, r.finish) for r in df.filter("kind = 'frame'").select(f, "type", "start", "finish").collect())
    assert key(got, "feed") == key(want, "path")
    assert got.agg(F.sum(F.col("finish") - F.col("start"))).first()[0] == sum(map(len, feeds.values()))
    assert counters(want).first().bytes == sum(map(len, feeds.values()))


def test_replay(spark):
    df = spark.createDataFrame([(1, 1, "set", 5.0), (1, 2, "set", 6.0), (2, 1, "set", 1.0), (2, 3, "remove", None)], "uid long, seq long, type string, value double")
    assert [tuple(r) for r in replay(df).collect()] == [(1, 6.0)]


def test_changes_are_told_once_a_trigger(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []
    q = on_change(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df, n: told.append(df.agg(F.sum("id")).first()[0]), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert told == [10]


def test_a_restart_goes_on_at_the_byte(spark, tmp_path):
    """Files grow between runs, one appears late, one is cut inside a frame's head; the frames are those of a batch."""
    from fieldloom.sources import gts

    rng = random.Random(12)
    feeds = {f"f{k}.bin": dump(rng) for k in range(3)}
    folder = tmp_path / "dumps"
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(gts.ChunkDataSource)
    for sizes, closed in (({"f0.bin": 5, "f1.bin": 333}, "false"), ({"f0.bin": 700, "f1.bin": 333, "f2.bin": 64}, "false"), ({f: None for f in feeds}, "true")):
        for f, n in sizes.items():
            (folder / f).write_bytes(feeds[f][:n])
        chunks = spark.readStream.format("gts_chunks").option("paths", str(folder)).option("chunk", 50).option("closed", closed).load()
        q = stream_frames(chunks, by_bytes=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("feed", F.element_at(F.split("feed", "/"), -1))
    want = frames(spark.createDataFrame(list(feeds.items()), "path string, content binary"))
    key = lambda df, f: sorted(((r[0], r.kind, r.type, r.start, r.finish) for r in df.select(f, "kind", "type", "start", "finish").collect()), key=repr)
    assert key(got, "feed") == key(want, "path")


def test_ranges_of_a_file():
    """Offsets are byte positions; what was told is not told again."""
    from fieldloom.sources.gts import ChunkReader

    r = ChunkReader({"paths": "", "chunk": "10"})
    r.RANGE = 25
    parts = lambda a, b: [(p.start, p.stop, p.ends) for p in r.partitions(a, b)]
    assert parts({}, {"x": [45, False]}) == [(0, 20, False), (20, 40, False), (40, 45, False)]
    assert parts({"x": [45, False]}, {"x": [45, False]}) == []
    assert parts({"x": [45, False]}, {"x": [45, True]}) == [(45, 45, True)]
    assert parts({"x": [45, True]}, {"x": [45, True]}) == []
    assert parts({"x": [40, False]}, {"x": [45, True], "y": [0, True]}) == [(40, 45, True), (0, 0, True)]


def test_small_files_share_a_task(tmp_path):
    """A hundred small files are a few tasks, each file read whole by one of them; a large one has a task of its own."""
    from fieldloom.sources import gts

    frame = b"00000003AN\x01bc"
    for k in range(100):
        (tmp_path / f"{k:03}").write_bytes(frame * (k % 3))
    r = gts.GtsReader({"paths": str(tmp_path)})
    parts = r.partitions()
    assert 1 <= len(parts) < 10
    got = [x for p in parts for b in r.read(p) for x in zip(*(b.column(k).to_pylist() for k in (0, 1, 6)), strict=True)]
    assert got == [(str(tmp_path / f"{k:03}"), no, frame) for k in range(100) for no in range(k % 3)]
    c = gts.ChunkReader({"paths": str(tmp_path), "chunk": "4096", "closed": "true"})
    end = c.latestOffset()
    parts = c.partitions({}, end)
    assert len(end) == 100 and 1 <= len(parts) < 10
    told = [x for p in parts for x in c.read(p)]
    assert sorted(f for f, _, data in told if data is None) == sorted(end)
    assert sum(len(data) for _, _, data in told if data) == sum(n for n, _ in end.values())
    assert gts.grouped(["a", "b", "c", "d"], [1, 5, 99, 1], most=10, opening=1) == [["a", "b"], ["c"], ["d"]]
