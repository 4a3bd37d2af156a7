"""Substring dedup over a log-structured fingerprint index.

Words come from whole texts; a window is WINDOW consecutive words. From every window the smallest hash of its GRAM-word
grams is kept (equal windows keep equal hashes, and neighbouring windows mostly share one, so about a tenth of the
positions is stored). A batch of documents becomes an immutable run of hashes with occurrence counts, bucketed and sorted
by hash. A new run is merge-joined with the runs before it, bucket by bucket and without a shuffle, which tells at once
which of the batch's hashes stand elsewhere; runs of one level are then compacted into one of the next. The runs and the
hashes of each text lie in a folder, and a later session opens them there and adds its batch.

Windows whose kept hash stands twice are candidates; those of the batch, and of earlier texts that hold one of the batch's
hashes, are verified by BLAKE2b digests (128 bits) of their words before anything is removed. A text goes by its SHA-256.

Defined results. Null or empty text: no words, nothing removed, digest of the empty string. Fewer than WINDOW words: kept
whole. Each row gives one row: repeated rows are separate documents that repeat each other, whatever their doc_id, which
may be null or repeat. Other columns are ignored. Empty table: no row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import WRITING, discard, in_parts, join_hot, settings, store, work_dir

WINDOW, GRAM = 35, 16
#: Runs of a level that are compacted into one of the next.
FANOUT = 2
#: Documents are added in so many batches; each batch's windows are verified in so many slices of their digests.
BATCHES, SLICES = 2, 2
U = np.uint64


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


BYTES, GRAMS = (Powers(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(x: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of x[start:end], each independent of where it stands."""
    up, down = powers.get(len(x) + 1)
    total = np.zeros(len(x) + 1, U)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def runs_of(x: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    at = np.arange(len(x) - n + 1)
    return spans(x, at, at + n, powers)


def sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = least(x[:-step], x[step:]), have + step
    return x


def word_hashes(words: list[bytes], powers: Powers) -> np.ndarray:
    """Hashes of words; words that collide only bring more candidates, for digests decide."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    return spans(np.frombuffer(b"".join(words), np.uint8).astype(U) + U(1), end - size, end, powers) + size.astype(U)


def kept_hashes(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each gram its hash; for each window the smallest of its grams' hashes."""
    grams = runs_of(word_hashes(words, BYTES), gram, GRAMS)
    return grams, sliding(grams, window - gram + 1, np.minimum)


def postings(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that some window keeps, each once, and how often they stand there (2 for more)."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    grams, least = kept_hashes(words, window, gram)
    span = window - gram
    edge = np.zeros(span, U)
    cover = sliding(np.concatenate([edge, least, edge]), span + 1, np.maximum)
    found, n = np.unique(grams[grams == cover], return_counts=True)
    return found.view(np.int64), np.minimum(n, 2).astype(np.int32)


def digests(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """The 128-bit BLAKE2b digests of the windows that start at the positions at, as two columns of 64 bits."""
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate([[0], end[:-1]])[at].tolist()
    found = [hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(start, (end[at + window - 1] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def listed(parts: list[np.ndarray], kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, parts[0].dtype if parts else np.int64), *parts]), kind))


def texts_of(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for x in batch.column("text"):
        yield (x.as_py() or "").encode().split()


def text_key(text: Column) -> Column:
    """A text's name: its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class FingerprintIndex:
    """Sorted immutable runs (h, n) in levels, one row a hash, and the hashes (key, h) of each text, in a folder.

    add() takes a batch of texts and answers it against all that was added before. open() finds an index again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder = spark, folder or f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
        self.window, self.gram, self.fanout = window, gram, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.postings: list[DataFrame] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier session left in the folder."""
        last = spark.read.parquet(f"{folder}/manifest").orderBy(F.col("version").desc()).first()
        index = cls(spark, folder, last.window, last.gram, last.fanout, last.buckets)
        index.version = last.version
        index.levels = [[index._run(path) for path in level] for level in last.levels]
        index.postings = [index._part(path) for path in last.postings]
        return index

    def _part(self, path: str) -> DataFrame:
        out = self.spark.read.schema("key binary, h array<long>, n array<int>").parquet(path)
        out.stored_at = path
        return out

    def _run(self, path: str) -> DataFrame:
        """A run as a bucketed table, so that joins by hash read it in place."""
        name = f"run_{path.rsplit('-', 1)[1]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        out = self.spark.table(name)
        out.stored_at, out.name = path, name
        return out

    def _write(self, rows: DataFrame, label: str) -> str:
        path = f"{self.folder}/{label}-{uuid.uuid4().hex}"
        with settings(self.spark, WRITING):
            if label == "run":
                name = f"new_{path.rsplit('-', 1)[1]}"
                rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").saveAsTable(name)
                self.spark.sql(f"DROP TABLE {name}")
            else:
                rows.write.option("compression", "zstd").parquet(path)
        return path

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds docs (key, text) as a batch. Stored rows (h, n, before): the batch's hashes that stand twice or more by now,
        how often, and how often before it."""
        window, gram = self.window, self.gram

        def scan(batches):
            for b in in_parts(batches):
                found = [postings(w, window, gram) for w in texts_of(b)]
                yield batch_of(key=b.column("key"), h=listed([x for x, _ in found], pa.int64()), n=listed([x for _, x in found], pa.int32()))

        own = self._part(self._write(docs.select("key", "text").mapInArrow(scan, "key binary, h array<long>, n array<int>"), "postings"))
        each = own.select(F.explode(F.arrays_zip("h", "n")).alias("x")).select("x.h", "x.n")
        run = self._run(self._write(each.groupBy("h").agg(F.sum("n").alias("n")), "run"))
        # The new run against each earlier one; a hash has one row in a run, and most runs are in few levels.
        hits, total, before = run.withColumnRenamed("n", "own"), F.col("own"), F.lit(0).cast("long")
        for k, old in enumerate(r for level in self.levels for r in level):
            hits = hits.join(old.select("h", F.col("n").alias(f"n{k}")).hint("merge"), "h", "left")
            total, before = total + F.coalesce(f"n{k}", F.lit(0)), before + F.coalesce(f"n{k}", F.lit(0))
        hits = store(hits.select("h", total.alias("n"), before.alias("before")).filter("n >= 2"), "hits")
        self.postings.append(own)
        gone = self._put(run, 0)
        self._commit()
        for old in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {old.name}")
        discard(*gone)
        return hits

    def _put(self, run: DataFrame, level: int) -> list[DataFrame]:
        """Adds a run to a level and compacts full levels; the runs that nothing needs once this is committed."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fanout:
            return []
        old, self.levels[level] = self.levels[level], []
        all_ = old[0]
        for other in old[1:]:
            new = other.select("h", F.col("n").alias("m"))
            all_ = all_.hint("merge").join(new, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return [*old, *self._put(self._run(self._write(all_, "run")), level + 1)]

    def _commit(self) -> None:
        """Writes what the index consists of now; the newest row counts, so a batch that broke off leaves the one before."""
        self.version += 1
        paths = lambda frames: [x.stored_at for x in frames]
        row = (self.version, self.window, self.gram, self.fanout, self.buckets, [paths(x) for x in self.levels], paths(self.postings))
        shape = "version int, window int, gram int, fanout int, buckets int, levels array<array<string>>, postings array<string>"
        self.spark.createDataFrame([row], shape).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def marks(self, hits: DataFrame) -> DataFrame:
        """(key, marks, rows): which of the hashes hits (h, n) each text of the index has, and how often the text was added."""
        own = self.postings[0]
        for x in self.postings[1:]:
            own = own.unionByName(x)
        each = own.select("key", F.explode("h").alias("h"))
        return join_hot(each, hits.select("h", "n"), ["h"], F.col("key"), "n").groupBy("key").agg(F.collect_set("h").alias("marks"), F.count("*").alias("rows")).withColumn("rows", F.ceil(F.col("rows") / F.size("marks")))

    def remove(self) -> None:
        """Deletes the index."""
        runs = [r for level in self.levels for r in level]
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        discard(*runs, *self.postings)


def outcome(words: list[bytes], starts, window: int) -> tuple[int, int, str, bytes]:
    """n_words, n_removed, the kept words and their digest when windows at starts are removed."""
    gone = np.zeros(len(words) + 1, np.int32)
    starts = np.asarray(starts, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + window, -1)
    gone = np.cumsum(gone[:-1]) > 0 if len(words) else np.zeros(0, bool)
    kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g]) if len(starts) else b" ".join(words)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept


def repeated_windows(index: FingerprintIndex, docs: DataFrame, hits: DataFrame, slices: int = SLICES) -> DataFrame:
    """(key, starts, rows) of the texts in docs (key, text: every text of the index that has one of the hashes hits) whose windows
    with those hashes stand twice or more in docs. Stored."""
    window, gram = index.window, index.gram

    def candidates(found):
        for b in in_parts(found):
            out: tuple[list, list] = ([], [])
            for words, m in zip(texts_of(b), b.column("marks"), strict=True):
                at = np.flatnonzero(np.isin(kept_hashes(words, window, gram)[1], np.asarray(m.values).view(U)))
                out[0].append(at.astype(np.int32))
                out[1].append(digests(words, at, window))
            v, w = ([x[:, k] for x in out[1]] for k in (0, 1))
            yield batch_of(key=b.column("key"), at=listed(out[0], pa.int32()), v=listed(v, pa.int64()), w=listed(w, pa.int64()))

    # Copies of one text may be very many; they are dealt out.
    marks = store(index.marks(hits), "marks")
    marked = join_hot(docs.select("key", "text"), marks, ["key"], F.monotonically_increasing_id(), "rows").mapInArrow(candidates, "key binary, at array<int>, v array<long>, w array<long>")
    held = store(marked.withColumn("uid", F.monotonically_increasing_id()), "candidates")
    each = held.select("uid", F.explode(F.arrays_zip("at", "v", "w")).alias("x")).select("uid", "x.at", "x.v", "x.w")
    starts = None
    for k in range(slices):
        own = each.filter(F.pmod("v", F.lit(slices)) == k)
        twice = store(own.groupBy("v", "w").count().filter("count >= 2"), "windows")
        found = store(join_hot(own, twice, ["v", "w"], F.col("uid"), "count").groupBy("uid").agg(F.collect_set("at").alias("at")), "starts")
        starts = found if starts is None else starts.unionByName(found)
        discard(twice)
    # Rows of one text have the same starts.
    named = starts.join(held.select("uid", "key"), "uid").select("key", "uid", F.explode("at").alias("at"))
    named = named.groupBy("key").agg(F.collect_set("at").alias("starts"), F.count("*").alias("rows")).withColumn("rows", F.ceil(F.col("rows") / F.size("starts")))
    named = store(named, "repeated")
    discard(marks, held)
    return named


def add_batch(index: FingerprintIndex, batch: DataFrame, earlier: DataFrame | None = None, slices: int = SLICES) -> DataFrame:
    """Adds batch (key, text) and answers it: stored rows (key, starts) of the windows that the batch makes known as
    repeated, in its own texts and in earlier ones. earlier: where texts of the index can be read; of these only the ones
    that share a hash with the batch are looked at."""
    hits = index.add(batch)
    pool = batch.select("key", "text") if earlier is None else earlier.select("key", "text").unionByName(batch.select("key", "text"))
    found = repeated_windows(index, pool, hits, slices)
    discard(hits)
    return found


def cleaned(docs: DataFrame, starts: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of docs (doc_id, key, text) without the windows at starts (key, starts,
    rows; stored)."""

    def cut(found):
        for b in in_parts(found):
            out = [outcome(w, s.as_py() or [], window) for w, s in zip(texts_of(b), b.column("starts"), strict=True)]
            n, gone, sha, kept = zip(*out, strict=True)
            text = {"kept": pa.array([x.decode() for x in kept], pa.string())} if keep_text else {}
            yield batch_of(doc_id=b.column("doc_id"), n_words=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), kept_sha256=pa.array(sha, pa.string()), **text)

    known = join_hot(docs.select("doc_id", "key", "text"), starts, ["key"], F.monotonically_increasing_id(), "rows", "left").select("doc_id", "text", "starts")
    return known.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, slices: int = SLICES, folder: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each row of docs (doc_id: long, text: string).

    Every word covered by a window whose words also start elsewhere goes. docs are added in so many batches, of which each
    is answered against the ones before; folder: where the index is left for later batches.
    """
    index = FingerprintIndex(docs.sparkSession, folder, window, gram)
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    part = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(batches))
    found = None
    for k in range(batches):
        new = add_batch(index, docs.filter(part == k), docs.filter(part < k) if k else None, slices)
        found = new if found is None else found.unionByName(new)
    starts = store(found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.max("rows").alias("rows")), "starts")
    if folder is None:
        index.remove()
    return cleaned(docs, starts, window, keep_text)


def op1(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
  s AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM d WHERE len(words) >= {WINDOW}),
  g AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + {WINDOW - 1}], ' ')) > 1 AS gone FROM s),
  x AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM g WHERE gone),
  w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
  k AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE x.i IS NULL) AS kept, count(x.i) AS n_removed FROM w LEFT JOIN x ON w.r = x.r AND w.i = x.i GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
