"""Quality classifier by nearest-neighbour voting in a latent space.

A text becomes counts of hashed words, of hashed word ends and of word habits (symbols, capitals, repeats). A bounded
sample of labelled documents (SAMPLE, half of each label, by a hash of doc_id) gives the latent-semantic basis, a
truncated SVD, and the labelled vectors. Both are broadcast: at most SAMPLE x RANK numbers. Every document is then
compared with all labelled vectors in blocks of exact cosine products, and its NEIGHBOURS nearest vote with the
similarity as weight.

Defined results. Null, empty or blank text has no direction: score 0. A document that lies opposite to or across from all
labelled ones gets the sample's mean label. Repeated rows get equal scores; of texts that share a labelled doc_id the one
with the smallest hash is learned from. A null doc_id is never labelled; its text is scored like any other. Labels that are null or other than 0 and 1 are
ignored, as are labels of held-out documents. No labels: score 0.5. Other columns are ignored. Empty table: no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import store
from fieldloom.llm.substring_dedup import BYTES, spans, texts_of

SAMPLE, RANK, NEIGHBOURS, THRESHOLD, FOLDS = 4000, 48, 25, 0.3, 5
WORDS, ENDS, HABITS = 1024, 512, 12
WIDTH = WORDS + ENDS + HABITS
SHARPNESS = 8
#: Texts that are described and compared at once.
BLOCK = 256


def describe(words: list[bytes]) -> np.ndarray:
    """Root shares of hashed words, word ends and habits."""
    out = np.zeros(WIDTH, np.float32)
    n = len(words)
    if not n:
        return out
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size)
    start = end - size
    flat = np.frombuffer(b"".join(words), np.uint8)
    h = spans(flat.astype(np.uint64) + np.uint64(1), start, end, BYTES)
    out[:WORDS] = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)[:WORDS]
    tail = flat[end - 1].astype(np.int64) + 256 * np.where(size > 1, flat[np.maximum(end - 2, 0)].astype(np.int64), 0)
    out[WORDS : WORDS + ENDS] = np.bincount(tail * 2654435761 % 4294967296 * ENDS // 4294967296, minlength=ENDS)[:ENDS]

    def share(kind: np.ndarray) -> float:
        """Of words with a byte of the kind."""
        total = np.concatenate([[0], np.cumsum(kind)])
        return float((total[end] > total[start]).mean())

    def full(kind: np.ndarray) -> float:
        total = np.concatenate([[0], np.cumsum(kind)])
        return float((total[end] - total[start] == size).mean())

    letters = (flat >= 97) & (flat <= 122)
    capitals = (flat >= 65) & (flat <= 90)
    habits = [
        share(np.isin(flat, np.frombuffer(b"#*$%&|<>", np.uint8))), share(flat == 33), share((flat >= 48) & (flat <= 57)),
        share(capitals), full(~letters), float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(h)) / n, float((size > 20).mean()), full((flat >= 128) | letters), float(n < 20), float(n < 60), 0.3,
    ]
    out[:WORDS] /= 4 * n
    out[WORDS:-HABITS] /= 2 * n
    out[-HABITS:] = habits
    return np.sqrt(out)


def basis(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of x, by a seeded range finder with power steps."""
    rng = np.random.default_rng(seed)
    y = x @ rng.standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.copy()


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


class Model:
    """Latent basis and labelled unit vectors."""

    def __init__(self, v: np.ndarray, known: np.ndarray, labels: np.ndarray):
        self.v, self.known, self.labels = v, known, labels

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = unit(x @ self.v) @ self.known.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        voted = np.divide((weight * self.labels[best]).sum(axis=1), total, out=np.full(len(x), self.labels.mean()), where=total > 0)
        return np.where(x.any(axis=1), np.clip(voted, 0, 1), 0.0)


def scores(model: Model, b: pa.RecordBatch) -> np.ndarray:
    """The score of each row's text, a few hundred rows at a time: texts may be very long and neighbours very many."""
    parts = [model.score(np.stack([describe(w) for w in texts_of(b.slice(at, BLOCK))])) for at in range(0, b.num_rows, BLOCK)]
    return np.concatenate([np.zeros(0), *parts])


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> Model:
    """Learns from the labelled documents outside the held-out fold."""
    known = labels.filter("quality in (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # doc_id decides which labels are in the sample, so the texts of at most sample documents are looked up.
    order = [F.xxhash64("doc_id", F.lit(11)), "doc_id"]
    halves = [known.filter(F.col("quality") == q).orderBy(*order).limit(sample // 2) for q in (0, 1)]
    chosen = store(halves[0].unionByName(halves[1]), "sample")
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Of texts that share a doc_id the same one is taken in every run.
    held = held.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for b in batches:
            x = [describe(w) for w in texts_of(b)]
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "quality": b.column("quality").cast(pa.int32()), "i": pa.array(at, pa.list_(pa.int32())), "x": pa.array([r[a] for r, a in zip(x, at, strict=True)], pa.list_(pa.float32()))})

    rows = held.mapInArrow(run, "doc_id long, quality int, i array<int>, x array<float>").orderBy("doc_id").toArrow()
    x = np.zeros((rows.num_rows, WIDTH), np.float32)
    for k, (i, v) in enumerate(zip(rows.column("i").to_pylist(), rows.column("x").to_pylist(), strict=True)):
        x[k, i] = v
    y = np.asarray(rows.column("quality")).astype(np.float64)
    if not len(y):
        return Model(np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    v = basis(x, min(rank, *x.shape))
    return Model(v, unit(x @ v), y)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(scores(shared.value, b), pa.float64())})

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(shared.value, b) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
