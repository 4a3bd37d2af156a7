"""Sum-of-squares online packing of token streams into windows.

Each task packs the documents of its partition as they come: full windows are cut off a long document, and what remains
goes to the fill level whose choice leaves the smallest sum over levels of squared counts of partially filled windows.
The counts live in an array by level. Memory is bounded by OPEN: where more windows would stay open, the fullest one is
filled up from the least filled ones and closed, and the rule goes on with the rest; by its nature the rule keeps few
windows open (on the driver's tables never more than some hundreds). When a partition ends, the open ones are cut and
poured together, and the last one is cut into power-of-two lengths, which need no padding. Nothing is shuffled.

Defined results. Null or empty text: the end id alone. Repeated rows are packed as often as they stand. An empty table
gives no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.tokens import default_vocabulary, encoder

LENGTH, END_ID = 2048, 1
#: Open windows of a task at most.
OPEN = 4096
#: Pieces that a task holds before it hands them on.
PIECES = 1024
SHAPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); out gets rows as windows close."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(length + 1)]
        self.out: list[tuple] = []
        self.windows = 0

    def level_for(self, size: int) -> int:
        """The level to put size tokens on (0: a new window) that least raises the sum of squares; the fullest of equals."""
        n, most = self.count, self.length - size
        rise = np.where(n[1 : most + 1] > 0, 1 - 2 * n[1 : most + 1], 1 << 40)
        rise[: most - 1] += 2 * n[size + 1 : self.length] + 1
        best = most - int(np.argmin(rise[::-1])) if most else 0
        return best if most and rise[best - 1] <= 2 * n[size] + 1 else 0

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, ids))
            offset += n
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, full = len(ids) // 4, self.length * 4
        cut = len(ids) - len(ids) % full
        for at in range(0, cut, full):
            self.close([(doc_id, at // 4, ids[at : at + full], total)])
        if cut == len(ids):
            return
        size = total - cut // 4
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            self.windows += 1
        window.append((doc_id, cut // 4, ids[cut:], total))
        level += size
        if level == self.length:
            self.windows -= 1
            self.close(window)
        else:
            self.open[level].append(window)
            self.count[level] += 1
            if self.windows > OPEN:
                self.top_up()

    def take(self, level: int) -> list[tuple]:
        """Takes a window off a level."""
        self.count[level] -= 1
        self.windows -= 1
        return self.open[level].pop()

    def fill(self, level: int, window: list[tuple]) -> int:
        """Moves the least filled windows' last tokens into a window until it is full or none is left; its new level."""
        while level < self.length and self.windows:
            low = int(np.argmax(self.count > 0))
            source = self.take(low)
            while source and level < self.length:
                doc_id, start, ids, total = source.pop()
                n = min(self.length - level, len(ids) // 4)
                window.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    source.append((doc_id, start + n, ids[4 * n :], total))
                level, low = level + n, low - n
            if source:
                self.open[low].append(source)
                self.count[low] += 1
                self.windows += 1
        return level

    def fullest(self) -> int:
        return self.length - int(np.argmax(self.count[::-1] > 0))

    def top_up(self) -> None:
        """Closes the fullest window, filled up from the least filled ones."""
        level = self.fullest()
        window = self.take(level)
        if self.fill(level, window) == self.length:
            self.close(window)
        else:
            self.close_in_powers(window)

    def pour(self) -> None:
        """Closes all windows."""
        while self.windows:
            self.top_up()

    def close_in_powers(self, window: list[tuple]) -> None:
        left = sum(len(p[2]) for p in window) // 4
        window = window[::-1]
        while left:
            part, room = [], 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, total = window.pop()
                n = min(room, len(ids) // 4)
                part.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    window.append((doc_id, start + n, ids[4 * n :], total))
                room -= n
            self.close(part)

    def rows(self, keep_ids: bool) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [()] * 8
        self.out = []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
        data = {k: pa.array(x, pa.int64()) for k, x in zip(names, columns, strict=False)}
        data["ids"] = pa.array(columns[7], pa.binary()) if keep_ids else pa.nulls(len(columns[0]), pa.binary())
        return pa.RecordBatch.from_pydict(data)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each piece of docs (doc_id: long, text: string): where it starts in its document, its ids, and where
    it lies in its sequence. sequence_id holds the partition's number above bit 33."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path), int(end_id).to_bytes(4, "little")
        packer = Packer(length, TaskContext.get().partitionId() << 33)
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                packer.add(doc_id, encode(text.as_py()) + end)
                if len(packer.out) >= PIECES:
                    yield packer.rows(keep_ids)
        packer.pour()
        yield packer.rows(keep_ids)

    return docs.select("doc_id", "text").mapInArrow(run, SHAPE)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False).drop("ids")
