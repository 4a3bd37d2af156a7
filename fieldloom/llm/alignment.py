"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both encodings of a text end their tokens at byte offsets. Each byte gets a label: no token ends there, one of A, one of B,
or one of each. A regular expression scans the labels for spans up to each both-label; a span's label counts say how
many tokens of A and of B form the group. Where the next byte belongs to, of either side, follows from the labels too,
so one pass over a span gives the pairs of overlapping tokens.

Byte-level pre-splitting, and the pieces' white-space rule, both begin anew at a space between two characters that are no
white space, so a text is cut there and each part is encoded, labelled and scanned once a worker (short parts are
remembered); a text's groups are its parts' groups in order.

Pairs are counted by document. Documents are dealt to blocks of BLOCK bytes of text; a block's distinct pairs are counted
locally, added up over the corpus, and come back to the blocks that hold them, so what is shuffled are distinct pairs a
block and not pairs a document, no pair has more rows than there are blocks, and a block never holds more than its
own texts' pairs.

Defined results. Null and empty texts, and texts whose tokens' bytes are not those of space + text (a literal U+2581, which
B cannot tell from a space), have no tokens: all counts are 0 and groups is empty. Special tokens' strings are plain
text. Texts of any length are taken whole. Repeated rows and null or repeated ids: every row is a document. Ties of
counts: all are best. Other columns pass through, ours get an underscore more where names clash. Empty table: no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import pieces
from fieldloom.llm.common import discard, fresh, join_hot, store
from fieldloom.llm.tokens import byte_letters

#: Parts remembered by a worker before it starts anew, and the longest part that is remembered.
REMEMBERED, SHORT = 150_000, 64
#: Bytes of text of a block of documents.
BLOCK = 2 << 20
#: A pair's key is A's id times this, and B's id.
KEY = 1 << 32
#: Labels: bit 1 for a token of A that ends here, bit 2 for one of B.
SPAN = re.compile(rb"[^\x03]*\x03", re.S)
#: A space between characters that are no white space for either side begins a new part.
CUT = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")
_aligners: dict[tuple[str, str], Aligner] = {}


def default_bytes() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Aligner:
    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = pieces.encoder(b)
        values = {c: k for k, c in byte_letters().items()}
        spelled = {i: len(t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = {i: bytes([values[c] for c in t]) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in values for c in t)}
        self.b_bytes = {i: p.encode() for i, p in enumerate(self.b.pieces)} | {i: bytes([k]) for k, i in enumerate(self.b.bytes)}
        self.a_size = np.array([spelled.get(i, 0) for i in range(self.a.get_vocab_size())])
        self.b_size = np.array([len(self.b_bytes[i]) for i in range(len(self.b_bytes))])
        self.text = [f"{i}{mark}" for size, marks in ((self.a_size, ",|"), (self.b_size, ",;")) for mark in marks for i in range(len(size))]
        self.parts: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def aligned(self, parts: list[str]) -> Iterator[tuple | None]:
        """For each part (tokens of A, tokens of B, groups, their text, keys of linked pairs); None if bytes differ. All parts but
        the last end without white space, so that they are encoded in one piece as they are apart."""
        whole = "".join(parts)
        raw = whole.encode()
        # B puts the space that parts begin with before a text by itself.
        a, b = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.b.library.encode(whole[1:])
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            if len(parts) == 1:
                yield None
            else:
                for p in parts:
                    yield from self.aligned([p])
            return
        labels = np.zeros(len(raw), "u1")
        a_ids, b_ids = np.array(a), np.array(b)
        a_end, b_end = np.cumsum(self.a_size[a_ids]) - 1, np.cumsum(self.b_size[b_ids]) - 1
        labels[a_end] |= 1
        labels[b_end] |= 2
        marks = np.flatnonzero(labels)
        ends = labels[marks].astype("i8")
        # Between two labels one token of each side is open: how many have ended before tells which.
        keys = a_ids[np.cumsum(ends & 1) - (ends & 1)] * KEY + b_ids[np.cumsum(ends >> 1) - (ends >> 1)]
        stops = np.array([m.end() - 1 for m in SPAN.finditer(labels.tobytes())])
        # A span's label counts say how many tokens of each side follow in its group; the last of a side is written otherwise.
        upto = np.searchsorted(marks, stops, "right")
        counts = [np.diff(np.concatenate([[0], np.cumsum(e)[upto - 1]])) for e in (ends & 1, ends >> 1)]
        own = [np.repeat(np.arange(len(stops)), n) for n in counts]
        last = [np.concatenate([g[1:] != g[:-1], [True]]) for g in own]
        shown = np.concatenate([a_ids + last[0] * len(self.a_size), b_ids + last[1] * len(self.b_size) + 2 * len(self.a_size)])
        shown = shown[np.argsort(np.concatenate([own[0] * 2, own[1] * 2 + 1]), kind="stable")].tolist()
        # What lies before each part's end: labels, tokens of each side, groups.
        stop = np.cumsum([len(p.encode()) for p in parts]) - 1
        before, text = (0, 0, 0, 0), self.text
        for at in zip(*[np.searchsorted(x, stop, "right").tolist() for x in (marks, a_end, b_end, stops)], strict=True):
            size = [x - y for x, y in zip(at, before, strict=True)]
            yield *size[1:], "".join([text[k] for k in shown[before[1] + before[2] : at[1] + at[2]]])[:-1], keys[before[0] : at[0]].tobytes()
            before = at

    def __call__(self, text: str | None) -> tuple:
        """(n_a, n_b, n_groups, groups, pairs, times): pairs are distinct keys in order, as often linked as times says."""
        nothing = (0, 0, 0, "", [], [])
        if not text:
            return nothing
        parts, known, old = CUT.split(" " + text), self.parts, self.old
        new = []
        for p in set(parts).difference(known):
            if p in old:
                known[p] = old[p]
            else:
                new.append(p)
        if new:
            loose = [p for p in new if p[-1].isspace() or "▁" in p]
            firm = [p for p in new if p not in loose] if loose else new
            if firm:
                known.update(zip(firm, self.aligned(firm), strict=True))
            for p in loose:
                (known[p],) = self.aligned([p])
        found = [known[p] for p in parts]
        for p in new:
            if len(p) > SHORT:
                known.pop(p)
        if len(known) > REMEMBERED:
            self.old, self.parts = known, {}
        if None in found:
            return nothing
        n_a, n_b, n_groups, groups, keys = zip(*found, strict=True)
        pairs, times = np.unique(np.frombuffer(b"".join(keys), "i8"), return_counts=True)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), pairs, times.astype("i4")


def align(docs: DataFrame, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """docs with n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), pairs and times: the distinct linked pairs of tokens, as
    A's id * KEY + B's id, and how many occurrences of each are linked."""
    key = (a or default_bytes(), b or pieces.default_model())
    names = fresh(docs.columns, "n_a", "n_b", "n_groups", "groups", "pairs", "times")
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())]

    def make():
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        return _aligners[key]

    return pieces.with_columns(docs, text, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)], make)


def in_blocks(rows: DataFrame, size: str, block: str) -> DataFrame:
    """rows with a number in column block: rows of one task that follow each other share it, as long as column size does not add
    up to more than BLOCK. The result should be stored, so that a number always means the same rows."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            numbers = []
            for n in b.column(b.schema.get_field_index(size)).to_pylist():
                if held and held + n > BLOCK:
                    at, held = at + 1, 0
                held += n
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=[*b.schema.names, block])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(block, T.LongType())]))


def link_counts(rows: DataFrame, block: str, pairs: str = "pairs", times: str = "times") -> DataFrame:
    """rows (stored, in blocks) without pairs, times and block, with n_links, n_best and count_sum: linked occurrences, those
    whose pair is in no fewer documents than any other of its A id, and the sum of their pairs' documents."""
    names = fresh(rows.columns, "n_links", "n_best", "count_sum")
    own = store(rows.select(F.col(block).alias("block"), F.explode(pairs).alias("key")).groupBy("block", "key").agg(F.count("*").alias("n")), "blocks")
    whole = store(own.groupBy("key").agg(F.sum("n").alias("docs"), F.count("*").alias("rows")), "counts")
    a = F.floor(F.col("key") / KEY).alias("a")
    best = whole.groupBy(a).agg(F.max("docs").alias("most"))
    whole = store(whole.withColumn("a", a).join(best, "a").select("key", "docs", (F.col("docs") == F.col("most")).alias("best"), "rows"), "best")
    facts = join_hot(own.select("block", "key"), whole, ["key"], F.col("block"), "rows", merge=True)
    kept = [f for f in rows.schema.fields if f.name not in (pairs, times, block)]

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        keys = known["key"].to_numpy()
        order = np.argsort(keys)
        keys, counts, tops = keys[order], known["docs"].to_numpy()[order], known["best"].to_numpy()[order]
        ours, n = docs[pairs].combine_chunks(), docs[times].combine_chunks()
        at = np.searchsorted(keys, ours.flatten().to_numpy())
        n = n.flatten().to_numpy().astype("i8")
        row = np.repeat(np.arange(docs.num_rows), ours.value_lengths().to_numpy())
        out = []
        for values in (n, n * tops[at] if len(keys) else n, n * counts[at] if len(keys) else n):
            total = np.zeros(docs.num_rows, "i8")
            np.add.at(total, row, values)
            out.append(pa.array(total))
        return pa.Table.from_arrays([*[docs[f.name] for f in kept], *out], names=[*[f.name for f in kept], *names])

    return rows.groupBy(block).cogroup(facts.groupBy("block")).applyInArrow(score, T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in names]]))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align(docs).withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))).drop("text")
    out = out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups")
    rows = store(in_blocks(out, "size", "block").drop("size"), "aligned")
    return link_counts(rows, "block").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
