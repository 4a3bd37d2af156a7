"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

Merging always joins the best adjacent pair, so a sequence of tokens is a text's encoding if and only if each two neighbours,
merged anew by themselves, come out as those two (no merge ever crosses their border). So the encoder takes the longest
token that starts at a place (an Aho-Corasick automaton over the reversed vocabulary finds them for all places in one scan
of the reversed text), tries its shorter prefixes until one goes with the token before it, and steps back where none does; a
bitfield keeps the places from which the text's rest cannot be reached, so each is left once. Neighbours are checked by
re-merging their characters, and remembered.

A text is cut where no token of the vocabulary can reach across (before white space that follows other characters, around
line feeds), and the ids of short parts are remembered by each Python worker. No shuffle; a row holds one text.

Defined results. Null or empty text: no tokens between begin and end. Characters without a token become byte tokens. Texts of any
length are encoded whole, in memory that follows the longest. Ties of scores: the leftmost pair, as the library does.
Repeated rows: each its own result. Other columns pass through; where one is named as ours, ours has an underscore more.
Empty table: no row. Models with user-defined or unused pieces, another normalizer than identity, or without byte
fallback are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import fresh

#: Parts remembered by a worker before it starts anew, the longest part that is remembered, and pairs of neighbours remembered.
REMEMBERED, SHORT, PAIRS = 300_000, 64, 1_000_000
#: Rows and bytes of text of one Arrow batch that leaves a worker.
ROWS, BYTES = 256, 4 << 20
_encoders: dict[str, PieceEncoder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Places:
    """An array read as a dict is."""

    def __init__(self, values: array):
        self.values = values

    def get(self, place: int, default: int) -> int:
        return self.values[place] if place >= 0 else default


class PieceEncoder:
    """Ids of texts by one model. In all tables the model's mark of white space is a space."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, spec = schema.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only merge-type models with byte fallback, a prefixed space and no other normalization")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.pieces = [p.piece.replace("▁", " ") for p in model.pieces]
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.bytes = [0] * 256
        self.score: dict[str, float] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type == kinds.NORMAL:
                self.score[self.pieces[i]] = p.score
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        # Every character of a piece may stand alone, whether or not it is a piece.
        self.tokens = list(dict.fromkeys([*self.ids, *[c for p in self.ids for c in p]]))
        self.width = [len(t) for t in self.tokens]
        number = {t: k for k, t in enumerate(self.tokens)}
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens]
        self.out = [array("I", [self.ids[t]]).tobytes() if t in self.ids else self.spelled(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(t[::-1], k)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        if any(" " in p.lstrip(" ") for p in self.ids):
            pattern = r"(?s).+"
        elif "\n" in inner:
            pattern = r" +[^ ]*|[^ ]+"
        else:
            pattern = r"\n| +[^ \n]*|[^ \n]+"
        self.cut = re.compile(pattern).findall
        # Marks that no token holds behind a letter: parts are cut there once more before they are encoded.
        letter = re.compile(r"[^\W\d_]").match
        marks = {c for c in inner if not letter(c)} - {b for p in self.ids for a, b in zip(p, p[1:]) if letter(a)} - {" "}
        self.finer = re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(''.join(sorted(marks)))}])").split if marks else lambda part: [part]

    def spelled(self, text: str) -> bytes:
        return array("I", [self.bytes[b] for b in text.encode()]).tobytes()

    def merged(self, text: str) -> list[str]:
        """A short text merged step by step: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether token may follow before (-1: nothing)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        own = [self.tokens[k] for k in (before, token) if k >= 0]
        known = self.pairs[before * len(self.tokens) + token] = self.merged("".join(own)) == own
        return known

    def longest(self, text: str):
        """For each place, counted from the text's end, the longest token that begins there."""
        found = self.automaton.iter(text[::-1])
        if len(text) <= SHORT:
            # The automaton tells the longest token of a place first; the last one that a dict is given stays.
            return dict(reversed(list(found)))
        out, width = array("i", [-1]) * len(text), self.width
        for place, token in found:
            if out[place] < 0 or width[token] > width[out[place]]:
                out[place] = token
        return _Places(out)

    def backtracked(self, text: str) -> bytes:
        width, shorter, pairs, many, last = self.width, self.shorter, self.pairs, len(self.tokens), len(text) - 1
        longest = self.longest(text).get
        out: list[bytes] = []
        failed: bytearray | None = None
        stack: list[int] = []
        at, before, token = 0, -1, longest(last, -1)
        while at <= last:
            if token < 0 and not stack:
                # No token holds this character, so nothing reaches across it.
                out.append(self.spelled(text[at]))
                at += 1
                token = longest(last - at, -1)
                continue
            while token >= 0:
                stop = at + width[token]
                if failed is None or not failed[stop >> 3] >> (stop & 7) & 1:
                    fits = pairs.get(before * many + token)
                    if fits or fits is None and self.fits(before, token):
                        break
                token = shorter[token]
            if token < 0:
                if not stack:
                    raise AssertionError("a part without an encoding")
                if failed is None:
                    failed = bytearray(last // 8 + 2)
                failed[at >> 3] |= 1 << (at & 7)
                at -= width[before]
                token = shorter[stack.pop()]
                before = stack[-1] if stack else -1
                continue
            stack.append(token)
            at, before = stop, token
            token = longest(last - at, -1)
            if token < 0:
                out += [self.out[t] for t in stack]
                stack.clear()
                before = -1
        return b"".join(out)

    def part(self, text: str) -> bytes:
        cut = self.finer(text)
        if len(cut) == 1:
            return self.backtracked(text)
        out = []
        for p in cut:
            ids = self.parts.get(p)
            if ids is None:
                ids = self.old.get(p)
                ids = self.backtracked(p) if ids is None else ids
                if len(p) <= SHORT:
                    self.parts[p] = ids
            out.append(ids)
        return b"".join(out)

    def inner(self, text: str) -> bytes:
        """The ids of a text that already begins with its space, without begin and end."""
        parts, known, old = self.cut(text.replace("▁", " ")), self.parts, self.old
        for p in set(parts).difference(known):
            found = old.get(p)
            known[p] = self.part(p) if found is None else found
        ids = b"".join([known[p] for p in parts])
        if len(text) > SHORT:
            for p in [p for p in parts if len(p) > SHORT]:
                known.pop(p, None)
        if len(known) > REMEMBERED:
            # What was used of late stays for another round.
            self.old, self.parts = known, {}
        return ids

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text with begin and end, as little-endian unsigned 32-bit numbers."""
        return array("I", [self.begin]).tobytes() + (self.inner(" " + text) if text else b"") + array("I", [self.end]).tobytes()

    def decode(self, ids: bytes) -> str:
        return self.library.decode(array("I", ids).tolist())


def encoder(path: str) -> PieceEncoder:
    """One encoder for each model and Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def with_columns(docs: DataFrame, reads: str, fields: list[T.StructField], make: Callable[[], Callable]) -> DataFrame:
    """docs with fields added: make() gives, in a Python worker, a function from a value of the column reads to the fields'
    values. Batches leave after ROWS rows or BYTES bytes of reads, so what a worker holds follows neither table nor session."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            column = b.column(b.schema.get_field_index(reads))
            start, held, rows = 0, 0, []
            for k in range(b.num_rows):
                value = column[k].as_py()
                rows.append(f(value))
                held += len(value or "")
                if k + 1 - start >= ROWS or held >= BYTES or k + 1 == b.num_rows:
                    own = b.slice(start, k + 1 - start).columns
                    new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*own, *new], names=[*b.schema.names, *[x.name for x in fields]])
                    start, held, rows = k + 1, 0, []

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def encode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit numbers, begin and end included) and n_tokens."""
    path = model or default_model()
    ids, n = fresh(docs.columns, "ids", "n_tokens")

    def make():
        enc = encoder(path)
        return lambda value: (enc(value),)

    out = with_columns(docs, text, [T.StructField(ids, T.BinaryType())], make)
    return out.withColumn(n, (F.length(ids) / 4).cast("long"))


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """rows with decoded: the text of ids as the library reads them."""
    path = model or default_model()
    (name,) = fresh(rows.columns, "decoded")

    def make():
        enc = encoder(path)
        return lambda value: (None if value is None else enc.decode(value),)

    return with_columns(rows, ids, [T.StructField(name, T.StringType())], make)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs).drop("text"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
