"""Packing: exact round trip of every id, bounded padding, the level rule against brute force, ids as the library's."""

import random
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldloom.llm.packing import Packer, pack
from fieldloom.llm.tokens import default_vocabulary, encoder

ODD = ["foo<|endoftext|>bar BAZ", "Σίσυφος ΟΔΟΣ οδός İstanbul", "é ́x a b c\x1cd​e", "don't 12 345's it'll", "a\x00b \x85c", "x²½ ٣٤ 'S'T", "<|startoftext|>", "ﬁn ǅ ß ẞ", "ab1 1 ab'", "€ 中文字。。 🙂🙂", "a" * 3000]


def test_ids_are_the_librarys():
    whole, ours = Tokenizer.from_file(default_vocabulary()), encoder(default_vocabulary())
    for x in ODD:
        assert ours(x) == array("I", whole.encode(x, add_special_tokens=False).ids).tobytes(), x


def test_level_rule_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p = Packer(32, 0)
        p.count[1:32] = rng.integers(0, 4, 31) * (rng.random(31) < 0.4)
        size = int(rng.integers(1, 32))

        def after(level, size=size, p=p):
            n = p.count.copy()
            n[level] -= level > 0
            n[level + size] += level + size < 32
            return int((n[1:32] ** 2).sum())

        options = [0, *[h for h in range(1, 33 - size) if p.count[h]]]
        assert after(p.level_for(size)) == min(after(h) for h in options)


def test_open_windows_are_bounded(monkeypatch):
    from fieldloom.llm import packing

    monkeypatch.setattr(packing, "OPEN", 3)
    rng = np.random.default_rng(2)
    p, sizes = Packer(64, 0), rng.integers(1, 150, 400).tolist()
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype="<u4").tobytes())
        assert p.windows == p.count.sum() == sum(map(len, p.open)) <= 3
    p.pour()
    assert not p.windows and not p.count.any()
    pieces: dict = {}
    for doc_id, start, n, _, total, *_, ids in p.out:
        assert n == len(ids) // 4 and total == sizes[doc_id]
        pieces.setdefault(doc_id, []).append((start, ids))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in pieces.items()} == {k: np.arange(n, dtype="<u4").tobytes() for k, n in enumerate(sizes)}


@pytest.mark.parametrize("parts", [1, 5])
def test_round_trip(spark, parts):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["Haus", "the", "zqx,", "12", "naïve"]) for _ in range(rng.randint(0, 900)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 9000), (203, "same"), (203, "same"), *[(300 + k, x) for k, x in enumerate(ODD)]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, ids string").repartition(parts)
    got = pack(docs).collect()
    whole = Tokenizer.from_file(default_vocabulary())
    want = {i: array("I", [*whole.encode(t or "", add_special_tokens=False).ids, 1]).tobytes() for i, t in rows}
    pieces, sequences = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 and r.doc_tokens == len(want[r.doc_id]) // 4
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.pop(203) == [(0, want[203])] * 2
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()} == {i: x for i, x in want.items() if i != 203}
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        fill = sum(n for _, n in s)
        assert fill <= 2048 and fill & (fill - 1) == 0


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
