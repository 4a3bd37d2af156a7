"""Encoding and decoding against the library."""

import hashlib
import random
from array import array

import pytest

from fieldloom.llm import pieces
from fieldloom.llm.queries import QUERIES

CASES = [None, "", " ", "   ", "▁", "a▁ b", "<s>", "</s> <unk> <0x0A>", "\n", "\r\n\t x", "漢字かな", "😀😀", "\x00\x01", "é" * 50, "a" * 3000, " " * 1000, "ab " * 2000, "x y z", "▁▁x  ▁ y"]


@pytest.fixture(scope="module")
def enc():
    return pieces.encoder(pieces.default_model())


def expected(enc, text):
    return enc.library.encode(text or "", add_bos=True, add_eos=True)


def test_cases_and_random_texts(enc):
    rng = random.Random(5)
    vocabulary = list(enc.ids)
    texts = list(CASES)
    for _ in range(1500):
        texts.append("".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))))
        texts.append("".join(rng.choice("aab  \n\r\t▁é漢😀x<0A>s/.#") for _ in range(rng.randint(0, 60))))
        texts.append(rng.choice(["a", "ab", " ", "\r\n", "etaoin", "=", "-", "\\"]) * rng.randint(1, 120))
    for t in texts:
        assert array("I", enc(t)).tolist() == expected(enc, t), repr(t)


def test_steps_back(enc):
    """Longest matches alone are not the encoding: some of these need steps back."""
    rng = random.Random(6)
    greedy = 0
    for _ in range(3000):
        t = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 30)))
        longest, out, at = enc.longest(t), [], 0
        while at < len(t):
            out.append(longest[len(t) - 1 - at])
            at += enc.width[out[-1]]
        want = [enc.ids[p] for p in enc.merged(t)]
        assert array("I", enc.backtracked(t)).tolist() == want
        greedy += [enc.ids[enc.tokens[k]] for k in out] == want
    assert greedy < 2900


def test_a_very_long_part(enc):
    t = "".join(random.Random(7).choice("abcde") for _ in range(200_000))
    assert array("I", enc(t)).tolist() == expected(enc, t)


def test_query_and_columns(spark, enc):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op11_pieces"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = expected(enc, texts[r.doc_id])
        text = enc.library.decode(ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    rows = [(None, t, "i") for t in CASES] * 2
    odd = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = pieces.decode(pieces.encode(odd), "ids_")
    assert out.columns == ["doc_id", "text", "IDS", "ids_", "n_tokens", "decoded"]
    for r in out.collect():
        assert array("I", r.ids_).tolist() == expected(enc, r.text) and r.decoded == enc.library.decode(expected(enc, r.text))
    assert pieces.encode(odd.limit(0)).collect() == []
