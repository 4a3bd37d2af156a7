"""Alignment against a plain computation from the libraries' own encodings."""

import hashlib
from collections import Counter

import pytest

from fieldloom.llm import alignment, pieces
from fieldloom.llm.queries import QUERIES
from fieldloom.llm.tokens import byte_letters

CASES = [None, "", " ", "a", " \n foo  bar ", "foo  ", "a▁b", "▁", "x ▁ y", "<|endoftext|> and <s>", "don't   stop\n\nnow\t!", "漢字 かな 😀 é", "\x1c x \x85 y z", "a" * 2000, "it's " * 500, "   a b", "x\x00y"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_bytes())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def plain(texts, libraries):
    """The results of each text, by intervals of bytes and loops."""
    a, b = libraries
    values = {c: k for k, c in byte_letters().items()}
    spans, out = [], []
    for t in texts:
        ids = ([], [])
        if t:
            raw = (" " + t).encode()
            x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
            parts = ([bytes(values[c] for c in a.id_to_token(i)) for i in x.ids], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]])
            if all(b"".join(p) == raw for p in parts):
                ids = (x.ids, y)
        own = []
        for k, side in enumerate(ids):
            at, s = 0, []
            for i, p in zip(side, parts[k] if side else (), strict=True):
                s.append((at, at + len(p), i))
                at += len(p)
            own.append(s)
        links, k = [], 0
        for s, e, i in own[0]:
            while k and k < len(own[1]) and own[1][k][0] > s or k == len(own[1]) and k:
                k -= 1
            while k < len(own[1]) and own[1][k][0] < e:
                if own[1][k][1] > s:
                    links.append((i, own[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in own[0]} & {e for _, e, _ in own[1]})
        text, low = [], 0
        for high in both:
            text.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in own) if len(own[0]) < 700 else None)
            low = high
        spans.append(links)
        out.append([len(own[0]), len(own[1]), len(both), len(links), text])
    docs = Counter(p for links in spans for p in set(links))
    best: dict = {}
    for (i, _), n in docs.items():
        best[i] = max(best.get(i, 0), n)
    for row, links in zip(out, spans, strict=True):
        row[4:4] = [sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links)]
    return out


def compare(got, want):
    assert list(got[:6]) == want[:6]
    if None not in want[6]:
        assert got[6] == (hashlib.sha256(";".join(want[6]).encode()).hexdigest() if want[6] else "")


def test_query(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], libraries), strict=True))
    got = QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want)
    for r in got:
        compare((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256), want[r.doc_id])


def test_cases(spark, libraries, tmp_path, monkeypatch):
    """Odd texts, null and repeated ids, several blocks."""
    monkeypatch.setattr(alignment, "BLOCK", 600)
    texts = CASES + CASES[3:6]
    rows = [(k if k % 3 else None, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, PAIRS long").repartition(3)
    out = alignment.align(df)
    assert out.columns[3:] == ["n_a", "n_b", "n_groups", "groups", "pairs_", "times"]
    sized = alignment.F.octet_length(alignment.F.coalesce("text", alignment.F.lit("")))
    stored = alignment.store(alignment.in_blocks(out.withColumn("size", sized), "size", "block"), "rows")
    assert stored.select("block").distinct().count() > 3
    got = {r.PAIRS: r for r in alignment.link_counts(stored, "block", "pairs_").collect()}
    want = plain(texts, libraries)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        r = got[k]
        digest = hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
        compare((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest), w)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["op13_alignment"](spark, str(tmp_path)).collect() == []
