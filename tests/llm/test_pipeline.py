"""The corpus pipeline, stage by stage and as a whole, against plain Python over a small table with odd rows."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldloom.llm import classifier, line_dedup, mixing
from fieldloom.llm.tokens import default_vocabulary
from tests.llm.test_native import brute_passages, brute_pieces
from tests.llm.test_simhash import brute_print, reach

#: The columns of documents, and others named as the operators name their own.
EXTRA = ["bits", "row", "kept", "component_id", "th", "marks", "n_lines", "n_removed", "size", "taken", "copies", "score"]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def documents():
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice("alpha beta gamma delta of the river stone light house".split()) + str(rng.randint(0, 99)) for _ in range(n))
    good = ["\n".join(line(rng.randint(8, 20)) for _ in range(rng.randint(3, 8))) for _ in range(40)]
    junk = ["### $$ || <> " * 30 + line(5) for _ in range(20)]
    shared = line(30) + "\n" + line(25)
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(good)] + [(100 + k, t, "s0") for k, t in enumerate(junk)]
    rows += [(200 + k, f"{line(20)}\n{shared}\n{line(9)}", "s1") for k in range(6)]
    near = good[0].split(" ")
    rows += [(300, " ".join(near[:-1] + ["end"]), "s2"), (301, good[1], "s2"), (None, good[2], "s2"), (None, line(80), None), (5, line(90), "s3"), (5, line(70), "s3")]
    # One line of fewer words than a passage has: only the near-duplicate stage finds its copies.
    single = line(45)
    rows += [(501, single, "s2"), (500, single, "s3"), (None, single, "s1"), (502, single.upper(), "s0")]
    return rows + [(400, None, "s1"), (401, "", "s1"), (402, " \n", "s1"), (403, line(3000), "s2")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    rows = [(i, t, "en", s, None if t is None else len(t), *(f"{c}{i}" for c in EXTRA)) for i, t, s in documents()]
    spark.createDataFrame(rows, SHAPE).coalesce(2).write.parquet(str(d / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(spark, rows, sf_dir):
    model = classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = lambda t: model.score(classifier.describe([w.encode() for w in words(t)])[None])[0]
    return [r for r in rows if score(r["text"]) >= classifier.THRESHOLD]


def lines(spark, rows, sf_dir):
    texts = sorted({r["text"] or "" for r in rows})
    th = {t: h for t, h in zip(texts, (r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text")).collect()), strict=True)}
    place = lambda r: (r[0] is not None, r[0] or 0, th[r[1]])
    left = brute_passages([(r["doc_id"], r["text"] or "") for r in rows], place, line_dedup.LONG, brute_pieces)
    out = []
    for r in rows:
        text = "\n".join(left[(r["doc_id"], r["text"] or "")])
        same = text == r["text"]
        if same or words(text):
            out.append(r | {"text": text, "n_chars": r["n_chars"] if same else len(text)})
    return out


def near(spark, rows, sf_dir):
    prints = [brute_print(r["text"]) for r in rows]
    label = reach(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    best: dict = {}
    for k, c in enumerate(label):
        best.setdefault(c, []).append((rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0, k))
    assert all(len({x[:2] for x in b}) == len(b) for b in best.values())
    return [rows[min(b)[2]] for b in best.values()]


def mixture(spark, rows, sf_dir):
    size = [len(words(r["text"])) for r in rows]
    total, sources = sum(size), sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    n = {s: sum(k for k, r in zip(size, rows, strict=True) if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    free, target = set(sources), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * n[s]}
        if not over:
            break
        target |= {s: 3 * n[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    won: Counter = Counter()
    for _ in range(total):
        won[max(sources, key=lambda s: (target[s] / (2 * won[s] + 1), -sources.index(s)))] += 1
    out = []
    for s in sources:
        key = lambda k: hashlib.md5(f"{'' if rows[k]['doc_id'] is None else rows[k]['doc_id']}:{mixing.SEED}".encode()).hexdigest()
        ring = sorted((k for k, r in enumerate(rows) if r["source"] == s), key=lambda k: (key(k), size[k]))
        copies, left = divmod(min(won[s], 3 * n[s]), max(n[s], 1))
        for k in ring:
            part = min(size[k], left)
            left -= part
            text = rows[k]["text"]
            out += [rows[k]] * (copies * (size[k] > 0))
            if part:
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                cut = text if part == size[k] else text[: ends[part - 1]]
                out.append(rows[k] | {"text": cut, "n_chars": len(cut)})
    return [r | {"n_chars": len(r["text"])} for r in out]


def shown(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


def test_stages_match_plain_python(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = before.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (quality, lines, near, mixture, None), strict=True):
        rows = [r.asDict() for r in before.collect()]
        out = stage(spark, before, sf_dir)
        if plain:
            assert out.columns == columns, name
            want = plain(spark, rows, sf_dir)
            got = [r.asDict() for r in out.collect()]
            assert shown(got) == shown(want), name
            assert 0 < len(got) and (len(got) < len(rows) or name in ("line dedup", "source mixing"))
            before = spark.createDataFrame([tuple(r[c] for c in columns) for r in got], SHAPE)
        else:
            whole = Tokenizer.from_file(default_vocabulary())
            ids = [(r["doc_id"], array("I", [*whole.encode(r["text"], add_special_tokens=False).ids, 1]).tobytes()) for r in rows]
            pieces = out.collect()
            assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == Counter((i, len(x) // 4) for i, x in ids)
            single = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
            assert not single - Counter((i, len(x) // 4, zlib.crc32(x)) for i, x in ids) and sum(r.length for r in pieces) == sum(len(x) // 4 for _, x in ids)
            fill: Counter = Counter()
            for r in pieces:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for plain in (quality, lines, near, mixture):
        rows = plain(spark, rows, sf_dir)
    whole = Tokenizer.from_file(default_vocabulary())
    want = Counter((r["doc_id"], len(whole.encode(r["text"], add_special_tokens=False).ids) + 1) for r in rows)
    assert Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect() if r.start == 0) == want


def test_empty_table(spark, sf_dir, tmp_path):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_votes_match_plain_numpy(spark):
    """Every document's neighbours among all labelled vectors, by a full sort in double precision."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit(docs, labels)
    got = sorted((r.doc_id, r.score) for r in classifier.classify(docs, model).collect())
    known = model.known.astype(float)
    want = []
    for r in docs.collect():
        x = classifier.describe((r.text or "").encode().split()).astype(float)
        y = x @ model.v.astype(float)
        near = known @ (y / np.linalg.norm(y)) if np.linalg.norm(y) > 1e-12 else np.zeros(len(known))
        best = np.argsort(-near, kind="stable")[: classifier.NEIGHBOURS]
        w = np.maximum(near[best], 0) ** classifier.SHARPNESS
        want.append((r.doc_id, 0.0 if not x.any() else float((w * model.labels[best]).sum() / w.sum()) if w.sum() > 0 else float(model.labels.mean())))
    for (i, a), (j, b) in zip(got, sorted(want), strict=True):
        assert i == j and abs(a - b) < 1e-3
