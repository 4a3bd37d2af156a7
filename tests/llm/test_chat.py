"""Chat formatting: escapes, exact round trip, and the tree against a plain walk."""

import hashlib

from fieldloom.llm.chat import default_vocabulary, encoding, escape, format_turn, op2, pieces_of, prefix_tree, read_back, read_turns, unescape

TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi </s>"), (1, 2, "user", "more"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi </s>"), (2, 2, "user", "other [INST] x"),
    (3, 0, "user", "hello"), (4, 1, "assistant", None), (4, 0, None, "x\\"), (5, 0, "tool] [/ROLE]", "\\[<"), (5, 1, "", ""),
    (6, 0, "user", "hello"), (6, 1, "assistant", "hi </s>"), (6, 2, "user", "more"), (7, 0, "system", "é🙂"), (7, 0, "system", "é🙂"),
    (None, 0, "user", "hello"), (8, 0, "user", "long " * 5000),
]
SHAPE = "conv_id long, turn long, role string, text string"


def test_escape_is_reversible():
    for x in ["", "\\", "\\\\", "[INST] ok [/INST]</s>", "a\\[b", "]<>[", "\n\\\n"]:
        assert unescape(escape(x)) == x and not set("[<") & set(escape(x).replace("\\\\", "").replace("\\[", "").replace("\\<", ""))
        for role in ("user", "assistant", "system", "", x):
            text, loss = format_turn(role, x)
            assert read_turns(text * 2) == [(role, x)] * 2
            assert loss is None or unescape(text[slice(*loss)]) == x
            assert "".join(p for p, _ in pieces_of(role, x)) == text and [p for p, learned in pieces_of(role, x) if learned] == ([text[slice(*loss)]] if loss else [])


def test_tree_and_round_trip(spark):
    table = spark.createDataFrame([(*t, 1) for t in TURNS], SHAPE + ", node int")
    nodes, leaves = prefix_tree(table)
    rows = sorted(nodes.collect(), key=lambda r: r.start)
    decode = lambda ids: encoding(default_vocabulary()).decode_bytes(ids).decode()
    shown = {r.start: decode(r.ids) for r in rows}
    assert all(r.end - r.start == len(r.ids) for r in rows)
    for r in rows:
        learned = [format_turn(a, x)[0][slice(*format_turn(a, x)[1])] for a, x in read_turns(shown[r.start]) if a == "assistant"]
        assert [decode(r.ids[m["from"] : m["to"]]) for m in r.loss] == [x for x in learned if x]
    assert rows[0].start == 0 and all(a.end == b.start for a, b in zip(rows, rows[1:], strict=False))
    want: dict = {}
    for c, t, r, x in TURNS:
        want.setdefault(c, []).append((t, r or "", x or ""))
    want = {c: [(r, x) for _, r, x in sorted(t)] for c, t in want.items()}
    paths = {tuple(t[: k + 1]) for t in want.values() for k in range(len(t))}
    has = {p: sum(tuple(t[: len(p)]) == p for t in want.values()) for p in paths}
    assert len(rows) == sum(len(p) == 1 or has[p[:-1]] != n for p, n in has.items()) and sum(len(read_turns(shown[r.start])) for r in rows) == len(paths)
    by_start = {r.start: r for r in rows}
    for r in rows:
        up = [by_start[a.start] for a in r.attends]
        assert [u.depth for u in up] == list(range(r.depth)) and r.position == sum(u.end - u.start for u in up)
        assert tuple(read_turns("".join(shown[u.start] for u in [*up, r]))) in paths
        # Depth-first: what lies between an ancestor and its descendant descends from the ancestor.
        assert all(u.start in {a.start for a in x.attends} for u in up for x in rows if u.start < x.start < r.start)
    got = {r.conv_id: (read_turns(r.formatted), "".join(map(unescape, r.loss))) for r in read_back(nodes, leaves).collect()}
    assert got == {c: (t, "".join(x for r, x in t if r == "assistant")) for c, t in want.items()}


def test_query(spark):
    got = op2(spark, "/root/testdata/sf0.001").collect()
    turns: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert len(got) == len(turns)
    for r in got:
        t = turns[r.conv_id]
        loss = "".join(x for a, x in t if a == "assistant")
        assert r.n_turns == len(t) and r.loss_chars == len(loss) and r.formatted_chars == sum(len(format_turn(*x)[0]) for x in t)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in t).encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    nodes, leaves = prefix_tree(spark.createDataFrame([], SHAPE))
    assert nodes.count() == 0 and read_back(nodes, leaves).count() == 0
