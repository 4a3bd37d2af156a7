"""Parse events of grammars given as data."""

import random
import time

from pyspark.sql import functions as F

from fieldloom.functions import events
from fieldloom.functions.events import compiled, parse_events, register, walked

WORD = ["capture", 1, ["re", "[a-z]+"]]


def found(rule, text):
    return list(walked(compiled(rule), text))


def test_order_and_failed_branches():
    pair = ["capture", 9, ["seq", WORD, ["re", "="], ["capture", 2, ["re", "[0-9]+"]]]]
    assert found(pair, "a=1 b= cc=22") == [(1, 0, 1), (2, 2, 3), (9, 0, 3), (1, 7, 9), (2, 10, 12), (9, 7, 12)]
    either = ["or", ["seq", WORD, ["re", "!"]], ["seq", ["capture", 3, ["re", "[a-z]+"]], ["re", "\\?"]]]
    assert found(either, "ab? cd! ef.") == [(3, 0, 2), (1, 4, 6)]
    assert found(["seq", ["star", ["seq", WORD, ["re", ","]]], ["not", WORD], ["re", ";"]], "a,b,;c,d") == [(1, 0, 1), (1, 2, 3)]
    assert found(["capture", 4, ["until", ["re", "="]]], "x=yz=w") == [(4, 0, 2), (4, 2, 5)]
    assert found(["capture", 5, ["seq", ["plus", ["re", "a"]], ["opt", ["re", "b"]]]], "aab a") == [(5, 0, 3), (5, 4, 5)]
    assert found(["star", WORD], "") == [] and found(["rest"], "abc") == []


def test_bounds():
    inner = ["seq", ["capture", 2, ["re", "[a-z]*"]], ["capture", 3, ["rest"]]]
    rule = ["capture", 1, ["bounded", ["re", "[0-9]{2}"], ["re", ":"], inner]]
    assert found(rule, "03:abcdef04:x99z") == [(2, 3, 6), (3, 6, 6), (1, 0, 6), (2, 12, 13), (3, 13, 16), (1, 9, 16)]
    assert found(rule, "09:abc") == []
    nested = ["bounded", ["re", "[0-9]{2}"], ["re", ""], ["star", rule]]
    assert found(nested, "1203:abc02:de03:abc")[:6] == [(2, 5, 8), (3, 8, 8), (1, 2, 8), (2, 11, 13), (3, 13, 13), (1, 8, 13)]


def test_table_function(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, None), (3, ""), (4, "9")], "k int, t string")
    got = parse_events(df, "t", WORD).orderBy("k", "seq").collect()
    assert [tuple(r) for r in got] == [(1, "ab cd", 0, 1, 0, 2), (1, "ab cd", 1, 1, 3, 5)]
    register(spark)
    df.createOrReplaceTempView("event_texts")
    sql = spark.sql("""SELECT k, count(*) AS n FROM event_texts, LATERAL parse_events(t, '["capture", 1, ["re", "[a-z]"]]') GROUP BY k""")
    assert sql.filter(F.col("n") == 4).count() == 1


def _random_rule(rng, depth):
    op = rng.choice(["re", "re", "seq", "or", "star", "plus", "opt", "not", "until", "capture", "capture", "bounded", "rest"] if depth else ["re"])
    inner = lambda: _random_rule(rng, depth - 1)
    if op == "re":
        return ["re", rng.choice(["a", "b+", "[ab]", "a*b?", "c|a", "ab|a", "", "(a)b", "[0-3]", "(?i:A)"])]
    if op in ("seq", "or"):
        return [op, *[inner() for _ in range(rng.randint(2, 3))]]
    if op == "capture":
        return ["capture", rng.randint(1, 9), inner()]
    if op == "bounded":
        return ["bounded", ["re", "[0-3]"], ["re", "b?"], inner()]
    return [op] if op == "rest" else [op, inner()]


def test_fused_rules_give_the_events_of_closures(monkeypatch):
    rng = random.Random(5)
    cases = [(_random_rule(rng, 4), ["".join(rng.choice("aabbc012") for _ in range(rng.randint(0, 12))) for _ in range(6)]) for _ in range(4000)]
    fused = [[found(rule, t) for t in texts] for rule, texts in cases]
    monkeypatch.setattr(events, "_one_match", lambda rule: None)
    assert fused == [[found(rule, t) for t in texts] for rule, texts in cases]


def test_words_are_matched_at_once(monkeypatch):
    """A loop of matches of one expression: less than half of what closures take for each word."""
    from fieldloom.plans.binary import LINES

    text = "some words of a line\n" * 20000

    def seconds():
        rule, taken = compiled(LINES), []
        for _ in range(3):
            start = time.perf_counter()
            got = walked(rule, text)
            taken.append(time.perf_counter() - start)
        return got, min(taken)

    fast = seconds()
    monkeypatch.setattr(events, "_one_match", lambda rule: None)
    slow = seconds()
    assert fast[0] == slow[0] and len(fast[0]) == 120000 and fast[1] < slow[1] / 2


def test_only_the_text_goes_through_python(spark):
    """Events are exploded from an array, so neither rows nor events are handed over one by one."""
    df = spark.createDataFrame([(1, "ab cd"), (1, "x"), (2, None)], "k int, t string")
    plan = parse_events(df, "t", WORD)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan
    empty = parse_events(df.filter("k > 5"), "t", WORD)
    assert empty.columns == ["k", "t", "seq", "id", "start", "finish"] and empty.count() == 0
