"""Nested parse events: a table function with the grammar as its argument.

A grammar is JSON: a list of an operator and its operands, choice ordered, repetition without going back.
["re", pattern], ["seq", ...], ["or", ...], ["star", r], ["plus", r], ["opt", r], ["not", r] (looks ahead), ["until", r] (up to
and with r), ["rest"] (to the end of what may be read), ["capture", id, r], and ["bounded", number, gap, r]: number's text says
how many characters after gap the rule r may read at most; what follows comes after those, however far r got.

Events come in order of completion, so inner captures precede the one around them; the events of a branch that fails
are taken back. Spans are half open, in characters from the text's beginning.

Rules without captures under a repetition become one regular expression of atomic groups, so that re does what a tree of
closures would do a character or a word at a time; a repetition of such a rule is a loop of matches. What is left (bounds, and
captures that repeat within captures) stays a closure.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf, udtf

#: (text, at, end, events) to the place after the match, or -1; then events are as before.
Matcher = Callable[[str, int, int, list], int]


def _fused(rule: list, groups: list[int] | None, done: list[tuple[int, int]] | None) -> str | None:
    """rule as a regular expression that never goes back into what has matched, or None if it has none: bounds, patterns with
    groups or flags of their own, and captures that repeat. groups takes the ids of its groups, done (id, group) in order
    of completion; without them captures are dropped."""
    op, *args = rule
    if op == "re":
        own = re.compile(args[0])
        return None if own.groups or own.flags != re.UNICODE else f"(?>{args[0]})"
    if op == "rest":
        return r"[\s\S]*+"
    if op == "capture":
        if groups is None:
            return _fused(args[1], None, None)
        groups.append(args[0])
        group, inner = len(groups), _fused(args[1], groups, done)
        done.append((args[0], group))
        return inner and f"({inner})"
    if op == "bounded" or op in ("star", "plus", "until") and groups is not None and _captures(rule):
        return None
    if op == "not":
        inner = _fused(args[0], None, None)
        return inner and f"(?!{inner})"
    parts = [_fused(a, groups, done) for a in args]
    if None in parts:
        return None
    if op == "seq":
        return f"(?>{''.join(parts)})"
    if op == "or":
        return f"(?>{'|'.join(parts)})"
    return {"star": "(?:{0})*+", "plus": "(?:{0})++", "opt": "(?:{0})?+", "until": r"(?>(?:(?!{0})[\s\S])*+{0})"}[op].format(parts[0])


def _captures(rule: list) -> bool:
    return rule[0] == "capture" or any(_captures(a) for a in rule[1:] if isinstance(a, list))


def _one_match(rule: list) -> tuple[Callable, list[tuple[int, int]]] | None:
    """The match function of the whole rule's regular expression, and (id, group) in order of completion."""
    done: list[tuple[int, int]] = []
    text = _fused(rule, [], done)
    return None if text is None else (re.compile(text).match, done)


def compiled(rule: list) -> Matcher:
    op, *args = rule
    if op == "rest":
        return lambda t, at, end, events: end
    if whole := _one_match(rule):
        match, done = whole

        def fused(t, at, end, events):
            m = match(t, at, end)
            if m is None:
                return -1
            for id_, group in done:
                if (start := m.start(group)) >= 0:
                    events.append((id_, start, m.end(group)))
            return m.end()

        return fused
    if op == "re":
        match = re.compile(args[0]).match

        def leaf(t, at, end, events):
            m = match(t, at, end)
            return m.end() if m else -1

        return leaf
    if op in ("star", "plus") and (whole := _one_match(args[0])):
        match, done = whole

        def repeated(t, at, end, events):
            m = match(t, at, end)
            if m is None:
                return at if op == "star" else -1
            while m:
                for id_, group in done:
                    start, stop = m.span(group)
                    if start >= 0:
                        events.append((id_, start, stop))
                if (stop := m.end()) <= at:
                    break
                at = stop
                m = match(t, at, end)
            return at

        return repeated
    if op == "capture":
        id_, inner = args[0], compiled(args[1])

        def capture(t, at, end, events):
            stop = inner(t, at, end, events)
            if stop >= 0:
                events.append((id_, at, stop))
            return stop

        return capture
    parts = [compiled(a) for a in args]

    def seq(t, at, end, events):
        mark = len(events)
        for p in parts:
            at = p(t, at, end, events)
            if at < 0:
                del events[mark:]
                return -1
        return at

    def choice(t, at, end, events):
        return next((stop for p in parts if (stop := p(t, at, end, events)) >= 0), -1)

    def star(t, at, end, events):
        while (stop := parts[0](t, at, end, events)) > at:
            at = stop
        return at

    def plus(t, at, end, events):
        first = parts[0](t, at, end, events)
        return first if first <= at else star(t, first, end, events)

    def opt(t, at, end, events):
        return max(at, parts[0](t, at, end, events))

    def reject(t, at, end, events):
        return -1 if parts[0](t, at, end, []) >= 0 else at

    def until(t, at, end, events):
        return next((stop for k in range(at, end + 1) if (stop := parts[0](t, k, end, events)) >= 0), -1)

    def bounded(t, at, end, events):
        number, gap, inner = parts
        mark, stop = len(events), number(t, at, end, events)
        start = gap(t, stop, end, events) if stop >= 0 else -1
        last = start + int(t[at:stop]) if start >= 0 else -1
        if start >= 0 and last <= end and inner(t, start, last, events) >= 0:
            return last
        del events[mark:]
        return -1

    return {"seq": seq, "or": choice, "star": star, "plus": plus, "opt": opt, "not": reject, "until": until, "bounded": bounded}[op]


def walked(rule: Matcher, text: str) -> list[tuple[int, int, int]]:
    """The events of all matches, from left to right; where the rule fails the next character is tried."""
    at, end = 0, len(text)
    events: list = []
    while at <= end:
        stop = rule(text, at, end, events)
        at = stop if stop > at else at + 1
    return events


@udtf(returnType="seq int, id int, start int, finish int", useArrow=True)
class ParseEvents:
    def __init__(self):
        self.rules: dict[str, Matcher] = {}

    def eval(self, text: str, grammar: str):
        if text is None or grammar is None:
            return
        if grammar not in self.rules:
            self.rules[grammar] = compiled(json.loads(grammar))
        for seq, event in enumerate(walked(self.rules[grammar], text)):
            yield seq, *event


def register(spark: SparkSession, name: str = "parse_events") -> None:
    """The table function for SQL: FROM t, LATERAL parse_events(t.text, '["re", "a"]')."""
    spark.udtf.register(name, ParseEvents)


def parse_events(rows: DataFrame, text: str, grammar: list) -> DataFrame:
    """rows with seq, id, start and finish of each event of grammar in column text. Null texts have none. A text's events
    come back as one array, so that no event is a row in Python and the text is not repeated for each."""
    event = pa.struct([(k, pa.int32()) for k in ("id", "start", "finish")])

    @arrow_udf("array<struct<id:int,start:int,finish:int>>", ArrowUDFType.SCALAR_ITER)
    def found(texts):
        rule = compiled(grammar)
        for column in texts:
            sizes, flat = [0], []
            for t in column:
                events = walked(rule, t.as_py()) if t.is_valid else []
                sizes.append(len(events))
                flat.append(np.fromiter(chain.from_iterable(events), np.int32, 3 * len(events)))
            parts = np.concatenate(flat or [np.empty(0, np.int32)]).reshape(-1, 3)
            fields = [pa.array(np.ascontiguousarray(parts[:, k])) for k in range(3)]
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(event)))

    return rows.select("*", F.posexplode(found(F.col(text))).alias("seq", "e")).select(*[F.col(f"`{k}`") for k in rows.columns], "seq", "e.*")
