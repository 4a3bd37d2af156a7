"""Parsing-expression combinators compiled to Java regular expressions, so parsing stays inside Spark's own functions.

Choice is ordered, repetition is possessive and nothing that succeeded is tried again, which atomic groups and possessive
quantifiers express. Bytes are seen as ISO 8859-1 text. Captures are groups numbered in order of opening; ids() tells
which id each has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A compiled rule: its regular expression and the ids of its captures."""

    regex: str
    captures: tuple[int, ...] = field(default=())

    def ids(self) -> tuple[int, ...]:
        return self.captures

    def search(self, text: Column, capture: int) -> Column:
        """The first match's text of a capture id (null if there is none)."""
        group = self.captures.index(capture) + 1
        return F.when(text.rlike(self.regex), F.regexp_extract(text, self.regex, group))

    def all(self, text: Column, capture: int | None = None) -> Column:
        """The texts of all matches, or of a capture in all matches."""
        return F.regexp_extract_all(text, F.lit(self.regex), F.lit(0 if capture is None else self.captures.index(capture) + 1))

    def matches(self, text: Column) -> Column:
        """Whether the whole text is derived from the rule."""
        return text.rlike(rf"\A(?:{self.regex})\z")

    def spans(self, text: Column) -> Column:
        """array<struct<start, finish>> of all matches, half open, from the pieces between them."""
        rows = F.arrays_zip(F.transform(F.split(text, self.regex, -1), F.length).alias("gap"), F.transform(self.all(text), F.length).alias("size"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,finish:int>>").alias("out"))

        def placed(a: Column, x: Column) -> Column:
            here = a.at + x.gap
            return F.struct((here + x["size"]).alias("at"), F.concat(a.out, F.array(F.struct(here.alias("start"), (here + x["size"]).alias("finish")))).alias("out"))

        return F.when(text.isNotNull(), F.aggregate(F.filter(rows, lambda x: x["size"].isNotNull()), start, placed, lambda a: a.out))


def latin1(data: Column) -> Column:
    """Bytes as text, one character a byte."""
    return F.decode(data, "ISO-8859-1")


def _quote(c: str) -> str:
    return c if c.isalnum() and c.isascii() else rf"\x{{{ord(c):x}}}"


def _joined(rules) -> tuple[int, ...]:
    return tuple(i for r in rules for i in r.captures)


_SINGLE = re.compile(r"\[[^\]]*\]|\\x\{[0-9a-f]+\}|[0-9A-Za-z]")


def _atom(rule: Rule) -> str:
    """A rule as one unit; a single character needs no group."""
    return rule.regex if _SINGLE.fullmatch(rule.regex) else f"(?:{rule.regex})"


end = Rule(r"\z")
nothing = Rule("(?:)")
any_char = Rule(r"[\s\S]")


def char(c: str) -> Rule:
    return Rule(_quote(c))


def between(a: str, b: str) -> Rule:
    return Rule(f"[{_quote(a)}-{_quote(b)}]")


def one_of(chars: str) -> Rule:
    return Rule("[" + "".join(map(_quote, chars)) + "]")


def literal(text: str) -> Rule:
    return Rule("".join(map(_quote, text)))


def choice(*rules: Rule) -> Rule:
    return Rule("(?>" + "|".join(map(_atom, rules)) + ")", _joined(rules))


def seq(*rules: Rule) -> Rule:
    return Rule("(?>" + "".join(map(_atom, rules)) + ")", _joined(rules))


def plus(rule: Rule) -> Rule:
    return Rule(_atom(rule) + "++", rule.captures)


def star(rule: Rule) -> Rule:
    return Rule(_atom(rule) + "*+", rule.captures)


def opt(rule: Rule) -> Rule:
    return Rule(_atom(rule) + "?+", rule.captures)


def repeat(rule: Rule, n: int, most: int | None = None) -> Rule:
    return Rule(f"{_atom(rule)}{{{n}{'' if most is None else f',{most}'}}}+", rule.captures)


def require(rule: Rule) -> Rule:
    return Rule(f"(?={rule.regex})", rule.captures)


def reject(rule: Rule) -> Rule:
    return Rule(f"(?!{rule.regex})", rule.captures)


def capture(id_: int, rule: Rule) -> Rule:
    return Rule(f"({rule.regex})", (id_, *rule.captures))


def advance_if_not(rule: Rule) -> Rule:
    """One or more characters until the rule would match."""
    return Rule(rf"(?:(?!{rule.regex})[\s\S])++")


def advance_until(rule: Rule) -> Rule:
    return Rule(advance_if_not(rule).regex + _atom(rule), rule.captures)


def event_text(text: Column, most: int = 60) -> Column:
    """A capture for display: beyond most characters its two halves with dots between, white space as blanks, others as stars."""
    half = most // 2
    short = F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit(" ... "), F.right(text, F.lit(half)))).otherwise(text)
    return F.regexp_replace(F.regexp_replace(short, r"\s", " "), r"[^\x20-\x7e]", "*")


digit, upper, alpha, alnum = between("0", "9"), between("A", "Z"), Rule("[A-Za-z]"), Rule("[0-9A-Za-z]")


def walk(rule: Rule, text: str) -> Iterator[tuple[int, int, int]]:
    """(id, start, finish) events of the first match, for tests and small inputs on the driver."""
    import regex

    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda x: rf"\U{int(x[1], 16):08x}", rule.regex.replace(r"\z", r"\Z"))
    m = regex.search(pattern, text)
    if m:
        for k, id_ in enumerate(rule.captures, 1):
            if m.start(k) >= 0:
                yield id_, m.start(k), m.end(k)
