"""Line dedup by content-defined chunks of lines.

Lines with words are hashed; a chunk ends after a line where the rolling hash over that line and the next is 0 modulo EVERY,
so boundaries depend on what stands around them alone and move with the text. A chunk that would be longer than MOST lines is
cut after every MOST. What is looked up are the pieces of two or more lines that a boundary fixes: a chunk, each of its
heads and tails, and the two lines on both sides of a boundary; and each line of LONG words or more. So a passage that begins or
ends inside a chunk is found to its first and last line. A line that a piece covers goes if the piece also starts at an
earlier place (by doc_id, hash of the text, line), after its bytes were compared: if pieces with one hash differ, the whole
run is repeated with a 256-bit hash. DataFrame functions only.

A repeated passage that holds a boundary goes as a whole. One of n lines holds none with a chance of 2 ** (1 - n), and even then
goes where both its places lie at an end of their chunks. One copy of each line stays: the earliest place of a piece's lines is
covered by no piece that stands earlier. passage_dedup looks up all pairs of neighbouring lines instead and misses none.

Defined results. Null text stays null; an empty text is one empty line and stays. Lines are split at \\n alone; blank lines
inside a piece go with it. Very long texts are handled whole, with at most 2 * MOST lines hashed for each line. Rows that share
doc_id and text are one document to the count and get equal results; a null doc_id comes before all others. Other columns
pass through; where one is named as a count of ours, ours has an underscore more. Empty table: no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import discard, fresh, join_hot, let, store

EVERY = 2
#: Lines of a chunk at most.
MOST = 8
#: What the previous line's hash is multiplied by in the rolling hash over two lines.
ROLL = 31
#: A line of so many words is a passage by itself.
LONG = 50
#: A line with words, and one with LONG words.
WORDED = r"[^\x20\x09-\x0D]"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def between(lines: Column, a: Column, b: Column) -> Column:
    """The text of lines a to b, both included, counted from 0."""
    return F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")


def chunk_ends(h: Column, every: int = EVERY, most: int = MOST) -> Column:
    """Where chunks end, as places in an array of line hashes."""
    ends = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))), lambda k: (k < F.size(h)) & ((k == F.size(h) - 1) | ((F.get(h, k) * ROLL + F.get(h, k + 1)) % every == 0)))

    def cut(e: Column) -> Column:
        def parts(end: Column, j: Column) -> Column:
            start = F.coalesce(F.get(e, j - 1) + 1, F.lit(0))
            return F.transform(F.sequence(F.lit(1), F.ceil((end - start + 1) / most).cast("int")), lambda x: F.least(start + x * most - 1, end))

        return F.flatten(F.transform(e, parts))

    return let(ends, cut)


def chunk_pieces(h: Column, every: int = EVERY, most: int = MOST) -> Column:
    """Array of (a, b): the pieces that the boundaries fix, as places in an array of line hashes."""
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def found(e: Column) -> Column:
        def own(end: Column, j: Column) -> Column:
            start = F.coalesce(F.get(e, j - 1) + 1, F.lit(0))
            tails = F.transform(F.filter(F.sequence(start, end), lambda k: k < end), lambda k: span(k, end))
            heads = F.transform(F.filter(F.sequence(start, end), lambda k: (k > start) & (k < end)), lambda k: span(start, k))
            across = F.filter(F.array(span(end, end + 1)), lambda x: x.b < F.size(h))
            return F.concat(tails, heads, across)

        return F.flatten(F.transform(e, own))

    return let(chunk_ends(h, every, most), found)


def worded_lines(lines: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORDED))


def long_lines(lines: Column, at: Column, long: int) -> Column:
    many = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{long - 1}}}{WORDED}"
    return F.transform(F.filter(at, lambda i: F.get(lines, i).rlike(many)), lambda i: F.struct(i.alias("a"), i.alias("b")))


def pieces(lines: Column, long: int = LONG, every: int = EVERY, most: int = MOST) -> Column:
    """Array of (a, b) of the pieces of content-defined chunks and of the long lines: lines a to b, both included, from 0."""
    short = lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")

    def found(at: Column) -> Column:
        chunked = let(F.transform(at, lambda i: short(F.get(lines, i))), lambda h: chunk_pieces(h, every, most))
        spans = F.transform(chunked, lambda p: F.struct(F.get(at, p.a).alias("a"), F.get(at, p.b).alias("b")))
        return F.concat(spans, long_lines(lines, at, long))

    return let(worded_lines(lines), found)


def windows(lines: Column, long: int = LONG) -> Column:
    """Array of (a, b) of all pairs of neighbouring lines with words and of the long lines."""

    def found(at: Column) -> Column:
        pairs = F.transform(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, k: F.struct(a.alias("a"), F.get(at, k + 1).alias("b")))
        return F.concat(pairs, long_lines(lines, at, long))

    return let(worded_lines(lines), found)


def without_repeats(docs: DataFrame, spans: Callable[[Column], Column], wide: bool = False) -> DataFrame:
    """docs without the lines of spans that start at an earlier place too, and n_lines, n_removed (lines) added. spans: what
    to look up in an array of lines, as an array of (a, b). wide: hash to 256 bits from the start."""
    digest = (lambda c: F.sha2(c.cast("binary"), 256)) if wide else F.xxhash64
    hashed = let(split_lines(F.col("text")), lambda c: F.transform(spans(c), lambda w: F.struct(w.a.alias("a"), w.b.alias("b"), digest(between(c, w.a, w.b)).alias("h"))))
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(hashed).alias("x"))
    each = store(each.select("doc_id", "th", "x.a", "x.b", "x.h"), "spans")
    place = F.struct("doc_id", "th", "a")
    repeated = each.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first <> last")
    repeated = store(repeated.select("h", F.col("first.doc_id").alias("fd"), F.col("first.th").alias("ft"), F.col("first.a").alias("fa"), "n"), "repeated")
    kept = F.col("doc_id").eqNullSafe(F.col("fd")) & F.col("th").eqNullSafe(F.col("ft")) & (F.col("a") == F.col("fa"))
    found = join_hot(each, repeated, ["h"], F.xxhash64("doc_id", "a"), "n")
    both, marks = marked(docs, found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b", "h", (~kept).alias("gone"))).alias("marks"), F.count("*").alias("n")))
    discard(each)
    lines = split_lines(F.col("text"))
    # The bytes of all spans with one hash are equal if the least and the greatest are.
    texts = both.filter(F.col(marks).isNotNull()).select(F.explode(let(lines, lambda c: F.transform(marks, lambda m: F.struct(m.h.alias("h"), between(c, m.a, m.b).alias("c"))))).alias("x"))
    unequal = texts.groupBy("x.h").agg(F.min("x.c").alias("a"), F.max("x.c").alias("b")).filter("a <> b")
    if unequal.limit(1).count():
        return without_repeats(docs, spans, wide=True)
    gone = F.flatten(F.transform(F.filter(marks, lambda m: m.gone), lambda m: F.sequence(m.a, m.b)))
    left = let(lines, lambda c: F.transform(F.array_except(F.sequence(F.lit(0), F.size(c) - 1), gone), lambda i: F.get(c, i)))
    some = F.coalesce(F.exists(marks, lambda m: m.gone), F.lit(False))
    n_lines, n_removed, rest = fresh([*docs.columns, marks], "n_lines", "n_removed", "left")
    out = both.withColumn(rest, F.when(some, left)).withColumn(n_lines, F.size(lines).cast("long"))
    out = out.withColumn(n_removed, F.when(some, F.col(n_lines) - F.size(rest)).otherwise(0).cast("long"))
    return out.withColumn("text", F.when(some, F.array_join(rest, "\n")).otherwise(F.col("text"))).select(*docs.columns, n_lines, n_removed)


def marked(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, str]:
    """docs with the column marks of marks (doc_id, th, marks, n: marks of all rows), null where there are none, and that
    column's name. Stored. Rows that share doc_id (null too) and text are dealt out where they are very many."""
    name, key, n = fresh(docs.columns, "marks", "key", "n")
    named = lambda th: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), th.cast("string")).alias(key)
    # Every row of a document has the same marks, so this is the number of its rows.
    one = marks.select(named(F.col("th")), F.col("marks").alias(name), (F.col("n") / F.size("marks")).cast("long").alias(n))
    many = docs.select("*", named(F.xxhash64("text")))
    both = join_hot(many, store(one, "marks"), [key], F.monotonically_increasing_id(), n, "left")
    return store(both.select(*docs.columns, name), "marked"), name


def line_dedup(docs: DataFrame, long: int = LONG, every: int = EVERY, most: int = MOST, wide: bool = False) -> DataFrame:
    """docs with text cleaned of repeated pieces of content-defined chunks, and n_lines, n_removed (lines) added."""
    return without_repeats(docs, lambda lines: pieces(lines, long, every, most), wide)


def passage_dedup(docs: DataFrame, long: int = LONG, wide: bool = False) -> DataFrame:
    """docs with text cleaned of all repeated passages, and n_lines, n_removed (lines) added."""
    return without_repeats(docs, lambda lines: windows(lines, long), wide)


def outcome(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9(spark, sf_dir: str) -> DataFrame:
    return outcome(line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op9_passages(spark, sf_dir: str) -> DataFrame:
    return outcome(passage_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Where rows share a doc_id, the twins order their texts otherwise than the operators do; else both agree.
OP9_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, text, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
  w AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  e AS (SELECT *, lead(i) OVER o AS after, coalesce((h * {ROLL} + lead(h) OVER o) % {EVERY} = 0, true) AS ends FROM w WINDOW o AS (PARTITION BY doc_id, text ORDER BY i)),
  k AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
  f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, text, no ORDER BY i) - 1) // {MOST} AS part FROM k),
  c AS (SELECT doc_id, text, lines, i, line, after, min(i) OVER u AS s, max(i) OVER u AS e FROM f WINDOW u AS (PARTITION BY doc_id, text, no, part)),
  p AS (SELECT doc_id, text, lines, i AS a, e AS b FROM c WHERE i < e UNION ALL SELECT doc_id, text, lines, s, i FROM c WHERE s < i AND i < e
    UNION ALL SELECT doc_id, text, lines, i, after FROM c WHERE i = e AND after IS NOT NULL
    UNION ALL SELECT doc_id, text, lines, i, i FROM c WHERE len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) >= {LONG}),
  r AS (SELECT doc_id, text, a, b, dense_rank() OVER (PARTITION BY array_to_string(lines[a:b], chr(10)) ORDER BY doc_id NULLS FIRST, text, a) > 1 AS gone FROM p),
  g AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS i FROM r WHERE gone),
  x AS (SELECT l.doc_id, l.text, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text IS NOT DISTINCT FROM g.text AND l.i = g.i),
  y AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM x GROUP BY ALL)
SELECT y.doc_id, n_lines, n_removed, kept_sha256 FROM y JOIN documents o ON y.doc_id IS NOT DISTINCT FROM o.doc_id AND y.text IS NOT DISTINCT FROM o.text
"""


OP9_PASSAGES_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, text, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
  w AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, text ORDER BY i) AS j FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  p AS (SELECT doc_id, text, i, j, array_to_string(lines[i:j], chr(10)) AS part FROM w WHERE j IS NOT NULL
    UNION ALL SELECT doc_id, text, i, i, line FROM w WHERE len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) >= {LONG}),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, text, i) > 1 AS gone FROM p),
  g AS (SELECT DISTINCT doc_id, text, unnest(range(i, j + 1)) AS i FROM r WHERE gone),
  k AS (SELECT l.doc_id, l.text, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text IS NOT DISTINCT FROM g.text AND l.i = g.i),
  a AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM k GROUP BY ALL)
SELECT a.doc_id, n_lines, n_removed, kept_sha256 FROM a JOIN documents o ON a.doc_id IS NOT DISTINCT FROM o.doc_id AND a.text IS NOT DISTINCT FROM o.text
"""
