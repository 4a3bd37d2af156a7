"""Quality rules by host: rule failures are added up by host, rates are shrunk by a beta prior fitted to all hosts, and the
host verdicts are joined back to the documents. DataFrame and SQL functions only.

Base rules look at one text. A host (source) whose shrunk failure rate is above LIMIT takes its documents with it. A host
that is worse than the prior's mean with a chance of three in four or more is watched: its documents must also pass a
stricter rule, at most MOST_SYMBOLS symbols in a hundred characters of words. The prior is fitted by the moments of the
hosts' rates, in one row.

Defined results. Null or empty text: no words, which fails the base rule. Null host: a host of its own. Repeated rows count as
often as they stand. Other columns are ignored. Empty table: no row. A repeated 8-word window is one whose words are
equal to another's (128 bits of hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE, join_hot, let, store, words_of

SPAN, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: The shrunk failure rate above which a host fails: most of its documents are bad.
LIMIT = 0.5
#: So many standard deviations of a host's rate above the prior's mean it is watched: a chance of three in four.
WATCH = 0.6745
#: Symbols in a hundred characters of words that a document of a watched host may have.
MOST_SYMBOLS = 5
SYMBOLS, WORDED = "[#*$%&|<>]+", r"[^\x20\x09-\x0D]"


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """How many words lie in span-word windows that stand twice or more in the text."""

    def covered(h: Column) -> Column:
        place = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, i, j: F.coalesce(F.get(p, i).h == F.get(p, j).h, F.lit(False))
        twice = lambda p: F.transform(F.filter(F.transform(p, lambda x, k: F.when(same(p, k, k - 1) | same(p, k, k + 1), x.i)), lambda x: x.isNotNull()), lambda x: x)
        # Sorted starts: each adds what the one before it does not cover.
        gaps = lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(span), x - F.coalesce(F.get(s, k - 1), F.lit(-span)))), F.lit(0), lambda a, x: a + x)
        return let(place, lambda p: let(F.array_sort(twice(p)), gaps))

    def within(w: Column) -> Column:
        n = F.size(w) - span + 1
        # Each word is hashed once; windows are hashed from their words' hashes, and once more where two seem equal.
        once = F.transform(w, lambda x: F.xxhash64(x))
        window = lambda h, i: F.slice(h, i, span)
        short = lambda h: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(window(h, i)))
        long = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(window(w, i)).alias("a"), F.xxhash64(F.lit(7), window(w, i)).alias("b")))
        some = let(let(once, short), lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when((n > 1) & some, covered(long)).otherwise(0)

    return within(words)


def features(docs: DataFrame, host: Column) -> DataFrame:
    """The base counts of each document, one row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORDED))
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    out = docs.select(
        "doc_id", host.alias("host"), counts.alias("c"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "host", "c.*", "word_chars", "n_symbols", "n_dup_lines")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(base: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(h, n, failed, rate, watched, host_failed): rate = (failed + a) / (n + a + b), where a and b fit the hosts' rates by
    moments: mean m and variance v give strength m (1 - m) / v - 1, kept between 1 and 1000 (no spread: 1000). A host's
    rate is spread as the beta distribution that the prior and its own documents give."""
    hosts = store(base.groupBy("h").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed")), "hosts")
    share = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(share).alias("m"), F.avg(share * share).alias("m2"))
    spread = F.col("m2") - F.col("m") * F.col("m")
    strength = F.when(spread > 1e-9, F.col("m") * (1 - F.col("m")) / spread - 1).otherwise(1000.0)
    prior = prior.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), strength)).alias("strength"))
    out = hosts.withColumn("_one", F.lit(1)).join(F.broadcast(prior.withColumn("_one", F.lit(1))), "_one").drop("_one")
    rate = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    out = out.withColumn("rate", rate)
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    watched = F.col("rate") - WATCH * spread > F.col("m")
    return out.select("h", "n", "failed", "rate", watched.alias("watched"), (F.col("rate") > limit).alias("host_failed"))


def quality_rules(docs: DataFrame, host: Column | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, watched, host_rate, kept)."""
    base = features(docs, F.col("source") if host is None else host)
    base = store(base.withColumn("h", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit(""))), "features")
    hosts = store(host_verdicts(base, limit).select("h", "n", "rate", "watched", "host_failed"), "verdicts")
    out = join_hot(base, hosts, ["h"], F.monotonically_increasing_id(), "n")
    strict = 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")
    kept = ~F.col("base_failed") & ~F.col("host_failed") & ~(F.col("watched") & strict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "watched", F.col("rate").alias("host_rate"), kept.alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.drop("host_failed", "watched", "host_rate")


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
  p AS (SELECT r, unnest(range(1, len(words) - {SPAN - 2})) AS i, words FROM w WHERE len(words) >= {SPAN}),
  g AS (SELECT r, i, array_to_string(words[i:i + {SPAN - 1}], ' ') AS g FROM p),
  t AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
  s AS (SELECT r, least({SPAN}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -100)) AS add FROM t WHERE n > 1),
  c AS (SELECT r, CAST(sum(add) AS BIGINT) AS n_repeat_words FROM s GROUP BY r),
  b AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
  f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM f GROUP BY ALL),
  m AS (SELECT avg(failed / n) AS m, avg(failed / n * (failed / n)) AS m2 FROM h),
  a AS (SELECT m, greatest(1.0, least(1000.0, CASE WHEN m2 - m * m > 1e-9 THEN m * (1 - m) / (m2 - m * m) - 1 ELSE 1000.0 END)) AS strength FROM m),
  u AS (SELECT source, n, m, strength, (failed + m * strength) / (n + strength) AS rate FROM h, a),
  v AS (SELECT source, rate > {LIMIT} AS host_failed, rate - {WATCH}::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1)) > m AS watched FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AND NOT (watched AND 100 * n_symbols > {MOST_SYMBOLS} * word_chars) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
