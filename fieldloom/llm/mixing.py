"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has as many words as all documents. Targets follow the weights, stop at REPEATS times a source's size, and what
is above is shared again by weight. The mix is cut into blocks of equal word counts; sources get blocks by highest
quotients target / 1, / 3, / 5, ..., and so do the shards of each source by their sizes. A shard's words in seeded order of
documents form a ring of blocks, of which the first ones up to its quota are taken. DataFrame and SQL functions only.

The apportionment never lists all quotients: with V votes, Q seats and S parties, seats = round(votes / d) for a d
with V / d within S / 2 of Q, so all but about 3 S seats are certain and only the rest is contested.

Defined results. Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Repeated rows count as
often as they stand; rows that share a doc_id are ordered by size and by their text's hash, so reruns agree, and each
takes its own share. Other columns are ignored by mix and pass through mixed_documents. Empty table: no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh, join_hot, store, sums_before, words_of

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 17
#: Blocks of the whole mix at least, documents of a shard at most (about), and blocks of a source and of a shard at least (about):
#: rounding to whole blocks then moves no source by more than a hundredth, however large the corpus or small the source.
BLOCKS, SHARD, FINE = 1 << 20, 4096, 64


def order_key(doc_id: Column, seed: int) -> Column:
    """A seeded hash that other SQL engines have too."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def deal_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The same for the shard, with the text in it, so that rows without an id of their own are dealt out too."""
    return F.md5(F.concat(order_key(doc_id, seed), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, n words, docs, one row each) with at and target: the level L with min(REPEATS * n, L * weight) adding
    up to all words. L is the largest of what is left over the weights left, as sources stop in order of n / weight."""
    kinds = F.array(*[F.lit(w) for w in WEIGHTS])
    out = sums_before(sources, [F.col("source").asc_nulls_last()], {"at": F.lit(1).cast("long")}).withColumn("at", F.col("at") + 1)
    out = out.withColumn("w", F.get(kinds, (F.col("at") - 1) % len(WEIGHTS)).cast("long"))
    all_ = out.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    out = sums_before(out, [F.col("n") / F.col("w"), F.col("at")], {"used": REPEATS * F.col("n"), "gone": F.col("w")})
    level = out.agg(F.max((F.lit(all_.n or 0) - F.col("used")) / (F.lit(all_.w or 0) - F.col("gone")))).first()[0] or 0.0
    return out.withColumn("target", F.least((REPEATS * F.col("n")).cast("double"), F.lit(level) * F.col("w"))).drop("used", "gone", "w")


def apportion(parties: DataFrame, seats: Column, within: list[str], order: list[str]) -> DataFrame:
    """parties (votes: double, ...) with quota: Sainte-Lague seats in each group within, equal quotients by order. A group's
    figures are added up and joined to its parties; ranks come from one order of all contested quotients."""
    group, one = within or ["all"], F.lit(1).cast("long")
    rows = parties.filter("votes > 0").withColumn("seats", seats)
    rows = store(rows if within else rows.withColumn("all", F.lit(0)), "parties")
    spread = F.xxhash64(*order)

    def joined(left: DataFrame, figures: DataFrame) -> DataFrame:
        return join_hot(left, store(figures, "figures"), group, spread, "rows")

    out = joined(rows, rows.groupBy(*group).agg(F.sum("votes").alias("total"), F.count("*").alias("parties"), F.count("*").alias("rows")))
    share = F.col("votes") / F.col("total")
    out = out.withColumn("sure", F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("parties") / 2) - 0.5)).cast("long"))
    out = store(out.withColumn("most", (F.floor(share * (F.col("seats") + F.col("parties") / 2) + 0.5) + 1).cast("long")), "shares")
    ranked = out.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.greatest("most", F.col("sure") + 1))))
    keys = list(dict.fromkeys([*within, *order]))
    ranked = sums_before(ranked.select(*group, *[k for k in order if k not in group], "sure", "k", "votes"), [*map(F.col, group), (F.col("votes") / (2 * F.col("k") - 1)).desc(), *map(F.col, order), F.col("k")], {"place": one})
    open_ = out.groupBy(*group).agg((F.first("seats") - F.sum("sure")).alias("open"))
    firsts = ranked.groupBy(*group).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    won = joined(ranked, firsts.join(open_, group))
    return won.groupBy(*keys).agg((F.first("sure") + F.count_if(F.col("place") - F.col("first") < F.col("open"))).alias("quota"))


def mix(docs: DataFrame, seed: int = SEED, blocks: int = BLOCKS, shard: int = SHARD, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source). row: a column that tells rows
    apart (long); it is then in doc_id's place."""
    size, th = F.size(words_of(F.col("text"))).cast("long"), F.xxhash64("text")
    sizes = docs.select("doc_id", "source", size.alias("size"), order_key(F.col("doc_id"), seed).alias("key"), deal_key(F.col("doc_id"), F.col("text"), seed).alias("deal"), th.alias("th"), *([F.col(row).alias("row")] if row else []))
    sizes = store(sizes.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "sizes")
    sources = store(targets(sizes.groupBy("s", "source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))), "sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    least = sources.filter("target > 0").agg(F.min("target")).first()[0] or 0
    block = max(1, min(total // blocks, int(least // FINE)))
    quotas = apportion(sources.select("at", "s", F.col("target").alias("votes")), F.lit(total // block), [], ["at"])
    sources = sources.join(quotas, "at", "left").select("s", F.col("n").alias("source_size"), "target", "docs", F.coalesce("quota", F.lit(0)).alias("seats"), F.greatest(F.lit(1), F.least(F.floor(F.col("docs") / shard), F.floor(F.col("n") / (FINE * block)))).cast("long").alias("shards"))
    sources = store(sources, "quotas")
    at = F.conv(F.substring("deal", 1, 8), 16, 10).cast("long") % F.col("shards")
    placed = join_hot(sizes.drop("source"), sources, ["s"], F.monotonically_increasing_id(), "docs").withColumn("shard", at)
    cells = store(placed.groupBy("s", "shard").agg(F.sum("size").alias("words"), F.max("seats").alias("seats")), "cells")
    shares = apportion(cells.select("s", "shard", "seats", F.col("words").cast("double").alias("votes")), F.col("seats"), ["s"], ["s", "shard"])
    take = F.least(F.col("quota") * block, REPEATS * F.col("words"))
    cells = cells.join(shares, ["s", "shard"], "left").select("s", "shard", "words", F.coalesce(take, F.lit(0)).alias("take"))
    ring = Window.partitionBy("s", "shard").orderBy("key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(store(cells, "takes"), ["s", "shard"]).withColumn("start", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    words = F.greatest(F.col("words"), F.lit(1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("take") % words - F.col("start")))
    return out.select("row" if row else "doc_id", "size", "source_size", "target", (F.floor(F.col("take") / words) * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix has them: as many whole copies as taken holds, and the first words of one more. Text that is not
    whole is cut after its last taken word."""
    row, taken, size, own, copies = fresh(docs.columns, "row", "taken", "size", "own", "copies")
    docs_ = store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    shares = mix(docs_, seed, row=row).filter("taken > 0").select(F.col("row").alias(own), F.col("taken").alias(taken), F.col("size").alias(size))
    out = docs_.join(shares, docs_[row] == shares[own])
    full, rest = F.floor(F.col(taken) / F.col(size)).cast("int"), F.col(taken) % F.col(size)
    cut = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), rest.cast("int")), "")
    all_ = F.concat(F.array_repeat("text", full), F.when(rest > 0, F.array(cut)).otherwise(F.expr("array()").cast("array<string>")))
    return out.withColumn(copies, all_).withColumn("text", F.explode(copies)).select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SEATS = """
  {name}_a AS (SELECT *, sum(votes) OVER ({part}) AS total, count(*) OVER ({part}) AS parties FROM {source} WHERE votes > 0),
  {name}_b AS (SELECT *, CAST(greatest(0, floor(votes / total * (seats - parties / 2) - 0.5)) AS BIGINT) AS sure,
      CAST(floor(votes / total * (seats + parties / 2) + 0.5) + 1 AS BIGINT) AS most FROM {name}_a),
  {name}_c AS (SELECT *, seats - sum(sure) OVER ({part}) AS open FROM {name}_b),
  {name}_d AS (SELECT *, unnest(range(sure + 1, greatest(most, sure + 1) + 1)) AS k FROM {name}_c),
  {name}_e AS (SELECT *, row_number() OVER ({part} ORDER BY votes / (2 * k - 1) DESC, {order}, k) AS rank FROM {name}_d),
  {name} AS (SELECT {keys}, CAST(any_value(sure) + count(*) FILTER (WHERE rank <= open) AS BIGINT) AS quota FROM {name}_e GROUP BY ALL)"""

OP8_SQL = f"""
WITH sizes AS (SELECT doc_id, source, coalesce('s' || source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS key, md5(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') || md5(coalesce(text, ''))) AS deal,
      CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
  n AS (SELECT s, source, CAST(sum(size) AS BIGINT) AS n, count(*) AS docs FROM sizes GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM n),
  l AS (SELECT *, (sum(n) OVER () - coalesce(sum({REPEATS} * n) OVER (ORDER BY n / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lef FROM w),
  t AS (SELECT *, least(CAST({REPEATS} * n AS DOUBLE), max(lef) OVER () * w) AS target FROM l),
  b AS (SELECT CAST(sum(n) AS BIGINT) AS total, greatest(1, least(CAST(sum(n) AS BIGINT) // {BLOCKS}, CAST(floor((SELECT min(target) FROM t WHERE target > 0) / {FINE}) AS BIGINT))) AS block FROM n),
  p AS (SELECT pos, s, target AS votes, (SELECT total // block FROM b) AS seats FROM t),
  {_SEATS.format(name="q", source="p", part="", order="pos", keys="pos")},
  src AS (SELECT t.s, t.n AS source_size, t.target, coalesce(q.quota, 0) AS seats, greatest(1, least(t.docs // {SHARD}, t.n // ({FINE} * (SELECT block FROM b)))) AS shards FROM t LEFT JOIN q USING (pos)),
  placed AS (SELECT sizes.*, src.source_size, src.target, src.seats, CAST('0x' || substr(deal, 1, 8) AS BIGINT) % shards AS shard FROM sizes JOIN src USING (s)),
  cells AS (SELECT s, shard, CAST(sum(size) AS BIGINT) AS words, max(seats) AS seats FROM placed GROUP BY ALL),
  c AS (SELECT s, shard, seats, CAST(words AS DOUBLE) AS votes FROM cells),
  {_SEATS.format(name="r", source="c", part="PARTITION BY s", order="s, shard", keys="s, shard")},
  takes AS (SELECT cells.s, cells.shard, words, least(coalesce(r.quota, 0) * (SELECT block FROM b), {REPEATS} * words) AS take FROM cells LEFT JOIN r ON cells.s = r.s AND cells.shard = r.shard),
  f AS (SELECT placed.*, words, take, coalesce(sum(size) OVER (PARTITION BY placed.s, placed.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM placed JOIN takes ON placed.s = takes.s AND placed.shard = takes.shard)
SELECT doc_id, size, source_size, target, CAST(take // greatest(words, 1) * size + greatest(0, least(size, take % greatest(words, 1) - start)) AS BIGINT) AS taken FROM f
"""
