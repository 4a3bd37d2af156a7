"""What the training-data operators share: stored intermediates, joins that survive hot keys, link components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
SPACE = "[\\x20\\x09-\\x0D]+"
#: A key is hot if it holds more than one of so many rows, so there are at most this many hot keys.
SHARES = 1000
#: Fewer rows than this are never dealt out.
LEAST = 64
#: While a table is written: shuffle files go as soon as the write has ended, for no later step reads them.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside; the caller's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a folder of our own if driver and executors are one
    process (tests); elsewhere executors would write to disks that nobody else sees, so that is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fieldloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """names, with underscores after those that clash with columns (or each other) in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here and a lost executor costs one task."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_parts(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches in parts of a few rows each, so that what a Python worker holds does not follow the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, weight: str, how: str = "inner", merge: bool = False, rows: int | None = None) -> DataFrame:
    """Joins many, where a key may have any number of rows, with one, where it has at most one row.

    weight: one's column (dropped) with about the number of many's rows for the key. Keys with more than 1 / SHARES of
    the rows (at most SHARES keys, so they may be broadcast) are dealt over as many salts as they have such shares, or
    shares of LEAST rows where that is more; one's rows for them are repeated once a salt. one should be a stored table.
    Null keys match nothing. merge: the plan is the same merge join at every size, whatever one's size turns out to be.
    rows: the sum of weights, where it is known.
    """
    rows = rows or one.agg(F.sum(weight)).first()[0] or 1
    share = F.lit(max(rows / SHARES, float(LEAST)))
    salt, salted = fresh([*many.columns, *one.columns], "salt", "salts")
    salts = F.ceil(F.col(weight) / share).cast("int")
    hot = F.broadcast(one.filter(F.col(weight) > share).select(*keys, salts.alias(salted)))
    left = many.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(spread), F.col(salted)).cast("int"), F.lit(0)))
    right = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > share, salts - 1).otherwise(0))))
    right = right.drop(weight).hint("merge") if merge else right.drop(weight)
    return left.drop(salted).join(right, [*keys, salt], how).drop(salt)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for each row of nodes (node: long, distinct).

    Each round takes the smallest label among a node's neighbours and then the label's own label, so the number of
    rounds grows with the logarithm of a component's diameter on usual graphs. Labels live in stored tables. A node with
    very many links and a label of very many nodes are dealt over salts by their counts; sums have map-side partial results.
    """
    links = links.filter("a <> b")
    links = store(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = store(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c"), F.count("*").alias("n")), "labels")
    size = labels.agg(F.sum("n"), F.count("*")).first()
    while size[0]:
        sent = join_hot(links, labels, ["a"], F.col("b"), "n", rows=size[0]).groupBy("b").agg(F.min("c").alias("m"))
        near = store(labels.join(sent, labels.a == sent.b, "left").select("a", "n", F.col("c").alias("old"), F.least("c", "m").alias("c")), "near")
        heads = near.groupBy("c").agg(F.count("*").alias("w"))
        up = near.select(F.col("a").alias("u"), F.col("c").alias("top"))
        heads = store(heads.join(up, heads.c == up.u, "left").select("c", "w", F.least("c", "top").alias("top")), "heads")
        jumped = store(join_hot(near, heads, ["c"], F.col("a"), "w", rows=size[1]).select("a", "n", "old", F.col("top").alias("c")), "labels")
        moved = jumped.filter("old <> c").limit(1).count()
        discard(labels, near, heads)
        labels = jumped.drop("old")
        labels.stored_at = jumped.stored_at
        if not moved:
            break
    discard(links)
    return nodes.join(labels, nodes.node == labels.a, "left").select("node", F.coalesce("c", "node").alias("component"))


def named_components(points: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """points (node: long, distinct, and more) with first: the least name (nulls last) among the points that links reach."""
    found = store(points.join(components(points.select("node"), links), "node"), "classes")
    whole = store(found.groupBy("component").agg(F.min(F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("name"))).alias("first"), F.count("*").alias("rows")), "wholes")
    out = join_hot(found, whole.select("component", F.col("first.name").alias("first"), "rows"), ["component"], F.col("node"), "rows")
    return out.drop("component")


def sums_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with each of sums added up over all rows before it in the order (0 for the first; the order tells rows apart).
    Rows are dealt out by ranges of the order; only the ranges' own sums, one row each, meet in one task. Stored."""
    own = fresh(df.columns, *[f"own_{k}" for k in sums])
    part = fresh([*df.columns, *own], "part")[0]
    rows = df.select("*", *[v.alias(k) for k, v in zip(own, sums.values(), strict=True)])
    dealt = store(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "dealt")
    upto = Window.unboundedPreceding, -1
    over = lambda w: [F.coalesce(F.sum(k).over(w.rowsBetween(*upto)), F.lit(0)) for k in own]
    bases = [f"{k}_" for k in own]
    starts = dealt.groupBy(part).agg(*[F.sum(k).alias(k) for k in own]).select(part, *[x.alias(k) for k, x in zip(bases, over(Window.orderBy(part)), strict=True)])
    inside = dealt.select("*", *[x.alias(k) for k, x in zip(sums, over(Window.partitionBy(part).orderBy(*order)), strict=True)])
    out = inside.join(F.broadcast(starts), part)
    return store(out.select(*df.columns, *[(F.col(k) + F.col(b)).alias(k) for k, b in zip(sums, bases, strict=True)]), "sums")
