"""Secret scans over an incremental blob ledger.

Every historical version of a file is content-addressed (SHA-256). Only pairs of blob and rule version that the ledger
lacks are scanned, each blob once however many paths hold it, and findings are joined back to all paths. The ledger is a
folder of parts (blob, rules, findings), one appended part a scan; a later session opens the folder, and many parts are
compacted into one. DataFrame and SQL functions only.

A text's matches and the pieces between them alternate, so a match starts after all pieces up to it and all matches
before it: one running sum over the text's matches, whose work is in proportion to their number.

Defined results. Null text is the empty blob. Repeated rows each get the blob's findings, paths may be null. Other columns
are ignored. An empty table gives no row. A blob without findings stands in the ledger too, so it is not scanned again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WRITING, discard, join_hot, settings, store, work_dir

#: Kind, pattern, what the text must hold for a match to be possible, least length of the counted part.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}
RULES = hashlib.sha256("\n".join([ASSIGN, ACCESS, HEX, repr(LEAST)]).encode()).hexdigest()[:16]

FINDING = "array<struct<start:int,kind:int,end:int>>"
#: Parts of a ledger beyond which they are compacted into one.
PARTS = 16
#: The session setting that names the folder of a ledger to go on with; unset, a scan starts a ledger of its own.
LEDGER = "spark.fieldloom.ledger.dir"


def matches(text: Column) -> Column:
    """All matches of all kinds: array of (kind, k, before, length, counted), where before is the length of the piece
    between match k - 1 and match k, and counted the length that must reach the kind's least."""

    def numbered(kind: int):
        return lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), x.p.alias("before"), x.m.alias("length"), x.c.alias("counted"))

    # A run of hex digits is taken whole from the left, so shorter runs cannot hide part of a longer one.
    runs = HEX[:-1] + "{%d,}" % LEAST["hex"]
    parts = []
    for kind, (pattern, group) in enumerate(((ASSIGN, 2), (ACCESS, 0), (runs, 0))):
        found, counted = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
        zipped = F.arrays_zip(F.transform(found, F.length).alias("m"), F.transform(counted, F.length).alias("c"), F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length).alias("p"))
        some = F.contains(text, F.lit("AKIA")) if pattern == ACCESS else text.rlike(pattern)
        parts.append(F.when(some, F.transform(zipped, numbered(kind))))
    none = F.expr("cast(array() as array<struct<kind:int,k:int,before:int,length:int,counted:int>>)")
    return F.concat(*[F.coalesce(x, none) for x in parts])


def findings(blobs: DataFrame) -> DataFrame:
    """(blob, findings) of blobs (blob, text), for the blobs that have any; findings by start, then kind."""
    each = blobs.select("blob", F.explode(matches(F.col("text"))).alias("x")).select("blob", "x.*")
    upto = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("before") + F.col("length")).over(upto).cast("int"))
    least = F.get(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind"))
    found = placed.filter(F.col("counted") >= least)
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "kind", "end")
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("findings"))


class BlobLedger:
    """Parts of (blob, rules, findings) in a folder, named by generation. A part called whole-<g> holds all of generations before
    g, so what a broken-off compaction leaves of those is not read again; a whole part counts once its writing has ended."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """folder: of a ledger to go on with (it may be empty or missing); else a new one in the shared folder."""
        self.spark, self.folder = spark, folder or f"{work_dir(spark)}/ledger-{uuid.uuid4().hex}"
        paths = self._paths()
        self.generation = max((self._generation(p) for p in paths), default=0)
        whole = max((self._generation(p) for p in paths if "/whole-" in p), default=0)
        self.parts = [self._read(p) for p in paths if self._generation(p) >= whole]

    @staticmethod
    def _generation(path: str) -> int:
        return int(path.rsplit("/", 1)[-1].split("-")[1])

    def _paths(self) -> list[str]:
        """The parts whose writing has ended."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{{part,whole}}-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def _read(self, path: str) -> DataFrame:
        part = self.spark.read.schema(f"blob string, rules string, findings {FINDING}").parquet(path)
        part.stored_at = path
        return part

    def _append(self, rows: DataFrame, kind: str = "part") -> DataFrame:
        self.generation += 1
        path = f"{self.folder}/{kind}-{self.generation:09d}-{uuid.uuid4().hex}"
        with settings(self.spark, WRITING):
            rows.write.option("compression", "zstd").parquet(path)
        return self._read(path)

    def _known(self, rules: str) -> DataFrame | None:
        known = None
        for part in self.parts:
            part = part.filter(F.col("rules") == rules)
            known = part if known is None else known.unionByName(part)
        return known

    def compact(self) -> None:
        """All parts as one, without rows that stand twice (as after a scan that was broken off between two compactions)."""
        rows = self.parts[0]
        for part in self.parts[1:]:
            rows = rows.unionByName(part)
        whole = self._append(rows.dropDuplicates(["blob", "rules"]), "whole")
        discard(*self.parts)
        self.parts = [whole]
    def scan(self, versions: DataFrame, rules: str = RULES) -> DataFrame:
        """versions (path, text) with findings; blobs new to the ledger are scanned and appended."""
        text = F.coalesce(F.col("text"), F.lit(""))
        blob = F.sha2(text.cast("binary"), 256).alias("blob")
        rows = store(versions.select("path", blob), "paths")
        texts = versions.select(blob, text.alias("text"))
        known = self._known(rules)
        # Copies of a blob give way to one of them before and after the shuffle.
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text"))
        unseen = unseen if known is None else unseen.join(known.select("blob"), "blob", "left_anti")
        names = store(rows.groupBy("blob").agg(F.count("*").alias("n")), "blobs")
        new = store(findings(unseen), "new")
        asked = names.select("blob") if known is None else names.select("blob").join(known.select("blob"), "blob", "left_anti")
        self.parts.append(self._append(asked.join(new, "blob", "left").select("blob", F.lit(rules).alias("rules"), F.coalesce("findings", F.expr(f"cast(array() as {FINDING})")).alias("findings"))))
        if len(self.parts) > PARTS:
            self.compact()
        # Sessions side by side may both have scanned a blob.
        found = self._known(rules).filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
        found = store(found.join(names, "blob"), "found")
        discard(new, names)
        return join_hot(rows, found, ["blob"], F.monotonically_increasing_id(), "n", "left").withColumn("findings", F.coalesce("findings", F.expr(f"cast(array() as {FINDING})")))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = BlobLedger(spark, spark.conf.get(LEDGER, None)).scan(docs.select(F.col("doc_id").alias("path"), "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", F.get(names, f.kind), f.start.cast("string"), f.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda f: f.kind == k)).cast("long")
    out = found.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), spans.alias("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def _kind_sql(name: str, number: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  {name}_a AS (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS c, regexp_split_to_array(text, '{pattern}') AS p FROM d),
  {name}_b AS (SELECT r, unnest(m) AS m, unnest(c) AS c, unnest(p[:len(m)]) AS p, unnest(range(len(m))) AS k FROM {name}_a),
  {name} AS (SELECT r, {number} AS kind, m, c, CAST(sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM {name}_b WINDOW w AS (PARTITION BY r ORDER BY k) QUALIFY length(c) >= {least})"""


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  {_kind_sql("a", 0, ASSIGN, 2, 6)}, {_kind_sql("b", 1, ACCESS, 0, 20)}, {_kind_sql("c", 2, HEX, 0, 24)},
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
  g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
      string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, kind) AS spans FROM u GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
