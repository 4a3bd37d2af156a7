"""The corpus pipeline: its stages, each written as Parquet and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Defined results. Null or empty text: scored 0 by the classifier, so it goes there. A null or repeated doc_id names a row like any
other: no stage joins rows by it. Other columns, whatever their names, pass through every stage but the last. Empty table:
every stage gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.classifier import fit, keep_good
from fieldloom.llm.common import store
from fieldloom.llm.line_dedup import WORDED, line_dedup
from fieldloom.llm.mixing import mixed_documents
from fieldloom.llm.packing import pack
from fieldloom.llm.simhash import near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines, or parts of them, go; a document that they made up goes with them."""
    out = line_dedup(docs)
    n_removed = F.col(out.columns[-1])
    out = out.filter((n_removed == 0) | F.col("text").rlike(WORDED))
    return out.withColumn("n_chars", F.when(n_removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, one with the smallest doc_id (null comes last)."""
    out = near_duplicates(docs, docs.columns)
    return out.filter(F.col(out.columns[-1])).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows with their ids."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("source mixing", mixture),
    ("packing", packed),
]

#: Vectors, fingerprints and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
