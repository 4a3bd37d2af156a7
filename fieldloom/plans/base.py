"""Registry of named queries and the inputs they derive from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under a name, with its DuckDB twin if SQL has one."""

    if name in QUERIES:
        raise ValueError(f"{name} is registered already")

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIDE = 64


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of 64 vectors each: (surface_id, nx, ny, buf). One group holds 64 vectors however many there are."""
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / SIDE).alias("surface_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    buf = F.flatten(F.transform("v", lambda r: r.embedding)).cast("array<double>")
    return rows.select("surface_id", F.lit(SIDE).alias("nx"), F.size("v").alias("ny"), buf.alias("buf"))


#: The same surfaces as cells, for the twins.
CELLS_SQL = f"""cells AS (SELECT vec_id // {SIDE} AS surface_id, y, i - 1 AS x, embedding[i]::DOUBLE AS value FROM
  (SELECT vec_id, embedding, row_number() OVER (PARTITION BY vec_id // {SIDE} ORDER BY vec_id) - 1 AS y, unnest(range(1, {SIDE + 1})) AS i FROM embeddings))"""
LEVELS_SQL = f"""{CELLS_SQL},
  bounds AS (SELECT surface_id, min(value) AS lo, max(value) AS hi FROM cells GROUP BY 1),
  levels AS (SELECT surface_id, 0 AS level_no, lo - (hi - lo) * 0.1::DOUBLE AS level, lo, hi FROM bounds
    UNION ALL SELECT surface_id, level_no + 1, level + (hi - lo) * 0.1::DOUBLE, lo, hi FROM levels WHERE level + (hi - lo) * 0.1::DOUBLE < hi + (hi - lo) * 0.1::DOUBLE)"""
