"""Every registered query runs at the smallest scale, and agrees with its DuckDB twin where it has one."""

import math
import os

import duckdb
import pytest

from fieldloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else repr(list(v)) if isinstance(v, list) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
    else:
        assert got


def test_look_ahead_covers_every_text(spark, tmp_path):
    texts = ["", "t", "tt", "ttt", "tth", "thth", "ttht", "at last the letter\nttt", "hht", "Tt\U0001f642t", "no match", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.rejected, r.required) for r in QUERIES["X-13_look_ahead"](spark, str(tmp_path)).collect()}
    last = lambda t, k: t[k] == "t" and t[k + 1 : k + 2] != "h"
    assert got == {i: (sum(last(t, k) for k in range(len(t))), t.count("th")) for i, t in enumerate(texts) if t is not None}


def test_wind_of_zeros(spark, tmp_path):
    """The sign of a zero decides between 180 and -180, as in the twin."""
    made = [(k, v, u) for k, (v, u) in enumerate((v, u) for v in (0.0, -0.0, 5.0, -5.0, 1e-9) for u in (0, 3))] + [(99, None, 3)]
    spark.createDataFrame(made, "event_id long, value double, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    df = QUERIES["X3_wind_from_components"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rel = con.sql(ORACLES["X3_wind_from_components"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())
