"""Queries on the catalog, on order and steps, on sets, regions and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import catalog as k
from fieldloom.operators import series
from fieldloom.operators import spatial as s
from fieldloom.operators.labels import place_labels
from fieldloom.plans.base import query, table
from fieldloom.streaming.framing import dash_offset, replay

c = F.col


def catalog(spark, d):
    """Events as a cube's catalog: type is the parameter, user the level, hour the valid time."""
    e = table(spark, d, "events")
    ts = F.date_trunc("hour", c("ts")).cast("timestamp")
    nil = F.lit(None)
    return e.select(
        c("event_id").alias("seq"), c("event_id").cast("string").alias("surface_id"),
        F.struct(c("event_type").alias("type"), nil.cast("int").alias("code"), F.when(c("event_id") % 2 == 0, "K").alias("unit")).alias("param"),
        F.struct(F.when(c("user_id") % 4 == 0, "surface").otherwise("isobaric").alias("type"), F.when(c("user_id") % 4 == 0, 4).otherwise(3).alias("ord"), F.when(c("user_id") % 4 != 0, c("user_id")).cast("int").alias("hpa1"), nil.cast("int").alias("hpa2")).alias("level"),
        F.struct(F.lit("instant").alias("type"), ts.alias("start"), nil.cast("timestamp").alias("finish")).alias("valid"),
        F.struct(*[F.lit(float(v)).alias(n) for v, n in ((60, "top"), (-60, "bottom"), (-180, "left"), (180, "right"))]).alias("area"), "value",
    )


CAT = """cat AS (SELECT event_id AS seq, event_id::VARCHAR AS surface_id, event_type AS param, CASE WHEN user_id % 4 = 0 THEN 4 ELSE 3 END AS ord, CASE WHEN user_id % 4 <> 0 THEN user_id::INT END AS hpa, date_trunc('hour', ts) AS valid, value FROM events)"""


@query("J-01_get_grid", f"WITH {CAT} SELECT a.seq AS wanted_id, (min(b.seq))::VARCHAR AS surface_id FROM cat a JOIN cat b ON a.param = b.param AND a.ord = b.ord AND a.hpa IS NOT DISTINCT FROM b.hpa AND a.valid = b.valid GROUP BY 1")
def get_grid(spark, d):
    cat = catalog(spark, d)
    return k.get_grid(cat, cat.withColumnRenamed("seq", "wanted_id").drop("surface_id"))


@query("F-06_all_but_one", f"WITH {CAT}, ch AS (SELECT DISTINCT ON (param) param, ord, hpa, valid FROM cat ORDER BY param, seq) SELECT ch.param AS choice_id, count(DISTINCT cat.valid) AS valids FROM cat JOIN ch ON cat.param = ch.param AND cat.ord = ch.ord AND cat.hpa IS NOT DISTINCT FROM ch.hpa GROUP BY 1")
def all_but_one(spark, d):
    cat = catalog(spark, d)
    first = cat.groupBy(c("param.type").alias("choice_id")).agg(F.min(F.struct("seq", "param", "level", "valid", "area")).alias("m")).select("choice_id", "m.param", "m.level", "m.valid", "m.area")
    return k.along(cat, first, "valid").groupBy("choice_id").agg(F.count("*").alias("valids"))


@query("W-01_level_order", f"WITH {CAT}, l AS (SELECT DISTINCT param, ord, hpa FROM cat) SELECT param, ord::INT AS ord, hpa, row_number() OVER (PARTITION BY param ORDER BY ord, hpa NULLS FIRST)::INT AS place FROM l")
def level_order(spark, d):
    levels = catalog(spark, d).select(c("param.type").alias("param"), c("level.ord").alias("ord"), c("level.hpa1").alias("hpa")).distinct()
    return k.ordered(levels, ["param"], ["ord", "hpa"]).select("param", "ord", "hpa", "place")


@query("W-02_level_step", f"WITH {CAT}, l AS (SELECT DISTINCT param, ord, hpa FROM cat) SELECT param, ord::INT AS ord, hpa, coalesce(lag(hpa) OVER w, -1)::INT AS below, coalesce(lead(hpa) OVER w, -1)::INT AS above FROM l WINDOW w AS (PARTITION BY param ORDER BY ord, hpa NULLS FIRST)")
def level_step(spark, d):
    levels = catalog(spark, d).select(c("param.type").alias("param"), c("level.ord").alias("ord"), c("level.hpa1").alias("hpa")).distinct()
    out = k.ordered(levels, ["param"], ["ord", "hpa"])
    return out.select("param", "ord", "hpa", F.coalesce("previous.hpa", F.lit(-1)).alias("below"), F.coalesce("next.hpa", F.lit(-1)).alias("above"))


@query("W-03_valid_step", f"WITH {CAT}, l AS (SELECT DISTINCT param, valid FROM cat) SELECT param, valid, lag(valid) OVER w AS before, lead(valid) OVER w AS after FROM l WINDOW w AS (PARTITION BY param ORDER BY valid)")
def valid_step(spark, d):
    valids = catalog(spark, d).select(c("param.type").alias("param"), c("valid.start").alias("valid")).distinct()
    out = k.ordered(valids, ["param"], ["valid"])
    ntz = lambda x: x.cast("timestamp_ntz")
    return out.select("param", ntz(c("valid")).alias("valid"), ntz(c("previous.valid")).alias("before"), ntz(c("next.valid")).alias("after"))


@query("W-04_retime", "SELECT event_type, user_id, min(ts)::TIMESTAMP_S::TIMESTAMP + to_seconds((floor(0.37::DOUBLE * ((epoch(max(ts)::TIMESTAMP_S)::BIGINT - epoch(min(ts)::TIMESTAMP_S)::BIGINT) // 5 // 60)) * 300)::BIGINT) AS at FROM (SELECT event_type, user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL")
def retime(spark, d):
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    sec = lambda x: F.date_trunc("second", x).cast("timestamp")
    return e.select("event_type", "user_id", k.retimed(sec(c("a")), sec(c("b")), F.lit(0.37)).cast("timestamp_ntz").alias("at"))


@query("A-09_valid_bounds", f"WITH {CAT} SELECT param, min(valid) AS first, max(valid) AS last FROM cat GROUP BY 1")
def valid_bounds(spark, d):
    ntz = lambda x: x.cast("timestamp_ntz")
    return catalog(spark, d).groupBy(c("param.type").alias("param")).agg(ntz(F.min("valid.start")).alias("first"), ntz(F.max("valid.start")).alias("last"))


@query("P-46_criteria_text", f"WITH {CAT} SELECT seq, param || CASE WHEN seq % 2 = 0 THEN ' (K)' ELSE '' END || ' ' || CASE WHEN ord = 4 THEN 'surface' ELSE hpa || ' hPa' END || ' ' || strftime(valid, '%Y-%m-%d %H:%M') AS shown FROM cat")
def criteria_text(spark, d):
    return catalog(spark, d).select("seq", F.concat_ws(" ", k.param_text(c("param")), k.level_text(c("level")), k.valid_text(c("valid"))).alias("shown"))


@query("W-05_draw_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)::INT AS place FROM orders")
def draw_order(spark, d):
    return k.ordered(table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "place")


@query("W-09_first_match", "SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def first_match(spark, d):
    return k.first_match(table(spark, d, "orders"), ["o_custkey"], c("o_orderstatus") == "O", "o_orderkey")


@query("F-07_layers", "SELECT l_linestatus, (l_linenumber * 20 >= 100) AS active, count(*) AS n FROM lineitem GROUP BY ALL")
def layers(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus", k.active(c("l_linenumber") * 20).alias("active")).agg(F.count("*").alias("n"))


@query("J-02_attributes", "SELECT doc_id, CASE WHEN name = 'quality' THEN v END AS quality, lang FROM (SELECT doc_id, 'quality' AS name, quality AS v FROM labels) RIGHT JOIN documents USING (doc_id)")
def attributes(spark, d):
    labels = table(spark, d, "labels")
    long = labels.select(c("doc_id").alias("id"), F.explode(F.array(F.struct(F.lit("quality").alias("name"), c("quality").alias("v")), F.struct(F.lit("toxic").alias("name"), c("toxic").alias("v")))).alias("a")).select("id", "a.name", c("a.v").alias("value"))
    shapes = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return k.with_attribute(shapes, long, "quality").select(c("id").alias("doc_id"), "quality", "lang")


@query("F-08_attribute_filter", "SELECT doc_id AS id, toxic FROM labels WHERE toxic IS NOT NULL")
def attribute_filter(spark, d):
    long = table(spark, d, "labels").select(c("doc_id").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array("quality", "toxic"))).alias("name", "value"))
    return k.attribute_of(long, "toxic").filter("toxic is not null")


@query("P-45_same_criteria", f"WITH {CAT} SELECT a.seq, count(*) AS same FROM cat a JOIN cat b ON a.param = b.param AND a.ord = b.ord AND a.hpa IS NOT DISTINCT FROM b.hpa AND a.valid = b.valid GROUP BY 1")
def same_criteria(spark, d):
    """How many catalog rows equal each in all four dimensions, whatever the units."""
    cat = catalog(spark, d)
    a, b = cat.select("seq", *k.KEY).alias("a"), cat.select(*k.KEY).alias("b")
    same = k.same_param(c("a.param"), c("b.param")) & k.same_level(c("a.level"), c("b.level")) & k.same_valid(c("a.valid"), c("b.valid")) & c("a.area").eqNullSafe(c("b.area"))
    return a.join(b, same).groupBy("a.seq").agg(F.count("*").alias("same"))


@query("U-02_registry", "WITH j AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0), l AS (SELECT * FROM j WHERE id % 5 <> 0) SELECT id, count(*) OVER (PARTITION BY id) = 1 AS unique FROM l")
def registry(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"))
    return k.registered(o.filter("id % 3 <> 0"), o.filter("id % 4 = 0"), o.filter("id % 5 = 0"))


def order_rects(spark, d):
    o = table(spark, d, "orders")
    x, y = (c("o_orderkey") * 7 % 1000).cast("double"), (c("o_custkey") * 13 % 500).cast("double")
    return o.select(c("o_orderkey").alias("id"), c("o_custkey").alias("view"), (c("o_orderkey") % 130).cast("int").alias("z"), x.alias("x1"), y.alias("y1"), (x + c("o_orderkey") % 9).alias("x2"), (y + c("o_custkey") % 5).alias("y2"))


RECTS = "r AS (SELECT o_orderkey AS id, o_custkey AS view, (o_orderkey % 130)::INT AS z, (o_orderkey * 7 % 1000)::DOUBLE AS x1, (o_custkey * 13 % 500)::DOUBLE AS y1, (o_orderkey * 7 % 1000 + o_orderkey % 9)::DOUBLE AS x2, (o_custkey * 13 % 500 + o_custkey % 5)::DOUBLE AS y2 FROM orders)"


@query("U-01_changed_set", "SELECT o_custkey, o_orderstatus, 'before' AS side FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT o_custkey, o_orderstatus, 'after' FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0)")
def changed_set(spark, d):
    o = table(spark, d, "orders")
    half = lambda n: o.filter(c("o_orderkey") % 2 == n).select("o_custkey", "o_orderstatus")
    return s.changed(half(0), half(1))


@query("U-03_invalid_region", f"WITH {RECTS} SELECT x1, y1, count(*) AS n FROM (SELECT * FROM r WHERE z >= 100 AND id % 2 = 1 UNION ALL SELECT * FROM r WHERE z >= 100 AND id % 2 = 0) GROUP BY ALL")
def region(spark, d):
    r = order_rects(spark, d)
    return s.invalid_region(r.filter("id % 2 = 0"), r.filter("id % 2 = 1")).groupBy("x1", "y1").agg(F.count("*").alias("n"))


@query("A-12_dirty_share", f"WITH {RECTS} SELECT round(sum((x2 - x1) * (y2 - y1)) / 500000, 6) AS share FROM r")
def dirty(spark, d):
    return s.dirty_share(order_rects(spark, d), 1000, 500).select(F.round("share", 6).alias("share"))


@query("A-11_sweep_sizes", f"WITH {RECTS} SELECT y1, count(*) AS n, round(avg(x2 - x1), 6) AS mean, max(x2 - x1) AS most FROM r GROUP BY 1")
def sweep(spark, d):
    return order_rects(spark, d).groupBy("y1").agg(F.count("*").alias("n"), F.round(F.avg(c("x2") - c("x1")), 6).alias("mean"), F.max(c("x2") - c("x1")).alias("most"))


@query("A-11_active_sizes", f"WITH {RECTS}, y AS (SELECT DISTINCT y1 AS y FROM r) SELECT y, count(*) AS active FROM y JOIN r ON r.y1 <= y AND y <= r.y2 GROUP BY 1")
def active_sizes(spark, d):
    """The size of a sweep line's active set at each y where a rectangle begins."""
    return s.sweep_sizes(order_rects(spark, d))


def _greedy(rows: str) -> str:
    """The sequential rule: one label of each view a step, against the list of those placed so far."""
    return f"""WITH RECURSIVE {RECTS}, o AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY z, id) AS k FROM ({rows})),
  g AS (SELECT view, 0::BIGINT AS k, NULL::BIGINT AS id, false AS free, []::STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS held FROM o WHERE k = 1
    UNION ALL SELECT view, k, id, free, CASE WHEN free THEN list_append(held, here) ELSE held END FROM (SELECT o.view, o.k, o.id, struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2) AS here, held,
      len(list_filter(held, lambda p: p.x1 <= o.x2 AND o.x1 <= p.x2 AND p.y1 <= o.y2 AND o.y1 <= p.y2)) = 0 AS free FROM g JOIN o ON o.view = g.view AND o.k = g.k + 1))
SELECT o.view, o.id, z, x1, y1, x2, y2, free FROM o JOIN g ON g.view = o.view AND g.k = o.k"""


@query("G-05_place_labels", _greedy("SELECT * FROM r"))
def labels(spark, d):
    return place_labels(order_rects(spark, d))


@query("G-05_crowded_views", _greedy("SELECT r.* REPLACE (o_orderstatus || o_orderpriority AS view) FROM r JOIN orders ON o_orderkey = id"))
def crowded(spark, d):
    """Few views with many labels each."""
    views = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("view"))
    return place_labels(order_rects(spark, d).drop("view").join(views, "id"), tile=8.0)


@query("G-09_dash_offset", "SELECT event_id, round((user_id * 37 + event_id) * 0.020 - 20 * floor((user_id * 37 + event_id) * 0.020 / 20), 6) AS dash FROM events")
def dash(spark, d):
    return table(spark, d, "events").select("event_id", F.round(dash_offset((c("user_id") * 37 + c("event_id")).cast("double")), 6).alias("dash"))


@query("T-05_replay", "SELECT user_id AS uid, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'purchase'")
def replayed(spark, d):
    e = table(spark, d, "events")
    return replay(e.select(c("user_id").alias("uid"), c("event_id").alias("seq"), F.when(c("event_type") == "purchase", "remove").otherwise(c("event_type")).alias("type"), "value"))


@query(
    "X4_asof_interpolation",
    """WITH s AS (SELECT event_type AS key, ts AS t, avg(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
  p AS (SELECT event_id AS probe_id, event_type AS key, ts + to_seconds(event_id * 7919 % 7200 - 3600) AS t FROM events),
  b AS (SELECT p.*, s.t AS before, s.value AS v0 FROM p ASOF LEFT JOIN s ON p.key = s.key AND p.t >= s.t),
  a AS (SELECT b.*, s.t AS after, s.value AS v1 FROM b ASOF LEFT JOIN s ON b.key = s.key AND b.t <= s.t)
SELECT probe_id, key, t AS "at", before, after, round(CASE WHEN before = after THEN v0 ELSE v0 + (v1 - v0) * (epoch_us(t) - epoch_us(before))::DOUBLE / (epoch_us(after) - epoch_us(before))::DOUBLE END, 6) AS value FROM a""",
)
def asof(spark, d):
    """Values of each type of events at arbitrary times, on the line between the samples before and after."""
    e = table(spark, d, "events")
    samples = e.filter("event_id % 3 <> 0").select(c("event_type").alias("key"), c("ts").alias("at"), "value")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c("event_id") * 7919 % 7200 - 3600).cast("decimal(18,6)"))
    probes = e.select(c("event_id").alias("probe_id"), c("event_type").alias("key"), (c("ts") + shift).alias("at"))
    return series.asof_interpolated(samples, probes).withColumn("value", F.round("value", 6))


@query(
    "T-05_state_as_of",
    """WITH e AS (SELECT user_id AS uid, event_id + 1 AS version, CASE WHEN event_type = 'purchase' THEN 'remove' ELSE event_type END AS type, value FROM events),
  v AS (SELECT DISTINCT (m * k // 7)::BIGINT AS as_of FROM (SELECT max(version) AS m FROM e), range(1, 8) r(k)),
  l AS (SELECT as_of, uid, version, type, value, row_number() OVER (PARTITION BY as_of, uid ORDER BY version DESC) AS n FROM v JOIN e ON version <= as_of)
SELECT as_of, uid, version, value FROM l WHERE n = 1 AND type <> 'remove'""",
)
def state_as_of(spark, d):
    """The state as of seven versions, each folded from the nearest of some snapshots."""
    e = table(spark, d, "events").select(c("user_id").alias("uid"), (c("event_id") + 1).alias("version"), F.when(c("event_type") == "purchase", "remove").otherwise(c("event_type")).alias("type"), "value")
    last = e.agg(F.max("version")).first()[0] or 0
    kept = series.EventStore(e, max(1, -(-last // 10)))
    return kept.states(sorted({last * k // 7 for k in range(1, 8)}))


@query("X2_time_interpolation", "WITH v AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL), n AS (SELECT *, lead(h) OVER w AS h2, lead(v) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY event_type ORDER BY h)) SELECT event_type, h + INTERVAL 30 MINUTE AS at, round(v + (v2 - v) * 1800 / (epoch(h2) - epoch(h)), 8) AS value FROM n WHERE h2 IS NOT NULL")
def interpolated(spark, d):
    """Extension: the value half an hour after each hour, on the line to the next hour that has one."""
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    out = k.ordered(e, ["event_type"], ["h", "v"]).filter("next is not null")
    span = F.unix_seconds(c("next.h").cast("timestamp")) - F.unix_seconds(c("h").cast("timestamp"))
    return out.select("event_type", (c("h").cast("timestamp") + F.expr("interval 30 minutes")).cast("timestamp_ntz").alias("at"), F.round(c("v") + (c("next.v") - c("v")) * 1800 / span, 8).alias("value"))


@query("X3_wind_from_components", "SELECT event_id, round(sqrt(value * value + user_id * user_id), 6) AS speed, round(degrees(atan2(-value, -user_id)), 4) AS direction FROM events")
def wind(spark, d):
    """Extension: speed and direction from two components. Spark's atan2 and round take -0.0 for 0.0; here a zero's sign counts."""
    u, v = c("value"), c("user_id")
    below = lambda x: x.cast("string") == "-0.0"
    angle = F.degrees(F.when(below(-u), -F.atan2(F.abs(u), -v)).otherwise(F.atan2(-u, -v)))
    return table(spark, d, "events").select("event_id", F.round(F.sqrt(u * u + v * v), 6).alias("speed"), F.when(below(angle), angle).otherwise(F.round(angle, 4)).alias("direction"))
