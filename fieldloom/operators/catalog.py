"""The cube: its catalog, selection along one dimension, order and steps, levels and valid times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
KEY = ("param", "level", "valid", "area")


def same_param(a: Column, b: Column) -> Column:
    """Units do not matter."""
    return a["type"].eqNullSafe(b["type"]) & a["code"].eqNullSafe(b["code"])


def same_level(a: Column, b: Column) -> Column:
    return a["type"].eqNullSafe(b["type"]) & a["hpa1"].eqNullSafe(b["hpa1"]) & a["hpa2"].eqNullSafe(b["hpa2"])


def same_valid(a: Column, b: Column) -> Column:
    return a["type"].eqNullSafe(b["type"]) & a["start"].eqNullSafe(b["start"]) & a["finish"].eqNullSafe(b["finish"])


def get_grid(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (wanted_id, param, level, valid, area) with the surface_id of the first equal catalog row (smallest seq);
    null where there is none. Only the first row of each criteria can win, so the catalog is cut to those before joining."""
    key = lambda p: F.struct(c("param.type"), c("param.code"), c("level.type"), c("level.hpa1"), c("level.hpa2"), c("valid.type"), c("valid.start"), c("valid.finish"), c("area")).alias(p)
    first = catalog.select(key("k"), "seq", "surface_id").groupBy("k").agg(F.min(F.struct("seq", "surface_id")).alias("m"))
    asked = wanted.select("wanted_id", key("k"))
    return asked.join(first, asked.k.eqNullSafe(first.k), "left").select("wanted_id", c("m.surface_id").alias("surface_id"))


def along(catalog: DataFrame, chosen: DataFrame, dimension: str) -> DataFrame:
    """All values of one dimension among catalog rows that agree with chosen (one row a choice_id) in the others."""
    others = [k for k in KEY if k != dimension]
    same = {"param": same_param, "level": same_level, "valid": same_valid, "area": lambda a, b: a.eqNullSafe(b)}
    a, b = catalog.alias("a"), chosen.alias("b")
    on = None
    for k in others:
        on = same[k](c(f"a.{k}"), c(f"b.{k}")) if on is None else on & same[k](c(f"a.{k}"), c(f"b.{k}"))
    return a.join(b, on).select(c("b.choice_id"), c(f"a.{dimension}").alias(dimension)).distinct()


def ordered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with place, previous and next (structs of the order columns) inside each group; null at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    own = F.struct(*order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("previous", F.lag(own).over(w)).withColumn("next", F.lead(own).over(w))


def retimed(start: Column, finish: Column, share: Column) -> Column:
    """The time at a share of the range, on steps of five minutes from its start."""
    steps = F.floor(F.floor((F.unix_seconds(finish) - F.unix_seconds(start)) / 5) / 60)
    return F.timestamp_seconds(F.unix_seconds(start) + F.floor(share * steps) * 300)


def level_text(level: Column) -> Column:
    kind = level["type"]
    hpa = level["hpa1"].cast("string")
    return F.when(kind == "isobaric", F.concat(hpa, F.lit(" hPa"))).when(kind == "isobaric_range", F.concat(hpa, F.lit("-"), level["hpa2"].cast("string"), F.lit(" hPa"))).otherwise(F.replace(kind, F.lit("_"), F.lit(" ")))


def valid_text(valid: Column) -> Column:
    show = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    return F.when(valid["type"] == "range", F.concat(show(valid["start"]), F.lit(" to "), show(valid["finish"]))).otherwise(show(valid["start"]))


def param_text(param: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(param["type"], F.lit("generic")), F.concat(F.lit("code "), param["code"].cast("string"))), F.coalesce(F.concat(F.lit(" ("), param["unit"], F.lit(")")), F.lit("")))


def first_match(rows: DataFrame, by: list[str], condition: Column, order: str) -> DataFrame:
    """by and first: the least order among each group's rows that meet the condition."""
    return rows.filter(condition).groupBy(*by).agg(F.min(order).alias("first"))


def active(z: Column, front: int = 100) -> Column:
    """Whether a job is drawn in the layer that stands for every frame anew."""
    return z >= front


def attribute_of(attributes: DataFrame, name: str, value: str = "value") -> DataFrame:
    """(id, name's value) of long-form attributes (id, name, value); an id without it has no row."""
    return attributes.filter(c("name") == name).select("id", c(value).alias(name))


def with_attribute(shapes: DataFrame, attributes: DataFrame, name: str, value: str = "value") -> DataFrame:
    """shapes (id, ...) with one attribute, null where a shape lacks it."""
    return shapes.join(attribute_of(attributes, name, value), "id", "left")


def registered(current: DataFrame, added: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """current and added jobs without the removed ones, with unique: false where a key is there more than once."""
    jobs = current.unionByName(added).join(removed.select(key).distinct(), key, "left_anti")
    return jobs.withColumn("unique", F.count("*").over(Window.partitionBy(key)) == 1)
