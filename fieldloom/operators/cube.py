"""A cube of planes as a lazy catalog: criteria, formulas over parameters, levels completed in between, and blurred surfaces.

A cube wraps rows (param, keys ..., value); nothing is read until a plane is asked for. A formula names parameters and
compiles to columns over a join of just the planes that it needs, each filtered by the cube's criteria, so that scans
see the filters and no other parameter is shuffled.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.when(b != 0, a / b), ast.Pow: lambda a, b: F.pow(a, b),
}
_CALLS = {
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)), "abs": F.abs, "exp": F.exp, "log": lambda a: F.when(a > 0, F.log(a)), "min": F.least, "max": F.greatest,
    "direction": lambda u, v: F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0)),
}


def names(formula: str) -> list[str]:
    """The parameters that a formula names, in order of first use."""
    tree = ast.parse(formula, mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return list(dict.fromkeys(n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id not in called))


def column(formula: str, of: dict[str, Column]) -> Column:
    """A formula of numbers, names, + - * / **, and sqrt, abs, exp, log, min, max, direction(u, v), as a column. Where it is not
    defined (division by 0, roots and logarithms of what has none) it is null."""

    def build(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return of[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](build(n.left), build(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -build(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*map(build, n.args))
        raise ValueError(f"not a formula: {formula}")

    return build(ast.parse(formula, mode="eval").body)


@dataclass(frozen=True)
class Cube:
    """rows (param, keys ..., value), one row for each parameter and keys; criteria restrict keys; formulas are parameters too."""

    rows: DataFrame
    keys: tuple[str, ...]
    criteria: tuple[Column, ...] = ()
    formulas: dict[str, str] = field(default_factory=dict)

    def where(self, *criteria: Column) -> Cube:
        return replace(self, criteria=(*self.criteria, *criteria))

    def define(self, param: str, formula: str) -> Cube:
        """A cube that has one parameter more. It may name formulas; they may not name it in turn."""
        found = {**self.formulas, param: formula}
        if not replace(self, formulas=found).needed(param):
            raise ValueError(f"no parameter in {formula}")
        return replace(self, formulas=found)

    def needed(self, param: str, within: tuple[str, ...] = ()) -> list[str]:
        """The stored parameters that a parameter comes from."""
        if param in within:
            raise ValueError(f"{param} is defined by itself")
        if param not in self.formulas:
            return [param]
        return list(dict.fromkeys(p for n in names(self.formulas[param]) for p in self.needed(n, (*within, param))))

    def catalog(self) -> DataFrame:
        """param and how many rows of each the criteria leave."""
        return reduce(DataFrame.filter, self.criteria, self.rows).groupBy("param").agg(F.count("*").alias("n"))

    def plane(self, param: str) -> DataFrame:
        """keys and value of a parameter: for a formula, where all the planes it needs have a row."""
        stored = self.needed(param)
        kept = reduce(DataFrame.filter, self.criteria, self.rows)
        planes = [kept.filter(c("param") == p).select(*self.keys, c("value").alias(f"_{k}")) for k, p in enumerate(stored)]
        both = reduce(lambda a, b: a.join(b, list(self.keys)), planes)
        of = {p: c(f"_{k}") for k, p in enumerate(stored)}

        def value(p: str) -> Column:
            return column(self.formulas[p], {n: value(n) for n in names(self.formulas[p])}) if p in self.formulas else of[p]

        return both.select(*self.keys, value(param).alias("value"))


def completed(planes: DataFrame, wanted: list[int], keys: list[str], level: str = "hpa", value: str = "value") -> DataFrame:
    """keys, level, value at each of the wanted pressure levels: those that planes have, and else the value between the nearest
    level above and below it, linear in the logarithm of pressure. Nothing is told beyond the outermost levels. planes has
    one row for each keys and level; null values are not there. Levels are a list of a few numbers: they travel with each
    row's neighbour and are exploded, so there is no join."""
    w = Window.partitionBy(*keys).orderBy("_p")
    there = planes.filter(c(value).isNotNull() & (c(level) > 0)).select(*keys, c(level).cast("double").alias("_p"), c(value).cast("double").alias("_v"))
    there = there.withColumn("_q", F.lead("_p").over(w)).withColumn("_u", F.lead("_v").over(w))
    levels = F.array(*[F.lit(float(x)) for x in sorted(set(wanted))])
    inside = F.filter(levels, lambda x: (x == c("_p")) | ((x > c("_p")) & (x < c("_q"))))
    out = there.withColumn("_x", F.explode(inside))
    share = (F.log("_x") - F.log("_p")) / (F.log("_q") - F.log("_p"))
    return out.select(*keys, c("_x").cast("int").alias(level), F.when(c("_x") == c("_p"), c("_v")).otherwise(c("_v") + (c("_u") - c("_v")) * share).alias(value))


def kernel(radius: int, sigma: float) -> list[float]:
    """Weights of a Gaussian from -radius to radius; they add up to 1."""
    import math

    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [r / sum(raw) for r in raw]


def blurred(cells: DataFrame, keys: list[str], radius: int, sigma: float, tile: int = 64) -> DataFrame:
    """cells (keys, x, y, value) blurred by a Gaussian, first along rows and then along columns. At borders and gaps the weights of
    the cells that are there are scaled up. Lines are dealt out in stretches of tile cells, and each stretch takes a
    halo of radius cells of its neighbours along, so a line of any length needs no task of its own."""
    weights = F.array(*[F.lit(w) for w in kernel(radius, sigma)])

    def along(df: DataFrame, at: str, other: str) -> DataFrame:
        first, last = F.floor((c(at) - radius) / tile), F.floor((c(at) + radius) / tile)
        sent = df.filter("value is not null").withColumn("_part", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        stretch = sent.groupBy(*keys, other, "_part").agg(F.map_from_entries(F.collect_list(F.struct(at, "value"))).alias("_m"), F.array_sort(F.collect_list(at)).alias("_ats"))
        own = F.filter("_ats", lambda a: F.floor(a / tile) == c("_part"))
        near = lambda a: F.filter(F.transform(weights, lambda w, k: F.struct(w.alias("w"), F.try_element_at("_m", (a + k - radius).cast("int")).alias("v"))), lambda s: s.v.isNotNull())
        mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, r: a + r.w * r.v) / F.aggregate(s, F.lit(0.0), lambda a, r: a + r.w)
        return stretch.withColumn("_a", F.explode(own)).withColumn("_s", near(c("_a"))).select(*keys, c("_a").alias(at), other, mean(c("_s")).alias("value"))

    plain = cells.select(*keys, c("x").cast("int").alias("x"), c("y").cast("int").alias("y"), c("value").cast("double").alias("value"))
    return along(along(plain, "x", "y"), "y", "x").select(*keys, "x", "y", "value")
