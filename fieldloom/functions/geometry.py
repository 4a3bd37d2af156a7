"""Scalar geometry and projections as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378000.0

Point = tuple[Column, Column]


# --- affine maps -----------------------------------------------------------------------------------------------------


def affine(m: tuple[float, ...], x: Column, y: Column) -> Point:
    """m = (sx, shy, shx, sy, tx, ty)."""
    sx, shy, shx, sy, tx, ty = m
    return x * sx + y * shx + tx, x * shy + y * sy + ty


def inverse(m: tuple[float, ...]) -> tuple[float, ...]:
    """The inverse map, on the driver: a map is six numbers."""
    sx, shy, shx, sy, tx, ty = m
    d = sx * sy - shy * shx
    return sy / d, -shy / d, -shx / d, sx / d, (shx * ty - sy * tx) / d, (shy * tx - sx * ty) / d


def then(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    """First a, then b."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def translation(dx: float, dy: float) -> tuple[float, ...]:
    return 1.0, 0.0, 0.0, 1.0, dx, dy


def scaling(sx: float, sy: float) -> tuple[float, ...]:
    return sx, 0.0, 0.0, sy, 0.0, 0.0


def drag_corner(bounds: tuple[float, float, float, float], corner: int, to: tuple[float, float]) -> tuple[float, ...]:
    """The map that moves a corner (0 to 3, from the first corner around) to a point and keeps the opposite one."""
    x1, y1, x2, y2 = bounds
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    (cx, cy), (ox, oy) = corners[corner], corners[(corner + 2) % 4]
    return then(then(translation(-ox, -oy), scaling((to[0] - ox) / (cx - ox), (to[1] - oy) / (cy - oy))), translation(ox, oy))


# --- orthographic projection -----------------------------------------------------------------------------------------


class Projection:
    """A pair of forward and reverse functions on points; compose with |."""

    def __init__(self, forward: Callable[[Column, Column], Point], reverse: Callable[[Column, Column], Point]):
        self.forward, self.reverse = forward, reverse

    def __or__(self, other: Projection) -> Projection:
        return Projection(lambda x, y: other.forward(*self.forward(x, y)), lambda x, y: self.reverse(*other.reverse(x, y)))


def affine_projection(m: tuple[float, ...]) -> Projection:
    return Projection(lambda x, y: affine(m, x, y), lambda x, y: affine(inverse(m), x, y))


def orthographic(lon_0: float = 10.0, lat_0: float = 30.0, radius: float = EARTH) -> Projection:
    """Degrees to metres on the plane that touches the sphere at (lon_0, lat_0). What cannot be seen becomes (0, 0)."""
    l0, p0 = math.radians(lon_0), math.radians(lat_0)
    s0, c0 = math.sin(p0), math.cos(p0)

    def forward(lon: Column, lat: Column) -> Point:
        lam, phi = F.radians(lon) - l0, F.radians(lat)
        seen = F.sin(phi) * s0 + F.cos(phi) * F.cos(lam) * c0 >= 0
        x, y = F.cos(phi) * F.sin(lam) * radius, (F.sin(phi) * c0 - F.cos(phi) * F.cos(lam) * s0) * radius
        return F.when(seen, x).otherwise(0.0), F.when(seen, y).otherwise(0.0)

    def reverse(x: Column, y: Column) -> Point:
        u, v = x / radius, y / radius
        r = F.sqrt(u * u + v * v)
        s = F.least(r, F.lit(1.0))
        c = F.sqrt(1 - s * s)
        lat = F.when(r < 1e-12, F.lit(p0)).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c * s0 + v * s * c0 / F.greatest(r, F.lit(1e-12))))))
        lon = l0 + F.atan2(u * s, r * c0 * c - v * s0 * s)
        lon = F.when(r < 1e-12, F.lit(l0)).otherwise(lon)
        lon = F.degrees(lon)
        lon = lon - 360 * F.floor((lon + 180) / 360)
        ok = r <= 1 + 1e-9
        return F.when(ok, lon).otherwise(0.0), F.when(ok, F.degrees(lat)).otherwise(0.0)

    return Projection(forward, reverse)


# --- edges, weights, kernels -----------------------------------------------------------------------------------------


def edge_contains(a: Column, b: Column, v: Column) -> Column:
    return (F.least(a, b) <= v) & (v < F.greatest(a, b))


def edge_weight(a: Column, b: Column, v: Column) -> Column:
    """The weight of a at the point between a and b where the value is v."""
    return (v - b) / (a - b)


def inside_bounds(kind: str, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether an edge from (x, y) to the right, down or along the diagonal lies in a w x h grid."""
    right = {"horizontal": 1, "vertical": 0, "diagonal": 1}[kind]
    down = {"horizontal": 0, "vertical": 1, "diagonal": 1}[kind]
    return (x >= 0) & (y >= 0) & (x + right < w) & (y + down < h)


#: Base of the stepped Gaussian, its steps, and the last step that counts.
GAUSS_BASE, GAUSS_STEPS, GAUSS_LAST = 2.718281828, 500, 1500


def warp_weight(dist2: Column) -> Column:
    """Weight of a warp at a squared distance: a Gaussian in steps of two units, 0 beyond the last step."""
    i = F.floor(dist2 * 0.5)
    return F.when(i <= GAUSS_LAST, F.sqrt(F.pow(F.lit(GAUSS_BASE), -(i / GAUSS_STEPS) * (i / GAUSS_STEPS)))).otherwise(0.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: the mean of value by weight; null where all weights are 0."""
    return F.sum(weight * value) / F.nullif(F.sum(weight), F.lit(0.0))


def spline(t: Column) -> Column:
    """Cubic B-spline kernel."""
    cube = lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(3.0))
    return (cube(t + 2) - 4 * cube(t + 1) + 6 * cube(t) - 4 * cube(t - 1)) / 6


# --- rectangles and intervals ----------------------------------------------------------------------------------------


def rect_contains(a: str, b: str) -> Column:
    """Whether rectangle a strictly contains b (prefixes of x1, y1, x2, y2)."""
    c = F.col
    return (c(f"{a}x1") < c(f"{b}x1")) & (c(f"{a}y1") < c(f"{b}y1")) & (c(f"{a}x2") > c(f"{b}x2")) & (c(f"{a}y2") > c(f"{b}y2"))


def rects_meet(a: str, b: str) -> Column:
    c = F.col
    return (c(f"{a}x1") <= c(f"{b}x2")) & (c(f"{b}x1") <= c(f"{a}x2")) & (c(f"{a}y1") <= c(f"{b}y2")) & (c(f"{b}y1") <= c(f"{a}y2"))


def intervals_meet(start_a: Column, stop_a: Column, start_b: Column, stop_b: Column) -> Column:
    return (start_a <= stop_b) & (start_b <= stop_a)


def polygon_contains(px: Column, py: Column, xs: Column, ys: Column, compat: bool = False) -> Column:
    """Even-odd test of a point against a ring given as arrays; a point on an edge is inside.

    compat: an edge counts at both its ends, so vertex hits count twice, and an odd number of crossings is outside.
    """
    n = F.size(xs)

    def edge(i: Column) -> tuple[Column, ...]:
        j = (i + 1) % n
        return F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)

    def crossing(i: Column) -> Column:
        x1, y1, x2, y2 = edge(i)
        hit = (F.least(y1, y2) <= py) & (py <= F.greatest(y1, y2)) if compat else (F.least(y1, y2) <= py) & (py < F.greatest(y1, y2))
        return F.when(hit & (y1 != y2), x1 + (py - y1) / (y2 - y1) * (x2 - x1))

    def touches(i: Column) -> Column:
        x1, y1, x2, y2 = edge(i)
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        return (cross == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))

    at = F.sequence(F.lit(0), n - 1)
    crossings = F.filter(F.transform(at, crossing), lambda x: x.isNotNull())
    left = F.size(F.filter(crossings, lambda x: x < px))
    if compat:
        return F.when(F.size(crossings) % 2 == 1, False).otherwise((left % 2 == 1) | F.exists(crossings, lambda x: x == px))
    return (left % 2 == 1) | F.exists(at, touches)


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed area by the shoelace formula; positive where the ring turns from x to y."""
    n = F.size(xs)
    term = lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, x: a + x) / 2


def turn(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Determinant of the turn at the second point: negative is clockwise."""
    return (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)
