"""Geometry as Column functions over array<array<double>> rings, [x, y] each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_float(text: Column) -> Column:
    """The longest numeric prefix of a text as a double, or null."""
    return F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")


def points(vertices: Column) -> Column:
    """[x, y] pairs of an array of points."""
    return F.transform(vertices, lambda p: F.array(p["x"], p["y"]))


def same_point(a: Column, b: Column) -> Column:
    """Null stands for a coordinate that is no number, and is the same as another such."""
    return F.get(a, 0).eqNullSafe(F.get(b, 0)) & F.get(a, 1).eqNullSafe(F.get(b, 1))


def is_ring(ring: Column) -> Column:
    return (F.size(ring) > 3) & same_point(F.get(ring, 0), F.element_at(ring, -1))


def rightmost(ring: Column) -> Column:
    """The index of the largest x; of equals, the last."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), lambda m, i: F.when(F.get(F.get(ring, m), 0) > F.get(F.get(ring, i), 0), m).otherwise(i))


def is_clockwise(ring: Column) -> Column:
    """By the turn at the rightmost point; a straight turn counts as counter-clockwise."""

    def turn(m: Column) -> Column:
        n = F.size(ring)
        before = F.get(ring, F.when(m <= 0, n - 2).otherwise(m - 1))
        after = F.get(ring, F.when(m >= n - 1, F.lit(1)).otherwise(m + 1))
        here = F.get(ring, m)
        x, y = (lambda p: F.get(p, 0)), (lambda p: F.get(p, 1))
        return (x(here) - x(before)) * (y(after) - y(before)) - (x(after) - x(before)) * (y(here) - y(before))

    # the index is computed once, by passing it through a one-element array
    return F.coalesce(F.element_at(F.transform(F.array(rightmost(ring)), lambda m: turn(m) < 0), 1), F.lit(False))


def oriented(ring: Column, clockwise: bool) -> Column:
    wrong = ~is_clockwise(ring) if clockwise else is_clockwise(ring)
    return F.when(wrong, F.reverse(ring)).otherwise(ring)


def contains(ring: Column, point: Column) -> Column:
    """Even-odd rule, half-open in x, strictly below in y."""
    px, py = F.get(point, 0), F.get(point, 1)

    def flip(inside: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        xi, yi, xj, yj = F.get(a, 0), F.get(a, 1), F.get(b, 0), F.get(b, 1)
        spans = ((xi <= px) & (px < xj)) | ((xj <= px) & (px < xi))
        below = py < F.try_divide((yj - yi) * (px - xi), xj - xi) + yi
        return F.when(F.coalesce(spans & below, F.lit(False)), ~inside).otherwise(inside)

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), flip)


def polygons(outers: Column, inners: Column) -> Column:
    """array of polygons: each outer ring with the inner rings whose first point it is the first to contain."""

    def home(inner: Column) -> Column:
        hits = F.transform(outers, lambda o: contains(o, F.get(inner, 0)))
        return F.struct(F.array_position(hits, F.lit(True)).alias("at"), inner.alias("ring"))

    placed = F.transform(inners, home)
    return F.transform(outers, lambda o, i: F.concat(F.array(o), F.transform(F.filter(placed, lambda h: h["at"] == i + 1), lambda h: h["ring"])))
