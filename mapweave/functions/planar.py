"""The rules of ``geometry`` for Python lists of points (x, y, key), and GeoJSON text of them."""

from __future__ import annotations

from collections.abc import Hashable

Point = tuple[float | None, float | None, Hashable]
Line = list[Point]


def is_ring(ring: Line) -> bool:
    return len(ring) > 3 and ring[0][:2] == ring[-1][:2]


def is_clockwise(ring: Line) -> bool:
    m, n = 0, len(ring)
    for i in range(1, n):
        a, b = ring[m][0], ring[i][0]
        if a is None or b is None or not a > b:
            m = i
    (x0, y0), (x1, y1), (x2, y2) = ring[n - 2 if m <= 0 else m - 1][:2], ring[m][:2], ring[1 if m >= n - 1 else m + 1][:2]
    if None in (x0, y0, x1, y1, x2, y2):
        return False
    return (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) < 0


def oriented(ring: Line, clockwise: bool) -> Line:
    return ring if is_clockwise(ring) == clockwise else ring[::-1]


def contains(ring: Line, point: Point) -> bool:
    px, py = point[:2]
    inside = False
    for i in range(len(ring)):
        (xi, yi), (xj, yj) = ring[i][:2], ring[i - 1][:2]
        if None in (px, py, xi, yi, xj, yj):
            continue
        if (xi <= px < xj) or (xj <= px < xi):
            at = (yj - yi) * (px - xi) / (xj - xi) + yi
            # for Spark, what is no number is above all others
            if py < at or at != at:
                inside = not inside
    return inside


def polygons(outers: list[Line], inners: list[Line]) -> list[list[Line]]:
    """Each outer ring with the inner rings whose first point it is the first to contain."""
    out = [[o] for o in outers]
    for ring in inners:
        home = next((k for k, o in enumerate(outers) if contains(o, ring[0])), None)
        if home is not None:
            out[home].append(ring)
    return out


def double(x: float | None) -> str:
    """A double as Java writes it in JSON."""
    if x is None:
        return "null"
    size = abs(x)
    if 1e-3 <= size < 1e7 or size == 0:
        return repr(x)
    if x != x or size == float("inf"):
        return '"NaN"' if x != x else '"Infinity"' if x > 0 else '"-Infinity"'
    mantissa, _, power = repr(size).partition("e")
    whole, _, part = mantissa.partition(".")
    at = int(power or 0) + (len(whole) - 1 if whole != "0" else len(part.lstrip("0")) - len(part) - 1)
    digits = (whole + part).strip("0")
    if len(digits) == 1:
        # of two digits, Java writes the nearest; they differ from one digit in the smallest numbers alone
        near, _, power = f"{size:.1e}".partition("e")
        if float(f"{near}e{power}") == size:
            digits, at = near.replace(".", ""), int(power)
    return f"{'-' if x < 0 else ''}{digits[0]}.{digits[1:] or '0'}E{at}"


def geometry(kind: str, coordinates: str) -> str:
    return f'{{"type":"{kind}","coordinates":{coordinates}}}'


def point_json(at: Point) -> str:
    return geometry("Point", f"[{double(at[0])},{double(at[1])}]")


def line_json(line: Line) -> str:
    return "[" + ",".join([f"[{double(p[0])},{double(p[1])}]" for p in line]) + "]"


def polygon_json(rings: list[Line]) -> str:
    return "[" + ",".join(map(line_json, rings)) + "]"
