"""Column expressions over points, boxes and balls.

A point is a list of coordinate columns, a box two such lists (closed), a ball a centre and a radius (closed). Distances
are squared; sums run over the dimensions in order and squares are products, so bounds computed here never contradict
distances computed here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]

#: Angles use this value of pi.
PI = 3.14159


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def dist2(p: Point, q: Point) -> Column:
    return _total([(a - b) * (a - b) for a, b in zip(p, q, strict=True)])


def array_dist2(p: Column, q: Column) -> Column:
    """For points in array columns; wide points stay within one expression."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def box_min_dist2(p: Point, lo: Point, hi: Point) -> Column:
    """To the nearest point of the box, 0 inside."""

    def side(x: Column, a: Column, b: Column) -> Column:
        gap = F.greatest(a - x, x - b, F.lit(0.0))
        return gap * gap

    return _total([side(x, a, b) for x, a, b in zip(p, lo, hi, strict=True)])


def box_max_dist2(p: Point, lo: Point, hi: Point) -> Column:
    """To the farthest corner of the box."""

    def side(x: Column, a: Column, b: Column) -> Column:
        gap = F.greatest(F.abs(x - a), F.abs(b - x))
        return gap * gap

    return _total([side(x, a, b) for x, a, b in zip(p, lo, hi, strict=True)])


def same_point(p: Point, q: Point) -> Column:
    return _all([a == b for a, b in zip(p, q, strict=True)])


def point_less(p: Point, q: Point) -> Column:
    """Lexicographic order."""
    return F.struct(*p) < F.struct(*q)


def least_coords(p: Point, q: Point) -> list[Column]:
    return [F.least(a, b) for a, b in zip(p, q, strict=True)]


def greatest_coords(p: Point, q: Point) -> list[Column]:
    return [F.greatest(a, b) for a, b in zip(p, q, strict=True)]


def format_point(p: Point, ident: Column | None = None) -> Column:
    text = F.concat(F.lit("("), *[F.concat(c.cast("string"), F.lit(", ")) for c in p], F.lit(")"))
    return text if ident is None else F.concat(ident.cast("string"), F.lit("-"), text)


def in_box(p: Point, lo: Point, hi: Point) -> Column:
    return _all([x.between(a, b) for x, a, b in zip(p, lo, hi, strict=True)])


def in_ball(p: Point, centre: Point, radius: Column) -> Column:
    return dist2(p, centre) <= radius * radius


def legal_box(lo: Point, hi: Point) -> Column:
    """Low is nowhere above high; the empty box (null) is legal."""
    return F.coalesce(_all([a <= b for a, b in zip(lo, hi, strict=True)]), F.lit(True))


def box_in_box(alo: Point, ahi: Point, blo: Point, bhi: Point) -> Column:
    return _all([(a >= c) & (b <= d) for a, b, c, d in zip(alo, ahi, blo, bhi, strict=True)])


def boxes_meet(alo: Point, ahi: Point, blo: Point, bhi: Point) -> Column:
    """Touching counts."""
    return _all([(b >= c) & (a <= d) for a, b, c, d in zip(alo, ahi, blo, bhi, strict=True)])


def box_in_ball(lo: Point, hi: Point, centre: Point, radius: Column) -> Column:
    return box_max_dist2(centre, lo, hi) <= radius * radius


def ball_meets_box(centre: Point, radius: Column, lo: Point, hi: Point) -> Column:
    return box_min_dist2(centre, lo, hi) <= radius * radius


def strictly_in_box(p: Point, lo: Point, hi: Point) -> Column:
    """The border does not count."""
    return _all([(x > a) & (x < b) for x, a, b in zip(p, lo, hi, strict=True)])


def widened(lo: Point, hi: Point, by: Column | float) -> tuple[list[Column], list[Column]]:
    """The box with every side moved out, or in for less than nothing; predicates of it are those with slack."""
    return [a - by for a in lo], [b + by for b in hi]


def same_box(alo: Point, ahi: Point, blo: Point, bhi: Point, slack: float = 0.0) -> Column:
    return _all([F.abs(a - b) <= slack for a, b in zip([*alo, *ahi], [*blo, *bhi], strict=True)])


def outside_cube(p: Point, centre: Point, half: Column | float) -> Column:
    """Not in the closed cube of that half side."""
    return ~_all([(c - half <= x) & (x <= c + half) for x, c in zip(p, centre, strict=True)])


def widest_dimension(lo: Point, hi: Point) -> Column:
    """Index of the longest side, from 0; the lowest of equals."""
    sides = F.array(*[b - a for a, b in zip(lo, hi, strict=True)])
    return (F.array_position(sides, F.array_max(sides)) - 1).cast("int")


def out_of_balance(left: Column, total: Column, ratio: Column | int = 30) -> Column:
    """The left share is more than ``ratio`` whole points off one half; an empty node is."""
    share = F.floor(F.abs(100.0 * left / F.when(total != 0, total) - 50.0))
    return F.coalesce(share > ratio, F.lit(True))


EPS = 2.0**-52


def eps_greater(a: Column, b: Column) -> Column:
    return a - b > EPS


def eps_less(a: Column, b: Column) -> Column:
    return a - b < -EPS


def eps_equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < EPS


# Two- and three-dimensional vectors, triangles and circles.


def dot(p: Point, q: Point) -> Column:
    return _total([a * b for a, b in zip(p, q, strict=True)])


def cross2(p: Point, q: Point) -> Column:
    return p[0] * q[1] - p[1] * q[0]


def cross3(p: Point, q: Point) -> list[Column]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def minus(p: Point, q: Point) -> list[Column]:
    return [a - b for a, b in zip(p, q, strict=True)]


def plus(p: Point, q: Point) -> list[Column]:
    return [a + b for a, b in zip(p, q, strict=True)]


def scaled(p: Point, by: Column | float) -> list[Column]:
    return [a * by for a in p]


def length(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def quadrant(p: Point, centre: Point) -> Column:
    """Bit i is set where coordinate i is above the centre's."""
    return _total([F.when(a > c, 1 << i).otherwise(0) for i, (a, c) in enumerate(zip(p, centre, strict=True))])


def offset_point(centre: Point, direction: Column, by: Column | float) -> list[Column]:
    """The centre moved along every axis, up where the direction's bit is set and down elsewhere."""
    return [F.when(direction.bitwiseAND(1 << i) != 0, c + by).otherwise(c - by) for i, c in enumerate(centre)]


def triangle_area2(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area."""
    return cross2(minus(b, a), minus(c, a))


def triangle_area_share(a: Point, b: Point, c: Point) -> Column:
    """``triangle_area2`` over the lengths of the sides at a: the sine of its angle; null where a side has no length."""
    return triangle_area2(a, b, c) / F.nullif(length(minus(b, a)) * length(minus(c, a)), F.lit(0.0))


def lifted(v: Point) -> list[Column]:
    """The vector with its own square as a further coordinate."""
    return [*v, dot(v, v)]


def in_circle_number(a: Point, b: Point, c: Point, p: Point) -> Column:
    """The determinant of ``in_circle`` over the lengths of its rows, in the units of the points; null where p is a corner."""
    u, v, w = (lifted(minus(x, p)) for x in (a, b, c))
    return dot(cross3(u, v), w) / F.nullif(length(u) * length(v) * length(w), F.lit(0.0))


def counter_clockwise(a: Point, b: Point, c: Point) -> Column:
    return triangle_area2(a, b, c) > 0


def in_circle(a: Point, b: Point, c: Point, p: Point) -> Column:
    """p is strictly inside the circle through the counter-clockwise triangle abc."""
    rows = []
    for v in (a, b, c):
        x, y = minus(v, p)
        rows.append((x, y, x * x + y * y))
    (ax, ay, aq), (bx, by, bq), (cx, cy, cq) = rows
    return ax * (by * cq - bq * cy) - ay * (bx * cq - bq * cx) + aq * (bx * cy - by * cx) > 0


def in_circle_share(a: Point, b: Point, c: Point, p: Point) -> Column:
    """How far p is inside the circle through the counter-clockwise triangle abc, from -1 to 1, wherever the triangle lies and
    however large it is: the determinant of ``in_circle`` over the lengths of its rows, in units of the farthest corner."""
    sides = [minus(v, p) for v in (a, b, c)]
    unit = F.greatest(*[length(v) for v in sides])
    rows = []
    for v in sides:
        x, y = v[0] / unit, v[1] / unit
        rows.append((x, y, x * x + y * y))
    (ax, ay, aq), (bx, by, bq), (cx, cy, cq) = rows
    size = 1.0
    for x, y, q in rows:
        size = size * F.sqrt(x * x + y * y + q * q)
    return F.when(size > 0, (ax * (by * cq - bq * cy) - ay * (bx * cq - bq * cx) + aq * (bx * cy - by * cx)) / size).otherwise(0.0)


def angle_degrees(a: Point, b: Point, c: Point) -> Column:
    """The angle at a."""
    u, v = minus(b, a), minus(c, a)
    return F.acos(F.least(F.greatest(dot(u, v) / (length(u) * length(v)), F.lit(-1.0)), F.lit(1.0))) * (180.0 / PI)


def least_angle_below(a: Point, b: Point, c: Point, degrees: float) -> Column:
    return F.least(angle_degrees(a, b, c), angle_degrees(b, c, a), angle_degrees(c, a, b)) < degrees


def circumcentre(a: Point, b: Point, c: Point) -> list[Column]:
    (bx, by), (cx, cy) = minus(b, a), minus(c, a)
    d = 2.0 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    return [a[0] + (cy * b2 - by * c2) / d, a[1] + (bx * c2 - cx * b2) / d]


# Morton keys.


def cell(x: Column, lo: Column, side: Column, bits: int) -> Column:
    """Which of 2**bits cells along one axis; one scale for all axes keeps cells square."""
    most = (1 << bits) - 1
    return F.when(side > 0, F.least(F.floor((x - lo) * float(most) / side), F.lit(most))).otherwise(F.lit(0)).cast("long")


def morton(cells: Sequence[Column], bits: int) -> Column:
    """Bits of all cells interleaved, dimension 0 lowest; bits * dimensions must stay below 64."""
    d = len(cells)
    if bits * d > 63:
        raise ValueError("a Morton key holds 63 bits")
    parts = [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), i * d + k) for i in range(bits) for k, c in enumerate(cells)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def in_low_half(key: Column, bits: int) -> Column:
    """Whether the last ``bits`` bits of a key, at most 63, are no more than half of what they can hold."""
    return key.bitwiseAND(F.lit((1 << bits) - 1)) <= F.lit(1 << (bits - 1))


def morton_bits(dimensions: int) -> int:
    return min(63 // dimensions, math.floor(64 / dimensions))
