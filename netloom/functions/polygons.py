"""Polygons with holes, and lines, as Columns: a shape is the array of its sides (ax, ay, bx, by).

What lies inside follows from the parity of the sides that a ray meets, so parts and
holes of one shape are simply further sides.  Distances take the place of buffers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions import scalars as S


def sides(lines: Column, area: Column) -> Column:
    """Sides of lines of (x, y); rings of an area are closed where they are not.  Repeated vertices make no side."""

    def of(line: Column) -> Column:
        ring = F.when(area & (line[0] != F.element_at(line, -1)), F.concat(line, F.array(line[0]))).otherwise(line)
        pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
        return F.filter(pairs, lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))

    return F.flatten(F.transform(F.filter(lines, lambda x: F.size(x) > 1), of))


def ends(s: Column) -> tuple[Column, Column, Column, Column]:
    return s["ax"], s["ay"], s["bx"], s["by"]


def envelope(shape: Column) -> tuple[Column, Column, Column, Column]:
    def both(f, a: str, b: str) -> Column:
        return f(F.flatten(F.transform(shape, lambda s: F.array(s[a], s[b]))))

    return both(F.array_min, "ax", "bx"), both(F.array_min, "ay", "by"), both(F.array_max, "ax", "bx"), both(F.array_max, "ay", "by")


def inside(x: Column, y: Column, shape: Column) -> Column:
    """Whether a point is inside; on the border either may be told (see ``covers``)."""
    met = F.filter(shape, lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.when(s["by"] != s["ay"], s["by"] - s["ay"]) + s["ax"]))
    return F.size(met) % 2 == 1


def border_distance(x: Column, y: Column, shape: Column) -> Column:
    return F.array_min(F.transform(shape, lambda s: S.point_to_segment(x, y, *ends(s))))


def covers(x: Column, y: Column, shape: Column, tolerance: float = 1e-9) -> Column:
    """Inside or on the border."""
    return inside(x, y, shape) | (border_distance(x, y, shape) <= tolerance)


def point_distance(x: Column, y: Column, shape: Column, area: Column) -> Column:
    """0 inside an area, else to the nearest side."""
    return F.when(area & inside(x, y, shape), 0.0).otherwise(border_distance(x, y, shape))


def segment_distance(a: Column, b: Column, c: Column, d: Column, shape: Column, area: Column) -> Column:
    """From the segment (a, b)-(c, d) to a shape: 0 where it meets a side or begins inside."""
    crossing = F.exists(shape, lambda s: S.cross_properly((a, b, c, d), ends(s)))
    near = F.transform(shape, lambda s: F.least(S.point_to_segment(a, b, *ends(s)), S.point_to_segment(c, d, *ends(s)), S.point_to_segment(s["ax"], s["ay"], a, b, c, d), S.point_to_segment(s["bx"], s["by"], a, b, c, d)))
    return F.when(crossing | (area & inside(a, b, shape)), 0.0).otherwise(F.array_min(near))


def cuts(a: Column, b: Column, c: Column, d: Column, shape: Column) -> Column:
    """Where a segment meets the sides, as shares of its length to nine digits, in order, with 0 and 1."""

    def position(s: Column) -> Column:
        across = (c - a) * (s["by"] - s["ay"]) - (d - b) * (s["bx"] - s["ax"])
        other = F.when(across != 0, across)
        t = ((s["ax"] - a) * (s["by"] - s["ay"]) - (s["ay"] - b) * (s["bx"] - s["ax"])) / other
        u = ((s["ax"] - a) * (d - b) - (s["ay"] - b) * (c - a)) / other
        return F.when((t >= 0) & (t <= 1) & (u >= -1e-12) & (u <= 1 + 1e-12), F.round(t, 9))

    met = F.filter(F.transform(shape, position), lambda t: t.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), met)))


def spans_inside(a: Column, b: Column, c: Column, d: Column, shape: Column) -> Column:
    """The parts (s0, s1) of a segment inside an area, one for each crossing, as shares of its length."""
    at = cuts(a, b, c, d, shape)
    parts = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda p, q: F.struct(p.alias("s0"), q.alias("s1")))

    def middle(p: Column) -> Column:
        t = (p["s0"] + p["s1"]) / 2
        return inside(a + t * (c - a), b + t * (d - b), shape)

    none = F.array().cast("array<struct<s0:double,s1:double>>")

    def joined(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        more = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s0"].alias("s0"), p["s1"].alias("s1"))))
        return F.when(F.size(done) == 0, F.array(p)).when(last["s1"] == p["s0"], more).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(F.filter(parts, middle), none, joined)


def _linear(p: Column, q: Column, low: Column | float, high: Column) -> tuple[Column, Column]:
    """For which t ``p + t q`` lies in [low, high]; start above end where it never does."""
    big = 1e300
    one, two = (low - p) / F.when(q != 0, q), (high - p) / F.when(q != 0, q)
    holds = (p >= low) & (p <= high)
    return F.coalesce(F.least(one, two), F.when(holds, -big).otherwise(big)), F.coalesce(F.greatest(one, two), F.when(holds, big).otherwise(-big))


def near_side(a: Column, b: Column, c: Column, d: Column, s: Column, far: Column) -> Column:
    """The part (s0, s1) of a segment that is within ``far`` of a side, or null: a capsule is convex, so there is one part."""
    dx, dy = c - a, d - b
    length = S.distance(*ends(s))
    ux, uy = (s["bx"] - s["ax"]) / length, (s["by"] - s["ay"]) / length
    along = _linear((a - s["ax"]) * ux + (b - s["ay"]) * uy, dx * ux + dy * uy, 0.0, length)
    aside = _linear((a - s["ax"]) * -uy + (b - s["ay"]) * ux, dx * -uy + dy * ux, -far, far)
    found = [(F.greatest(along[0], aside[0]), F.least(along[1], aside[1]))]
    for x, y in ((s["ax"], s["ay"]), (s["bx"], s["by"])):
        square, half, rest = dx * dx + dy * dy, dx * (a - x) + dy * (b - y), (a - x) * (a - x) + (b - y) * (b - y) - far * far
        root = half * half - square * rest
        ok = (square > 0) & (root >= 0)
        r = F.sqrt(F.when(ok, root))
        found.append((F.coalesce((-half - r) / F.when(square > 0, square), F.lit(1e300)), F.coalesce((-half + r) / F.when(square > 0, square), F.lit(-1e300))))
    s0 = F.least(*[F.when(p <= q, p).otherwise(1e300) for p, q in found])
    s1 = F.greatest(*[F.when(p <= q, q).otherwise(-1e300) for p, q in found])
    s0, s1 = F.greatest(s0, F.lit(0.0)), F.least(s1, F.lit(1.0))
    return F.when(s0 < s1, F.struct(s0.alias("s0"), s1.alias("s1")))
