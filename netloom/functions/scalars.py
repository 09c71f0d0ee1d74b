"""Scalar rules as Columns: rounding, money, catalogue lookups, plane geometry, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.catalogues import DEFAULT, Catalogues


def rounded(x: Column) -> Column:
    """Half up to a whole number, as bigint."""
    return F.floor(x + 0.5).cast("long")


def snapped_up(x: Column, tolerance: float) -> Column:
    """The next whole number where ``x`` is within ``tolerance`` below it, else ``x``."""
    up = F.ceil(x - 1e-9).cast("double")
    return F.when(up - x <= tolerance, up).otherwise(x)


def smallest_dn(flow: Column, length: Column | None = None, at_least: Column | None = None, c: Catalogues = DEFAULT) -> Column:
    """The least diameter that carries the flow (over the length, not below ``at_least``); null if none does.

    The catalogue is a chain of conditions, so rows need no join.
    """
    out: Column = F.lit(None).cast("int")
    for dn, capacity, longest, _ in reversed(c.diameters):
        fits = flow <= capacity
        if length is not None:
            fits &= length <= longest + 1e-9
        if at_least is not None:
            fits &= at_least <= dn
        out = F.when(fits, dn).otherwise(out)
    return out


def by_dn(dn: Column, values: dict[int, int]) -> Column:
    """The value of exactly this diameter, else null."""
    out: Column = F.lit(None).cast("long")
    for k, v in values.items():
        out = F.when(dn == k, F.lit(v).cast("long")).otherwise(out)
    return out


def price(dn: Column, c: Catalogues = DEFAULT) -> Column:
    return by_dn(dn, {r[0]: r[3] for r in c.diameters})


def longest_run(dn: Column, c: Catalogues = DEFAULT) -> Column:
    return by_dn(dn, {r[0]: r[2] for r in c.diameters})


def next_dn(dn: Column, c: Catalogues = DEFAULT) -> Column:
    out: Column = F.lit(None).cast("int")
    for k, *_ in reversed(c.diameters):
        out = F.when(dn < k, k).otherwise(out)
    return out


def pair_width(dn: Column, c: Catalogues = DEFAULT) -> Column:
    """Width of the first envelope for this diameter or a larger one, else of the last; 0 without envelopes."""
    out: Column = F.lit(c.envelopes[-1][1] if c.envelopes else 0).cast("long")
    for k, width in reversed(c.envelopes):
        out = F.when(dn <= k, F.lit(width).cast("long")).otherwise(out)
    return out


def chamber_price(dn: Column, c: Catalogues = DEFAULT) -> Column:
    out: Column = F.lit(None).cast("long")
    for k, value in reversed(c.chambers):
        out = F.when(dn <= k, F.lit(value).cast("long")).otherwise(out)
    return out


def segment_cost(length: Column, dn: Column, k_depth: Column | float = 1.0, k_special: Column | float = 1.0, c: Catalogues = DEFAULT) -> Column:
    return rounded(length * price(dn, c) * k_depth * k_special)


def penalty(flow: Column, c: Catalogues = DEFAULT) -> Column:
    return F.lit(c.penalty[0]) + rounded(F.coalesce(flow, F.lit(0)) * F.lit(c.penalty[1]))


def score(cost: Column, length: Column, c: Catalogues = DEFAULT) -> Column:
    """Weighted cost (millions) and length (hundreds of metres); lower is better."""
    return c.weights[0] * (cost / F.lit(1e6)) + c.weights[1] * (length / F.lit(100.0))


def depth_factor(h: Column, normal: float = 3.0, rate: float = 0.1) -> Column:
    return F.when(h <= normal, 1.0).otherwise(1.0 + rate * (h - normal))


def pipe_height(dn: Column, c: Catalogues = DEFAULT) -> Column:
    """Height of a pipe in metres: of the first row for this diameter or a larger one, else of the last."""
    out: Column = F.lit(c.heights[-1][1] / 100 if c.heights else 0.0)
    for k, height in reversed(c.heights):
        out = F.when(dn <= k, height / 100).otherwise(out)
    return out


def avoidance_depth(top: Column, height: Column, new_height: Column | float = 0.0, clearance: float = 0.2, least: float = 0.7) -> Column:
    """Depth at which a new pipe passes a line: above it, where its own height and the clearance leave that deep enough, else below; -1 if neither is."""
    above, below = top - new_height - clearance, top + height + clearance
    return F.when(above >= least - 1e-9, above).when(below >= least - 1e-9, below).otherwise(-1.0)


# Plane geometry, metres.


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The angle between two directions, 0 for straight on."""
    return F.degrees(F.atan2(F.abs(ax * by - ay * bx), ax * bx + ay * by))


def position_on(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where the nearest point of a segment lies, 0 (start) to 1 (end)."""
    square = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / F.when(square > 0, square).otherwise(1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def point_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = position_on(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def cross_properly(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) cross in the inside of both."""
    return (side(*a, b[0], b[1]) * side(*a, b[2], b[3]) < 0) & (side(*b, a[0], a[1]) * side(*b, a[2], a[3]) < 0)


def hex_centre(col: Column, row: Column, cell: float) -> tuple[Column, Column]:
    """Centre of a pointy-topped hexagon, odd rows shifted by half a cell."""
    return (col + F.when(F.pmod(row, F.lit(2)) == 1, 0.5).otherwise(0.0)) * cell, row * (cell * math.sqrt(3) / 2)


def hex_cell(x: Column, y: Column, cell: float) -> Column:
    """(row, col) of the hexagon whose centre is nearest to a point, the lower row and column of equals."""
    high = cell * math.sqrt(3) / 2
    low = F.floor(y / high).cast("int")

    def at(row: Column, more: int) -> Column:
        col = F.floor(x / cell - F.when(F.pmod(row, F.lit(2)) == 1, 0.5).otherwise(0.0)).cast("int") + more
        cx, cy = hex_centre(col, row, cell)
        return F.struct(F.round((x - cx) * (x - cx) + (y - cy) * (y - cy), 9).alias("off"), row.alias("row"), col.alias("col"))

    best = F.array_min(F.array(*[at(low + k, more) for k in (0, 1) for more in (0, 1)]))
    return F.struct(best["row"].alias("row"), best["col"].alias("col"))


def hex_neighbours(row: Column, col: Column) -> Column:
    """The six hexagons beside one, as (row, col)."""
    odd = F.pmod(row, F.lit(2)).cast("int")
    steps = [(F.lit(0), F.lit(-1)), (F.lit(0), F.lit(1)), *((F.lit(dy), odd + dx) for dy in (-1, 1) for dx in (-1, 0))]
    return F.array(*[F.struct((row + dy).alias("row"), (col + dx).alias("col")) for dy, dx in steps])


# Transverse Mercator (WGS84), after the series in Snyder's "Map Projections: A Working Manual".

A, E2, K0 = 6378137.0, 0.00669437999014, 0.9996


def to_utm(lon: Column, lat: Column, zone: int = 37) -> tuple[Column, Column]:
    ep2 = E2 / (1 - E2)
    phi, dl = F.radians(lat), F.radians(lon - (6 * zone - 183))
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), ep2 * F.cos(phi) * F.cos(phi)
    a = F.cos(phi) * dl
    m = A * ((1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256) * phi - (3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024) * F.sin(2 * phi) + (15 * E2**2 / 256 + 45 * E2**3 / 1024) * F.sin(4 * phi) - (35 * E2**3 / 3072) * F.sin(6 * phi))
    x = 500000.0 + K0 * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a * a * a * a * a / 120)
    y = K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a * a * a * a * a * a / 720))
    return x, y


def to_wgs84(x: Column, y: Column, zone: int = 37) -> tuple[Column, Column]:
    ep2, e1 = E2 / (1 - E2), (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (y / K0) / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = ep2 * F.cos(p) * F.cos(p), F.tan(p) * F.tan(p)
    w = 1 - E2 * F.sin(p) * F.sin(p)
    n, r = A / F.sqrt(w), A * (1 - E2) / (w * F.sqrt(w))
    d = (x - 500000.0) / (n * K0)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * d * d * d * d / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * d * d * d * d * d * d / 720)
    lon = (d - (1 + 2 * t + c) * d * d * d / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * d * d * d * d * d / 120) / F.cos(p)
    return F.degrees(lon) + (6 * zone - 183), F.degrees(lat)
