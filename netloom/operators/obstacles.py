"""Keep-outs, bands, gates and exits as distance predicates on boxes; no buffer is ever built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators.spatial import candidates, corners, segment_box

SIDES = (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))


def box_distance(x: Column, y: Column) -> Column:
    """From a point to a box (x0, y0, x1, y1); 0 inside."""
    dx = F.greatest(F.col("x0") - x, F.lit(0), x - F.col("x1")).cast("double")
    dy = F.greatest(F.col("y0") - y, F.lit(0), y - F.col("y1")).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def segment_box_distance(*ends: Column) -> Column:
    """From a segment to a box: an end's distance, a corner's distance to the segment, or 0 where it crosses a side."""
    a, b, c, d = ends
    corners = [S.point_to_segment(F.col(x), F.col(y), a, b, c, d) for x, y, _, _ in SIDES]
    crossing = F.lit(False)
    for side in SIDES:
        crossing |= S.cross_properly((a, b, c, d), tuple(F.col(n) for n in side))
    return F.when(crossing, 0.0).otherwise(F.least(box_distance(a, b), box_distance(c, d), *corners))


def blocked(segments: DataFrame, boxes: DataFrame, reach: float) -> DataFrame:
    """(seg_id, r_id, dist): segments nearer to a box than its ``keep`` (metres, at most ``reach``), by more than a millimetre."""
    names = ("p1", "q1", "p2", "q2")
    s = segments.select("seg_id", *[F.col(c).cast("double").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), names, strict=True)])
    rows = candidates(s, segment_box(*names), boxes.select("r_id", "x0", "y0", "x1", "y1", "keep"), corners("x0", "y0", "x1", "y1"), reach)
    return rows.select("seg_id", "r_id", "keep", segment_box_distance(*map(F.col, names)).alias("dist")).filter(F.col("dist") < F.col("keep") - 1e-3).drop("keep")


def crossing_angles(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """(seg_id, r_id, angle): the acute angle at which a segment crosses a side of a box, in degrees, the least of them."""
    sides = boxes.select("r_id", F.explode(F.array(*[F.struct(*[F.col(c).cast("double").alias(n) for c, n in zip(side, ("a", "b", "c", "d"), strict=True)]) for side in SIDES])).alias("s")).select("r_id", "s.*")
    own = segments.select("seg_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = candidates(own, segment_box(), sides, segment_box("a", "b", "c", "d"))
    cross = S.cross_properly(tuple(map(F.col, ("x1", "y1", "x2", "y2"))), tuple(map(F.col, ("a", "b", "c", "d"))))
    turn = S.turn_degrees(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("c") - F.col("a"), F.col("d") - F.col("b"))
    return rows.filter(cross).groupBy("seg_id", "r_id").agg(F.round(F.min(F.least(turn, 180 - turn)), 6).alias("angle"))


def through(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2), each once: segments that cross a side of a box which holds neither of their ends; a way into the box that holds its end is a tail."""
    ends, names = ("x1", "y1", "x2", "y2"), ("p1", "q1", "p2", "q2")
    s = segments.select(*[F.col(c).cast("double").alias(n) for c, n in zip(ends, names, strict=True)]).distinct()
    rows = candidates(s, segment_box(*names), boxes.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), corners("x0", "y0", "x1", "y1"))
    held, crossing = F.lit(False), F.lit(False)
    for x, y in (names[:2], names[2:]):
        held |= (F.col("x0") < F.col(x)) & (F.col(x) < F.col("x1")) & (F.col("y0") < F.col(y)) & (F.col(y) < F.col("y1"))
    for side in SIDES:
        crossing |= S.cross_properly(tuple(map(F.col, names)), tuple(map(F.col, side)))
    return rows.filter(~held & crossing).select(*[F.col(n).alias(c) for c, n in zip(ends, names, strict=True)]).distinct()


def narrowest_angles(directions: DataFrame, key: str) -> DataFrame:
    """(key, angle, n): the least angle between any two directions at a node, in degrees.

    Directions in order of their bearing: the least angle is between neighbours,
    so a node of n directions needs n comparisons.
    """
    bearing = F.pmod(F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))), F.lit(360.0))
    rows = directions.select(key, bearing.alias("b"))
    order = Window.partitionBy(key).orderBy("b")
    whole = Window.partitionBy(key)
    after = F.coalesce(F.lead("b").over(order), F.min("b").over(whole) + 360)
    gaps = rows.select(key, (after - F.col("b")).alias("gap"))
    return gaps.groupBy(key).agg(F.min(F.least("gap", 360 - F.col("gap"))).alias("angle"), F.count("*").alias("n")).filter("n > 1").select(key, F.round("angle", 4).alias("angle"), "n")


def gates(axes: DataFrame, step: float) -> DataFrame:
    """(seg_id, nth, x, y): places every ``step`` metres along an axis, from its start."""
    length = S.distance(*map(F.col, ("x1", "y1", "x2", "y2")))
    rows = axes.withColumn("length", length).withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor(length / step).cast("int"))))
    t = F.col("nth") * step / F.when(F.col("length") > 0, F.col("length")).otherwise(1)
    return rows.select("seg_id", "nth", F.round(F.col("x1") + t * (F.col("x2") - F.col("x1")), 6).alias("x"), F.round(F.col("y1") + t * (F.col("y2") - F.col("y1")), 6).alias("y"))


def in_bands(points: DataFrame, axes: DataFrame, width: float, step: float, thickness: float) -> DataFrame:
    """(cp_id, seg_id, in_gate): points within ``width`` of an axis, and whether a gate lets them through."""
    rows = candidates(points.select("cp_id", "x", "y"), corners("x", "y", "x", "y"), axes.select("seg_id", "x1", "y1", "x2", "y2"), segment_box(), width)
    ends = tuple(map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    along = S.position_on(*ends) * S.distance(*ends[2:])
    off = F.abs(along - F.floor(along / step + 0.5) * step)
    return rows.filter(S.point_to_segment(*ends) < width).select("cp_id", "seg_id", (off <= thickness / 2 + 1e-9).alias("in_gate"))


def exits(points: DataFrame, boxes: DataFrame, clearance: float, most: float) -> DataFrame:
    """(cp_id, r_id, side, ex, ey, tail, nth): straight ways out of a point's building, shortest first.

    A way ends ``clearance`` beyond a side; ways longer than ``most`` inside the
    building, or ending nearer than the clearance to another box, are left out.
    """
    from netloom.operators.spatial import owning

    owned = owning(points, boxes.withColumn("rtype", F.lit("oks"))).filter("r_id is not null").join(points, "cp_id").join(boxes.select("r_id", "x0", "y0", "x1", "y1"), "r_id")
    x, y = F.col("x"), F.col("y")
    ways = F.array(
        *[
            F.struct(F.lit(n).alias("side"), ex.cast("double").alias("ex"), ey.cast("double").alias("ey"), tail.cast("double").alias("inside"))
            for n, ex, ey, tail in (("W", F.col("x0") - clearance, y, x - F.col("x0")), ("E", F.col("x1") + clearance, y, F.col("x1") - x), ("S", x, F.col("y0") - clearance, y - F.col("y0")), ("N", x, F.col("y1") + clearance, F.col("y1") - y))
        ]
    )
    out = owned.select("cp_id", "r_id", F.explode(ways).alias("w")).select("cp_id", "r_id", "w.*").filter(F.col("inside") <= most)
    others = boxes.select(F.col("r_id").alias("other"), "x0", "y0", "x1", "y1")
    near = candidates(out, corners("ex", "ey", "ex", "ey"), others, corners("x0", "y0", "x1", "y1"), clearance).filter((F.col("other") != F.col("r_id")) & (box_distance(F.col("ex"), F.col("ey")) < clearance - 1e-3))
    order = Window.partitionBy("cp_id").orderBy("tail", "side")
    free = out.join(near.select("cp_id", "side").distinct(), ["cp_id", "side"], "left_anti")
    return free.select("cp_id", "r_id", "side", "ex", "ey", (F.col("inside") + clearance).alias("tail")).withColumn("nth", F.row_number().over(order))


def mask(boxes: DataFrame, cell: float) -> DataFrame:
    """(col, row, value): cells whose centre is in a box, with the greatest ``value`` of these."""

    def inner(a: str, b: str) -> Column:
        # Centres (k + 1/2) * cell strictly between the sides.
        return F.sequence(F.floor(F.col(a) / cell + 0.5).cast("int"), (F.ceil(F.col(b) / cell - 0.5) - 1).cast("int"))

    def some(a: str, b: str) -> Column:
        return F.floor(F.col(a) / cell + 0.5) <= F.ceil(F.col(b) / cell - 0.5) - 1

    rows = boxes.filter(some("x0", "x1") & some("y0", "y1"))
    return rows.select("value", F.explode(inner("x0", "x1")).alias("col"), F.col("y0"), F.col("y1")).select("value", "col", F.explode(inner("y0", "y1")).alias("row")).groupBy("col", "row").agg(F.max("value").alias("value"))
