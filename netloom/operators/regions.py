"""Relations between points, segments and regions: polygons with holes, and lines with a distance to keep.

A region is (r_id, rtype, lines, area): rings of an area or the line itself.  ``shaped``
adds its sides and envelope; all relations start from candidate pairs whose
envelopes meet, and then ask the exact question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from netloom.functions import polygons as P
from netloom.functions import scalars as S
from netloom.operators import sequences
from netloom.operators.spatial import candidates, corners, segment_box
from netloom.sources.shared import Tables

SEGMENT = ("x1", "y1", "x2", "y2")
ENVELOPE = ("ex0", "ey0", "ex1", "ey1")
SPANS = ArrayType(StructType([StructField("s0", DoubleType()), StructField("s1", DoubleType())]))
#: Pairs of cells or segments with sides that a task compares at once.
COMPARED = 1 << 19


def shaped(regions: DataFrame) -> DataFrame:
    """Regions with ``sides`` and their envelope."""
    rows = regions.withColumn("sides", P.sides(F.col("lines"), F.col("area"))).filter(F.size("sides") > 0).drop("lines")
    return rows.select("*", *[c.alias(n) for c, n in zip(P.envelope(F.col("sides")), ENVELOPE, strict=True)])


def axes(regions: DataFrame) -> DataFrame:
    """(r_id, side, ax, ay, bx, by): a line itself, or an area's rings."""
    return shaped(regions).select("r_id", F.posexplode("sides").alias("side", "s")).select("r_id", "side", "s.*")


def covered(places: DataFrame, regions: DataFrame) -> DataFrame:
    """Each place (x, y, ...) beside every area that covers it, the border included (``on_edge``), with all columns of both."""
    pairs = candidates(places, corners("x", "y", "x", "y"), shaped(regions.filter("area")), corners(*ENVELOPE))
    x, y, shape = F.col("x"), F.col("y"), F.col("sides")
    rows = pairs.withColumn("on_edge", P.border_distance(x, y, shape) <= 1e-9).withColumn("within", P.inside(x, y, shape))
    return rows.filter(F.col("within") | F.col("on_edge")).drop("within", "sides", *ENVELOPE)


def containing(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(cp_id, r_id, rtype, on_edge) of every point and each area that covers it, the border included."""
    # Points of one place share its answer; areas are asked once for each place.
    found = covered(points.select("x", "y").distinct(), regions).select("x", "y", "r_id", "rtype", "on_edge")
    return points.select("cp_id", "x", "y").join(found.hint("merge"), ["x", "y"]).select("cp_id", "r_id", "rtype", "on_edge")


def owning(points: DataFrame, regions: DataFrame, border_owns: bool = True) -> DataFrame:
    """(cp_id, r_id): the first area in order that covers a point; null where none does."""
    found = covered(points.select("x", "y").distinct(), regions)
    found = found if border_owns else found.filter("not on_edge")
    first = found.groupBy("x", "y").agg(F.min("r_id").alias("r_id"))
    return points.select("cp_id", "x", "y").join(first.hint("merge"), ["x", "y"], "left").select("cp_id", "r_id")


def least_dn(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(r_id, dn): the least diameter that points (cp_id, x, y, flow) in an area ask for, else the least of all points."""
    asked = points.groupBy("x", "y").agg(F.min(S.smallest_dn(F.col("flow"))).alias("dn"))
    inside = covered(asked, regions).groupBy("r_id").agg(F.min("dn").alias("dn"))
    least = asked.agg(F.min("dn").alias("least"))  # one row
    return regions.select("r_id").join(inside.hint("merge"), "r_id", "left").crossJoin(F.broadcast(least)).select("r_id", F.coalesce("dn", "least").alias("dn"))


def in_envelope(regions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Ids of regions whose envelope meets a box."""
    return shaped(regions).filter((F.col("ex0") <= x1) & (F.col("ex1") >= x0) & (F.col("ey0") <= y1) & (F.col("ey1") >= y0)).select("r_id")


def pairs_within(segments: DataFrame, regions: DataFrame, reach: float) -> DataFrame:
    """Segments (seg_id, x1, y1, x2, y2) beside regions whose envelopes are within reach, with all columns of both."""
    rows = segments.select("seg_id", *[F.col(c).cast("double").alias(c) for c in SEGMENT])
    return candidates(rows, segment_box(), shaped(regions), corners(*ENVELOPE), reach)


def passing(pairs: DataFrame) -> DataFrame:
    """Pairs of segments and regions without those that a side of the region's envelope or of the segment parts by more than its ``keep``."""
    a, b, c, d = map(F.col, SEGMENT)
    x0, y0, x1, y1 = map(F.col, ENVELOPE)
    # A margin of a millimetre outweighs rounding; exact questions follow.
    near = F.col("keep") + 1e-3
    boxes = (F.least(a, c) - near <= x1) & (F.greatest(a, c) + near >= x0) & (F.least(b, d) - near <= y1) & (F.greatest(b, d) + near >= y0)
    aside = F.abs(((y0 + y1) / 2 - b) * (c - a) - ((x0 + x1) / 2 - a) * (d - b))
    return pairs.filter(boxes & (aside <= (x1 - x0) / 2 * F.abs(d - b) + (y1 - y0) / 2 * F.abs(c - a) + near * S.distance(a, b, c, d)))


def blocked(segments: DataFrame, regions: DataFrame, reach: float) -> DataFrame:
    """(seg_id, r_id, dist): segments nearer to a region than its ``keep`` (metres, at most ``reach``), by more than a millimetre."""
    dist = P.segment_distance(*map(F.col, SEGMENT), F.col("sides"), F.col("area"))
    return passing(pairs_within(segments, regions, reach)).select("seg_id", "r_id", "keep", dist.alias("dist")).filter(F.col("dist") < F.col("keep") - 1e-3).drop("keep")


def spans(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """(seg_id, r_id, rtype, s0, s1): parts of segments inside areas, one for each crossing, as shares of the length."""
    found = P.spans_inside(*map(F.col, SEGMENT), F.col("sides"))
    return pairs_within(segments, regions.filter("area"), 0.0).select("seg_id", "r_id", "rtype", F.explode(found).alias("s")).select("seg_id", "r_id", "rtype", "s.s0", "s.s1")


def interior_blocked(segments: DataFrame, regions: DataFrame, erosion: float = 1e-3) -> DataFrame:
    """(seg_id, r_id): segments that go deeper into an area than ``erosion``; running along its border is none."""
    rows = pairs_within(segments, regions.filter("area"), 0.0)
    a, b, c, d = map(F.col, SEGMENT)
    rows = rows.withColumn("s", F.explode(P.spans_inside(a, b, c, d, F.col("sides"))))
    t = (F.col("s.s0") + F.col("s.s1")) / 2
    deep = P.border_distance(a + t * (c - a), b + t * (d - b), F.col("sides")) > erosion
    return rows.filter(deep).select("seg_id", "r_id").distinct()


def near_spans(pairs: DataFrame) -> DataFrame:
    """Pairs with ``near``: the parts (s0, s1) of the segment within ``keep`` of each side (``polygons.near_side``, whose expression is
    far too long to be interpreted side by side; the sums are the same, in the same order)."""
    big = 1e300

    def linear(p: np.ndarray, q: np.ndarray, low: np.ndarray | float, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two, holds = (low - p) / q, (high - p) / q, (p >= low) & (p <= high)
        return np.where(q != 0, np.minimum(one, two), np.where(holds, -big, big)), np.where(q != 0, np.maximum(one, two), np.where(holds, big, -big))

    def parts(batch: pa.RecordBatch) -> pa.Array:
        n = batch.column("sides").value_lengths().to_numpy(zero_copy_only=False)
        flat = batch.column("sides").flatten()
        ax, ay, bx, by = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by"))
        a, b, c, d, far = (np.repeat(batch.column(v).to_numpy(zero_copy_only=False), n) for v in (*SEGMENT, "keep"))
        with np.errstate(all="ignore"):
            dx, dy = c - a, d - b
            length = np.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
            ux, uy = (bx - ax) / length, (by - ay) / length
            along = linear((a - ax) * ux + (b - ay) * uy, dx * ux + dy * uy, 0.0, length)
            aside = linear((a - ax) * -uy + (b - ay) * ux, dx * -uy + dy * ux, -far, far)
            found = [(np.maximum(along[0], aside[0]), np.minimum(along[1], aside[1]))]
            for x, y in ((ax, ay), (bx, by)):
                square, half, rest = dx * dx + dy * dy, dx * (a - x) + dy * (b - y), (a - x) * (a - x) + (b - y) * (b - y) - far * far
                root = half * half - square * rest
                ok, r = (square > 0) & (root >= 0), np.sqrt(np.maximum(root, 0.0))
                found.append((np.where(ok, (-half - r) / square, big), np.where(ok, (-half + r) / square, -big)))
            s0 = np.maximum(np.minimum.reduce([np.where(p <= q, p, big) for p, q in found]), 0.0)
            s1 = np.minimum(np.maximum.reduce([np.where(p <= q, q, -big) for p, q in found]), 1.0)
            held = s0 < s1
        ends = np.append(0, np.cumsum(held))[np.append(0, np.cumsum(n))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s0[held]), pa.array(s1[held])], ["s0", "s1"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("sides").value_lengths().to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, "right")))
                some = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*some.columns, parts(some)], [*some.schema.names, "near"])
                low = high

    pairs = pairs.withColumn("keep", F.col("keep").cast("double"))
    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("near", SPANS)]))


def band_spans(segments: DataFrame, regions: DataFrame, reach: float) -> DataFrame:
    """(seg_id, r_id, s0, s1): parts of segments within a region's ``keep`` (at most ``reach``), parts inside an area included."""
    pairs = passing(pairs_within(segments, regions, reach)).select("seg_id", "r_id", *SEGMENT, "keep", "area", "sides")
    rows = near_spans(pairs)
    ends = tuple(map(F.col, SEGMENT))
    within = F.when(F.col("area"), P.spans_inside(*ends, F.col("sides"))).otherwise(F.array().cast(SPANS))
    rows = rows.select(F.struct("seg_id", "r_id").alias("k"), F.explode(F.concat("near", within)).alias("s")).select("k", "s.s0", "s.s1", F.lit(0).alias("v"))
    return sequences.merged_spans(rows, "k", "s0", "s1", "v").select("k.seg_id", "k.r_id", "s0", "s1")


def crossing_angles(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """(seg_id, r_id, angle): the least acute angle at which a segment crosses a side of a region."""
    ends = tuple(map(F.col, SEGMENT))
    rows = pairs_within(segments, regions, 0.0).select("seg_id", "r_id", *SEGMENT, F.explode("sides").alias("s")).filter(S.cross_properly(ends, P.ends(F.col("s"))))
    turn = S.turn_degrees(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("s.bx") - F.col("s.ax"), F.col("s.by") - F.col("s.ay"))
    return rows.groupBy("seg_id", "r_id").agg(F.round(F.min(F.least(turn, 180 - turn)), 6).alias("angle"))


def angle_verdicts(segments: DataFrame, regions: DataFrame, least: float) -> DataFrame:
    """(seg_id, legal): whether a segment crosses every region at ``least`` degrees or more; true where it crosses none."""
    found = crossing_angles(segments, regions).groupBy("seg_id").agg(F.min("angle").alias("angle"))
    return segments.select("seg_id").join(found, "seg_id", "left").select("seg_id", F.coalesce(F.col("angle") >= least - 1e-6, F.lit(True)).alias("legal"))


def mask(regions: DataFrame, cell: float) -> DataFrame:
    """(col, row, value): cells whose centre is within a region's ``keep`` (0: inside it), with the greatest ``value`` of these."""
    bounds = {"c0": F.col("ex0") - F.col("keep"), "c1": F.col("ex1") + F.col("keep"), "r0": F.col("ey0") - F.col("keep"), "r1": F.col("ey1") + F.col("keep")}
    rows = shaped(regions).select("value", "area", F.col("keep").cast("double").alias("keep"), "sides", *[F.floor(c / cell).cast("int").alias(n) for n, c in bounds.items()])
    rows = rows.filter("c0 <= c1 and r0 <= r1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c0, c1, r0, r1, keep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("c0", "c1", "r0", "r1", "keep"))
            area = batch.column("area").fill_null(False).to_numpy(zero_copy_only=False)
            number = batch.column("sides").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("sides").flatten()
            corners_ = [flat.field(n).to_numpy(zero_copy_only=False) for n in ("ax", "ay", "bx", "by")]
            high = r1.astype(np.int64) - r0 + 1
            ends, side_ends = np.cumsum((c1.astype(np.int64) - c0 + 1) * high), np.cumsum(number)
            size = max(1, COMPARED // int(number.max()))
            for low in range(0, int(ends[-1]), size):
                at = np.arange(low, min(low + size, int(ends[-1])))
                of = np.searchsorted(ends, at, "right")
                place = at - (ends[of] - (c1[of].astype(np.int64) - c0[of] + 1) * high[of])
                col, row = c0[of] + place // high[of], r0[of] + place % high[of]
                n = number[of]
                first = np.cumsum(n) - n
                side = np.arange(int(n.sum())) + np.repeat(side_ends[of] - n - first, n)
                ax, ay, bx, by = (c[side] for c in corners_)
                x, y = np.repeat((col + 0.5) * cell, n), np.repeat((row + 0.5) * cell, n)
                with np.errstate(all="ignore"):
                    # The sums of ``polygons.inside`` and ``scalars.point_to_segment``, in their order.
                    met = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
                    hit = area[of] & (np.add.reduceat(met.astype(np.int64), first) % 2 == 1)
                    if (keep > 0).any():
                        square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
                        t = np.maximum(0.0, np.minimum(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / np.where(square > 0, square, 1.0)))
                        dx, dy = ax + t * (bx - ax) - x, ay + t * (by - ay) - y
                        far = np.fmin.reduceat(np.sqrt(dx * dx + dy * dy), first)
                        hit |= (keep[of] > 0) & (far < keep[of] - 1e-9)
                cells = [pa.array(v[hit].astype(np.int32)) for v in (col, row)]
                yield pa.RecordBatch.from_arrays([*cells, batch.column("value").take(pa.array(of[hit]))], ["col", "row", "value"])

    kind = rows.schema["value"].dataType.simpleString()
    return rows.mapInArrow(run, f"col int, row int, value {kind}").groupBy("col", "row").agg(F.max("value").alias("value"))


def exits(points: DataFrame, regions: DataFrame, pair_width: float, most_tail: float, reach: float) -> DataFrame:
    """(cp_id, r_id, side, ex, ey, tail, nth): straight ways out of a point's building, shortest first.

    points (cp_id, x, y, r_id, keep): with the building that holds each (``keep``: what
    to keep from it); regions (r_id, rtype, lines, area, keep): everything to keep off.
    A way leaves through the nearest point of a side (the outer normal, where the
    point is on it) and ends where it leaves the building's band.  Where another
    band begins sooner than a pair of pipes is wide, it ends in the middle of that
    gap.  Ways that come nearer to others than their bands, go back into the
    building, or are longer inside than ``most_tail`` are left out; so are ways to a
    corner, which are ways of the neighbouring side.
    """
    tables = Tables(points.sparkSession)  # every step is read several times
    regions = tables.write(regions, "exit-regions")
    # Points of one place in one building have the same ways out.
    spot = ["x", "y", "r_id", "keep"]
    points = tables.write(points.select("cp_id", *spot), "exit-points")
    places = tables.write(points.select(*spot).distinct().withColumn("place", F.monotonically_increasing_id()), "exit-places")
    buildings = shaped(regions.filter("area")).select("r_id", "sides", *ENVELOPE)
    rows = places.join(buildings.hint("merge"), "r_id").select("place", "r_id", "x", "y", "keep", "sides", *ENVELOPE, F.posexplode("sides").alias("side", "s"))
    x, y, s = F.col("x").cast("double"), F.col("y").cast("double"), F.col("s")
    t = S.position_on(x, y, *P.ends(s))
    qx, qy = s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])
    far = S.distance(x, y, qx, qy)
    length = S.distance(*P.ends(s))
    nx, ny = -(s["by"] - s["ay"]) / length, (s["bx"] - s["ax"]) / length
    turned = F.when(P.inside(x + nx * 0.1, y + ny * 0.1, F.col("sides")), -1.0).otherwise(1.0)
    on = far < 1e-6
    corner = (F.least(t, 1 - t) * length < 1e-3) & ~on
    wide = S.distance(*map(F.col, ENVELOPE)) + 2 * F.col("keep") + 1 + reach
    rows = rows.filter(~corner).select("place", "r_id", "side", x.alias("x1"), y.alias("y1"), "keep", far.alias("foot"), wide.alias("wide"), F.when(on, nx * turned).otherwise((qx - x) / far).alias("ux"), F.when(on, ny * turned).otherwise((qy - y) / far).alias("uy"))
    rows = rows.select("*", F.struct("place", "side").alias("seg_id"), (F.col("x1") + F.col("ux") * F.col("wide")).alias("x2"), (F.col("y1") + F.col("uy") * F.col("wide")).alias("y2"))
    rows = tables.write(rows, "exit-rays")
    bands = band_spans(rows, regions, reach).withColumnRenamed("r_id", "other")
    met = tables.write(rows.select("seg_id", "r_id", "foot", "wide").join(bands, "seg_id"), "exit-bands").select("seg_id", (F.col("other") == F.col("r_id")).alias("own"), "foot", (F.col("s0") * F.col("wide")).alias("from"), (F.col("s1") * F.col("wide")).alias("to"))
    left = met.filter(F.col("own") & (F.col("from") <= F.col("foot") + 1e-6) & (F.col("to") >= F.col("foot") - 1e-6)).groupBy("seg_id").agg(F.max("to").alias("out"))
    after = met.filter("not own").join(left, "seg_id").filter(F.col("from") > F.col("out") + 1e-6).groupBy("seg_id").agg(F.min("from").alias("next"))
    ways = rows.join(left, "seg_id").join(after, "seg_id", "left").filter(F.col("out") < F.col("wide") - 1e-6)
    tail = F.when(F.col("next") - F.col("out") < pair_width, (F.col("next") + F.col("out")) / 2).otherwise(F.col("out"))
    ways = ways.select("seg_id", "place", "r_id", "side", "x1", "y1", "keep", tail.alias("tail"), "ux", "uy").filter(F.col("tail") - F.col("keep") <= most_tail + 1e-6)
    ways = ways.select("*", (F.col("x1") + F.col("tail") * F.col("ux")).alias("x2"), (F.col("y1") + F.col("tail") * F.col("uy")).alias("y2"))
    ways = tables.write(ways, "exit-ways")
    close = blocked(ways, regions, reach).join(ways.select("seg_id", F.col("r_id").alias("own")), "seg_id").filter("r_id != own").select("seg_id").distinct()
    back = ways.join(buildings.hint("merge"), "r_id").filter(F.size(P.spans_inside(*map(F.col, SEGMENT), F.col("sides"))) > 1).select("seg_id")
    free = ways.join(close, "seg_id", "left_anti").join(back, "seg_id", "left_anti")
    # Neighbouring sides may lead the same way out.
    order = Window.partitionBy("place").orderBy(F.round("tail", 6), "side")
    found = free.select("place", "side", F.round("x2", 6).alias("ex"), F.round("y2", 6).alias("ey"), F.round("tail", 6).alias("tail"), F.row_number().over(order).alias("nth"))
    return points.join(places.hint("merge"), spot).join(found.hint("merge"), "place").select("cp_id", "r_id", "side", "ex", "ey", "tail", "nth")
