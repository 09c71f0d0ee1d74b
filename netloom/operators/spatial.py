"""Spatial relations without a geometry library: equi-joins on grid bins, then exact predicates.

A bin join never compares rows that share no bin.  Bins come in sizes: a box lies in
at most four bins of its own size class, and two boxes are compared in bins of the
larger one's class, so neither small nor very large boxes make many rows.  The key says
which side is the larger, so two small boxes never meet in a large bin.  Bins that
hold very many rows are ordinary skewed keys of a sort-merge join, which adaptive
execution splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.sources.shared import Tables

BIN = 64
#: Bins of one class are so many times as wide as those of the class before.
STEP = 4

Box = tuple[Column, Column, Column, Column]


def corners(*names: str) -> Box:
    return tuple(F.col(n).cast("double") for n in names)


def segment_box(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Box:
    a, b, c, d = corners(x1, y1, x2, y2)
    return F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)


def size_class(box: Box) -> Column:
    wide = F.greatest(box[2] - box[0], box[3] - box[1])
    return F.when(wide > BIN, F.ceil(F.log(wide / BIN) / math.log(STEP) - 1e-9)).otherwise(0).cast("int")


def sharing_bins(left: DataFrame, left_box: Box, right: DataFrame, right_box: Box, reach: float = 0.0) -> DataFrame:
    """Rows of both sides that share a bin of the larger one's class, once for each such bin, with ``_a`` and ``_b``, their
    boxes (one widened by ``reach``), and the bin (``_class``, ``_bx``, ``_by``).

    One small aggregate reads which size classes there are (some ten at most).
    """

    def placed(df: DataFrame, box: Box, mark: str, more: float) -> DataFrame:
        wide = (box[0] - more, box[1] - more, box[2] + more, box[3] + more)
        return df.withColumns({f"_{mark}": F.struct(*[c.alias(n) for c, n in zip(wide, ("x0", "y0", "x1", "y1"), strict=True)]), f"_{mark}c": size_class(wide)})

    a, b = placed(left, left_box, "a", reach), placed(right, right_box, "b", 0.0)
    of = {m: {r[0] for r in df.select(f"_{m}c").distinct().collect() if r[0] is not None} for m, df in (("a", a), ("b", b))}
    # Where two rows meet: in bins of one class, which is that of both, or of one while the other's is less.
    met = [(c, "ab") for c in sorted(of["a"] & of["b"])] + [(c, m) for m, o in ("ab", "ba") for c in sorted(of[m]) if any(k < c for k in of[o])]

    def binned_(df: DataFrame, mark: str) -> DataFrame:
        places = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in met or [(0, "ab")]])
        own = F.col(f"_{mark}c")
        at = F.filter(places, lambda p: F.when(F.contains(p["m"], F.lit(mark)), p["c"] == own).otherwise(p["c"] > own))
        rows = df.withColumn("_at", F.explode(at)).withColumns({"_class": F.col("_at.c"), "_larger": F.col("_at.m")}).drop("_at")
        size = F.lit(float(BIN)) * F.pow(F.lit(float(STEP)), F.col("_class"))

        def span(low: str, high: str) -> Column:
            return F.sequence(F.floor(F.col(f"_{mark}.{low}") / size).cast("long"), F.floor(F.col(f"_{mark}.{high}") / size).cast("long"))

        return rows.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("y0", "y1")))

    # Sizes guessed from files know nothing of exploded rows and shapes; a broadcast by such a guess may not fit the driver.
    return binned_(a, "a").hint("merge").join(binned_(b, "b"), ["_class", "_larger", "_bx", "_by"]).drop("_larger", "_ac", "_bc")


def candidates(left: DataFrame, left_box: Box, right: DataFrame, right_box: Box, reach: float = 0.0) -> DataFrame:
    """Rows of both sides whose boxes, one widened by ``reach``, overlap or touch; each pair once.

    Columns of the two sides must have different names.
    """
    rows = sharing_bins(left, left_box, right, right_box, reach)
    size = F.lit(float(BIN)) * F.pow(F.lit(float(STEP)), F.col("_class"))
    meet = (F.col("_a.x0") <= F.col("_b.x1")) & (F.col("_b.x0") <= F.col("_a.x1")) & (F.col("_a.y0") <= F.col("_b.y1")) & (F.col("_b.y0") <= F.col("_a.y1"))
    # A pair is taken in one bin only: the one of the overlap's lower corner.
    home = (F.col("_bx") == F.floor(F.greatest("_a.x0", "_b.x0") / size)) & (F.col("_by") == F.floor(F.greatest("_a.y0", "_b.y0") / size))
    return rows.filter(meet & home).drop("_class", "_bx", "_by", "_a", "_b")


def bins(x0: Column, y0: Column, x1: Column, y1: Column, size: int = BIN) -> Column:
    """All bins of a box, as an array of (bx, by)."""

    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int"))

    return F.flatten(F.transform(span(x0, x1), lambda bx: F.transform(span(y0, y1), lambda by: F.struct(bx.alias("bx"), by.alias("by")))))


def binned(df: DataFrame, x0: str, y0: str, x1: str, y1: str, margin: float = 0, size: int = BIN) -> DataFrame:
    c = F.col
    return df.withColumn("_bin", F.explode(bins(c(x0) - margin, c(y0) - margin, c(x1) + margin, c(y1) + margin, size)))


def containing(points: DataFrame, rects: DataFrame) -> DataFrame:
    """(cp_id, r_id, on_edge) of every point and each box that covers it, edges included."""
    edge = (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")) | (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))
    pairs = candidates(points.select("cp_id", "x", "y"), corners("x", "y", "x", "y"), rects.select("r_id", "rtype", "x0", "y0", "x1", "y1"), corners("x0", "y0", "x1", "y1"))
    return pairs.select("cp_id", "r_id", "rtype", edge.alias("on_edge"))


def owning(points: DataFrame, rects: DataFrame) -> DataFrame:
    """(cp_id, r_id): the first building that covers a point; null where none does."""
    found = containing(points, rects.filter("rtype = 'oks'")).groupBy("cp_id").agg(F.min("r_id").alias("r_id"))
    return points.select("cp_id").join(found, "cp_id", "left")


def building_dn(points: DataFrame, rects: DataFrame) -> DataFrame:
    """(r_id, dn): the least diameter that points in a building ask for, else the least of all."""
    asked = points.withColumn("dn", S.smallest_dn(F.col("flow")))
    inside = containing(points, rects.filter("rtype = 'oks'")).join(asked.select("cp_id", "dn"), "cp_id").groupBy("r_id").agg(F.min("dn").alias("dn"))
    least = asked.agg(F.min("dn").alias("least"))
    return rects.filter("rtype = 'oks'").select("r_id").join(inside, "r_id", "left").crossJoin(F.broadcast(least)).select("r_id", F.coalesce("dn", "least").alias("dn"))


def overlapping(rects: DataFrame) -> DataFrame:
    """(a, b): boxes that touch or overlap, each pair once."""
    other = rects.select(F.col("r_id").alias("r_id_b"), *[F.col(c).alias(f"{c}_b") for c in ("x0", "y0", "x1", "y1")])
    pairs = candidates(rects.select("r_id", "x0", "y0", "x1", "y1"), corners("x0", "y0", "x1", "y1"), other, corners("x0_b", "y0_b", "x1_b", "y1_b"))
    return pairs.filter("r_id < r_id_b").select(F.col("r_id").alias("a"), F.col("r_id_b").alias("b"))


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(cp_id, node_id, dist2): pairs of points at most ``radius`` apart."""
    size = max(BIN, math.ceil(radius))

    def at(df: DataFrame, name: str) -> Column:  # squares of whole numbers need long
        return F.col(name).cast("long" if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int") else df.schema[name].dataType)

    p = binned(points, "x", "y", "x", "y", radius, size).select("cp_id", at(points, "x").alias("x"), at(points, "y").alias("y"), "_bin")
    o = binned(others, "x", "y", "x", "y", 0, size).select("node_id", at(others, "x").alias("ox"), at(others, "y").alias("oy"), "_bin")
    d = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return p.join(o, "_bin").select("cp_id", "node_id", d.alias("dist2")).filter(F.col("dist2") <= radius * radius)


def extent(*tables: DataFrame) -> tuple[int, float]:
    """Rows of the last table, and the diagonal of all tables' (x, y)."""
    found = [t.agg(F.count("*").alias("n"), F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"), F.max("x").cast("double").alias("x1"), F.max("y").cast("double").alias("y1")).first() for t in tables]
    some = [r for r in found if r["n"]]
    if not some:
        return 0, 0.0
    return found[-1]["n"], math.hypot(max(r["x1"] for r in some) - min(r["x0"] for r in some), max(r["y1"] for r in some) - min(r["y0"] for r in some))


def nearest(points: DataFrame, others: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(cp_id, node_id, dist2, nth): the k nearest, ties by id; within a radius, or however far.

    Without a radius, rings widen: each round answers the points that have k within
    its radius, and only the others go on with twice that, so crowded places never
    make pairs over wide rings.  Rounds are written tables.
    """
    order = Window.partitionBy("cp_id").orderBy("dist2", "node_id")

    def ranked(some: DataFrame, far: float) -> DataFrame:
        return within(some, others, far).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)

    if radius is not None:
        return ranked(points, radius)
    number, wide = extent(points, others)
    far = max(1.0, wide * math.sqrt(k / max(number, 1) / math.pi))
    tables, left, done = Tables(points.sparkSession), points.select("cp_id", "x", "y"), []
    while True:
        last = far >= wide
        found = tables.write(ranked(left, wide + 1.0 if last else far), "nearest")
        if last:
            done.append(found)
            break
        full = found.groupBy("cp_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, number)).select("cp_id")
        done.append(found.join(full, "cp_id", "left_semi"))
        left, seen = tables.counted(left.join(full, "cp_id", "left_anti"), "nearest-left")
        if not seen["n"]:
            break
        far *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def attachments(segments: DataFrame, chambers: DataFrame, radius: float = 0.5) -> DataFrame:
    """(node_id, n): ends of segments at a chamber."""
    ends = segments.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(F.monotonically_increasing_id().alias("cp_id"), "e.x", "e.y")
    return within(ends, chambers, radius).groupBy("node_id").agg(F.count("*").alias("n"))


def degrees(chambers: DataFrame, attached: DataFrame, used: DataFrame) -> DataFrame:
    """Chambers with ``pipes``, existing attachments (node_id, n), and ``used``, new ones (node_id, used)."""
    out = chambers.join(attached, "node_id", "left").join(used, "node_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"pipes": F.coalesce("n", zero), "used": F.coalesce("used", zero)}).drop("n")


def free_candidates(points: DataFrame, chambers: DataFrame, radius: float) -> DataFrame:
    """Points with no chamber within the radius."""
    return points.join(within(points, chambers, radius).select("cp_id"), "cp_id", "left_anti")


def near_segments(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(cp_id, seg_id, dist): pairs at most ``reach`` apart."""
    pairs = candidates(points.select("cp_id", "x", "y"), corners("x", "y", "x", "y"), segments.select("seg_id", "x1", "y1", "x2", "y2"), segment_box(), reach)
    return pairs.select("cp_id", "seg_id", F.round(S.point_to_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))), 6).alias("dist")).filter(F.col("dist") <= reach)


def nearest_on_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(cp_id, seg_id, dist): for each point the nearest segment, however far, ties by id; by widening rings as in ``nearest``."""
    ends = segments.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("e.x", "e.y")
    number, wide = extent(points, ends)
    if not number:
        return near_segments(points, segments, 0.0)
    far = max(1.0, wide / math.sqrt(number))
    tables, left, done = Tables(points.sparkSession), points.select("cp_id", "x", "y"), []
    while True:
        best = near_segments(left, segments, min(far, wide + 1.0)).groupBy("cp_id").agg(F.min(F.struct("dist", "seg_id")).alias("b"))
        done.append(tables.write(best.select("cp_id", "b.seg_id", "b.dist"), "nearest"))
        left, seen = tables.counted(left.join(done[-1].select("cp_id"), "cp_id", "left_anti"), "nearest-left")
        if not seen["n"] or far >= wide:
            break
        far *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tie_candidates(chambers: DataFrame, segments: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """(x_cm, y_cm, source, x, y): places where new pipes may begin: chambers (source 1), places every ``step`` metres along
    segments (2), and the places nearest to points on their nearest segment (3); one for each centimetre, the first source wins."""
    length = S.distance(*map(F.col, ("x1", "y1", "x2", "y2")))
    t = F.col("k") * step / F.when(length > 0, length).otherwise(1)
    samples = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(length / step).cast("int"))))
    rows = chambers.select(F.lit(1).alias("source"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.unionByName(samples.select(F.lit(2).alias("source"), (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y")))
    spots = points.select("cp_id", "x", "y")
    feet = nearest_on_segments(spots, segments).join(spots, "cp_id").join(segments, "seg_id")
    u = S.position_on(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    rows = rows.unionByName(feet.select(F.lit(3).alias("source"), (F.col("x1") + u * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + u * (F.col("y2") - F.col("y1"))).alias("y")))
    cm = [S.rounded(F.round(F.col(v) * 100, 6)).alias(f"{v}_cm") for v in ("x", "y")]
    return rows.groupBy(*cm).agg(F.min(F.struct("source", "x", "y")).alias("b")).select("x_cm", "y_cm", "b.source", "b.x", "b.y")


def tiles(rects: DataFrame, size: int, margin: int) -> DataFrame:
    """(r_id, tc, tr): every tile that a box, widened by the margin, reaches."""
    return binned(rects, "x0", "y0", "x1", "y1", margin, size).select("r_id", F.col("_bin.bx").alias("tc"), F.col("_bin.by").alias("tr"))


def crossings(segments: DataFrame) -> DataFrame:
    """(a, b): segments that cross in the inside of both, each pair once."""
    names = ("x1", "y1", "x2", "y2")
    other = segments.select(F.col("seg_id").alias("seg_id_b"), *[F.col(c).alias(f"{c}_b") for c in names])
    cross = S.cross_properly(tuple(map(F.col, names)), tuple(F.col(f"{c}_b") for c in names))
    pairs = candidates(segments.select("seg_id", *names), segment_box(), other, segment_box(*[f"{c}_b" for c in names]))
    return pairs.filter((F.col("seg_id") < F.col("seg_id_b")) & cross).select(F.col("seg_id").alias("a"), F.col("seg_id_b").alias("b"))


def spans(segments: DataFrame, rects: DataFrame) -> DataFrame:
    """(seg_id, r_id, s0, s1): the part of each segment inside each box, as shares of its length (clipped, exact).

    Boxes are convex, so one segment has one span per box.
    """
    s = segments.select("seg_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    r = rects.select("r_id", "rtype", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = candidates(s, segment_box(), r, corners("rx0", "ry0", "rx1", "ry1"))

    def part(a: str, d: Column, low: str, high: str) -> tuple[Column, Column, Column]:
        """Entry and exit along one axis; a segment parallel to it is in or out as a whole."""
        p, q = (F.col(low) - F.col(a)) / F.when(d != 0, d), (F.col(high) - F.col(a)) / F.when(d != 0, d)
        out = (d == 0) & ((F.col(a) < F.col(low)) | (F.col(a) > F.col(high)))
        return F.coalesce(F.least(p, q), F.lit(0.0)), F.coalesce(F.greatest(p, q), F.lit(1.0)), out

    ax, bx, nx = part("x1", F.col("x2") - F.col("x1"), "rx0", "rx1")
    ay, by, ny = part("y1", F.col("y2") - F.col("y1"), "ry0", "ry1")
    return pairs.filter(~nx & ~ny).select("seg_id", "r_id", "rtype", (F.round(F.greatest(ax, ay, F.lit(0.0)), 6) + 0.0).alias("s0"), (F.round(F.least(bx, by, F.lit(1.0)), 6) + 0.0).alias("s1")).filter("s1 > s0")
