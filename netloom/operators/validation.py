"""Checks of a planned network, as relations of its faults: an empty result is a sound network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.operators import regions, sequences, spatial


def loose_ends(segments: DataFrame, nodes: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """(seg_id, end, node_id, off): ends that are not where the node is that they name; ``off`` is null without such a node.

    segments (seg_id, from_id, to_id, x1, y1, x2, y2), nodes (node_id, x, y).
    """
    ends = segments.select("seg_id", F.inline(F.array(F.struct(F.lit("from").alias("end"), F.col("from_id").alias("node_id"), F.col("x1").alias("ex"), F.col("y1").alias("ey")), F.struct(F.lit("to").alias("end"), F.col("to_id").alias("node_id"), F.col("x2").alias("ex"), F.col("y2").alias("ey")))))
    met = ends.join(nodes.select("node_id", "x", "y"), "node_id", "left").withColumn("off", S.distance(*map(F.col, ("ex", "ey", "x", "y"))))
    return met.filter("off is null or off >= %r" % tolerance).select("seg_id", "end", "node_id", F.round("off", 6).alias("off"))


def dangling(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (node_id, ...) to nodes that are not there."""
    return references.join(nodes.select("node_id"), "node_id", "left_anti")


def inner_points(edges: DataFrame) -> DataFrame:
    """(tree, n, children): edges that end at a point (``point`` true) and go on all the same."""
    children = edges.filter("parent > 0").groupBy("tree", F.col("parent").alias("n")).agg(F.count("*").alias("children"))
    return edges.filter("point").select("tree", "n").join(children, ["tree", "n"])


def crowded(degrees: DataFrame, most: int = 4) -> DataFrame:
    """(node_id, degree): chambers whose existing and new pipes are more than ``most``; degrees (node_id, pipes, used)."""
    return degrees.select("node_id", (F.col("pipes") + F.col("used")).alias("degree")).filter(F.col("degree") > most)


def crossing(segments: DataFrame) -> DataFrame:
    """(a, b): segments that cross away from shared nodes."""
    return spatial.crossings(segments)


def sharp_turns(points: DataFrame, key: str, order: str, most: float = 90.0, tolerance: float = 0.05) -> DataFrame:
    """Inner vertices that turn by more than ``most`` degrees."""
    return sequences.turns(points, key, order).filter(F.col("turn") > most + tolerance)


def bent_specials(points: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, points): stretches of consecutive special vertices with more than two points.

    points (key, order, special); a special piece goes straight through.
    """
    island = F.sum(F.when(F.col("special"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy(order))
    runs = points.withColumn("_g", island).filter("special").groupBy(key, "_g").agg(F.min(order).alias("first"), F.count("*").alias("points"))
    return runs.filter("points > 2").select(key, "first", "points")


def missing_exits(exits: DataFrame, vertices: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(cp_id): points whose canonical exit (cp_id, ex, ey) is no vertex (cp_id, x, y) of their own line."""
    near = S.distance(*map(F.col, ("ex", "ey", "x", "y"))) <= tolerance
    met = exits.join(vertices, "cp_id").filter(near).select("cp_id").distinct()
    return exits.select("cp_id").join(met, "cp_id", "left_anti")


def through_buildings(segments: DataFrame, buildings: DataFrame, own: DataFrame) -> DataFrame:
    """(seg_id, r_id, inside_m): segments with a part inside a box that is not the one their own tail ends in.

    own (seg_id, r_id): the building that a segment may enter.
    """
    length = S.distance(*map(F.col, ("x1", "y1", "x2", "y2")))
    found = spatial.spans(segments, buildings).join(own, ["seg_id", "r_id"], "left_anti").join(segments.select("seg_id", length.alias("length")), "seg_id")
    return found.select("seg_id", "r_id", F.round((F.col("s1") - F.col("s0")) * F.col("length"), 3).alias("inside_m")).filter("inside_m > 0.01")


def through_regions(segments: DataFrame, buildings: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(seg_id, r_id, inside_m): as ``through_buildings``, for polygons."""
    length = S.distance(*map(F.col, ("x1", "y1", "x2", "y2")))
    found = regions.spans(segments, buildings).join(segments.select("seg_id", length.alias("length")), "seg_id")
    found = found if own is None else found.join(own, ["seg_id", "r_id"], "left_anti")
    total = F.sum((F.col("s1") - F.col("s0")) * F.col("length"))
    return found.groupBy("seg_id", "r_id").agg(total.alias("m")).filter("m > 0.01").select("seg_id", "r_id", F.round("m", 3).alias("inside_m"))


def branching(edges: DataFrame, most_vertices: int, tail_m: float) -> DataFrame:
    """(what, n): forks outside chambers, edges of too many vertices, short tails of points, points that share a chamber.

    edges (tree, n, parent, vertices, len_m, point, chamber): ``chamber``: the edge ends in one.
    """
    children = edges.filter("parent > 0").groupBy("tree", F.col("parent").alias("n")).agg(F.count("*").alias("children"))
    rows = edges.join(children, ["tree", "n"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    faults = F.array(
        F.when((F.col("children") > 1) & ~F.col("chamber"), "FORK_OUTSIDE_CHAMBER"),
        F.when(F.col("vertices") > most_vertices, "MANY_VERTICES"),
        F.when(F.col("point") & (F.col("len_m") < tail_m), "SHORT_TAIL"),
    )
    single = rows.select(F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("what"))
    shared = edges.filter("point").groupBy("tree", "parent").agg(F.count("*").alias("points")).filter("points > 1").select(F.lit("SHARED_CHAMBER").alias("what"))
    return single.unionByName(shared).groupBy("what").agg(F.count("*").alias("n"))
