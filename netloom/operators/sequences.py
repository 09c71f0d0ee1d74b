"""Operators on ordered rows: islands, splits, cumulative lengths, turns, clamps, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S


def merged_spans(spans: DataFrame, key: str, start: str, end: str, value: str) -> DataFrame:
    """(key, start, end, value): unions of overlapping or touching spans with their greatest value."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col(start) <= before, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.max(value).alias(value)).drop("_island")


def split_spans(spans: DataFrame, lengths: DataFrame, key: str, start: str, end: str, value: str) -> DataFrame:
    """(key, start, end, value): [0, length] cut at every border; each piece with the greatest value over it, else 0."""
    cuts = spans.select(key, F.explode(F.array(start, end)).alias("c")).union(lengths.select(key, F.explode(F.array(F.lit(0).cast("double"), F.col("length").cast("double"))).alias("c"))).distinct()
    pieces = cuts.withColumn("to", F.lead("c").over(Window.partitionBy(key).orderBy("c"))).filter("to is not null")
    over = spans.select(F.col(key).alias("_k"), F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(value).alias("_v"))
    middle = (F.col("c") + F.col("to")) / 2
    return pieces.join(over, (F.col(key) == F.col("_k")) & (F.col("_a") <= middle) & (middle <= F.col("_b")), "left").groupBy(key, F.col("c").alias(start), F.col("to").alias(end)).agg(F.coalesce(F.max("_v"), F.lit(0)).alias(value))


def cumulative(points: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with ``way``: the length of the line up to each vertex."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(S.distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y)), F.lit(0.0))
    return points.withColumn("_step", step).withColumn("way", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def turns(points: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Inner vertices with ``turn``, in degrees."""
    w = Window.partitionBy(key).orderBy(order)
    ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    return points.withColumn("turn", S.turn_degrees(ax, ay, bx, by)).filter("turn is not null")


def simplified(points: DataFrame, key: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Vertices without repeated ones and those that go straight on."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.coalesce((F.lag(x).over(w) == F.col(x)) & (F.lag(y).over(w) == F.col(y)), F.lit(False))
    kept = points.withColumn("_same", same).filter("not _same").drop("_same")
    ax, ay = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    bx, by = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    straight = F.coalesce((ax * by == ay * bx) & (ax * bx + ay * by > 0), F.lit(False))
    return kept.withColumn("_straight", straight).filter("not _straight").drop("_straight")


def clamped(events: DataFrame) -> DataFrame:
    """Events with ``shown``: the greatest progress so far, 0 to 100."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.greatest(F.lit(0), F.least(F.lit(100), F.max("progress").over(w))))


def thinned(rows: DataFrame, key: str, order: str, step: int, must: Column) -> DataFrame:
    """Every ``step``-th row of a key, and the rows that must stay."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(((F.col("_nth") - 1) % step == 0) | must).drop("_nth")


def interpolated(at: Column, s0: Column, s1: Column, h0: Column, h1: Column) -> Column:
    """A value between two places, linearly."""
    return h0 + (h1 - h0) * (at - s0) / F.when(s1 > s0, s1 - s0).otherwise(1)
