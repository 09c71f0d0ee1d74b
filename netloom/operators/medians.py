"""The weighted geometric median: the place of the least weighted distance to a group's points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def median(points: list[tuple[float, float, float]], steps: int = 50, stop: float = 1e-4) -> tuple[float, float] | None:
    """Weiszfeld's iteration from the weighted mean; one point is itself, two have their middle, none has no median."""
    if not points:
        return None
    if len(points) <= 2:
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    whole = sum(w for *_, w in points) or 1.0
    x, y = sum(a * w for a, _, w in points) / whole, sum(b * w for _, b, w in points) / whole
    for _ in range(steps):
        pulls = [(a, b, w / max(math.dist((a, b), (x, y)), 1e-9)) for a, b, w in points]
        total = sum(p for *_, p in pulls) or 1.0
        new = sum(a * p for a, _, p in pulls) / total, sum(b * p for _, b, p in pulls) / total
        moved = math.dist(new, (x, y))
        x, y = new
        if moved < stop:
            break
    return x, y


def medians(points: DataFrame, key: str) -> DataFrame:
    """(key, x, y) of each group of points (key, x, y, weight).

    A median needs its whole group; groups here are a node's neighbours, a few points each.
    """
    groups = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "weight")]))).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [median([(p["x"], p["y"], p["weight"]) for p in ps]) for ps in batch.column("points").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([p[0] for p in found], pa.float64()), pa.array([p[1] for p in found], pa.float64())], [key, "x", "y"])

    return groups.mapInArrow(run, f"{key} {groups.schema[key].dataType.simpleString()}, x double, y double")
