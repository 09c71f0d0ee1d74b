"""Depth profiles: each crossing asks for a depth on a stretch of an edge; ramps lead there and back to the normal depth.

Close crossings share one shelf, that of the larger deviation.  Merging goes on
until nothing is close, so an edge is one group; pieces are plain rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    normal: float = 3.0
    least: float = 0.7
    slope: float = 0.1
    #: Crossings whose shelves would be nearer than their ramps and this gap are one.
    gap: float = 5.0


def merged(wanted: list[tuple[float, float, float]], r: Rules) -> list[tuple[float, float, float]]:
    """Stretches (start, end, depth) without close neighbours."""
    rows = sorted(wanted)
    while True:
        for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
            ramps = (abs(a[2] - r.normal) + abs(b[2] - r.normal)) / r.slope
            if b[0] - a[1] < ramps + r.gap:
                depth = max((a[2], b[2]), key=lambda h: (abs(h - r.normal), h))
                rows[i : i + 2] = [(a[0], max(a[1], b[1]), depth)]
                break
        else:
            return rows


def profile(length: float, wanted: list[tuple[float, float, float]], r: Rules = Rules()) -> list[tuple[float, float, float, float]]:
    """Pieces (s0, s1, depth at s0, depth at s1) from 0 to ``length``, constant and ramps in turn; equal neighbours are one."""
    knots: list[tuple[float, float]] = []
    for start, end, depth in merged([(max(0.0, a), min(length, b), h) for a, b, h in wanted if b > 0 and a < length], r):
        run = abs(depth - r.normal) / r.slope
        knots += [(start - run, r.normal), (start, depth), (end, depth), (end + run, r.normal)]
    out: list[tuple[float, float, float, float]] = []

    def put(s0: float, s1: float, h0: float, h1: float) -> None:
        a, b = max(s0, 0.0), min(s1, length)
        if b - a <= 1e-9:
            return
        if s1 > s0 and (a, b) != (s0, s1):  # clipped ramps keep their slope
            h0, h1 = (h0 + (h1 - h0) * (t - s0) / (s1 - s0) for t in (a, b))
        if out and out[-1][2] == out[-1][3] == h0 == h1:
            out[-1] = (out[-1][0], b, h0, h1)
        else:
            out.append((a, b, h0, h1))

    at, depth = 0.0, r.normal
    for s, h in knots:
        if s > at:
            put(at, s, depth, h)
        at, depth = max(at, s) if s > at else s, h
    put(at, length, depth, r.normal if not knots or at >= knots[-1][0] else depth)
    return out


def profiles(edges: DataFrame, crossings: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(edge, s0, s1, h0, h1).  edges (edge, length), crossings (edge, start, end, depth)."""
    key = edges.schema["edge"].dataType.simpleString()
    asked = crossings.filter("depth >= 0").groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("start", "end", "depth"))).alias("asked"))
    rows = edges.select("edge", F.col("length").cast("double")).join(asked, "edge", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(edge, *piece) for edge, length, found in zip(*(batch.column(c).to_pylist() for c in ("edge", "length", "asked")), strict=True) for piece in profile(length, [(x["start"], x["end"], x["depth"]) for x in found or ()], r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.column("edge").type), *(pa.array([x[i] for x in out], pa.float64()) for i in range(1, 5))], ["edge", "s0", "s1", "h0", "h1"])

    return rows.mapInArrow(run, f"edge {key}, s0 double, s1 double, h0 double, h1 double")


def warnings(edges: DataFrame, crossings: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(edge, code): stretches whose depth cannot be had (a depth below 0), and those nearer to an edge's end than their ramp is long."""
    rows = crossings.join(edges.select("edge", F.col("length").cast("double")), "edge")
    run = F.abs(F.col("depth") - r.normal) / r.slope
    short = (F.col("start") - run < -1e-9) | (F.col("end") + run > F.col("length") + 1e-9)
    code = F.when(F.col("depth") < 0, "DEPTH_OBSTACLE_UNRESOLVED").when(short, "DEPTH_SLOPE_EXCEEDED")
    return rows.select("edge", code.alias("code")).filter("code is not null").distinct()


def violations(pieces: DataFrame, r: Rules = Rules()) -> DataFrame:
    """(edge, s0, what): pieces that are too shallow or too steep."""
    shallow = F.least("h0", "h1") < r.least - 1e-9
    steep = F.abs(F.col("h1") - F.col("h0")) > r.slope * (F.col("s1") - F.col("s0")) + 1e-9
    return pieces.filter(shallow | steep).select("edge", "s0", F.when(shallow, "SHALLOW").otherwise("STEEP").alias("what"))
