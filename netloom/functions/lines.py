"""Lines as arrays of (x, y): lengths, places along them, parts and splits, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions import scalars as S

POINTS = "array<struct<x:double,y:double>>"


def steps(line: Column) -> Column:
    """The segments of a line: (ax, ay, bx, by, at, length), ``at`` being the way to each one's start."""
    n = F.size(line)
    pairs = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    begin = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double,at:double,length:double>>").alias("out"))

    def add(done: Column, s: Column) -> Column:
        far = S.distance(s["ax"], s["ay"], s["bx"], s["by"])
        own = F.struct(*[s[c].cast("double").alias(c) for c in ("ax", "ay", "bx", "by")], done["at"].alias("at"), far.alias("length"))
        return F.struct((done["at"] + far).alias("at"), F.concat(done["out"], F.array(own)).alias("out"))

    return F.aggregate(pairs, begin, add)["out"]


def length(line: Column) -> Column:
    last = F.try_element_at(steps(line), F.lit(-1))
    return F.when(F.size(line) < 2, 0.0).otherwise(last["at"] + last["length"])


def point_at(line: Column, way: Column) -> Column:
    """The point (x, y) so far along a line; its ends for ways before or beyond it."""
    found = steps(line)
    on = F.coalesce(F.try_element_at(F.filter(found, lambda s: s["at"] + s["length"] >= way), F.lit(1)), F.try_element_at(found, F.lit(-1)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (way - on["at"]) / F.when(on["length"] > 0, on["length"]).otherwise(1)))
    return F.struct((on["ax"] + t * (on["bx"] - on["ax"])).alias("x"), (on["ay"] + t * (on["by"] - on["ay"])).alias("y"))


def part(line: Column, start: Column, end: Column) -> Column:
    """What of a line lies between two ways along it."""
    inner = F.transform(F.filter(steps(line), lambda s: (s["at"] > start + 1e-9) & (s["at"] < end - 1e-9)), lambda s: F.struct(s["ax"].alias("x"), s["ay"].alias("y")))
    return F.concat(F.array(point_at(line, start)), inner, F.array(point_at(line, end)))


def project(line: Column, x: Column, y: Column) -> Column:
    """How far along a line its point nearest to (x, y) is, the first of equals, and how far off: (way, off)."""

    def on(s: Column) -> Column:
        t = S.position_on(x, y, s["ax"], s["ay"], s["bx"], s["by"])
        off = S.distance(x, y, s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"]))
        return F.struct(F.round(off, 9).alias("off"), (s["at"] + t * s["length"]).alias("way"))

    best = F.array_min(F.transform(steps(line), on))
    return F.struct(best["way"].alias("way"), best["off"].alias("off"))


def split_at(line: Column, way: Column) -> Column:
    """The two parts of a line before and after a place on it, which both have."""
    whole = length(line)
    return F.array(part(line, F.lit(0.0), way), part(line, way, whole))


def signature(line: Column) -> Column:
    """The line in whole centimetres, as text."""
    return F.array_join(F.transform(line, lambda p: F.concat(S.rounded(p["x"] * 100).cast("string"), F.lit(","), S.rounded(p["y"] * 100).cast("string"))), ";")
