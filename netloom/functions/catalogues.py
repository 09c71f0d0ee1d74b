"""Catalogues: diameters, envelopes, rules and prices.  They are configuration; the values here are invented samples."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

Row = tuple


@dataclass(frozen=True)
class Catalogues:
    #: (dn, capacity, longest run in m, price per m), ascending.
    diameters: tuple[Row, ...] = ((50, 20, 60, 9000), (80, 60, 120, 12000), (100, 120, 200, 15000), (150, 300, 350, 21000), (200, 700, 600, 30000), (300, 1600, 1000, 45000))
    #: (dn, width of a pipe pair in cm).
    envelopes: tuple[Row, ...] = ((80, 40), (150, 60), (300, 100))
    #: (type, mode, least distance in dm, price factor in percent).
    rules: tuple[Row, ...] = (
        ("oks", "PROHIBITED", 50, 100), ("park", "PROHIBITED", 20, 100), ("social_area", "PROHIBITED", 40, 100), ("prohibited_site", "PROHIBITED", 60, 100),
        ("water", "PROHIBITED", 30, 100), ("railway", "PROHIBITED", 80, 100), ("road", "SPECIAL", 10, 150), ("tram_tracks", "SPECIAL", 15, 170),
        ("gas_pipeline", "SPECIAL", 12, 130), ("power_cable", "SPECIAL", 8, 120), ("heat_network", "SPECIAL", 5, 110),
    )
    fallback: Row = ("PROHIBITED", 25, 100)
    #: (type, largest dn, least distance in dm): the first band that a dn fits.
    bands: tuple[Row, ...] = (("oks", 100, 30), ("oks", 200, 40), ("road", 150, 6), ("water", 100, 22), ("water", 200, 26))
    #: (largest dn, price of a chamber); the last is without limit.
    chambers: tuple[Row, ...] = ((80, 120_000), (150, 180_000), (1 << 30, 260_000))
    tie_in: int = 90_000
    penalty: tuple[int, int] = (1_000_000, 25_000)
    #: (largest dn, height of a pipe in cm), and (type, depth of the top in m, height in m) of lines to pass above or below.
    heights: tuple[Row, ...] = ((80, 30), (150, 45), (300, 70))
    verticals: tuple[Row, ...] = (("gas_pipeline", 1.2, 0.3), ("power_cable", 0.8, 0.1), ("heat_network", 2.0, 0.8))
    #: Weights of the score: percent of cost per million, percent of length per 100 m.
    weights: tuple[float, float] = field(default=(0.6, 0.4))


DEFAULT = Catalogues()


def load(text: str) -> Catalogues:
    """Catalogues from JSON text: an object with any of the fields above, lists in place of tuples; others keep their samples.

    Diameters and bands of prices must ascend, and names be known.
    """
    given = json.loads(text)
    unknown = set(given) - {f.name for f in fields(Catalogues)}
    if unknown:
        raise ValueError(f"no catalogue of this name: {', '.join(sorted(unknown))}")

    def fixed(x):
        return tuple(fixed(y) for y in x) if isinstance(x, list) else x

    out = Catalogues(**{k: fixed(v) for k, v in given.items()})
    for name in ("diameters", "envelopes", "chambers", "heights"):
        firsts = [r[0] for r in getattr(out, name)]
        if firsts != sorted(set(firsts)):
            raise ValueError(f"{name} must ascend")
    if not out.diameters:
        raise ValueError("there must be diameters")
    return out


def diameters(spark: SparkSession, c: Catalogues = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(c.diameters), "dn int, capacity long, max_len long, price long")


def envelopes(spark: SparkSession, c: Catalogues = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(c.envelopes), "dn int, width long")


def rules(spark: SparkSession, c: Catalogues = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(c.rules), "rtype string, mode string, min_dist long, factor long")


def bands(spark: SparkSession, c: Catalogues = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(c.bands), "rtype string, max_dn int, dist long")


def chamber_bands(spark: SparkSession, c: Catalogues = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(c.chambers), "max_dn int, price long")
