"""GeoJSON feature collections and feature lines as DataFrames.

Bronze rows are (feature_seq, feature): the JSON text of each feature.  ``parsed``
makes typed columns of them, ``classified`` adds a status, and good and bad rows
are two filters of one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.sources import splitting

# Object types of the input format, and the geometries each may have.
OBJECT_TYPES = {
    "source": ("Point",),
    "heat_network": ("LineString",),
    "heat_chamber": ("Point",),
    "oks_connection_point": ("Point",),
    "restriction": ("LineString", "MultiLineString", "Polygon", "MultiPolygon"),
}
LEGACY_TYPES = ("oks_future", "oks_existing")
WARNINGS = ("UNKNOWN_OBJECT_TYPE", "MISSING_GEOMETRY", "INVALID_GEOMETRY", "WRONG_GEOMETRY_TYPE", "MISSING_RESTRICTION_TYPE")
# end of fixed values

POINT = "array<double>"
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
BRONZE = "feature_seq long, feature string"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection file (one JSON value of any size), or of a folder of them.  A file without a ``features`` array is an error."""
    return splitting.objects(spark, path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of JSON lines; blank lines are skipped.  The order of lines is kept within a file's part only."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("feature_seq"), F.col("value").alias("feature"))


def parsed(features: DataFrame) -> DataFrame:
    """Typed columns of bronze rows; what cannot be read is null."""
    top = F.from_json("feature", "geometry struct<type: string, coordinates: string>, properties map<string,string>")
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(feature), '$.properties.id', 'variant'))")
    rows = features.select("*", top.alias("f"), kind.alias("kind"))
    p = F.col("f.properties")
    return rows.select(
        "feature_seq",
        F.get(F.array(p["object_type"]), F.lit(0)).alias("object_type"),
        p["id"].alias("id"),
        F.coalesce(F.col("kind").isin("BIGINT", "DOUBLE") | F.col("kind").startswith("DECIMAL"), F.lit(False)).alias("id_is_numeric"),
        p["name"].alias("name"),
        F.expr("try_cast(f.properties['diameter'] as int)").alias("dn"),
        F.expr("try_cast(f.properties['flow_tph'] as double)").alias("flow_tph"),
        p["restriction_type"].alias("rtype"),
        F.col("f.geometry.type").alias("gtype"),
        F.col("f.geometry.coordinates").alias("coordinates"),
        (F.col("f.geometry").isNotNull() & F.col("f.geometry.type").isNotNull()).alias("has_geometry"),
    )


def lines_of(gtype: Column, coordinates: Column) -> Column:
    """A geometry as an array of lines of [x, y]: parts, and rings of parts, one after another; null if it cannot be read."""

    def read(depth: int) -> Column:
        kind = POINT
        for _ in range(depth):
            kind = f"array<{kind}>"
        return F.from_json(coordinates, kind)

    one, two, three = read(1), read(2), read(3)
    out = F.when(gtype == "Point", F.array(F.array(read(0)))).when(gtype.isin("MultiPoint", "LineString"), F.array(one)).when(gtype.isin("MultiLineString", "Polygon"), two).when(gtype == "MultiPolygon", F.flatten(three))
    sound = F.size(out) > 0
    sound &= F.forall(out, lambda line: (F.size(line) > 0) & F.forall(line, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()))
    return F.when(F.coalesce(sound, F.lit(False)), out)


def classified(features: DataFrame) -> DataFrame:
    """Rows with ``lines`` and ``status``: OK, a warning code, or null for types that are dropped silently."""
    rows = parsed(features).withColumn("lines", lines_of(F.col("gtype"), F.col("coordinates")))
    known = F.coalesce(F.col("object_type").isin(*OBJECT_TYPES), F.lit(False))
    fitting = F.lit(False)
    for name, kinds in OBJECT_TYPES.items():
        fitting = F.when(F.col("object_type") == name, F.col("gtype").isin(*kinds)).otherwise(fitting)
    status = (
        F.when(F.col("object_type").isin(*LEGACY_TYPES), F.lit(None))
        .when(~known, "UNKNOWN_OBJECT_TYPE")
        .when(~F.col("has_geometry"), "MISSING_GEOMETRY")
        .when(~F.col("gtype").isin(*DEPTHS) | F.col("lines").isNull(), "INVALID_GEOMETRY")
        .when(~fitting, "WRONG_GEOMETRY_TYPE")
        .when((F.col("object_type") == "restriction") & (F.coalesce(F.trim("rtype"), F.lit("")) == ""), "MISSING_RESTRICTION_TYPE")
        .otherwise("OK")
    )
    return rows.withColumn("status", status)


def projected(good: DataFrame, zone: int = 37) -> DataFrame:
    """Lines in metres of the zone, as arrays of (x, y)."""

    def point(p: Column) -> Column:
        x, y = S.to_utm(p[0], p[1], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return good.withColumn("lines", F.transform("lines", lambda line: F.transform(line, point)))


def diagnostics(rows: DataFrame) -> DataFrame:
    """(object_type, status, n): what was read, and what was left out and why."""
    return rows.groupBy("object_type", "status").agg(F.count("*").alias("n"))
