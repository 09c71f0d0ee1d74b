"""Results as GeoJSON, JSON and tiles.  A collection is written as text parts that are one document when read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature(geometry: Column | None, properties: Column) -> Column:
    """The JSON text of one feature; without a geometry it is null, and so are properties without a value."""
    shape = F.lit("null") if geometry is None else F.to_json(geometry)
    return F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def write_lines(features: DataFrame, path: str) -> None:
    """One feature a line, in any number of files."""
    features.select("feature").write.mode("overwrite").text(path)


def write_collection(features: DataFrame, path: str, order: list[str]) -> None:
    """A FeatureCollection in files that sort as they follow each other; features have a comma after all but the last.

    The last feature in order closes the document; it is found by one aggregate,
    not by gathering rows.
    """
    key = F.struct(*order)
    last = features.agg(F.max(key).alias("k")).first()["k"]
    if last is None:
        features.sparkSession.createDataFrame([('{"type":"FeatureCollection","features":[]}',)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    first = features.agg(F.min(key).alias("k")).first()["k"]
    ends = F.struct(*[F.lit(last[c]).alias(c) for c in order]), F.struct(*[F.lit(first[c]).alias(c) for c in order])
    text = F.concat(F.when(key == ends[1], '{"type":"FeatureCollection","features":[').otherwise(""), F.col("feature"), F.when(key == ends[0], "]}").otherwise(","))
    features.repartitionByRange(*order).sortWithinPartitions(*order).select(text.alias("value")).write.mode("overwrite").text(path)


def write_collections(features: DataFrame, path: str, by: str, order: list[str]) -> None:
    """One FeatureCollection for each value of ``by``, in a folder of its own; a value's rows are one task's."""
    group = Window.partitionBy(by).orderBy(*order)
    first, last = F.lag(F.lit(1)).over(group).isNull(), F.lead(F.lit(1)).over(group).isNull()
    text = F.concat(F.when(first, '{"type":"FeatureCollection","features":[').otherwise(""), F.col("feature"), F.when(last, "]}").otherwise(","))
    rows = features.repartition(by).select(by, *order, text.alias("value")).sortWithinPartitions(by, *order)
    rows.select(by, "value").write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", 0).text(path)


def write_tiles(features: DataFrame, path: str) -> DataFrame:
    """Rows by tile, and the manifest: (tile_id, n)."""
    features.write.mode("overwrite").partitionBy("tile_id").json(path)
    return features.groupBy("tile_id").agg(F.count("*").alias("n"))


def packed_mask(cells: DataFrame, factor: int) -> DataFrame:
    """(row, bits): a mask by blocks of ``factor`` cells, a block set if any of its cells is; bits as base64, north first."""
    block = cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.max(F.col("blocked").cast("int")).alias("b"))
    bytes_ = block.groupBy("row", F.floor(F.col("col") / 8).alias("byte")).agg(F.sum(F.col("b") * F.expr("cast(shiftleft(1, cast(col % 8 as int)) as long)")).alias("v"))
    whole = bytes_.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("byte", "v"))).alias("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("p", -1)["byte"]), lambda i: F.lpad(F.hex(F.coalesce(F.element_at(F.filter("p", lambda q: q["byte"] == i), 1)["v"], F.lit(0).cast("long"))), 2, "0")), "")
    return whole.select("row", F.base64(F.unhex(text)).alias("bits")).orderBy(F.desc("row"))
