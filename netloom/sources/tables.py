"""Domain relations projected from star-schema tables, in integers, so that sums do not depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Restriction types by turn; the last has no rule of its own.
RESTRICTION_TYPES = ("oks", "park", "social_area", "prohibited_site", "water", "railway", "road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network", "unlisted")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees: edge n hangs on edge n // 2 (0: the root) and ends in node n, where ``flow`` is drawn."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag", F.row_number().over(order).alias("n"))
    return rows.select(
        F.col("l_orderkey").alias("tree"),
        "n",
        F.shiftright("n", 1).alias("parent"),
        (5 + F.floor(F.col("l_extendedprice") / 1000)).cast("long").alias("len_m"),
        F.floor("l_quantity").cast("long").alias("flow"),
        F.col("l_returnflag").alias("rtype"),
    )


def loose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges in trees of any shape: chains, stars and forks, numbered downwards from 1000 so that parents have the larger numbers."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_partkey", "l_suppkey", F.row_number().over(order).alias("k"))
    other = F.when(F.col("l_partkey") % 2 == 0, F.col("k") - 1).otherwise((1 + F.col("l_suppkey") % (F.col("k") - 1)).cast("int"))
    before = F.when((F.col("k") == 1) | (F.col("l_partkey") % 9 == 0), 0).otherwise(other)
    return rows.select(
        F.col("l_orderkey").alias("tree"),
        (1000 - F.col("k")).alias("n"),
        F.when(before > 0, 1000 - before).otherwise(0).alias("parent"),
        (5 + F.floor(F.col("l_extendedprice") / 1000)).cast("long").alias("len_m"),
        F.floor("l_quantity").cast("long").alias("flow"),
        F.col("l_returnflag").alias("rtype"),
    )


def connection_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("cp_id"), (k * 7919 % 2000).alias("x"), (k * 104729 % 1600).alias("y"), (1 + k % 77).alias("flow"))


def net_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("node_id"), (20 * k).alias("x"), (800 + (k * 37 % 21 - 10)).alias("y"), (k % 3 == 0).alias("is_chamber"))


def net_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment i joins nodes i and i + 1."""
    a = net_nodes(spark, sf_dir)
    b = a.select((F.col("node_id") - 1).alias("node_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, "node_id").select(F.col("node_id").alias("seg_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2", (100 + F.col("node_id") % 4 * 100).cast("int").alias("dn"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, RESTRICTION_TYPES))
    x0, y0 = k * 613 % 1950, k * 353 % 1550
    return table(spark, sf_dir, "part").select(k.alias("r_id"), F.get(kinds, (k % len(RESTRICTION_TYPES)).cast("int")).alias("rtype"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size")).alias("x1"), (y0 + 1 + k % 30).alias("y1"))


#: Shapes in quarters of a box: an L, a triangle, a diamond with a hole.
SHAPES = (
    (((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)),),
    (((0, 0), (4, 1), (1, 4)),),
    (((2, 0), (4, 2), (2, 4), (0, 2)), ((1, 2), (2, 3), (3, 2), (2, 1))),
)


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrictions as polygons in the boxes of ``rects``, with open rings: (r_id, rtype, lines, area)."""

    def at(low: str, high: str, f: int):
        return F.col(low) + f * 0.25 * (F.col(high) - F.col(low))

    def lines(shape):
        return F.array(*[F.array(*[F.struct(at("x0", "x1", a).alias("x"), at("y0", "y1", b).alias("y")) for a, b in ring]) for ring in shape])

    kind = F.col("r_id") % 3
    return rects(spark, sf_dir).select("r_id", "rtype", F.when(kind == 0, lines(SHAPES[0])).when(kind == 1, lines(SHAPES[1])).otherwise(lines(SHAPES[2])).alias("lines"), F.lit(True).alias("area"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plan and variant a tree belongs to."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"), F.col("o_custkey").alias("plan"), (1 + F.col("o_orderkey") % 3).alias("variant"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(order).alias("seq"), "ts", F.col("event_type").alias("stage"), F.least(F.lit(100), F.floor(F.col("value") / 5)).cast("int").alias("progress"))
