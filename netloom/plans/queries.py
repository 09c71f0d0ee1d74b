"""The queries by their survey names: operators over projected relations, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import catalogues as K
from netloom.functions import lines as L
from netloom.functions import scalars as S
from netloom.operators import regions, sequences, spatial, trees, validation
from netloom.plans.oracle import point_segment, ray_meets, with_
from netloom.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, relations: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_(relations, sql)
        return f

    return keep


def designed(spark: SparkSession, d: str) -> DataFrame:
    return trees.with_design(T.edges(spark, d), heap=True)


def tree_query(name: str, relations: str, sql: str | None = None) -> Callable[[Callable[[DataFrame, DataFrame, SparkSession, str], DataFrame]], None]:
    """A query on edges and designed edges, twice: on heap-numbered trees, and (``_any_shape``) on trees of any shape."""

    def keep(f: Callable[[DataFrame, DataFrame, SparkSession, str], DataFrame]) -> None:
        QUERIES[name] = lambda spark, d: f(T.edges(spark, d), designed(spark, d), spark, d)

        def loose(spark: SparkSession, d: str) -> DataFrame:
            edges = T.loose_edges(spark, d)
            return f(edges, trees.with_design(edges), spark, d)

        QUERIES[f"{name}_any_shape"] = loose
        if sql is not None:
            SQL[name] = with_(relations, sql)
            SQL[f"{name}_any_shape"] = with_(relations, sql, {"edges": "loose_edges"})

    return keep


# Joins with catalogues.


@query("jn01_smallest_dn_by_flow", "edges cat", "SELECT tree, n, (SELECT min(dn) FROM cat WHERE capacity >= flow) AS dn FROM edges")
def _(spark, d):
    return T.edges(spark, d).select("tree", "n", S.smallest_dn(F.col("flow")).alias("dn"))


@query("jn02_smallest_dn_by_flow_and_length", "edges cat", "SELECT tree, n, (SELECT min(dn) FROM cat WHERE capacity >= flow AND max_len >= len_m) AS dn FROM edges")
def _(spark, d):
    return T.edges(spark, d).select("tree", "n", S.smallest_dn(F.col("flow"), F.col("len_m")).alias("dn"))


@query("jn03_smallest_dn_not_below", "designed", "SELECT tree, n, (SELECT min(c.dn) FROM cat c WHERE c.capacity >= d.total_flow AND c.max_len >= d.len_m AND c.dn >= d.dn) AS dn FROM designed d")
def _(spark, d):
    return designed(spark, d).select("tree", "n", S.smallest_dn(F.col("total_flow"), F.col("len_m"), F.col("dn")).alias("dn"))


@query("jn04_catalogue_row", "designed", "SELECT d.tree, d.n, c.max_len, c.price FROM designed d JOIN cat c ON c.dn = d.dn")
def _(spark, d):
    return designed(spark, d).select("tree", "n", S.longest_run(F.col("dn")).alias("max_len"), S.price(F.col("dn")).alias("price"))


@query("jn05_next_catalogue_row", "cat", "SELECT dn, lead(dn) OVER (ORDER BY dn) AS next_dn, capacity FROM cat")
def _(spark, d):
    # A catalogue is a handful of rows; one window over all of it is its size.
    return K.diameters(spark).select("dn", S.next_dn(F.col("dn")).alias("next_dn"), "capacity")


@query("jn06_pair_envelope", "net_segments env", "SELECT seg_id, dn, coalesce((SELECT width FROM env WHERE env.dn >= s.dn ORDER BY env.dn LIMIT 1), (SELECT width FROM env ORDER BY dn DESC LIMIT 1)) AS width FROM net_segments s")
def _(spark, d):
    return T.net_segments(spark, d).select("seg_id", "dn", S.pair_width(F.col("dn")).alias("width"))


def by_rule(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with the rule of their type, or the fallback for a type without one."""
    mode, least, factor = K.DEFAULT.fallback
    out = rows.join(F.broadcast(K.rules(spark)), "rtype", "left")
    return out.select(*rows.columns, F.col("mode").isNull().alias("unknown"), F.coalesce("mode", F.lit(mode)).alias("mode"), F.coalesce("min_dist", F.lit(least).cast("long")).alias("min_dist"), F.coalesce("factor", F.lit(factor).cast("long")).alias("factor"))


def ruled(spark: SparkSession, d: str) -> DataFrame:
    """Restrictions with their rule."""
    return by_rule(spark, T.rects(spark, d))


RULED = f"SELECT r_id, r.rtype, x0, y0, x1, y1, u.mode IS NULL AS unknown, coalesce(u.mode, '{K.DEFAULT.fallback[0]}') AS mode, CAST(coalesce(u.min_dist, {K.DEFAULT.fallback[1]}) AS BIGINT) AS min_dist, CAST(coalesce(u.factor, {K.DEFAULT.fallback[2]}) AS BIGINT) AS factor FROM rects r LEFT JOIN rules u ON u.rtype = r.rtype"


@query("prj06_rule_or_fallback", "rects rules", RULED)
def _(spark, d):
    return ruled(spark, d)


@query("jn07_band_distance", "rects rules bands cat", f"SELECT r_id, c.dn, coalesce((SELECT min(dist) FROM bands b WHERE b.rtype = r.rtype AND c.dn <= b.max_dn), r.min_dist) AS dist FROM ({RULED}) r CROSS JOIN cat c")
def _(spark, d):
    return with_distance(spark, d).select("r_id", "dn", "dist")


def with_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each restriction with the catalogue's diameters and the distance to keep for each."""
    grouped = K.bands(spark).groupBy("rtype").agg(F.collect_list(F.struct("max_dn", "dist")).alias("bands"))
    dns = F.array(*[F.lit(r[0]) for r in K.DEFAULT.diameters])
    rows = ruled(spark, d).join(F.broadcast(grouped), "rtype", "left").withColumn("dn", F.explode(dns))
    fitting = F.transform(F.filter("bands", lambda b: F.col("dn") <= b["max_dn"]), lambda b: b["dist"])
    return rows.withColumn("dist", F.coalesce(F.array_min(fitting), F.col("min_dist")))


@query(
    "prj07_keep_out_distance",
    "rects rules bands cat env",
    f"SELECT r_id, c.dn, coalesce((SELECT min(dist) FROM bands b WHERE b.rtype = r.rtype AND c.dn <= b.max_dn), r.min_dist) * 10 + coalesce((SELECT width FROM env WHERE env.dn >= c.dn ORDER BY env.dn LIMIT 1), (SELECT width FROM env ORDER BY dn DESC LIMIT 1)) / 2.0 AS keep_cm FROM ({RULED}) r CROSS JOIN cat c WHERE r.mode = 'PROHIBITED'",
)
def _(spark, d):
    return with_distance(spark, d).filter("mode = 'PROHIBITED'").select("r_id", "dn", (F.col("dist") * 10 + S.pair_width(F.col("dn")) / 2.0).alias("keep_cm"))


@query("jn08_chamber_price", "ends chambers", "SELECT tree, node, max_dn, CAST((SELECT min(price) FROM chambers c WHERE c.max_dn >= n.max_dn) AS BIGINT) AS price FROM (SELECT tree, node, max(dn) AS max_dn FROM ends GROUP BY tree, node) n")
def _(spark, d):
    return trees.node_dn(designed(spark, d)).select("tree", "node", "max_dn", S.chamber_price(F.col("max_dn")).alias("price"))


@query("jn09_rule_join_modes", "rects rules", f"SELECT mode, unknown, count(*) AS restrictions, CAST(sum(min_dist) AS BIGINT) AS dist_sum FROM ({RULED}) GROUP BY mode, unknown")
def _(spark, d):
    return ruled(spark, d).groupBy("mode", "unknown").agg(F.count("*").alias("restrictions"), F.sum("min_dist").alias("dist_sum"))


#: Points farther than this from every pipe stand for those that a plan leaves unconnected.
REACH = 150
LOST = f""", lost AS (SELECT c.* FROM cps c WHERE NOT EXISTS (SELECT 1 FROM (
      SELECT c.x - x1 - t * (x2 - x1) AS dx, c.y - y1 - t * (y2 - y1) AS dy FROM (SELECT *, greatest(0.0, least(1.0, ((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS t FROM net_segments)) WHERE round(sqrt(dx * dx + dy * dy), 6) <= {REACH}))"""


def lost_points(spark: SparkSession, d: str) -> DataFrame:
    points = T.connection_points(spark, d)
    near = spatial.near_segments(points, T.net_segments(spark, d), REACH)
    return points.join(near.select("cp_id").distinct(), "cp_id", "left_anti")


@query("jn22_unconnected_flow", "cps net_segments", f"{LOST} SELECT cp_id, flow FROM lost")
def _(spark, d):
    return lost_points(spark, d).select("cp_id").join(T.connection_points(spark, d), "cp_id", "left").select("cp_id", "flow")


#: Points that have a chamber as their nearest one, within 100 m, use it.
USED = """, used AS (SELECT node_id, count(*) AS used FROM (SELECT c.cp_id, n.node_id, row_number() OVER (PARTITION BY c.cp_id ORDER BY (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y), n.node_id) AS k, (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) AS d FROM cps c JOIN net_nodes n ON n.is_chamber) WHERE k = 1 AND d <= 10000 GROUP BY node_id),
    degree AS (SELECT c.node_id, c.x, c.y, (SELECT count(*) FROM net_segments s WHERE s.seg_id IN (c.node_id, c.node_id - 1)) AS pipes, coalesce(u.used, 0) AS used FROM net_nodes c LEFT JOIN used u ON u.node_id = c.node_id WHERE c.is_chamber)"""


def chamber_degrees(spark: SparkSession, d: str) -> DataFrame:
    """(node_id, x, y, pipes, used) of every chamber: existing attachments, and points that use it."""
    chambers = T.net_nodes(spark, d).filter("is_chamber").drop("is_chamber")
    used = spatial.nearest(T.connection_points(spark, d), chambers, 1, 100).groupBy("node_id").agg(F.count("*").alias("used"))
    return spatial.degrees(chambers, spatial.attachments(T.net_segments(spark, d), chambers), used)


@query("jn23_chambers_below_capacity", "net_nodes net_segments cps", f"{USED} SELECT node_id FROM degree WHERE pipes + used < 4")
def _(spark, d):
    return chamber_degrees(spark, d).filter("pipes + used < 4").select("node_id")


@query("jn24_dangling_references", "edges", "SELECT e.tree, e.n, e.parent FROM edges e WHERE e.rtype <> 'A' AND e.parent > 0 AND NOT EXISTS (SELECT 1 FROM edges p WHERE p.tree = e.tree AND p.n = e.parent AND p.rtype <> 'A')")
def _(spark, d):
    kept = T.edges(spark, d).filter("rtype <> 'A'")
    known = kept.select("tree", F.col("n").alias("parent"))
    return kept.filter("parent > 0").join(known, ["tree", "parent"], "left_anti").select("tree", "n", "parent")


@query("jn25_terminals_and_points", "cps", "SELECT c.cp_id, e.cp_id IS NULL AS no_exit, CASE WHEN e.cp_id IS NULL THEN 'NO_FLOW' END AS warning FROM cps c LEFT JOIN (SELECT cp_id FROM cps WHERE flow > 5) e ON e.cp_id = c.cp_id")
def _(spark, d):
    points = T.connection_points(spark, d)
    exits = points.filter("flow > 5").select("cp_id", F.lit(True).alias("has"))
    out = points.join(exits, "cp_id", "left")
    return out.select("cp_id", F.col("has").isNull().alias("no_exit"), F.when(F.col("has").isNull(), "NO_FLOW").alias("warning"))


@query("jn26_rename_on_merge", "edges", "SELECT tree, n, CASE WHEN parent = 0 THEN 'root' ELSE 't' || (tree % 4) || '/' || parent END AS from_id FROM edges")
def _(spark, d):
    shared = spark.createDataFrame([(0, "root")], "parent int, kept string")
    out = T.edges(spark, d).join(F.broadcast(shared), "parent", "left")
    return out.select("tree", "n", F.coalesce("kept", F.concat(F.lit("t"), (F.col("tree") % 4).cast("string"), F.lit("/"), F.col("parent").cast("string"))).alias("from_id"))


# Spatial joins.

INSIDE = "c.x BETWEEN r.x0 AND r.x1 AND c.y BETWEEN r.y0 AND r.y1"


@query("jn10_points_in_restrictions", "cps rects", f"SELECT c.cp_id, r.r_id, r.rtype, (c.x = r.x0 OR c.x = r.x1 OR c.y = r.y0 OR c.y = r.y1) AS on_edge FROM cps c JOIN rects r ON {INSIDE}")
def _(spark, d):
    return spatial.containing(T.connection_points(spark, d), T.rects(spark, d))


@query("jn10_owning_building", "cps rects", f"SELECT c.cp_id, (SELECT min(r.r_id) FROM rects r WHERE r.rtype = 'oks' AND {INSIDE}) AS r_id FROM cps c")
def _(spark, d):
    return spatial.owning(T.connection_points(spark, d), T.rects(spark, d))


@query("jn11_building_dn", "cps rects cat", f"SELECT r.r_id, coalesce((SELECT min(k.dn) FROM cps c JOIN cat k ON k.capacity >= c.flow WHERE {INSIDE}), (SELECT min(k.dn) FROM cps c JOIN cat k ON k.capacity >= c.flow)) AS dn FROM rects r WHERE r.rtype = 'oks'")
def _(spark, d):
    return spatial.building_dn(T.connection_points(spark, d), T.rects(spark, d))


@query("jn12_chamber_attachments", "net_nodes net_segments", "SELECT c.node_id, count(*) AS n FROM net_nodes c JOIN (SELECT x1 AS x, y1 AS y FROM net_segments UNION ALL SELECT x2, y2 FROM net_segments) e ON (e.x - c.x) * (e.x - c.x) + (e.y - c.y) * (e.y - c.y) <= 0.25 WHERE c.is_chamber GROUP BY c.node_id")
def _(spark, d):
    return spatial.attachments(T.net_segments(spark, d), T.net_nodes(spark, d).filter("is_chamber"))


@query("jn13_candidates_away_from_chambers", "cps net_nodes", "SELECT cp_id FROM cps c WHERE NOT EXISTS (SELECT 1 FROM net_nodes n WHERE n.is_chamber AND (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) <= 1600)")
def _(spark, d):
    return spatial.free_candidates(T.connection_points(spark, d), T.net_nodes(spark, d).filter("is_chamber"), 40).select("cp_id")


@query("jn14_candidates_away_from_spare_chambers", "cps net_nodes net_segments", f"{USED} SELECT cp_id FROM cps c WHERE NOT EXISTS (SELECT 1 FROM degree n WHERE n.pipes + n.used < 4 AND (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) <= 1600)")
def _(spark, d):
    spare = chamber_degrees(spark, d).filter("pipes + used < 4")
    return spatial.free_candidates(T.connection_points(spark, d), spare, 40).select("cp_id")


@query(
    "jn15_nearest_on_segments",
    "cps net_segments",
    """SELECT cp_id, seg_id, dist FROM (SELECT cp_id, seg_id, dist, row_number() OVER (PARTITION BY cp_id ORDER BY dist, seg_id) AS k FROM (
      SELECT cp_id, seg_id, round(sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))), 6) AS dist FROM (
        SELECT c.cp_id, s.seg_id, c.x, c.y, s.x1, s.y1, s.x2, s.y2, greatest(0.0, least(1.0, ((c.x - s.x1) * (s.x2 - s.x1) + (c.y - s.y1) * (s.y2 - s.y1)) / CAST((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1) AS DOUBLE))) AS t
        FROM cps c CROSS JOIN net_segments s))) WHERE k = 1""",
)
def _(spark, d):
    return spatial.nearest_on_segments(T.connection_points(spark, d), T.net_segments(spark, d))


@query("jn16_nearest_nodes", "cps net_nodes", "SELECT cp_id, node_id, dist2, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cp_id ORDER BY dist2, node_id) AS INT) AS nth FROM (SELECT cp_id, node_id, (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) AS dist2 FROM cps c CROSS JOIN net_nodes n)) WHERE nth <= 16")
def _(spark, d):
    return spatial.nearest(T.connection_points(spark, d), T.net_nodes(spark, d), 16)


@query("jn17_overlapping_boxes", "rects", "SELECT a.r_id AS a, b.r_id AS b FROM rects a JOIN rects b ON a.r_id < b.r_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def _(spark, d):
    return spatial.overlapping(T.rects(spark, d))


@query("jn18_features_to_tiles", "rects", "SELECT r_id, CAST(tc AS INT) AS tc, CAST(tr AS INT) AS tr FROM (SELECT r_id, unnest(generate_series(CAST(floor((x0 - 50) / 400.0) AS BIGINT), CAST(floor((x1 + 50) / 400.0) AS BIGINT))) AS tc, y0, y1 FROM rects) q, LATERAL (SELECT unnest(generate_series(CAST(floor((q.y0 - 50) / 400.0) AS BIGINT), CAST(floor((q.y1 + 50) / 400.0) AS BIGINT))) AS tr)")
def _(spark, d):
    return spatial.tiles(T.rects(spark, d), 400, 50)


@query("jn18_points_to_tiles", "cps", "SELECT CAST(x // 400 AS INT) AS tc, CAST(y // 400 AS INT) AS tr, count(*) AS points, CAST(sum(flow) AS BIGINT) AS flow FROM cps GROUP BY 1, 2")
def _(spark, d):
    tile = [F.floor(F.col(c) / 400).cast("int").alias(t) for c, t in (("x", "tc"), ("y", "tr"))]
    return T.connection_points(spark, d).groupBy(*tile).agg(F.count("*").alias("points"), F.sum("flow").alias("flow"))


SPANS = """SELECT seg_id, r_id, rtype, round(greatest(ax0, ay0, 0.0), 6) + 0.0 AS s0, round(least(ax1, ay1, 1.0), 6) + 0.0 AS s1 FROM (
  SELECT s.seg_id, r.r_id, r.rtype,
    coalesce(least((r.x0 - s.x1) / dx, (r.x1 - s.x1) / dx), 0.0) AS ax0, coalesce(greatest((r.x0 - s.x1) / dx, (r.x1 - s.x1) / dx), 1.0) AS ax1,
    coalesce(least((r.y0 - s.y1) / dy, (r.y1 - s.y1) / dy), 0.0) AS ay0, coalesce(greatest((r.y0 - s.y1) / dy, (r.y1 - s.y1) / dy), 1.0) AS ay1,
    (dx IS NULL AND (s.x1 < r.x0 OR s.x1 > r.x1)) OR (dy IS NULL AND (s.y1 < r.y0 OR s.y1 > r.y1)) AS away
  FROM (SELECT *, CAST(nullif(x2 - x1, 0) AS DOUBLE) AS dx, CAST(nullif(y2 - y1, 0) AS DOUBLE) AS dy FROM net_segments) s CROSS JOIN rects r
) WHERE NOT away AND round(least(ax1, ay1, 1.0), 6) > round(greatest(ax0, ay0, 0.0), 6)"""


@query("jn19_segment_spans", "net_segments rects", SPANS)
def _(spark, d):
    return spatial.spans(T.net_segments(spark, d), T.rects(spark, d))


def cross_lines(spark: SparkSession, d: str) -> DataFrame:
    """One diagonal of every restriction, as lines to test for crossings."""
    low, high = F.when(F.col("r_id") % 4 == 0, F.col("y0")).otherwise(F.col("y1")), F.when(F.col("r_id") % 4 == 0, F.col("y1")).otherwise(F.col("y0"))
    return T.rects(spark, d).select(F.col("r_id").alias("seg_id"), F.col("x0").alias("x1"), low.alias("y1"), F.col("x1").alias("x2"), high.alias("y2"))


@query(
    "jn20_crossing_edges",
    "rects",
    """, l AS (SELECT r_id AS s, x0 AS a, CASE WHEN r_id % 4 = 0 THEN y0 ELSE y1 END AS b, x1 AS c, CASE WHEN r_id % 4 = 0 THEN y1 ELSE y0 END AS d FROM rects)
    SELECT p.s AS a, q.s AS b FROM l p JOIN l q ON p.s < q.s
    AND sign((p.c - p.a) * (q.b - p.b) - (p.d - p.b) * (q.a - p.a)) * sign((p.c - p.a) * (q.d - p.b) - (p.d - p.b) * (q.c - p.a)) < 0
    AND sign((q.c - q.a) * (p.b - q.b) - (q.d - q.b) * (p.a - q.a)) * sign((q.c - q.a) * (p.d - q.b) - (q.d - q.b) * (p.c - q.a)) < 0""",
)
def _(spark, d):
    return spatial.crossings(cross_lines(spark, d))


# Aggregations on trees.


@query("ag01_counts_by_type", "rects", "SELECT rtype, count(*) AS n FROM rects GROUP BY rtype")
def _(spark, d):
    return T.rects(spark, d).groupBy("rtype").agg(F.count("*").alias("n"))


@query("ag02_bounding_box", "cps rects", "SELECT min(a) AS x0, min(b) AS y0, max(c) AS x1, max(e) AS y1 FROM (SELECT x AS a, y AS b, x AS c, y AS e FROM cps UNION ALL SELECT x0, y0, x1, y1 FROM rects)")
def _(spark, d):
    p = T.connection_points(spark, d).select("x", "y", F.col("x").alias("u"), F.col("y").alias("v"))
    both = p.union(T.rects(spark, d).select("x0", "y0", "x1", "y1"))
    return both.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("u").alias("x1"), F.max("v").alias("y1"))


@tree_query("ag03_subtree_flow", "carried", "SELECT * FROM carried")
def _(edges, designed, spark, d):
    return designed.select("tree", "n", "total_flow")


@tree_query("ag04_node_dn", "ends", "SELECT tree, node, max(dn) AS max_dn FROM ends GROUP BY tree, node")
def _(edges, designed, spark, d):
    return trees.node_dn(designed)


@tree_query("ag05_node_degree", "ends", "SELECT tree, node, count(*) AS degree FROM ends GROUP BY tree, node")
def _(edges, designed, spark, d):
    return trees.node_degree(edges)


@tree_query("ag06_tie_ins", "edges", "SELECT tree, count(*) AS tie_ins FROM edges WHERE parent = 0 GROUP BY tree")
def _(edges, designed, spark, d):
    return edges.filter("parent = 0").groupBy("tree").agg(F.count("*").alias("tie_ins"))


@tree_query("ag07_tree_totals", "totals", "SELECT * FROM totals")
def _(edges, designed, spark, d):
    return trees.tree_totals(designed)


@query("ag08_unconnected_penalty", "cps net_segments", f"{LOST} SELECT count(*) AS n, CAST(sum({K.DEFAULT.penalty[0]} + floor(flow * {K.DEFAULT.penalty[1]} + 0.5)) AS BIGINT) AS penalty FROM lost")
def _(spark, d):
    return lost_points(spark, d).agg(F.count("*").alias("n"), F.sum(S.penalty(F.col("flow"))).alias("penalty"))


VARIANTS = f"""SELECT plan, variant, CAST(sum(pipe_cost + chamber_cost + tie_ins * {K.DEFAULT.tie_in}) AS BIGINT) AS cost, CAST(sum(length_m) AS BIGINT) AS length_m,
  round({K.DEFAULT.weights[0]} * (CAST(sum(pipe_cost + chamber_cost + tie_ins * {K.DEFAULT.tie_in}) AS DOUBLE) / 1e6) + {K.DEFAULT.weights[1]} * (CAST(sum(length_m) AS DOUBLE) / 100.0), 6) AS score
  FROM totals JOIN variants USING (tree) GROUP BY plan, variant"""


@tree_query("wn01_ranked_variants", "totals variants", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY plan ORDER BY score, variant) AS INT) AS rank FROM ({VARIANTS})) WHERE rank <= 3")
def _(edges, designed, spark, d):
    return trees.ranked_variants(designed, T.variants(spark, d))


@query("tk01_best_variant", "totals variants", f"SELECT plan, arg_min(variant, (score, variant)) AS variant, min(score) AS score FROM ({VARIANTS}) GROUP BY plan")
def _(spark, d):
    best = trees.ranked_variants(designed(spark, d), T.variants(spark, d)).groupBy("plan").agg(F.min(F.struct("score", "variant")).alias("b"))
    return best.select("plan", "b.variant", "b.score")


@query(
    "ag09_merged_variants",
    "totals variants",
    f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score, variant) AS rank, count(*) OVER (PARTITION BY plan) AS n FROM ({VARIANTS})),
    k(k) AS (VALUES (1), (2), (3))
    SELECT k.k AS k, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(length_m) AS BIGINT) AS length_m FROM k JOIN ranked r ON r.rank = least(k.k, r.n) GROUP BY k.k""",
)
def _(spark, d):
    ranked = trees.ranked_variants(designed(spark, d), T.variants(spark, d))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy("plan")))
    # A plan's last variant stands for the ranks it lacks.
    ks = F.when(F.col("rank") == F.col("n"), F.sequence(F.col("rank"), F.lit(3))).otherwise(F.array("rank"))
    return ranked.withColumn("k", F.explode(ks)).groupBy("k").agg(F.sum("cost").alias("cost"), F.sum("length_m").alias("length_m"))


@query("ag10_chamber_usage", "edges", "SELECT tree % 50 AS chamber, count(*) AS usage FROM edges WHERE parent = 0 GROUP BY 1")
def _(spark, d):
    return T.edges(spark, d).filter("parent = 0").groupBy((F.col("tree") % 50).alias("chamber")).agg(F.count("*").alias("usage"))


@query("ag11_largest_dn", "designed", "SELECT tree % 100 AS plan, max(dn) AS dn FROM designed GROUP BY 1")
def _(spark, d):
    return designed(spark, d).groupBy((F.col("tree") % 100).alias("plan")).agg(F.max("dn").alias("dn"))


@query("ag12_cell_maximum", "rects rules", f"SELECT CAST(x0 // 10 AS INT) AS c, CAST(y0 // 10 AS INT) AS r, max(factor) AS k FROM ({RULED}) WHERE mode = 'SPECIAL' GROUP BY 1, 2")
def _(spark, d):
    cell = [F.floor(F.col(a) / 10).cast("int").alias(b) for a, b in (("x0", "c"), ("y0", "r"))]
    return ruled(spark, d).filter("mode = 'SPECIAL'").groupBy(*cell).agg(F.max("factor").alias("k"))


@query("ag15_route_factor", "net_segments rects rules", f"SELECT seg_id, max(factor) AS k FROM ({SPANS}) s JOIN rules u ON u.rtype = s.rtype AND u.mode = 'SPECIAL' GROUP BY seg_id")
def _(spark, d):
    special = K.rules(spark).filter("mode = 'SPECIAL'").select("rtype", "factor")
    return spatial.spans(T.net_segments(spark, d), T.rects(spark, d)).join(F.broadcast(special), "rtype").groupBy("seg_id").agg(F.max("factor").alias("k"))


RUNS = """, runs AS (SELECT tree, n AS below, n, dn, len_m FROM designed UNION ALL SELECT r.tree, r.below, p.n, r.dn, p.len_m FROM runs r JOIN designed e ON e.tree = r.tree AND e.n = r.n JOIN designed p ON p.tree = r.tree AND p.n = e.parent AND p.dn = r.dn)"""


@tree_query("wn08_run_lengths", "designed", f"{RUNS} SELECT tree, below AS n, CAST(sum(len_m) AS BIGINT) AS run_m FROM runs GROUP BY tree, below")
def _(edges, designed, spark, d):
    return trees.run_lengths(designed)


@tree_query("ag16_required_run", "designed", f"{RUNS}, sums AS (SELECT tree, below, CAST(sum(len_m) AS BIGINT) AS run_m FROM runs GROUP BY tree, below) SELECT r.tree, r.n, max(s.run_m) AS required_m FROM runs r JOIN sums s ON s.tree = r.tree AND s.below = r.below GROUP BY r.tree, r.n")
def _(edges, designed, spark, d):
    return trees.required_run(designed)


@tree_query(
    "wn10_longest_downstream",
    "up",
    """, depth AS (SELECT u.tree, u.below AS n, CAST(sum(e.len_m) AS BIGINT) AS way FROM up u JOIN edges e ON e.tree = u.tree AND e.n = u.n GROUP BY u.tree, u.below)
    SELECT u.tree, u.n, max(d.way) - any_value(o.way) + any_value(e.len_m) AS longest FROM up u JOIN depth d ON d.tree = u.tree AND d.n = u.below JOIN depth o ON o.tree = u.tree AND o.n = u.n JOIN edges e ON e.tree = u.tree AND e.n = u.n GROUP BY u.tree, u.n""",
)
def _(edges, designed, spark, d):
    return trees.longest_downstream(edges)


@tree_query("gr12_node_types", "ends", "SELECT tree, node, degree, CASE WHEN node = 0 OR degree >= 3 THEN 'CHAMBER' WHEN degree = 2 THEN 'TECHNICAL_NODE' ELSE 'CONNECTION_POINT' END AS kind FROM (SELECT tree, node, count(*) AS degree FROM ends GROUP BY tree, node)")
def _(edges, designed, spark, d):
    return trees.node_type(edges)


@tree_query("gr14_orientation", "up", "SELECT tree, below AS n, max(steps) AS level FROM up GROUP BY tree, below")
def _(edges, designed, spark, d):
    return trees.levels(edges).select("tree", "n", F.col("level").cast("int").alias("level"))


@tree_query("gr28_run_length_rule", "")
def _(edges, designed, spark, d):
    return trees.enforce_runs(designed)


@tree_query("gr29_optimal_diameters", "")
def _(edges, designed, spark, d):
    return trees.optimal_diameters(designed)


@query("gr30_plan_score", "totals variants", VARIANTS)
def _(spark, d):
    cost = F.sum(F.col("pipe_cost") + F.col("chamber_cost") + F.col("tie_ins") * K.DEFAULT.tie_in)
    totals = trees.tree_totals(designed(spark, d)).join(T.variants(spark, d), "tree").groupBy("plan", "variant").agg(cost.alias("cost"), F.sum("length_m").alias("length_m"))
    return totals.withColumn("score", F.round(S.score(F.col("cost"), F.col("length_m")), 6))


@query("gr35_degree_warnings", "net_nodes net_segments cps", f"{USED} SELECT node_id, pipes + used AS degree FROM degree WHERE pipes + used > 4")
def _(spark, d):
    return chamber_degrees(spark, d).select("node_id", (F.col("pipes") + F.col("used")).alias("degree")).filter("degree > 4")


@query("prj16_degree_limit", "ends", "SELECT tree, node, count(*) AS degree FROM ends GROUP BY tree, node HAVING count(*) > 2")
def _(spark, d):
    return trees.node_degree(T.edges(spark, d)).filter("degree > 2")


# Ordered rows.


def street(spark: SparkSession, d: str) -> DataFrame:
    """A line through the network's nodes, in parts of 25."""
    return T.net_nodes(spark, d).select(F.floor(F.col("node_id") / 25).alias("line"), F.col("node_id").alias("pos"), "x", "y")


STREET = ", street AS (SELECT node_id // 25 AS line, node_id AS pos, x, y FROM net_nodes)"


@query("wn02_turns", "net_nodes", f"{STREET} SELECT line, pos, round(degrees(atan2(abs(ax * by_ - ay * bx), ax * bx + ay * by_)), 6) AS turn FROM (SELECT line, pos, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM street WINDOW w AS (PARTITION BY line ORDER BY pos)) WHERE ax IS NOT NULL AND bx IS NOT NULL")
def _(spark, d):
    return sequences.turns(street(spark, d), "line", "pos").select("line", "pos", F.round("turn", 6).alias("turn"))


@query("prj13_turn_legality", "net_nodes", f"{STREET} SELECT line, count(*) FILTER (WHERE ax * bx + ay * by_ < 0) AS illegal, count(*) AS vertices FROM (SELECT line, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM street WINDOW w AS (PARTITION BY line ORDER BY pos)) WHERE ax IS NOT NULL AND bx IS NOT NULL GROUP BY line")
def _(spark, d):
    return sequences.turns(street(spark, d), "line", "pos").groupBy("line").agg(F.count(F.when(F.col("turn") > 90 + 1e-6, 1)).alias("illegal"), F.count("*").alias("vertices"))


@query("wn03_cumulative_length", "net_nodes", f"{STREET} SELECT line, pos, round(sum(step) OVER (PARTITION BY line ORDER BY pos), 4) AS way FROM (SELECT line, pos, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS step FROM street WINDOW w AS (PARTITION BY line ORDER BY pos))")
def _(spark, d):
    return sequences.cumulative(street(spark, d), "line", "pos").select("line", "pos", F.round("way", 4).alias("way"))


@query("ge01_line_length", "net_nodes", f"{STREET} SELECT line, round(sum(step), 4) AS length FROM (SELECT line, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0.0) AS step FROM street WINDOW w AS (PARTITION BY line ORDER BY pos)) GROUP BY line")
def _(spark, d):
    return sequences.cumulative(street(spark, d), "line", "pos").groupBy("line").agg(F.round(F.max("way"), 4).alias("length"))


def strips(spark: SparkSession, d: str) -> DataFrame:
    """Spans of special restrictions along horizontal strips."""
    return ruled(spark, d).filter("mode = 'SPECIAL'").select(F.floor(F.col("y0") / 50).alias("strip"), F.col("x0").cast("double").alias("s0"), F.col("x1").cast("double").alias("s1"), "factor")


STRIPS = f", strips AS (SELECT y0 // 50 AS strip, CAST(x0 AS DOUBLE) AS s0, CAST(x1 AS DOUBLE) AS s1, factor FROM ({RULED}) WHERE mode = 'SPECIAL')"


@query(
    "wn04_merged_spans",
    "rects rules",
    f"{STRIPS}, flagged AS (SELECT *, CASE WHEN s0 <= max(s1) OVER (PARTITION BY strip ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM strips), isl AS (SELECT *, sum(f) OVER (PARTITION BY strip ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM flagged) SELECT strip, min(s0) AS s0, max(s1) AS s1, max(factor) AS factor FROM isl GROUP BY strip, g",
)
def _(spark, d):
    return sequences.merged_spans(strips(spark, d), "strip", "s0", "s1", "factor")


@query(
    "wn05_split_spans",
    "rects rules",
    f"{STRIPS}, cuts AS (SELECT strip, s0 AS c FROM strips UNION SELECT strip, s1 FROM strips UNION SELECT DISTINCT strip, 0.0 FROM strips UNION SELECT DISTINCT strip, 2100.0 FROM strips), p AS (SELECT strip, c, lead(c) OVER (PARTITION BY strip ORDER BY c) AS e FROM cuts) SELECT p.strip, p.c AS s0, p.e AS s1, coalesce((SELECT max(factor) FROM strips t WHERE t.strip = p.strip AND t.s0 <= (p.c + p.e) / 2 AND t.s1 >= (p.c + p.e) / 2), 0) AS factor FROM p WHERE e IS NOT NULL",
)
def _(spark, d):
    s = strips(spark, d)
    return sequences.split_spans(s, s.select("strip").distinct().withColumn("length", F.lit(2100)), "strip", "s0", "s1", "factor")


@query("wn09_progress_clamp", "run_events", "SELECT run_id, seq, progress, greatest(0, least(100, max(progress) OVER (PARTITION BY run_id ORDER BY seq))) AS shown FROM run_events")
def _(spark, d):
    return sequences.clamped(T.run_events(spark, d)).select("run_id", "seq", "progress", "shown")


@query("wn11_depth_at_distance", "edges", "SELECT tree, n, round(3.0 + (CAST(1 + n % 4 AS DOUBLE) - 3.0) * (len_m / 3.0) / len_m, 6) AS depth FROM edges")
def _(spark, d):
    length = F.col("len_m").cast("double")
    depth = sequences.interpolated(length / 3.0, F.lit(0.0), length, F.lit(3.0), (1 + F.col("n") % 4).cast("double"))
    return T.edges(spark, d).select("tree", "n", F.round(depth, 6).alias("depth"))


@query("wn12_thinned", "run_events", "SELECT run_id, seq FROM run_events WHERE (seq - 1) % 5 = 0 OR progress >= 95")
def _(spark, d):
    return sequences.thinned(T.run_events(spark, d), "run_id", "seq", 5, F.col("progress") >= 95).select("run_id", "seq")


# Scalars, sets, top-k.


@query("prj18_snapped_up", "edges", "SELECT tree, n, CASE WHEN ceil(v - 1e-9) - v <= 0.25 THEN CAST(ceil(v - 1e-9) AS DOUBLE) ELSE v END AS snapped FROM (SELECT tree, n, len_m / 4.0 AS v FROM edges)")
def _(spark, d):
    return T.edges(spark, d).select("tree", "n", S.snapped_up(F.col("len_m") / 4.0, 0.25).alias("snapped"))


@query("prj03_lenient_numbers", "", "SELECT p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS brand_no, try_cast(p_name AS DOUBLE) AS name_no, try_cast(CAST(p_size AS VARCHAR) AS INT) AS size_no FROM part")
def _(spark, d):
    part = T.table(spark, d, "part")
    return part.select("p_partkey", F.expr("try_cast(regexp_replace(p_brand, '[^0-9]', '') as bigint)").alias("brand_no"), F.expr("try_cast(p_name as double)").alias("name_no"), F.expr("try_cast(cast(p_size as string) as int)").alias("size_no"))


def utm(spark: SparkSession, d: str) -> DataFrame:
    points = T.connection_points(spark, d).select("cp_id", (37.0 + F.col("x") / 10000.0).alias("lon"), (55.0 + F.col("y") / 10000.0).alias("lat"))
    x, y = S.to_utm(F.col("lon"), F.col("lat"))
    return points.withColumn("ux", x).withColumn("uy", y)


@query("prj04_utm_round_trip", "cps", "SELECT cp_id, round(37.0 + x / 10000.0, 8) AS lon, round(55.0 + y / 10000.0, 8) AS lat FROM cps")
def _(spark, d):
    lon, lat = S.to_wgs84(F.col("ux"), F.col("uy"))
    return utm(spark, d).select("cp_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("ge04_point_to_segment", "net_segments", "SELECT seg_id, round(sqrt((1000 - x1 - t * (x2 - x1)) * (1000 - x1 - t * (x2 - x1)) + (900 - y1 - t * (y2 - y1)) * (900 - y1 - t * (y2 - y1))), 6) AS dist FROM (SELECT *, greatest(0.0, least(1.0, ((1000 - x1) * (x2 - x1) + (900 - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS t FROM net_segments)")
def _(spark, d):
    return T.net_segments(spark, d).select("seg_id", F.round(S.point_to_segment(F.lit(1000), F.lit(900), *map(F.col, ("x1", "y1", "x2", "y2"))), 6).alias("dist"))


@query("ge13_hex_cells", "cps", "SELECT cp_id, CAST(round((x // 10 + CASE WHEN (y // 10) % 2 = 1 THEN 0.5 ELSE 0.0 END) * 10.0, 6) AS DOUBLE) AS hx, round((y // 10) * (10.0 * sqrt(3) / 2), 6) AS hy FROM cps")
def _(spark, d):
    hx, hy = S.hex_centre(F.floor(F.col("x") / 10), F.floor(F.col("y") / 10), 10.0)
    return T.connection_points(spark, d).select("cp_id", F.round(hx, 6).alias("hx"), F.round(hy, 6).alias("hy"))


@query("ge15_tile_metres", "cps", "SELECT cp_id, round(400.0 / 110540.0, 8) AS dlat, round(400.0 / (111320.0 * cos(radians(55.0 + y / 10000.0))), 8) AS dlon FROM cps")
def _(spark, d):
    lat = 55.0 + F.col("y") / 10000.0
    return T.connection_points(spark, d).select("cp_id", F.lit(round(400.0 / 110540.0, 8)).alias("dlat"), F.round(400.0 / (111320.0 * F.cos(F.radians(lat))), 8).alias("dlon"))


@query("st01_candidates_distinct", "net_nodes cps", "SELECT gx, gy, min(pri) AS source FROM (SELECT x // 10 AS gx, y // 10 AS gy, 1 AS pri FROM net_nodes WHERE is_chamber UNION ALL SELECT x // 10, y // 10, 2 FROM net_nodes UNION ALL SELECT x // 10, y // 10, 3 FROM cps) GROUP BY gx, gy")
def _(spark, d):
    nodes, points = T.net_nodes(spark, d), T.connection_points(spark, d)

    def cells(df: DataFrame, source: int) -> DataFrame:
        return df.select(F.floor(F.col("x") / 10).alias("gx"), F.floor(F.col("y") / 10).alias("gy"), F.lit(source).alias("source"))

    return cells(nodes.filter("is_chamber"), 1).union(cells(nodes, 2)).union(cells(points, 3)).groupBy("gx", "gy").agg(F.min("source").alias("source"))


@query("st02_distinct_plans", "edges", "SELECT sig, min(tree) AS tree, count(*) AS copies FROM (SELECT tree, sha256(string_agg(s, ';' ORDER BY s)) AS sig FROM (SELECT tree, parent || '>' || n || ';' || len_m AS s FROM edges) GROUP BY tree) GROUP BY sig")
def _(spark, d):
    part = F.concat_ws("", F.col("parent"), F.lit(">"), F.col("n"), F.lit(";"), F.col("len_m"))
    signs = T.edges(spark, d).groupBy("tree").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ";"), 256).alias("sig"))
    return signs.groupBy("sig").agg(F.min("tree").alias("tree"), F.count("*").alias("copies"))


@query("st03_unconnected", "cps", "SELECT cp_id FROM cps WHERE NOT (flow > 20 OR cp_id % 3 = 0)")
def _(spark, d):
    points = T.connection_points(spark, d).select("cp_id", "flow")
    connected = points.filter("flow > 20").select("cp_id").union(points.filter("cp_id % 3 = 0").select("cp_id"))
    return points.select("cp_id").join(connected, "cp_id", "left_anti")


@query("st05_flattened_parts", "rects", "SELECT r_id, unnest([x0, x1]) AS x, unnest([y0, y1]) AS y FROM rects")
def _(spark, d):
    return T.rects(spark, d).select("r_id", F.inline(F.arrays_zip(F.array("x0", "x1").alias("x"), F.array("y0", "y1").alias("y")))).toDF("r_id", "x", "y")


@query("tk03_nearest_chambers", "cps net_nodes", "SELECT cp_id, node_id, dist2, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cp_id ORDER BY dist2, node_id) AS INT) AS nth FROM (SELECT cp_id, node_id, (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) AS dist2 FROM cps c CROSS JOIN net_nodes n WHERE n.is_chamber)) WHERE nth <= 25")
def _(spark, d):
    return spatial.nearest(T.connection_points(spark, d), T.net_nodes(spark, d).filter("is_chamber"), 25)


@query("tk06_runs_newest_first", "run_events", "SELECT run_id, max(ts) AS last_ts, count(*) AS events FROM run_events GROUP BY run_id")
def _(spark, d):
    return T.run_events(spark, d).groupBy("run_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("events")).orderBy(F.desc("last_ts"), "run_id")


# Life of a run.


@query("sm01_latest_progress", "run_events", "SELECT run_id, arg_max(stage, seq) AS stage, max(progress) AS progress FROM run_events GROUP BY run_id")
def _(spark, d):
    return T.run_events(spark, d).groupBy("run_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("progress").alias("progress"))


@query("sm02_run_status", "run_events", "SELECT run_id, CASE WHEN count(*) FILTER (WHERE stage = 'error') > 0 THEN 'PARTIAL' WHEN max(progress) >= 100 THEN 'DONE' ELSE 'RUNNING' END AS status FROM run_events GROUP BY run_id")
def _(spark, d):
    """Events of the stage error stand for points that a run leaves unconnected."""
    from netloom.streaming import progress

    rows = T.run_events(spark, d)
    return progress.status(progress.latest(rows), rows.filter("stage = 'error'").select("run_id"))


# Validation.


@query("val03_points_are_leaves", "edges", "SELECT tree, n FROM edges e WHERE flow > 40 AND EXISTS (SELECT 1 FROM edges c WHERE c.tree = e.tree AND c.parent = e.n)", )
def _(spark, d):
    """Edges with a large draw stand for those that end at a point; the fault is one that goes on."""
    e = T.edges(spark, d)
    return e.filter("flow > 40").join(e.filter("parent > 0").select("tree", F.col("parent").alias("n")).distinct(), ["tree", "n"], "left_semi").select("tree", "n")


@query("val06_chamber_degree", "ends", "SELECT tree, node, count(*) AS degree FROM ends GROUP BY tree, node HAVING count(*) > 4")
def _(spark, d):
    return trees.node_degree(T.edges(spark, d)).filter("degree > 4")


@query("val10_branching_summary", "ends", "SELECT degree, count(*) AS nodes FROM (SELECT tree, node, count(*) AS degree FROM ends GROUP BY tree, node) GROUP BY degree")
def _(spark, d):
    return trees.node_degree(T.edges(spark, d)).groupBy("degree").agg(F.count("*").alias("nodes"))


# Ingest.


def features(spark: SparkSession, d: str) -> DataFrame:
    """Feature texts of all kinds, also faulty ones, made of the tables."""
    from netloom.sources.sinks import feature

    p = T.connection_points(spark, d)
    spot = F.struct(F.lit("Point").alias("type"), F.array(37.0 + F.col("x") / 10000.0, 55.0 + F.col("y") / 10000.0).alias("coordinates"))
    points = p.select(F.col("cp_id").alias("feature_seq"), feature(spot, F.struct(F.col("cp_id").alias("id"), F.when(F.col("cp_id") % 11 == 0, "oks_future").when(F.col("cp_id") % 13 == 0, "unheard_of").otherwise("oks_connection_point").alias("object_type"), F.col("flow").alias("flow_tph"))).alias("feature"))
    r = T.rects(spark, d)

    def corner(x: str, y: str):
        return F.array(F.col(x).cast("double"), F.col(y).cast("double"))

    ring = F.when(F.col("r_id") % 7 == 0, F.lit(None)).otherwise(F.array(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y0"))))
    shape = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    kind = F.when(F.col("r_id") % 5 == 0, "heat_chamber").otherwise("restriction")
    boxes = r.select((F.col("r_id") + 10_000_000).alias("feature_seq"), feature(shape, F.struct(F.concat(F.lit("r"), F.col("r_id")).alias("id"), kind.alias("object_type"), F.when(F.col("r_id") % 3 > 0, F.col("rtype")).alias("restriction_type"))).alias("feature"))
    return points.union(boxes)


@query(
    "prj01_classified_features",
    "cps rects",
    """SELECT object_type, status, count(*) AS n FROM (
      SELECT CASE WHEN cp_id % 11 = 0 THEN 'oks_future' WHEN cp_id % 13 = 0 THEN 'unheard_of' ELSE 'oks_connection_point' END AS object_type, CASE WHEN cp_id % 11 = 0 THEN NULL WHEN cp_id % 13 = 0 THEN 'UNKNOWN_OBJECT_TYPE' ELSE 'OK' END AS status FROM cps
      UNION ALL SELECT CASE WHEN r_id % 5 = 0 THEN 'heat_chamber' ELSE 'restriction' END, CASE WHEN r_id % 7 = 0 THEN 'INVALID_GEOMETRY' WHEN r_id % 5 = 0 THEN 'WRONG_GEOMETRY_TYPE' WHEN r_id % 3 = 0 THEN 'MISSING_RESTRICTION_TYPE' ELSE 'OK' END FROM rects
    ) GROUP BY object_type, status""",
)
def _(spark, d):
    from netloom.sources import geojson

    return geojson.diagnostics(geojson.classified(features(spark, d)))


@query(
    "src01_collections_read_back",
    "cps rects",
    """SELECT CAST(cp_id AS VARCHAR) AS id, 'Point' AS gtype, CAST(flow AS DOUBLE) AS flow_tph FROM cps
    UNION ALL SELECT 'r' || r_id, 'Polygon', NULL FROM rects""",
)
def _(spark, d):
    """Features written as collections and read again in parts."""
    from uuid import uuid4

    from netloom.sources import geojson, shared, sinks

    path = f"{shared.shared_dir(spark)}/collections-{uuid4().hex}"
    sinks.write_collections(features(spark, d).withColumn("bucket", F.col("feature_seq") % 16), path, "bucket", ["feature_seq"])
    return geojson.parsed(geojson.read_collection(spark, path)).select("id", "gtype", "flow_tph")


@query("src03_parsed_geometry", "rects", "SELECT r_id, r_id % 7 <> 0 AS sound, CASE WHEN r_id % 7 <> 0 THEN 4 ELSE 0 END AS vertices, CASE WHEN r_id % 7 <> 0 THEN CAST(x1 AS DOUBLE) END AS right_x FROM rects")
def _(spark, d):
    from netloom.sources import geojson

    rows = geojson.classified(features(spark, d).filter("feature_seq >= 10000000"))
    return rows.select((F.col("feature_seq") - 10_000_000).alias("r_id"), F.col("lines").isNotNull().alias("sound"), F.coalesce(F.size(F.get("lines", F.lit(0))), F.lit(0)).alias("vertices"), F.array_max(F.transform(F.get("lines", F.lit(0)), lambda p: p[0])).alias("right_x"))


@query("prj03_numeric_ids", "cps rects", "SELECT id_is_numeric, count(*) AS n FROM (SELECT true AS id_is_numeric FROM cps UNION ALL SELECT false FROM rects) GROUP BY id_is_numeric")
def _(spark, d):
    from netloom.sources import geojson

    return geojson.parsed(features(spark, d)).groupBy("id_is_numeric").agg(F.count("*").alias("n"))


# Planning by tiles.

TILE = 400


def planned(spark: SparkSession, d: str) -> DataFrame:
    from netloom.operators import planner

    def tiled(df: DataFrame) -> DataFrame:
        return df.withColumn("tile", (F.floor(F.col("x") / TILE) * 1000 + F.floor(F.col("y") / TILE)).cast("long"))

    points = tiled(T.connection_points(spark, d)).select("tile", F.col("cp_id").alias("id"), "x", "y", "flow")
    spots = tiled(T.connection_points(spark, d).filter("cp_id % 40 = 1")).select("tile", F.col("cp_id").alias("id"), "x", "y")
    boxes = ruled(spark, d).filter("mode = 'PROHIBITED'")
    boxes = spatial.binned(boxes, "x0", "y0", "x1", "y1", 0, TILE).select((F.col("_bin.bx") * 1000 + F.col("_bin.by")).cast("long").alias("tile"), "x0", "y0", "x1", "y1")
    return planner.plan(points, spots, boxes)


def planned_once(spark: SparkSession, d: str) -> DataFrame:
    """The plan's edges as a written table, for queries that read them several times: the search runs once."""
    from netloom.sources import shared

    return shared.written(planned(spark, d).filter("edge is not null"), "planned")


def planned_unconnected(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(cp_id, flow): the points that the planner reports as unconnected, the same in all variants."""
    return rows.filter("unconnected is not null").select(F.col("unconnected").alias("cp_id")).join(points.select("cp_id", "flow"), "cp_id")


@query("jn22_planned_unconnected")
def _(spark, d):
    return planned_unconnected(planned(spark, d), T.connection_points(spark, d)).select("cp_id", "flow")


@query("ag08_planned_penalty")
def _(spark, d):
    return planned_unconnected(planned(spark, d), T.connection_points(spark, d)).agg(F.count("*").alias("n"), F.sum(S.penalty(F.col("flow"))).alias("penalty"))


@query("gr36_planned_summary")
def _(spark, d):
    from netloom.operators import assembly

    rows = planned(spark, d)
    largest = F.lit(max(r[0] for r in K.DEFAULT.diameters))
    edges = rows.filter("edge is not null").select("variant", "length", F.coalesce(S.smallest_dn(F.col("flow")), largest).alias("dn"))
    costs = edges.select("variant", S.segment_cost(F.col("length"), F.col("dn")).alias("cost"))
    lost = costs.select("variant").distinct().crossJoin(planned_unconnected(rows, T.connection_points(spark, d)))
    return assembly.summary(costs, lost, "variant")


@query("gr09_grown_forest")
def _(spark, d):
    rows = planned(spark, d)
    return rows.groupBy("tile", "variant").agg(F.count("edge").alias("edges"), F.count("unconnected").alias("lost"), F.round(F.sum("length"), 3).alias("length_m"), F.round(F.sum(F.when(F.col("parent") == 0, F.col("flow"))), 3).alias("flow"))


@query("val05_planned_turns")
def _(spark, d):
    points = planned(spark, d).filter("edge is not null").select("tile", "variant", "edge", F.posexplode("line").alias("pos", "p"))
    key = F.concat_ws("/", "tile", "variant", "edge").alias("line")
    return sequences.turns(points.select(key, "pos", "p.x", "p.y"), "line", "pos").groupBy((F.col("turn") > 90.05).alias("illegal")).agg(F.count("*").alias("vertices"))


@query("val03_planned_leaves")
def _(spark, d):
    edges = planned(spark, d).filter("edge is not null")
    inner = edges.select("tile", "variant", F.col("parent").alias("edge")).filter("edge > 0").distinct()
    ends = edges.filter("node >= 0").join(inner.withColumn("inner", F.lit(True)), ["tile", "variant", "edge"], "left")
    return ends.groupBy("variant").agg(F.count("*").alias("points"), F.count("inner").alias("not_leaves"))


# Depth, medians, assembly.


@query("wn07_depth_profiles")
def _(spark, d):
    from netloom.operators import depth

    e = T.edges(spark, d).select((F.col("tree") * 100 + F.col("n")).alias("edge"), (F.col("len_m") * 2).cast("double").alias("length"), "rtype")
    asked = e.filter("rtype <> 'N'").select("edge", (F.col("length") / 2 - 2).alias("start"), (F.col("length") / 2 + 2).alias("end"), F.when(F.col("rtype") == "A", 2.5).otherwise(3.6).alias("depth"))
    return depth.profiles(e, asked)


@query("val11_depth_rules", "edges", "SELECT edge, s0, CASE WHEN least(h0, h1) < 0.7 - 1e-9 THEN 'SHALLOW' ELSE 'STEEP' END AS what FROM (SELECT tree * 100 + n AS edge, CAST(0 AS DOUBLE) AS s0, CAST(len_m AS DOUBLE) AS s1, 3.0 AS h0, 3.0 - flow / 16.0 AS h1 FROM edges) WHERE least(h0, h1) < 0.7 - 1e-9 OR abs(h1 - h0) > 0.1 * (s1 - s0) + 1e-9")
def _(spark, d):
    """Pieces with made-up depths, some too shallow and some too steep."""
    from netloom.operators import depth

    e = T.edges(spark, d).select((F.col("tree") * 100 + F.col("n")).alias("edge"), F.lit(0.0).alias("s0"), F.col("len_m").cast("double").alias("s1"), F.lit(3.0).alias("h0"), (3.0 - F.col("flow") / 16.0).alias("h1"))
    return depth.violations(e)


@query("val11_planned_depths")
def _(spark, d):
    """Profiles that the operator makes break no rule, so the answer has no rows."""
    from netloom.operators import depth

    return depth.violations(QUERIES["wn07_depth_profiles"](spark, d)).groupBy("what").agg(F.count("*").cast("int").alias("n"))


@query("ag13_geometric_median")
def _(spark, d):
    from netloom.operators import medians

    points = T.connection_points(spark, d).select((F.floor(F.col("x") / 100) * 100 + F.floor(F.col("y") / 100)).alias("block"), "x", "y", F.col("flow").alias("weight"))
    return medians.medians(points, "block").select("block", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def special_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and made-up special stretches on them, in metres along the edge."""
    e = designed(spark, d).select((F.col("tree") * 100 + F.col("n")).alias("edge"), F.col("len_m").cast("double").alias("length"), "dn", "rtype")
    s = e.filter("rtype <> 'N'").select("edge", (F.col("length") / 4).alias("s0"), (F.col("length") / 2).alias("s1"), F.lit(150).cast("long").alias("factor"))
    t = e.filter("rtype = 'A'").select("edge", (F.col("length") / 8).alias("s0"), (3 * F.col("length") / 8).alias("s1"), F.lit(170).cast("long").alias("factor"))
    return e, s.union(t)


@query(
    "gr36_result_pieces",
    "designed",
    """, e AS (SELECT tree * 100 + n AS edge, CAST(len_m AS DOUBLE) AS l, dn, rtype FROM designed),
    s AS (SELECT edge, l / 4 AS s0, l / 2 AS s1, 150 AS factor FROM e WHERE rtype <> 'N' UNION ALL SELECT edge, l / 8, 3 * l / 8, 170 FROM e WHERE rtype = 'A'),
    c AS (SELECT edge, 0.0 AS s FROM e UNION SELECT edge, l FROM e UNION SELECT edge, s0 FROM s UNION SELECT edge, s1 FROM s),
    p AS (SELECT edge, s AS s0, lead(s) OVER (PARTITION BY edge ORDER BY s) AS s1, row_number() OVER (PARTITION BY edge ORDER BY s) > 1 AS technical FROM c),
    q AS (SELECT p.edge, p.s0, p.s1, p.technical, CAST(coalesce(max(s.factor), 100) AS BIGINT) AS factor FROM p LEFT JOIN s ON s.edge = p.edge AND s.s0 <= (p.s0 + p.s1) / 2 AND (p.s0 + p.s1) / 2 <= s.s1 WHERE p.s1 IS NOT NULL GROUP BY ALL)
    SELECT q.*, q.factor * 0 + CAST(floor((q.s1 - q.s0) * cat.price * 1.0 * (q.factor / 100.0) + 0.5) AS BIGINT) AS cost, e.dn FROM q JOIN e ON e.edge = q.edge JOIN cat ON cat.dn = e.dn""",
)
def _(spark, d):
    from netloom.operators import assembly

    e, s = special_spans(spark, d)
    return assembly.priced(assembly.pieces(e, s), e)


@query("gr36_variant_summary", "cps net_segments", f"{LOST} SELECT c.cp_id % 3 AS variant, CAST(sum(c.flow * 1000) AS BIGINT) AS construction_cost, CAST(sum(CASE WHEN l.cp_id IS NOT NULL THEN {K.DEFAULT.penalty[0]} + c.flow * {K.DEFAULT.penalty[1]} ELSE 0 END) AS BIGINT) AS penalty, CAST(sum(c.flow * 1000 + CASE WHEN l.cp_id IS NOT NULL THEN {K.DEFAULT.penalty[0]} + c.flow * {K.DEFAULT.penalty[1]} ELSE 0 END) AS BIGINT) AS calculated_cost, count(l.cp_id) AS lost FROM cps c LEFT JOIN lost l ON l.cp_id = c.cp_id GROUP BY 1")
def _(spark, d):
    from netloom.operators import assembly

    variant = (F.col("cp_id") % 3).alias("variant")
    costs = T.connection_points(spark, d).select(variant, (F.col("flow") * 1000).alias("cost"))
    return assembly.summary(costs, lost_points(spark, d).select(variant, "cp_id", "flow"), "variant")


@tree_query(
    "gr13_contracted_chains",
    "designed",
    """, k AS (SELECT d.*, (SELECT count(*) FROM designed c WHERE c.tree = d.tree AND c.parent = d.n) AS children FROM designed d),
    f AS (SELECT k.tree, k.n, k.parent, k.len_m, coalesce(p.children = 1 AND p.dn = k.dn, false) AS goes_on FROM k LEFT JOIN k p ON p.tree = k.tree AND p.n = k.parent AND k.parent > 0),
    h AS (SELECT tree, n AS head, n, len_m, 0 AS k FROM f WHERE NOT goes_on UNION ALL SELECT h.tree, h.head, f.n, f.len_m, h.k + 1 FROM h JOIN f ON f.tree = h.tree AND f.parent = h.n AND f.goes_on)
    SELECT tree, CAST(head AS BIGINT) AS head, arg_max(n, k) AS tail, count(*) AS edges, CAST(sum(len_m) AS BIGINT) AS len_m FROM h GROUP BY tree, head""",
)
def _(edges, designed, spark, d):
    from netloom.operators import assembly

    return assembly.contracted(designed)


# Obstacles.


def keep_outs(spark: SparkSession, d: str) -> DataFrame:
    return ruled(spark, d).filter("mode = 'PROHIBITED'").withColumn("keep", F.col("min_dist") / 10.0)


@query(
    "prj08_blocked_segments",
    "net_segments rects rules",
    f""", z AS (SELECT * FROM ({RULED}) WHERE mode = 'PROHIBITED'),
    p AS (SELECT s.seg_id, z.r_id, z.min_dist / 10.0 AS keep, CAST(s.x1 AS DOUBLE) AS a, CAST(s.y1 AS DOUBLE) AS b, CAST(s.x2 AS DOUBLE) AS c, CAST(s.y2 AS DOUBLE) AS e, z.x0, z.y0, z.x1, z.y1 FROM net_segments s CROSS JOIN z),
    k AS (SELECT seg_id, r_id, keep, a, b, c, e, x0, y0, x1, y1, unnest([{{'x': x0, 'y': y0}}, {{'x': x1, 'y': y0}}, {{'x': x1, 'y': y1}}, {{'x': x0, 'y': y1}}]) AS v FROM p),
    t AS (SELECT *, greatest(0.0, least(1.0, ((v.x - a) * (c - a) + (v.y - b) * (e - b)) / ((c - a) * (c - a) + (e - b) * (e - b)))) AS t FROM k),
    corner AS (SELECT seg_id, r_id, min(sqrt(pow(v.x - a - t * (c - a), 2) + pow(v.y - b - t * (e - b), 2))) AS far FROM t GROUP BY seg_id, r_id),
    -- Liang and Barsky: what of the segment is in the box.
    w AS (SELECT *, CASE WHEN c <> a THEN least((x0 - a) / (c - a), (x1 - a) / (c - a)) WHEN a BETWEEN x0 AND x1 THEN 0.0 ELSE 2.0 END AS u0, CASE WHEN c <> a THEN greatest((x0 - a) / (c - a), (x1 - a) / (c - a)) WHEN a BETWEEN x0 AND x1 THEN 1.0 ELSE -1.0 END AS u1,
      CASE WHEN e <> b THEN least((y0 - b) / (e - b), (y1 - b) / (e - b)) WHEN b BETWEEN y0 AND y1 THEN 0.0 ELSE 2.0 END AS v0, CASE WHEN e <> b THEN greatest((y0 - b) / (e - b), (y1 - b) / (e - b)) WHEN b BETWEEN y0 AND y1 THEN 1.0 ELSE -1.0 END AS v1 FROM p),
    f AS (SELECT w.seg_id, w.r_id, keep, CASE WHEN greatest(u0, v0, 0.0) <= least(u1, v1, 1.0) THEN 0.0 ELSE least(far, sqrt(pow(greatest(x0 - a, 0, a - x1), 2) + pow(greatest(y0 - b, 0, b - y1), 2)), sqrt(pow(greatest(x0 - c, 0, c - x1), 2) + pow(greatest(y0 - e, 0, e - y1), 2))) END AS dist FROM w JOIN corner USING (seg_id, r_id))
    SELECT seg_id, r_id, round(dist, 6) AS dist FROM f WHERE dist < keep - 1e-3""",
)
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.blocked(T.net_segments(spark, d), keep_outs(spark, d), 10.0).select("seg_id", "r_id", F.round("dist", 6).alias("dist"))


@query(
    "prj09_crossing_angles",
    "net_segments rects",
    """, sides AS (SELECT r_id, x0 AS a, y0 AS b, x1 AS c, y0 AS e FROM rects UNION ALL SELECT r_id, x1, y0, x1, y1 FROM rects UNION ALL SELECT r_id, x1, y1, x0, y1 FROM rects UNION ALL SELECT r_id, x0, y1, x0, y0 FROM rects)
    SELECT seg_id, r_id, round(min(least(t, 180 - t)), 6) AS angle FROM (
      SELECT seg_id, r_id, degrees(atan2(abs(CAST((x2 - x1) * (e - b) - (y2 - y1) * (c - a) AS DOUBLE)), CAST((x2 - x1) * (c - a) + (y2 - y1) * (e - b) AS DOUBLE))) AS t FROM net_segments CROSS JOIN sides
      WHERE sign((x2 - x1) * (b - y1) - (y2 - y1) * (a - x1)) * sign((x2 - x1) * (e - y1) - (y2 - y1) * (c - x1)) < 0 AND sign((c - a) * (y1 - b) - (e - b) * (x1 - a)) * sign((c - a) * (y2 - b) - (e - b) * (x2 - a)) < 0) GROUP BY seg_id, r_id""",
)
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.crossing_angles(T.net_segments(spark, d), T.rects(spark, d))


@query(
    "prj14_chamber_pair_angles",
    "cps net_nodes",
    """, d AS (SELECT node_id, cp_id, dx, dy FROM (SELECT n.node_id, c.cp_id, c.x - n.x AS dx, c.y - n.y AS dy FROM cps c CROSS JOIN net_nodes n) WHERE dx * dx + dy * dy BETWEEN 1 AND 10000)
    SELECT a.node_id, round(min(degrees(atan2(abs(CAST(a.dx * b.dy - a.dy * b.dx AS DOUBLE)), CAST(a.dx * b.dx + a.dy * b.dy AS DOUBLE)))), 4) AS angle, any_value(k.n) AS n FROM d a JOIN d b ON b.node_id = a.node_id AND b.cp_id <> a.cp_id JOIN (SELECT node_id, count(*) AS n FROM d GROUP BY node_id) k ON k.node_id = a.node_id GROUP BY a.node_id""",
)
def _(spark, d):
    from netloom.operators import obstacles

    points, nodes = T.connection_points(spark, d), T.net_nodes(spark, d)
    near = spatial.within(points, nodes, 100).filter("dist2 >= 1").join(points.select("cp_id", "x", "y"), "cp_id").join(nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny")), "node_id")
    return obstacles.narrowest_angles(near.select("node_id", (F.col("x") - F.col("nx")).alias("dx"), (F.col("y") - F.col("ny")).alias("dy")), "node_id")


@query("ge08_gates", "net_segments", "SELECT seg_id, CAST(nth AS INT) AS nth, round(x1 + nth * 5.0 / l * (x2 - x1), 6) AS x, round(y1 + nth * 5.0 / l * (y2 - y1), 6) AS y FROM (SELECT *, unnest(generate_series(0, CAST(floor(l / 5.0) AS BIGINT))) AS nth FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM net_segments))")
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.gates(T.net_segments(spark, d), 5.0)


@query(
    "gr33_bands_and_gates",
    "cps net_segments",
    """SELECT cp_id, seg_id, abs(t * l - floor(t * l / 5.0 + 0.5) * 5.0) <= 0.5 + 1e-9 AS in_gate FROM (
      SELECT c.cp_id, s.seg_id, c.x, c.y, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS t FROM cps c CROSS JOIN net_segments s)
    WHERE sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) < 30""",
)
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.in_bands(T.connection_points(spark, d), T.net_segments(spark, d), 30.0, 5.0, 1.0)


EXITS = """, b AS (SELECT * FROM rects WHERE rtype = 'oks'),
    o AS (SELECT c.*, r.* FROM cps c JOIN b r ON r.r_id = (SELECT min(r_id) FROM b q WHERE c.x BETWEEN q.x0 AND q.x1 AND c.y BETWEEN q.y0 AND q.y1)),
    w AS (SELECT cp_id, r_id, 'W' AS side, CAST(x0 - 5 AS DOUBLE) AS ex, CAST(y AS DOUBLE) AS ey, CAST(x - x0 AS DOUBLE) AS inside FROM o UNION ALL SELECT cp_id, r_id, 'E', x1 + 5, y, x1 - x FROM o UNION ALL SELECT cp_id, r_id, 'S', x, y0 - 5, y - y0 FROM o UNION ALL SELECT cp_id, r_id, 'N', x, y1 + 5, y1 - y FROM o)
    SELECT cp_id, r_id, side, ex, ey, inside + 5.0 AS tail, CAST(row_number() OVER (PARTITION BY cp_id ORDER BY inside, side) AS INT) AS nth FROM w WHERE inside <= 15
      AND NOT EXISTS (SELECT 1 FROM b q WHERE q.r_id <> w.r_id AND pow(greatest(q.x0 - ex, 0, ex - q.x1), 2) + pow(greatest(q.y0 - ey, 0, ey - q.y1), 2) < 4.999 * 4.999)"""


@query("gr34_exits", "cps rects", EXITS)
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.exits(T.connection_points(spark, d), T.rects(spark, d).filter("rtype = 'oks'"), 5.0, 15.0)


@query("tk02_canonical_exits", "cps rects", EXITS.replace("SELECT cp_id, r_id, side, ex, ey, inside + 5.0 AS tail, CAST(row_number() OVER (PARTITION BY cp_id ORDER BY inside, side) AS INT) AS nth FROM w", "SELECT cp_id, arg_min(side, (inside, side)) AS side, min(inside) + 5.0 AS tail FROM w") + " GROUP BY cp_id")
def _(spark, d):
    return QUERIES["gr34_exits"](spark, d).filter("nth = 1").select("cp_id", "side", "tail")


@query(
    "gr04_passability_mask",
    "rects rules",
    f", z AS ({RULED}), g AS (SELECT i AS col, j AS row FROM range(0, 205) a(i) CROSS JOIN range(0, 165) b(j)) SELECT CAST(col AS INT) AS col, CAST(row AS INT) AS row, max(min_dist) AS value FROM g JOIN z ON z.mode = 'PROHIBITED' AND col * 10 + 5 > x0 AND col * 10 + 5 < x1 AND row * 10 + 5 > y0 AND row * 10 + 5 < y1 GROUP BY col, row",
)
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.mask(ruled(spark, d).filter("mode = 'PROHIBITED'").withColumn("value", F.col("min_dist")), 10.0)


@query("jn21_cell_factors", "rects rules", f", z AS ({RULED}), g AS (SELECT i AS col, j AS row FROM range(0, 205) a(i) CROSS JOIN range(0, 165) b(j)) SELECT CAST(col AS INT) AS col, CAST(row AS INT) AS row, max(factor) AS value FROM g JOIN z ON z.mode = 'SPECIAL' AND col * 10 + 5 > x0 AND col * 10 + 5 < x1 AND row * 10 + 5 > y0 AND row * 10 + 5 < y1 GROUP BY col, row")
def _(spark, d):
    from netloom.operators import obstacles

    return obstacles.mask(ruled(spark, d).filter("mode = 'SPECIAL'").withColumn("value", F.col("factor")), 10.0)


@query("ag17_blocked_cells", "rects rules", f", z AS ({RULED}), g AS (SELECT i AS col, j AS row FROM range(0, 205) a(i) CROSS JOIN range(0, 165) b(j)) SELECT row // 10 AS band, count(*) AS cells FROM g WHERE EXISTS (SELECT 1 FROM z WHERE z.mode = 'PROHIBITED' AND col * 10 + 5 > x0 AND col * 10 + 5 < x1 AND row * 10 + 5 > y0 AND row * 10 + 5 < y1) GROUP BY row // 10")
def _(spark, d):
    return QUERIES["gr04_passability_mask"](spark, d).groupBy(F.floor(F.col("row") / 10).alias("band")).agg(F.count("*").alias("cells"))


@query("sm03_usage_carried_over_tiles", "edges", "SELECT chamber, tile, CAST(sum(used) OVER (PARTITION BY chamber ORDER BY tile) AS BIGINT) AS so_far FROM (SELECT tree % 50 AS chamber, tree % 7 AS tile, count(*) AS used FROM edges WHERE parent = 0 GROUP BY 1, 2)")
def _(spark, d):
    used = T.edges(spark, d).filter("parent = 0").groupBy((F.col("tree") % 50).alias("chamber"), (F.col("tree") % 7).alias("tile")).agg(F.count("*").alias("used"))
    return used.select("chamber", "tile", F.sum("used").over(Window.partitionBy("chamber").orderBy("tile")).alias("so_far"))


@query("val02_ends_meet")
def _(spark, d):
    rows = planned_once(spark, d)
    up = rows.select("tile", "variant", F.col("edge").alias("parent"), F.element_at("line", -1).alias("end"))
    both = rows.join(up, ["tile", "variant", "parent"])
    apart = S.distance(F.col("line")[0]["x"], F.col("line")[0]["y"], F.col("end.x"), F.col("end.y")) > 1e-5
    return both.groupBy("variant").agg(F.count("*").alias("joints"), F.count(F.when(apart, 1)).alias("apart"))


@query("val09_no_dangling_references")
def _(spark, d):
    rows = planned(spark, d).filter("edge is not null").select("tile", "variant", "edge", "parent")
    known = rows.select("tile", "variant", F.col("edge").alias("parent")).withColumn("known", F.lit(1))
    return rows.filter("parent > 0").join(known, ["tile", "variant", "parent"], "left").groupBy("variant").agg(F.count("*").alias("refs"), F.count(F.when(F.col("known").isNull(), 1)).alias("dangling"))


@query("gr37_detours")
def _(spark, d):
    rows = planned(spark, d).filter("edge is not null and node >= 0")
    straight = S.distance(F.col("line")[0]["x"], F.col("line")[0]["y"], F.element_at("line", -1)["x"], F.element_at("line", -1)["y"])
    return rows.withColumn("detour", F.col("length") - straight).filter("detour between 2 and 10").groupBy("variant").agg(F.count("*").alias("eligible"))


@query("val12_steiner_gap")
def _(spark, d):
    """Each tile's network against the least spanning tree of its places; no network is shorter than 0.866 of that."""
    from netloom.operators import planner

    edges = planned(spark, d).filter("edge is not null and variant = 1")
    ends = edges.select("tile", F.explode(F.array(F.when(F.col("node") >= 0, F.element_at("line", -1)), F.when(F.col("parent") == 0, F.col("line")[0]))).alias("p")).filter("p is not null").distinct()
    places = ends.groupBy("tile").agg(F.collect_list("p").alias("places"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [planner.spanning([(p["x"], p["y"]) for p in ps]) for ps in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(found, pa.float64())], ["tile", "spanning"])

    total = edges.groupBy("tile").agg(F.sum("length").alias("length"))
    return places.mapInArrow(run, "tile long, spanning double").join(total, "tile").select("tile", F.round("length", 3).alias("length"), F.round("spanning", 3).alias("spanning"))


# More of the plane, and of the plan's bookkeeping.


@query("ge02_turn_angle", "edges", "SELECT tree, n, round(degrees(atan2(abs(CAST(len_m * 3 - flow * n AS DOUBLE)), CAST(len_m * n + flow * 3 AS DOUBLE))), 6) AS turn FROM edges")
def _(spark, d):
    a, b, c, e = F.col("len_m"), F.col("flow"), F.col("n"), F.lit(3)
    return T.edges(spark, d).select("tree", "n", F.round(S.turn_degrees(a.cast("double"), b.cast("double"), c.cast("double"), e.cast("double")), 6).alias("turn"))


@query("ge07_restriction_axes", "rects", "SELECT r_id, CAST(k AS INT) AS side, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS ax, CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS ay FROM rects CROSS JOIN range(0, 4) t(k)")
def _(spark, d):
    from netloom.operators import obstacles

    ring = F.array(*[F.struct(F.col(a).alias("ax"), F.col(b).alias("ay")) for a, b, _, _ in obstacles.SIDES])
    return T.rects(spark, d).select("r_id", F.posexplode(ring).alias("side", "p")).select("r_id", "side", "p.ax", "p.ay")


@query("ge11_pushed_points", "cps", "SELECT cp_id, round(x + 5.0 * dx / l, 6) AS px, round(y + 5.0 * dy / l, 6) AS py FROM (SELECT cp_id, x, y, 1000.5 - x AS dx, 800.5 - y AS dy, sqrt((1000.5 - x) * (1000.5 - x) + (800.5 - y) * (800.5 - y)) AS l FROM cps)")
def _(spark, d):
    dx, dy = 1000.5 - F.col("x"), 800.5 - F.col("y")
    far = F.sqrt(dx * dx + dy * dy)
    return T.connection_points(spark, d).select("cp_id", F.round(F.col("x") + 5.0 * dx / far, 6).alias("px"), F.round(F.col("y") + 5.0 * dy / far, 6).alias("py"))


@query("ge12_midpoints_and_normals", "net_segments", "SELECT seg_id, (x1 + x2) / 2.0 AS mx, (y1 + y2) / 2.0 AS my, round(-(y2 - y1) / l, 6) + 0.0 AS nx, round((x2 - x1) / l, 6) AS ny FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM net_segments)")
def _(spark, d):
    length = S.distance(*map(F.col, ("x1", "y1", "x2", "y2")))
    return T.net_segments(spark, d).select("seg_id", ((F.col("x1") + F.col("x2")) / 2.0).alias("mx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("my"), (F.round(-(F.col("y2") - F.col("y1")) / length, 6) + 0.0).alias("nx"), F.round((F.col("x2") - F.col("x1")) / length, 6).alias("ny"))


@query("ge16_line_split_at_point", "net_nodes", f"{STREET}, c AS (SELECT line, pos, x, y, pos <= m AS first FROM street JOIN (SELECT line, CAST(floor(avg(pos)) AS BIGINT) AS m FROM street GROUP BY line) USING (line)) SELECT line, first, count(*) AS vertices, min(x) AS from_x, max(x) AS to_x FROM (SELECT line, first, x FROM c UNION ALL SELECT line, false, x FROM c q WHERE first AND pos = (SELECT max(pos) FROM c z WHERE z.line = q.line AND z.first)) GROUP BY line, first")
def _(spark, d):
    rows = street(spark, d)
    middle = rows.groupBy("line").agg(F.floor(F.avg("pos")).alias("m"))
    both = rows.join(middle, "line").select("line", "x", F.explode(F.when(F.col("pos") == F.col("m"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("pos") < F.col("m")))).alias("first"))
    return both.groupBy("line", "first").agg(F.count("*").alias("vertices"), F.min("x").alias("from_x"), F.max("x").alias("to_x"))


@query(
    "prj17_simplified_lines",
    "net_nodes",
    """, v AS (SELECT node_id // 25 AS line, 3 * node_id + k AS pos, CASE k WHEN 1 THEN x + 10 ELSE x END AS x, y FROM net_nodes CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR node_id % 4 = 0),
    o AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY line ORDER BY pos)), u AS (SELECT line, pos, x, y FROM o WHERE px IS NULL OR px <> x OR py <> y)
    SELECT line, pos FROM (SELECT *, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM u WINDOW w AS (PARTITION BY line ORDER BY pos)) WHERE NOT coalesce(ax * by_ = ay * bx AND ax * bx + ay * by_ > 0, false)""",
)
def _(spark, d):
    """Lines with repeated, straight and turning-back vertices."""
    nodes = T.net_nodes(spark, d).select("*", F.explode(F.when(F.col("node_id") % 4 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(*map(F.lit, (0, 1))))).alias("k"))
    rows = nodes.select(F.floor(F.col("node_id") / 25).alias("line"), (3 * F.col("node_id") + F.col("k")).alias("pos"), F.when(F.col("k") == 1, F.col("x") + 10).otherwise(F.col("x")).alias("x"), "y")
    return sequences.simplified(rows, "line", "pos").select("line", "pos")


@query("gr02_terminals", "cps rects rules", f", z AS ({RULED}) SELECT cp_id, CASE WHEN flow <= 2 THEN 'NO_FLOW' WHEN EXISTS (SELECT 1 FROM z r WHERE r.mode = 'PROHIBITED' AND r.rtype <> 'oks' AND c.x BETWEEN r.x0 AND r.x1 AND c.y BETWEEN r.y0 AND r.y1) THEN 'BLOCKED' ELSE 'OK' END AS state FROM cps c")
def _(spark, d):
    points = T.connection_points(spark, d)
    closed = ruled(spark, d).filter("mode = 'PROHIBITED' and rtype <> 'oks'")
    blocked = spatial.containing(points, closed).select("cp_id").distinct().withColumn("blocked", F.lit(True))
    return points.join(blocked, "cp_id", "left").select("cp_id", F.when(F.col("flow") <= 2, "NO_FLOW").when(F.col("blocked"), "BLOCKED").otherwise("OK").alias("state"))


@query("gr03_grid_bounds", "cps net_nodes", "SELECT min(x) - 20 AS x0, min(y) - 20 AS y0, max(x) + 20 AS x1, max(y) + 20 AS y1 FROM (SELECT x, y FROM cps UNION ALL SELECT x, y FROM net_nodes)")
def _(spark, d):
    both = T.connection_points(spark, d).select("x", "y").union(T.net_nodes(spark, d).select("x", "y"))
    return both.agg((F.min("x") - 20).alias("x0"), (F.min("y") - 20).alias("y0"), (F.max("x") + 20).alias("x1"), (F.max("y") + 20).alias("y1"))


@query("gr30_cheapest_dn_is_not_below_flow", "designed", "SELECT dn, count(*) AS edges, max(total_flow) AS most FROM designed GROUP BY dn")
def _(spark, d):
    return designed(spark, d).groupBy("dn").agg(F.count("*").alias("edges"), F.max("total_flow").alias("most"))


@query("tk05_first_candidates", "edges", "SELECT tree, n FROM edges WHERE len_m > 60 ORDER BY tree, n LIMIT 200")
def _(spark, d):
    return T.edges(spark, d).filter("len_m > 60").select("tree", "n").orderBy("tree", "n").limit(200)


@query("tk07_sorted_catalogue", "cat", "SELECT dn, capacity, max_len, price FROM cat ORDER BY dn")
def _(spark, d):
    return K.diameters(spark).orderBy("dn")


@query("prj05_legacy_dropped", "cps", "SELECT cp_id FROM cps WHERE cp_id % 11 <> 0")
def _(spark, d):
    from netloom.sources import geojson

    rows = geojson.classified(features(spark, d).filter("feature_seq < 10000000"))
    return rows.filter("status is not null").select(F.col("id").cast("long").alias("cp_id"))


@query("prj12_exit_filter", "cps rects", "SELECT c.cp_id, count(*) AS ways FROM cps c JOIN rects r ON r.rtype = 'oks' AND c.x BETWEEN r.x0 AND r.x1 AND c.y BETWEEN r.y0 AND r.y1 WHERE least(c.x - r.x0, r.x1 - c.x, c.y - r.y0, r.y1 - c.y) <= 3 GROUP BY c.cp_id")
def _(spark, d):
    boxes = T.rects(spark, d).filter("rtype = 'oks'")
    inside = spatial.containing(T.connection_points(spark, d), boxes).join(T.connection_points(spark, d), "cp_id").join(boxes.drop("rtype"), "r_id")
    near = F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    return inside.filter(near <= 3).groupBy("cp_id").agg(F.count("*").alias("ways"))


@query("val07_special_pieces_are_straight", "net_nodes rects rules", f"{STREET}, z AS ({RULED}), v AS (SELECT line, CAST(pos AS BIGINT) AS pos, x, EXISTS (SELECT 1 FROM z WHERE mode = 'SPECIAL' AND s.x BETWEEN x0 AND x1) AS special FROM street s), r AS (SELECT *, sum(CASE WHEN special THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY pos) AS g FROM v) SELECT line, min(pos) AS first, count(*) AS points FROM r WHERE special GROUP BY line, g HAVING count(*) > 2")
def _(spark, d):
    """Stretches of a line that run under special restrictions (seen from above, by x), with more than two points."""
    zones = ruled(spark, d).filter("mode = 'SPECIAL'").select("r_id", "rtype", "x0", F.lit(0).alias("y0"), "x1", F.lit(0).alias("y1"))
    points = street(spark, d)
    inside = spatial.containing(points.select(F.col("pos").alias("cp_id"), "x", F.lit(0).alias("y")), zones).select(F.col("cp_id").alias("pos")).distinct().withColumn("special", F.lit(True))
    rows = points.join(inside, "pos", "left").withColumn("special", F.coalesce("special", F.lit(False)))
    return validation.bent_specials(rows, "line", "pos")


@query("val06_planned_degree")
def _(spark, d):
    rows = planned(spark, d).filter("edge is not null")
    ends = rows.select("tile", "variant", F.explode(F.array(F.col("line")[0], F.element_at("line", -1))).alias("p"))
    return ends.groupBy("tile", "variant", "p").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("places"))


def planned_segments(spark: SparkSession, d: str, variant: int = 1) -> DataFrame:
    """Straight parts of a variant's edges, with ids of their own."""
    rows = planned_once(spark, d).filter(F.col("variant") == variant)
    parts = F.transform(F.slice("line", 1, F.size("line") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.col("line")[i + 1]["x"].alias("x2"), F.col("line")[i + 1]["y"].alias("y2")))
    out = rows.select("tile", "edge", F.posexplode(parts).alias("pos", "s")).select("tile", "edge", "s.*", "pos")
    return out.withColumn("seg_id", F.col("tile") * 100_000_000 + F.col("edge").cast("long") * 1000 + F.col("pos"))


@query("val04_planned_crossings")
def _(spark, d):
    parts = planned_segments(spark, d)
    pairs = spatial.crossings(parts)
    # Tiles are planned apart, so only crossings within one tile are faults.
    return pairs.select((F.floor(F.col("a") / 100_000_000) == F.floor(F.col("b") / 100_000_000)).alias("same_tile")).groupBy("same_tile").agg(F.count("*").alias("crossings"))


@query("val01_routes_through_restrictions")
def _(spark, d):
    from netloom.operators import obstacles

    # Equal segments are asked for once.
    ends = ("x1", "y1", "x2", "y2")
    ways = planned_segments(spark, d).groupBy(*ends).agg(F.count("*").alias("n"))
    found = obstacles.through(ways, ruled(spark, d).filter("mode = 'PROHIBITED'")).withColumn("through", F.lit(True))
    rows = ways.join(found, [*ends], "left").select(F.coalesce("through", F.lit(False)).alias("through"), "n", S.distance(*map(F.col, ends)).alias("length"))
    return rows.groupBy("through").agg(F.sum("n").alias("segments"), F.round(F.sum(F.col("n") * F.col("length")), 3).alias("length"))


# Checks of a network with faults in it.


def result_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with references to their ends, some of them wrong, some ends beside their node."""
    s = T.net_segments(spark, d)
    off = F.when(F.col("seg_id") % 5 == 0, 0.25).otherwise(0.0)
    to = F.when(F.col("seg_id") % 7 == 0, F.col("seg_id") + 1_000_000).otherwise(F.col("seg_id") + 1)
    return s.select("seg_id", F.col("seg_id").alias("from_id"), to.alias("to_id"), "x1", "y1", (F.col("x2") + off).alias("x2"), "y2")


RESULT = ", result AS (SELECT seg_id, seg_id AS from_id, CASE WHEN seg_id % 7 = 0 THEN seg_id + 1000000 ELSE seg_id + 1 END AS to_id, x1, y1, x2 + CASE WHEN seg_id % 5 = 0 THEN 0.25 ELSE 0.0 END AS x2, y2 FROM net_segments)"


@query("val02_loose_ends", "net_segments", f"{RESULT} SELECT seg_id, 'to' AS end, to_id AS node_id, round(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)), 6) AS off FROM result LEFT JOIN net_nodes ON node_id = to_id WHERE node_id IS NULL OR sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) >= 1e-5")
def _(spark, d):
    return validation.loose_ends(result_segments(spark, d), T.net_nodes(spark, d))


@query("val09_dangling_ends", "net_segments", f"{RESULT} SELECT to_id AS node_id, seg_id FROM result WHERE to_id NOT IN (SELECT node_id FROM net_nodes)")
def _(spark, d):
    references = result_segments(spark, d).select("seg_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    return validation.dangling(references, T.net_nodes(spark, d)).select("node_id", "seg_id")


@query("val06_crowded_chambers", "net_nodes net_segments cps", f"{USED} SELECT node_id, pipes + used AS degree FROM degree WHERE pipes + used > 3")
def _(spark, d):
    return validation.crowded(chamber_degrees(spark, d), 3)


@query("val05_sharp_turns", "net_nodes", ", street AS (SELECT node_id // 25 AS line, node_id AS pos, x + CASE WHEN node_id % 6 = 0 THEN 45 ELSE 0 END AS x, y FROM net_nodes) SELECT line, pos, round(t, 6) AS turn FROM (SELECT line, pos, degrees(atan2(abs(CAST(ax * by_ - ay * bx AS DOUBLE)), CAST(ax * bx + ay * by_ AS DOUBLE))) AS t FROM (SELECT line, pos, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM street WINDOW w AS (PARTITION BY line ORDER BY pos)) WHERE ax IS NOT NULL AND bx IS NOT NULL) WHERE t > 90.05")
def _(spark, d):
    bent = street(spark, d).withColumn("x", F.col("x") + F.when(F.col("pos") % 6 == 0, 45).otherwise(0))
    return validation.sharp_turns(bent, "line", "pos").select("line", "pos", F.round("turn", 6).alias("turn"))


@query("val08_missing_exits", "cps rects", EXITS.replace("SELECT cp_id, r_id, side, ex, ey, inside + 5.0 AS tail, CAST(row_number() OVER (PARTITION BY cp_id ORDER BY inside, side) AS INT) AS nth FROM w", "SELECT DISTINCT cp_id FROM w") + " AND cp_id % 3 = 0")
def _(spark, d):
    """Lines of every third point end a metre beside the exit."""
    exits = QUERIES["gr34_exits"](spark, d).filter("nth = 1").select("cp_id", "ex", "ey")
    return validation.missing_exits(exits, exits.select("cp_id", (F.col("ex") + F.when(F.col("cp_id") % 3 == 0, 1.0).otherwise(0.0)).alias("x"), F.col("ey").alias("y")))


@query(
    "val10_branching_faults",
    "edges",
    """, e AS (SELECT *, 2 + n % 5 AS vertices, flow > 30 AS point, n % 2 = 0 AS chamber FROM edges), k AS (SELECT e.*, (SELECT count(*) FROM edges c WHERE c.tree = e.tree AND c.parent = e.n) AS children FROM e)
    SELECT what, count(*) AS n FROM (SELECT 'FORK_OUTSIDE_CHAMBER' AS what FROM k WHERE children > 1 AND NOT chamber UNION ALL SELECT 'MANY_VERTICES' FROM k WHERE vertices > 4 UNION ALL SELECT 'SHORT_TAIL' FROM k WHERE point AND len_m < 20 UNION ALL SELECT 'SHARED_CHAMBER' FROM (SELECT tree, parent FROM k WHERE point GROUP BY tree, parent HAVING count(*) > 1)) GROUP BY what""",
)
def _(spark, d):
    e = T.edges(spark, d).withColumns({"vertices": 2 + F.col("n") % 5, "point": F.col("flow") > 30, "chamber": F.col("n") % 2 == 0})
    return validation.branching(e, 4, 20.0)


# Candidates, bounds, cells.


@query(
    "st01_tie_candidates",
    "net_segments cps",
    """, s AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS l FROM net_segments), k AS (SELECT *, unnest(generate_series(0, CAST(floor(l / 1.0) AS BIGINT))) AS k FROM s),
    f AS (SELECT cp_id, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y, round(sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2)), 6) AS off, seg_id FROM (SELECT c.cp_id, c.x AS px, c.y AS py, s.*, greatest(0.0, least(1.0, ((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))) AS t FROM cps c CROSS JOIN s)),
    u AS (SELECT 1 AS source, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM net_nodes WHERE is_chamber UNION ALL SELECT 2, x1 + k / l * (x2 - x1), y1 + k / l * (y2 - y1) FROM k UNION ALL SELECT 3, arg_min(x, (off, seg_id)), arg_min(y, (off, seg_id)) FROM f GROUP BY cp_id)
    SELECT CAST(floor(round(x * 100, 6) + 0.5) AS BIGINT) AS x_cm, CAST(floor(round(y * 100, 6) + 0.5) AS BIGINT) AS y_cm, min(source) AS source FROM u GROUP BY 1, 2""",
)
def _(spark, d):
    chambers = T.net_nodes(spark, d).filter("is_chamber").select("x", "y")
    return spatial.tie_candidates(chambers, T.net_segments(spark, d), T.connection_points(spark, d), 1.0).select("x_cm", "y_cm", "source")


@query("ag15_factor_bound", "net_segments rects rules", f", z AS ({RULED}) SELECT seg_id, max(factor) AS k FROM net_segments s JOIN z r ON r.mode = 'SPECIAL' AND least(s.x1, s.x2) <= r.x1 AND greatest(s.x1, s.x2) >= r.x0 AND least(s.y1, s.y2) <= r.y1 AND greatest(s.y1, s.y2) >= r.y0 GROUP BY seg_id")
def _(spark, d):
    """Not less than the factor of any stretch: envelopes only."""
    zones = ruled(spark, d).filter("mode = 'SPECIAL'").select("r_id", "factor", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = spatial.candidates(T.net_segments(spark, d), spatial.segment_box(), zones, spatial.corners("rx0", "ry0", "rx1", "ry1"))
    return pairs.groupBy("seg_id").agg(F.max("factor").alias("k"))


@query("jn26_rename_but_keep", "edges net_nodes", "SELECT tree, n, CASE WHEN parent = 0 THEN 'root' WHEN k.node_id IS NOT NULL THEN CAST(parent AS VARCHAR) ELSE 't' || (tree % 4) || '/' || parent END AS from_id FROM edges LEFT JOIN (SELECT node_id FROM net_nodes WHERE is_chamber) k ON k.node_id = parent")
def _(spark, d):
    """Chambers of the existing network keep their ids; all other nodes get their tile before theirs."""
    keep = T.net_nodes(spark, d).filter("is_chamber").select(F.col("node_id").alias("parent"), F.lit(True).alias("kept"))
    out = T.edges(spark, d).withColumn("parent", F.col("parent").cast("long")).join(keep, "parent", "left")
    name = F.when(F.col("parent") == 0, "root").when(F.col("kept"), F.col("parent").cast("string")).otherwise(F.concat(F.lit("t"), (F.col("tree") % 4).cast("string"), F.lit("/"), F.col("parent").cast("string")))
    return out.select("tree", "n", name.alias("from_id"))


@query("ge13_hex_cell_of_point", "cps", "SELECT cp_id, CAST(arg_min(r, (off, r, c)) AS INT) AS row, CAST(arg_min(c, (off, r, c)) AS INT) AS col FROM (SELECT cp_id, r, c, round(pow(x - (c + CASE WHEN r % 2 = 1 THEN 0.5 ELSE 0 END) * 7.0, 2) + pow(y - r * (7.0 * sqrt(3) / 2), 2), 9) AS off FROM (SELECT cp_id, x, y, r, unnest([CAST(floor(x / 7.0) AS BIGINT) - 1, CAST(floor(x / 7.0) AS BIGINT), CAST(floor(x / 7.0) AS BIGINT) + 1]) AS c FROM (SELECT *, unnest([CAST(floor(y / (7.0 * sqrt(3) / 2)) AS BIGINT), CAST(floor(y / (7.0 * sqrt(3) / 2)) AS BIGINT) + 1]) AS r FROM cps))) GROUP BY cp_id")
def _(spark, d):
    cell = S.hex_cell(F.col("x").cast("double"), F.col("y").cast("double"), 7.0)
    return T.connection_points(spark, d).select("cp_id", cell.alias("h")).select("cp_id", "h.row", "h.col")


@query(
    "ge13_hex_neighbours",
    "cps",
    """, c AS (SELECT cp_id, x // 10 AS c, y // 10 + 1 AS r FROM cps), g AS (SELECT cp_id, c, r, unnest([c - 1, c, c + 1]) AS nc, unnest([r - 1, r - 1, r - 1]) AS nr FROM c UNION ALL SELECT cp_id, c, r, unnest([c - 1, c, c + 1]), unnest([r, r, r]) FROM c UNION ALL SELECT cp_id, c, r, unnest([c - 1, c, c + 1]), unnest([r + 1, r + 1, r + 1]) FROM c),
    d AS (SELECT *, sqrt(pow((nc + CASE WHEN nr % 2 = 1 THEN 0.5 ELSE 0 END - c - CASE WHEN r % 2 = 1 THEN 0.5 ELSE 0 END) * 10.0, 2) + pow((nr - r) * (10.0 * sqrt(3) / 2), 2)) AS off FROM g)
    SELECT cp_id, CAST(nr AS BIGINT) AS row, CAST(nc AS BIGINT) AS col FROM d WHERE off > 1 AND off < 10.001""",
)
def _(spark, d):
    """The cells one cell off each point's cell (SQL tries all nine around)."""
    cells = T.connection_points(spark, d).select("cp_id", F.floor(F.col("x") / 10).alias("col"), (F.floor(F.col("y") / 10) + 1).alias("row"))
    return cells.select("cp_id", F.explode(S.hex_neighbours(F.col("row"), F.col("col"))).alias("b")).select("cp_id", F.col("b.row").cast("long").alias("row"), F.col("b.col").cast("long").alias("col"))


@query(
    "ge14_cells_on_segments",
    "net_segments",
    """, s AS (SELECT seg_id, x1 + 0.37 AS a, y1 + 0.61 AS b, x2 + 0.37 AS c, y2 + 0.61 AS e FROM net_segments),
    g AS (SELECT s.*, col, unnest(generate_series(CAST(floor(least(b, e) / 7.0) AS BIGINT), CAST(floor(greatest(b, e) / 7.0) AS BIGINT))) AS row FROM (SELECT *, unnest(generate_series(CAST(floor(least(a, c) / 7.0) AS BIGINT), CAST(floor(greatest(a, c) / 7.0) AS BIGINT))) AS col FROM s) s),
    w AS (SELECT *, CASE WHEN c <> a THEN least((col * 7 - a) / (c - a), (col * 7 + 7 - a) / (c - a)) ELSE 0.0 END AS u0, CASE WHEN c <> a THEN greatest((col * 7 - a) / (c - a), (col * 7 + 7 - a) / (c - a)) ELSE 1.0 END AS u1, CASE WHEN e <> b THEN least((row * 7 - b) / (e - b), (row * 7 + 7 - b) / (e - b)) ELSE 0.0 END AS v0, CASE WHEN e <> b THEN greatest((row * 7 - b) / (e - b), (row * 7 + 7 - b) / (e - b)) ELSE 1.0 END AS v1 FROM g)
    SELECT seg_id, col, row FROM w WHERE greatest(u0, v0, 0.0) < least(u1, v1, 1.0)""",
)
def _(spark, d):
    from netloom.operators import shapes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("seg_id", "a", "b", "c", "e")), strict=True)
            found = [(i, *cell) for i, a, b, c, e in ends for cell in shapes.cells_on((a, b), (c, e), 7.0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["seg_id", "col", "row"])

    moved = T.net_segments(spark, d).select("seg_id", *[(F.col(n) + o).alias(m) for n, m, o in (("x1", "a", 0.37), ("y1", "b", 0.61), ("x2", "c", 0.37), ("y2", "e", 0.61))])
    return moved.mapInArrow(run, "seg_id long, col long, row long")


@query("ag14_search_counts")
def _(spark, d):
    from netloom.operators import planner

    return planner.counts(planned(spark, d))


# Polygons.

IN_PLOTS = f"""covered AS (SELECT c.cp_id, c.flow, p.r_id, p.rtype, count(*) FILTER (WHERE {ray_meets("c.x", "c.y")}) % 2 = 1 AS inside, min({point_segment("c.x", "c.y", "ax", "ay", "bx", "by_")}) <= 1e-9 AS on_edge
      FROM cps c CROSS JOIN plot_sides p GROUP BY c.cp_id, c.flow, p.r_id, p.rtype)"""


@query("jn10_points_in_plots", "cps plot_sides", f", {IN_PLOTS} SELECT cp_id, r_id, rtype, on_edge FROM covered WHERE inside OR on_edge")
def _(spark, d):
    return regions.containing(T.connection_points(spark, d), T.plots(spark, d))


@query("jn10_owning_plot", "cps plot_sides", f", {IN_PLOTS} SELECT c.cp_id, min(v.r_id) AS r_id FROM cps c LEFT JOIN covered v ON v.cp_id = c.cp_id AND (v.inside OR v.on_edge) GROUP BY c.cp_id")
def _(spark, d):
    return regions.owning(T.connection_points(spark, d), T.plots(spark, d))


@query("jn11_plot_dn", "cps plot_sides cat", f", {IN_PLOTS} SELECT r.r_id, coalesce((SELECT min(k.dn) FROM covered v JOIN cat k ON k.capacity >= v.flow WHERE v.r_id = r.r_id AND (v.inside OR v.on_edge)), (SELECT min(k.dn) FROM cps c JOIN cat k ON k.capacity >= c.flow)) AS dn FROM rects r")
def _(spark, d):
    return regions.least_dn(T.connection_points(spark, d), T.plots(spark, d))


#: Each segment's distance to each plot: 0 where it crosses a side or begins inside, else the least between their ends and sides.
TO_PLOTS = f"""far AS (SELECT s.seg_id, p.r_id, p.rtype, CASE WHEN bool_or(sign((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * sign((x2 - x1) * (by_ - y1) - (y2 - y1) * (bx - x1)) < 0 AND sign((bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax)) * sign((bx - ax) * (y2 - ay) - (by_ - ay) * (x2 - ax)) < 0)
      OR count(*) FILTER (WHERE {ray_meets("x1", "y1")}) % 2 = 1 THEN 0.0 ELSE min(least({point_segment("x1", "y1", "ax", "ay", "bx", "by_")}, {point_segment("x2", "y2", "ax", "ay", "bx", "by_")}, {point_segment("ax", "ay", "x1", "y1", "x2", "y2")}, {point_segment("bx", "by_", "x1", "y1", "x2", "y2")})) END AS dist
      FROM net_segments s CROSS JOIN plot_sides p GROUP BY s.seg_id, p.r_id, p.rtype)"""


def plots_to_keep(spark: SparkSession, d: str) -> DataFrame:
    return by_rule(spark, T.plots(spark, d)).filter("mode = 'PROHIBITED'").select("r_id", "rtype", "lines", "area", (F.col("min_dist") / 10.0).alias("keep"))


@query("prj08_blocked_by_plots", "net_segments plot_sides rules", f", z AS ({RULED}), {TO_PLOTS} SELECT seg_id, f.r_id, round(dist, 6) AS dist FROM far f JOIN z ON z.r_id = f.r_id AND z.mode = 'PROHIBITED' WHERE dist < z.min_dist / 10.0 - 1e-3")
def _(spark, d):
    return regions.blocked(T.net_segments(spark, d), plots_to_keep(spark, d), 10.0).select("seg_id", "r_id", F.round("dist", 6).alias("dist"))


#: Parts of segments inside plots: cut at every side, those whose middle is inside, neighbours as one.
IN_PARTS = f"""cut AS (SELECT seg_id, r_id, round(t, 9) AS t FROM (SELECT s.seg_id, p.r_id, ((ax - x1) * (by_ - ay) - (ay - y1) * (bx - ax)) / nullif((x2 - x1) * (by_ - ay) - (y2 - y1) * (bx - ax), 0) AS t, ((ax - x1) * (y2 - y1) - (ay - y1) * (x2 - x1)) / nullif((x2 - x1) * (by_ - ay) - (y2 - y1) * (bx - ax), 0) AS u FROM net_segments s CROSS JOIN plot_sides p) WHERE t BETWEEN 0 AND 1 AND u BETWEEN -1e-12 AND 1 + 1e-12
      UNION SELECT seg_id, r_id, unnest([0.0, 1.0]) FROM net_segments CROSS JOIN rects),
    piece AS (SELECT seg_id, r_id, t AS s0, lead(t) OVER (PARTITION BY seg_id, r_id ORDER BY t) AS s1 FROM cut),
    held AS (SELECT q.seg_id, q.r_id, q.s0, q.s1 FROM piece q JOIN net_segments s ON s.seg_id = q.seg_id JOIN plot_sides p ON p.r_id = q.r_id WHERE q.s1 IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (WHERE {ray_meets("(x1 + (q.s0 + q.s1) / 2 * (x2 - x1))", "(y1 + (q.s0 + q.s1) / 2 * (y2 - y1))")}) % 2 = 1),
    island AS (SELECT *, sum(f) OVER (PARTITION BY seg_id, r_id ORDER BY s0) AS g FROM (SELECT *, CASE WHEN lag(s1) OVER (PARTITION BY seg_id, r_id ORDER BY s0) = s0 THEN 0 ELSE 1 END AS f FROM held)),
    parts AS (SELECT seg_id, r_id, min(s0) AS s0, max(s1) AS s1 FROM island GROUP BY seg_id, r_id, g)"""


@query("jn19_spans_in_plots", "net_segments plot_sides", f", {IN_PARTS} SELECT i.seg_id, i.r_id, r.rtype, s0, s1 FROM parts i JOIN rects r ON r.r_id = i.r_id")
def _(spark, d):
    return regions.spans(T.net_segments(spark, d), T.plots(spark, d))


@query("val01_pipes_through_plots", "net_segments plot_sides", f", {IN_PARTS} SELECT i.seg_id, i.r_id, round(sum((s1 - s0) * sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))), 3) AS inside_m FROM parts i JOIN rects r ON r.r_id = i.r_id JOIN net_segments s ON s.seg_id = i.seg_id WHERE r.rtype = 'oks' GROUP BY i.seg_id, i.r_id HAVING sum((s1 - s0) * sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1))) > 0.01")
def _(spark, d):
    return validation.through_regions(T.net_segments(spark, d), T.plots(spark, d).filter("rtype = 'oks'"))


@query("prj09_plot_angle_verdicts", "net_segments plot_sides", """, hit AS (SELECT seg_id, degrees(atan2(abs((x2 - x1) * (by_ - ay) - (y2 - y1) * (bx - ax)), (x2 - x1) * (bx - ax) + (y2 - y1) * (by_ - ay))) AS t FROM net_segments CROSS JOIN plot_sides
      WHERE sign((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * sign((x2 - x1) * (by_ - y1) - (y2 - y1) * (bx - x1)) < 0 AND sign((bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax)) * sign((bx - ax) * (y2 - ay) - (by_ - ay) * (x2 - ax)) < 0)
    SELECT s.seg_id, coalesce(min(round(least(t, 180 - t), 6)) >= 45 - 1e-6, true) AS legal FROM net_segments s LEFT JOIN hit h ON h.seg_id = s.seg_id GROUP BY s.seg_id""")
def _(spark, d):
    return regions.angle_verdicts(T.net_segments(spark, d), T.plots(spark, d), 45.0)


@query("gr04_plot_mask", "plot_sides rules", f", z AS ({RULED}), g AS (SELECT i AS col, j AS row FROM range(0, 205) a(i) CROSS JOIN range(0, 165) b(j)), held AS (SELECT g.col, g.row, p.r_id FROM g JOIN rects r ON g.col * 10 + 5 BETWEEN r.x0 AND r.x1 AND g.row * 10 + 5 BETWEEN r.y0 AND r.y1 JOIN plot_sides p ON p.r_id = r.r_id GROUP BY ALL HAVING count(*) FILTER (WHERE {ray_meets('(g.col * 10 + 5.0)', '(g.row * 10 + 5.0)')}) % 2 = 1) SELECT CAST(col AS INT) AS col, CAST(row AS INT) AS row, max(min_dist) AS value FROM held h JOIN z ON z.r_id = h.r_id AND z.mode = 'PROHIBITED' GROUP BY col, row")
def _(spark, d):
    closed = by_rule(spark, T.plots(spark, d)).filter("mode = 'PROHIBITED'")
    return regions.mask(closed.select("r_id", "lines", "area", F.col("min_dist").alias("value"), F.lit(0.0).alias("keep")), 10.0)


@query("jn21_plot_cell_factors", "plot_sides rules", f", z AS ({RULED}), g AS (SELECT i AS col, j AS row FROM range(-5, 210) a(i) CROSS JOIN range(-5, 170) b(j)), near AS (SELECT g.col, g.row, p.r_id, count(*) FILTER (WHERE {ray_meets('(g.col * 10 + 5.0)', '(g.row * 10 + 5.0)')}) % 2 = 1 AS inside, min({point_segment('(g.col * 10 + 5.0)', '(g.row * 10 + 5.0)', 'ax', 'ay', 'bx', 'by_')}) AS dist FROM g JOIN rects r ON g.col * 10 + 5 BETWEEN r.x0 - 20 AND r.x1 + 20 AND g.row * 10 + 5 BETWEEN r.y0 - 20 AND r.y1 + 20 JOIN plot_sides p ON p.r_id = r.r_id GROUP BY ALL) SELECT CAST(col AS INT) AS col, CAST(row AS INT) AS row, max(factor) AS value FROM near n JOIN z ON z.r_id = n.r_id AND z.mode = 'SPECIAL' WHERE inside OR dist < 20 - 1e-9 GROUP BY col, row")
def _(spark, d):
    """Price factors of cells inside a special plot or within two cells of it."""
    special = by_rule(spark, T.plots(spark, d)).filter("mode = 'SPECIAL'")
    return regions.mask(special.select("r_id", "lines", "area", F.col("factor").alias("value"), F.lit(20.0).alias("keep")), 10.0)


@query("ge07_plot_axes", "plot_sides", "SELECT r_id, CAST(row_number() OVER (PARTITION BY r_id ORDER BY ring, k) - 1 AS INT) AS side, ax, ay, bx, by_ AS by FROM plot_sides")
def _(spark, d):
    return regions.axes(T.plots(spark, d))


@query("prj08_plots_in_envelope", "rects", "SELECT r_id FROM rects WHERE (CASE WHEN r_id % 3 = 1 THEN x0 ELSE x0 END) <= 900 AND x1 >= 600 AND y0 <= 700 AND y1 >= 500")
def _(spark, d):
    return regions.in_envelope(T.plots(spark, d), 600, 500, 900, 700)


MIDDLE = "(s.x1 + (i.s0 + i.s1) / 2 * (s.x2 - s.x1))", "(s.y1 + (i.s0 + i.s1) / 2 * (s.y2 - s.y1))"


@query("prj08_interior_blocked", "net_segments plot_sides", f", {IN_PARTS} SELECT DISTINCT seg_id, r_id FROM (SELECT i.seg_id, i.r_id, i.s0, min({point_segment(*MIDDLE, 'p.ax', 'p.ay', 'p.bx', 'p.by_')}) AS deep FROM parts i JOIN net_segments s ON s.seg_id = i.seg_id JOIN plot_sides p ON p.r_id = i.r_id GROUP BY i.seg_id, i.r_id, i.s0) WHERE deep > 1e-3")
def _(spark, d):
    return regions.interior_blocked(T.net_segments(spark, d), T.plots(spark, d))


@query("jn19_band_spans")
def _(spark, d):
    special = ruled(spark, d).filter("mode = 'SPECIAL'").select("r_id", (F.col("min_dist") / 10.0).alias("keep"))
    return regions.band_spans(T.net_segments(spark, d), T.plots(spark, d).join(special, "r_id"), 10.0)


@query("ge09_plot_exits")
def _(spark, d):
    points = T.connection_points(spark, d)
    closed = plots_to_keep(spark, d)
    owned = regions.owning(points, closed.filter("rtype = 'oks'")).filter("r_id is not null").join(closed.select("r_id", "keep"), "r_id").join(points.select("cp_id", "x", "y"), "cp_id")
    return regions.exits(owned, closed, 1.0, 15.0, 10.0)


# Places along lines.


def street_lines(spark: SparkSession, d: str) -> DataFrame:
    """(line, points): whole lines of the street, with their vertices in order."""
    p = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return street(spark, d).groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", p.alias("p")))), lambda v: v["p"]).alias("points")).filter(F.size("points") > 1)


WAYS = STREET + """, step AS (SELECT line, pos, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS l FROM street WINDOW w AS (PARTITION BY line ORDER BY pos)),
    way AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM step WHERE bx IS NOT NULL), whole AS (SELECT line, sum(l) AS length FROM way GROUP BY line)"""


@query("wn03_point_at_distance", "net_nodes", f"{WAYS} SELECT line, round(ax + (length / 3 - so_far) / l * (bx - ax), 4) AS x, round(ay + (length / 3 - so_far) / l * (by_ - ay), 4) AS y FROM way JOIN whole USING (line) WHERE so_far < length / 3 AND length / 3 <= so_far + l")
def _(spark, d):
    at = L.point_at(F.col("points"), L.length(F.col("points")) / 3)
    return street_lines(spark, d).select("line", at.alias("p")).select("line", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("wn03_part_of_line", "net_nodes", f"{WAYS} SELECT line, CAST(2 + count(*) FILTER (WHERE so_far > length / 4 + 1e-9 AND so_far < length / 2 - 1e-9) AS INT) AS vertices, round(any_value(length) / 4, 4) AS length FROM way JOIN whole USING (line) GROUP BY line")
def _(spark, d):
    part = L.part(F.col("points"), L.length(F.col("points")) / 4, L.length(F.col("points")) / 2)
    return street_lines(spark, d).select("line", part.alias("p")).select("line", F.size("p").alias("vertices"), F.round(L.length(F.col("p")), 4).alias("length"))


@query("wn03_projected_points", "net_nodes", f"{WAYS}, on_ AS (SELECT line, so_far + t * l AS way, round(sqrt(pow(1000 - ax - t * (bx - ax), 2) + pow(900 - ay - t * (by_ - ay), 2)), 9) AS off FROM (SELECT *, greatest(0.0, least(1.0, ((1000 - ax) * (bx - ax) + (900 - ay) * (by_ - ay)) / (l * l))) AS t FROM way)) SELECT line, round(arg_min(way, (off, way)), 4) AS way, round(min(off), 6) AS off FROM on_ GROUP BY line")
def _(spark, d):
    found = L.project(F.col("points"), F.lit(1000.0), F.lit(900.0))
    return street_lines(spark, d).select("line", found.alias("p")).select("line", F.round("p.way", 4).alias("way"), F.round("p.off", 6).alias("off"))


@query("ge16_line_split_at_place", "net_nodes", f"{WAYS}, c AS (SELECT line, count(*) FILTER (WHERE so_far > 1e-9 AND so_far < 100 - 1e-9) AS n, any_value(length) AS length FROM way JOIN whole USING (line) GROUP BY line), v AS (SELECT line, count(*) FILTER (WHERE so_far > 100 + 1e-9 AND so_far < length - 1e-9) AS n FROM way JOIN whole USING (line) GROUP BY line) SELECT c.line, k, CASE k WHEN 0 THEN c.n + 2 ELSE v.n + 2 END AS vertices, round(CASE k WHEN 0 THEN 100.0 ELSE length - 100 END, 4) AS length FROM c JOIN v ON v.line = c.line CROSS JOIN (VALUES (0), (1)) t(k) WHERE length > 200")
def _(spark, d):
    rows = street_lines(spark, d).filter(L.length(F.col("points")) > 200).select("line", F.posexplode(L.split_at(F.col("points"), F.lit(100.0))).alias("k", "p"))
    return rows.select("line", "k", F.size("p").cast("long").alias("vertices"), F.round(L.length(F.col("p")), 4).alias("length"))


@query("st02_line_signatures", "net_nodes", f"{STREET}, sig AS (SELECT line, string_agg(CAST(x * 100 AS BIGINT) || ',' || CAST(y * 100 AS BIGINT), ';' ORDER BY pos) AS sig, count(*) AS n FROM street GROUP BY line) SELECT line, sig FROM sig WHERE n > 1")
def _(spark, d):
    return street_lines(spark, d).select("line", L.signature(F.col("points")).alias("sig"))
