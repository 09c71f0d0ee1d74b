"""From planned edges to what a run gives out: segments, chambers, technical nodes, one summary for each variant, warnings.

Plan rows are those of ``planner.plan``; every relation here is keyed by ``eid``, the
text ``tile/variant/edge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import lines as L
from netloom.functions import scalars as S
from netloom.functions.catalogues import DEFAULT, Catalogues
from netloom.operators import depth as D
from netloom.operators import regions, sequences, trees
from netloom.sources.shared import Tables


def edges(plan: DataFrame, targets: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(eid, tile, variant, n, parent, node, root, flow, line, length, children): whole lines, tails to points included.

    targets (id, x, y, tail_x, tail_y): where the planner was to reach a point, and the point itself.
    """
    rows = plan.filter("edge is not null")
    key = F.concat_ws("/", "tile", "variant", "edge")
    ends = targets.select(F.col("id").alias("node"), F.struct(F.col("tail_x").cast("double").alias("x"), F.col("tail_y").cast("double").alias("y")).alias("end"))
    children = rows.filter("parent > 0").groupBy("tile", "variant", F.col("parent").alias("edge")).agg(F.count("*").alias("children"))
    rows = rows.join(ends, "node", "left").join(children, ["tile", "variant", "edge"], "left")
    last = F.element_at("line", -1)
    whole = F.when(F.col("end").isNotNull() & (S.distance(last["x"], last["y"], F.col("end.x"), F.col("end.y")) > 1e-6), F.concat("line", F.array("end"))).otherwise(F.col("line"))
    return rows.select(key.alias("eid"), "tile", "variant", F.col("edge").alias("n"), "parent", "node", "root", "flow", whole.alias("line"), L.length(whole).alias("length"), F.coalesce("children", F.lit(0)).alias("children"))


def designed(rows: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """Edges with ``dn``: the cheapest admissible diameters of each tile's variant; where there are none, the least that carry
    the flow (``how`` tells)."""
    tree = F.xxhash64("tile", "variant")
    base = rows.select(tree.alias("tree"), "n", "parent", F.ceil("length").cast("long").alias("len_m"), F.ceil(F.col("flow")).cast("long").alias("total_flow"), F.coalesce(S.smallest_dn(F.col("flow"), c=c), F.lit(c.diameters[-1][0])).alias("dn"))
    found = trees.optimal_diameters(base, c).withColumnsRenamed({"dn": "best"})
    both = rows.withColumn("tree", tree).join(base.select("tree", "n", F.col("dn").alias("least")), ["tree", "n"]).join(found.select("tree", "n", "best", "how"), ["tree", "n"])
    return both.withColumn("dn", F.coalesce("best", "least")).drop("tree", "best", "least")


def zone_spans(rows: DataFrame, zones: DataFrame, reach: float) -> DataFrame:
    """(eid, r_id, s0, s1): stretches of edges within zones' bands, in metres along the edge, one for each crossing."""
    parts = rows.select("eid", F.posexplode(L.steps(F.col("line"))).alias("pos", "s")).filter("s.length > 0")
    parts = parts.select(F.struct("eid", "pos").alias("seg_id"), F.col("s.ax").alias("x1"), F.col("s.ay").alias("y1"), F.col("s.bx").alias("x2"), F.col("s.by").alias("y2"), F.col("s.at").alias("at"), F.col("s.length").alias("length"))
    tables = Tables(rows.sparkSession)
    parts = tables.write(parts, "zone-parts")
    found = regions.band_spans(parts, zones, reach).join(parts.select("seg_id", "at", "length"), "seg_id")
    place = [F.round(F.col("at") + F.col(s) * F.col("length"), 6).alias(s) for s in ("s0", "s1")]
    whole = sequences.merged_spans(found.select(F.struct("seg_id.eid", "r_id").alias("k"), *place, F.lit(0).alias("v")), "k", "s0", "s1", "v")
    return whole.filter("s1 - s0 > 0.001").select("k.eid", "k.r_id", "s0", "s1")


def pieces(rows: DataFrame, spans: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(eid, s0, s1, factor, h0, h1, k_depth): edges cut at every border of a stretch or a depth profile's piece.

    spans (eid, s0, s1, factor); profiles (eid, s0, s1, h0, h1).
    """
    ends = rows.select("eid", F.explode(F.array(F.lit(0.0), F.round("length", 6))).alias("s"))
    cuts = ends.union(spans.select("eid", F.explode(F.array("s0", "s1")).alias("s")))
    if profiles is not None:
        cuts = cuts.union(profiles.select("eid", F.explode(F.array(F.round("s0", 6), F.round("s1", 6))).alias("s")))
    order = Window.partitionBy("eid").orderBy("s")
    parts = cuts.distinct().select("eid", F.col("s").alias("a"), F.lead("s").over(order).alias("b")).filter("b - a > 1e-6")
    middle = (F.col("a") + F.col("b")) / 2
    over = spans.select("eid", F.col("s0").alias("p"), F.col("s1").alias("q"), "factor")
    factors = parts.join(over, "eid").filter((F.col("p") <= middle) & (middle <= F.col("q"))).groupBy("eid", "a").agg(F.max("factor").alias("factor"))
    out = parts.join(factors, ["eid", "a"], "left").withColumn("factor", F.coalesce("factor", F.lit(100).cast("long")))
    if profiles is None:
        return out.select("eid", F.col("a").alias("s0"), F.col("b").alias("s1"), "factor", F.lit(None).cast("double").alias("h0"), F.lit(None).cast("double").alias("h1"), F.lit(1.0).alias("k_depth"))
    p = profiles.select("eid", F.col("s0").alias("p"), F.col("s1").alias("q"), F.col("h0").alias("u"), F.col("h1").alias("v"))
    both = out.join(p, "eid").filter((F.col("p") <= middle) & (middle < F.col("q")))
    at = [sequences.interpolated(F.col(x), F.col("p"), F.col("q"), F.col("u"), F.col("v")) for x in ("a", "b")]
    return both.select("eid", F.col("a").alias("s0"), F.col("b").alias("s1"), "factor", F.round(at[0], 6).alias("h0"), F.round(at[1], 6).alias("h1"), ((S.depth_factor(F.col("u")) + S.depth_factor(F.col("v"))) / 2).alias("k_depth"))


def depth_profiles(rows: DataFrame, spans: DataFrame, c: Catalogues = DEFAULT, r: D.Rules = D.Rules()) -> tuple[DataFrame, DataFrame]:
    """(eid, s0, s1, h0, h1) of every edge, and warnings (eid, code): ways above or below lines with a known depth (spans with rtype)."""
    top, height = (F.create_map(*[x for t, *v in c.verticals for x in (F.lit(t), F.lit(float(v[i])))]) for i in (0, 1))
    asked = spans.join(rows.select("eid", "dn"), "eid").withColumn("top", F.try_element_at(top, "rtype")).filter("top is not null")
    wanted = S.avoidance_depth(F.col("top"), F.try_element_at(height, "rtype"), S.pipe_height(F.col("dn"), c), least=r.least)
    asked = asked.select(F.col("eid").alias("edge"), F.col("s0").alias("start"), F.col("s1").alias("end"), F.round(wanted, 6).alias("depth"))
    lengths = rows.select(F.col("eid").alias("edge"), "length")
    return D.profiles(lengths, asked, r).withColumnRenamed("edge", "eid"), D.warnings(lengths, asked, r).withColumnRenamed("edge", "eid")


def node_ids(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with ``from_id`` and ``to_id``: ids of points and existing chambers as they came in, of new nodes with tile and variant before them.

    names (seq, name): ids of points and chambers by their number.
    """
    own = F.concat(F.lit("v"), "variant", F.lit("_t"), "tile", F.lit("_n"), "n")
    named = rows.join(names.select(F.col("seq").alias("node"), F.col("name").alias("point")), "node", "left").join(names.select(F.col("seq").alias("root"), F.col("name").alias("chamber")), "root", "left")
    named = named.withColumn("to_id", F.when(F.col("node") >= 0, F.coalesce("point", F.col("node").cast("string"))).otherwise(own))
    up = named.select("tile", "variant", F.col("n").alias("parent"), F.col("to_id").alias("above"))
    first = F.when(F.col("root") >= 0, F.coalesce("chamber", F.col("root").cast("string"))).otherwise(F.concat(F.lit("v"), "variant", F.lit("_t"), "tile", F.lit("_r"), (-F.col("root")).cast("string")))
    return named.join(up, ["tile", "variant", "parent"], "left").withColumn("from_id", F.coalesce("above", first)).drop("above", "point", "chamber")


def segments(rows: DataFrame, parts: DataFrame, tolerance: float = 0.01, c: Catalogues = DEFAULT) -> DataFrame:
    """One row for each piece: (eid, tile, variant, id, start_node_id, end_node_id, flow, dn, length, laying_method, depth_start, depth_end, cost, line, s0, s1).

    A special piece goes straight from its first to its last point.
    """
    met = parts.join(rows.select("eid", "tile", "variant", "from_id", "to_id", "flow", "dn", "line", F.round("length", 6).alias("whole")), "eid")
    special = F.col("factor") > 100
    part = L.part(F.col("line"), F.col("s0"), F.col("s1"))
    met = met.withColumn("part", F.when(special, F.array(L.point_at(F.col("line"), F.col("s0")), L.point_at(F.col("line"), F.col("s1")))).otherwise(part))
    length = S.snapped_up(F.round(L.length(F.col("part")), 9), tolerance)

    def at(s: str) -> Column:
        return F.concat(F.lit("v"), "variant", F.lit("_"), F.replace("eid", F.lit("/"), F.lit("_")), F.lit("_at"), S.rounded(F.col(s) * 100).cast("string"))

    start = F.when(F.col("s0") <= 1e-6, F.col("from_id")).otherwise(at("s0"))
    end = F.when(F.col("s1") >= F.col("whole") - 1e-6, F.col("to_id")).otherwise(at("s1"))
    met = met.withColumn("length", length)
    cost = S.segment_cost(F.col("length"), F.col("dn"), F.col("k_depth"), F.col("factor") / 100.0, c)
    name = F.concat(F.lit("s_"), F.replace("eid", F.lit("/"), F.lit("_")), F.lit("_"), S.rounded(F.col("s0") * 100).cast("string"))
    return met.select("eid", "tile", "variant", name.alias("id"), start.alias("start_node_id"), end.alias("end_node_id"), "flow", "dn", "length", F.when(special, "special").otherwise("base").alias("laying_method"), F.col("h0").alias("depth_start"), F.col("h1").alias("depth_end"), cost.alias("cost"), F.col("part").alias("line"), "s0", "s1")


def chambers(rows: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(tile, variant, id, dn, cost, x, y, existing, tie_ins): nodes where edges begin; ends of the existing network cost a tie-in for each edge."""
    start = F.col("line")[0]
    first = rows.filter("parent = 0").groupBy("tile", "variant", F.col("from_id").alias("id")).agg(F.max("dn").alias("dn"), F.count("*").alias("tie_ins"), F.first(start).alias("p"), F.first("root").alias("root"))
    first = first.select("tile", "variant", "id", "dn", F.when(F.col("root") >= 0, F.col("tie_ins") * c.tie_in).otherwise(S.chamber_price(F.col("dn"), c)).cast("long").alias("cost"), "p.x", "p.y", (F.col("root") >= 0).alias("existing"), "tie_ins")
    last = F.element_at("line", -1)
    forks = rows.filter("children > 1").select("tile", "variant", F.col("to_id").alias("id"), "dn", S.chamber_price(F.col("dn"), c).alias("cost"), last["x"].alias("x"), last["y"].alias("y"), F.lit(False).alias("existing"), F.lit(0).cast("long").alias("tie_ins"))
    return first.unionByName(forks)


def technical_nodes(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """(tile, variant, id, x, y): nodes at cuts within edges, and nodes where one edge goes on as another."""
    cuts = segs.filter("s0 > 1e-6").select("tile", "variant", F.col("start_node_id").alias("id"), F.col("line")[0]["x"].alias("x"), F.col("line")[0]["y"].alias("y"))
    last = F.element_at("line", -1)
    return cuts.unionByName(rows.filter("children = 1 and node < 0").select("tile", "variant", F.col("to_id").alias("id"), last["x"].alias("x"), last["y"].alias("y")))


def merged(segs: DataFrame, places: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(tile, variant, k): which of a tile's variants is its k-th best; a tile's last one stands for the ranks it lacks (up to the most that any tile has)."""
    cost = segs.groupBy("tile", "variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length")).join(places.groupBy("tile", "variant").agg(F.sum("cost").alias("places")), ["tile", "variant"], "left")
    order = Window.partitionBy("tile").orderBy(F.round(S.score(F.col("pipes") + F.coalesce("places", F.lit(0).cast("long")), F.col("length"), c), 9), "variant")
    ranked = cost.select("tile", "variant", F.row_number().over(order).alias("rank")).withColumn("n", F.max("rank").over(Window.partitionBy("tile"))).filter("rank <= 3")
    most = ranked.agg(F.max("rank").alias("most"))  # one row
    last = F.when(F.col("rank") == F.least(F.col("n"), F.lit(3)), F.sequence(F.col("rank"), F.greatest("rank", "most"))).otherwise(F.array("rank"))
    return ranked.crossJoin(F.broadcast(most)).select("tile", "variant", F.explode(last).alias("k"))


def summaries(segs: DataFrame, places: DataFrame, choice: DataFrame, lost: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """One row for each variant k: costs, length, score, rank.  lost (cp_id, flow): points that no variant connects."""
    zero = F.lit(0).cast("long")
    pipes = segs.join(choice, ["tile", "variant"]).groupBy("k").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("length"))
    own, met = ~F.col("existing"), F.col("existing")
    nodes = places.join(choice, ["tile", "variant"]).groupBy("k").agg(F.sum(F.when(own, F.col("cost")).otherwise(zero)).alias("chambers"), F.sum(F.when(met, F.col("tie_ins")).otherwise(zero)).alias("tie_ins"), F.sum(F.when(met, F.col("cost")).otherwise(zero)).alias("tie_cost"))
    due = lost.agg(F.coalesce(F.sum(S.penalty(F.col("flow"), c)), zero).alias("penalty"))  # one row
    out = pipes.join(nodes, "k", "left").crossJoin(F.broadcast(due)).withColumns({n: F.coalesce(n, zero) for n in ("chambers", "tie_ins", "tie_cost")})
    out = out.withColumn("construction", F.col("pipes") + F.col("chambers") + F.col("tie_cost")).withColumn("calculated", F.col("construction") + F.col("penalty"))
    out = out.withColumn("score", F.round(S.score(F.col("calculated"), F.col("length"), c), 9))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("score", "k")))  # three rows at most
