"""From planned edges to result rows: pieces at borders of special stretches, nodes, costs, one summary for each variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.functions.catalogues import DEFAULT, Catalogues
from netloom.operators import trees


def pieces(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """(edge, s0, s1, factor, technical): edges (edge, length) cut wherever a special stretch begins or ends.

    spans (edge, s0, s1, factor) may overlap; a piece has the largest factor over
    it, 100 where none is.  ``technical``: the piece begins at a cut.
    """
    ends = edges.select("edge", F.explode(F.array(F.lit(0.0), F.col("length").cast("double"))).alias("s"))
    cuts = ends.union(spans.select("edge", F.explode(F.array("s0", "s1")).alias("s"))).distinct()
    order = Window.partitionBy("edge").orderBy("s")
    parts = cuts.select("edge", F.col("s").alias("a"), F.lead("s").over(order).alias("b"), (F.row_number().over(order) > 1).alias("technical")).filter("b is not null")
    middle = (F.col("a") + F.col("b")) / 2
    over = spans.select(F.col("edge").alias("e"), "s0", "s1", "factor")
    hit = parts.join(over, (F.col("edge") == F.col("e")) & (F.col("s0") <= middle) & (middle <= F.col("s1")), "left")
    return hit.groupBy("edge", F.col("a").alias("s0"), F.col("b").alias("s1"), "technical").agg(F.coalesce(F.max("factor"), F.lit(100).cast("long")).alias("factor"))


def priced(parts: DataFrame, edges: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """Pieces with their cost."""
    rows = parts.join(edges.select("edge", "dn"), "edge")
    return rows.withColumn("cost", S.segment_cost(F.col("s1") - F.col("s0"), F.col("dn"), 1.0, F.col("factor") / 100.0, c))


def summary(costs: DataFrame, unconnected: DataFrame, key: str, c: Catalogues = DEFAULT) -> DataFrame:
    """(key, construction_cost, penalty, calculated_cost, lost): costs (key, cost), unconnected (key, cp_id, flow).

    ``lost`` counts the unconnected; which they are stays a relation, however many there are.
    """
    built = costs.groupBy(key).agg(F.sum("cost").alias("construction_cost"))
    lost = unconnected.groupBy(key).agg(F.sum(S.penalty(F.col("flow"), c)).alias("penalty"), F.count("*").alias("lost"))
    zero = F.lit(0).cast("long")
    out = built.join(lost, key, "full").select(key, F.coalesce("construction_cost", zero).alias("construction_cost"), F.coalesce("penalty", zero).alias("penalty"), F.coalesce("lost", zero).alias("lost"))
    return out.withColumn("calculated_cost", F.col("construction_cost") + F.col("penalty"))


def contracted(edges: DataFrame) -> DataFrame:
    """(tree, head, tail, edges, len_m): chains of one diameter through nodes of degree two, each as one edge.

    ``head`` is the first edge of the chain and ``tail`` the last.  An edge
    continues its parent's chain if it is the only child and has its diameter.
    """
    children = edges.filter("parent > 0").groupBy("tree", F.col("parent").alias("n")).agg(F.count("*").alias("children"))
    own = edges.join(children, ["tree", "n"], "left").select("tree", "n", "parent", "len_m", "dn", F.coalesce("children", F.lit(0)).alias("children"))
    above = own.select("tree", F.col("n").alias("parent"), F.col("dn").alias("dn_above"), F.col("children").alias("siblings"))
    joined = own.join(above, ["tree", "parent"], "left").withColumn("goes_on", F.coalesce((F.col("siblings") == 1) & (F.col("dn") == F.col("dn_above")), F.lit(False)))
    # Within the forest of edges that go on, a chain's head is its root.
    linked = joined.withColumn("chain", F.when(F.col("goes_on"), F.col("parent")).otherwise(0))
    rows = linked.join(heads(linked), ["tree", "n"])
    return rows.groupBy("tree", "head").agg(F.max_by("n", "place").alias("tail"), F.count("*").alias("edges"), F.sum("len_m").alias("len_m"))


def heads(linked: DataFrame) -> DataFrame:
    """(tree, n, head, place): the first edge of each edge's chain, and the place in it; ``chain`` is the edge before, or 0.

    Only heads carry their number, so the sum over an edge and those above it is the head's.
    """
    own = F.when(F.col("chain") == 0, F.col("n").cast("long")).otherwise(F.lit(0).cast("long"))
    return trees.folded(linked, above={"head": own, "place": F.lit(1)}, parent=F.col("chain"))
