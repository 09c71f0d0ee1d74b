"""Operators on trees of edges (tree, n, parent, len_m, flow): flows, diameters, run lengths, costs, ranks.

Edge n hangs on the edge ``parent`` of its tree (0 or null: on the root) and ends
in node n; numbers are any positive integers.  What is summed over all edges
below or above one is found by doubling: a row holds its edge's value over the
next 2**k levels and the edge 2**k levels up, and every round doubles both.  So a
tree of depth d takes log d rounds on one row for each edge, whatever its shape;
each round is a written table.

Trees numbered like heaps (edge n hangs on edge n // 2) may say so: their
ancestors follow from the numbers, without any round.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import scalars as S
from netloom.functions.catalogues import DEFAULT, Catalogues
from netloom.sources.shared import Tables

#: Rounds of doubling after which parents must form a circle.
ROUNDS = 40


def folded(edges: DataFrame, below: dict[str, tuple[str, Column]] | None = None, above: dict[str, Column] | None = None, parent: Column | None = None) -> DataFrame:
    """(tree, n, ...): values of each edge with all edges below it, or with all above it.

    below: name to ("sum" or "max", value), over the edge and its subtree.
    above: name to a value that is summed over the edge and its ancestors.
    ``parent`` stands for the column of that name; a circle of parents is an error.
    """
    below, above = below or {}, above or {}
    up = F.coalesce(parent if parent is not None else F.col("parent"), F.lit(0))
    rows = edges.select("tree", "n", F.when(up > 0, up).alias("up"), *[v.alias(name) for name, (_, v) in below.items()], *[v.alias(name) for name, v in above.items()])
    tables = Tables(edges.sparkSession)
    open_ = F.count("up").alias("open")
    rows, seen = tables.counted(rows, "fold", open_)
    for _ in range(ROUNDS):
        if not seen["open"]:
            break
        out = rows
        if below:
            gained = rows.filter("up is not null").groupBy("tree", F.col("up").alias("n")).agg(*[{"sum": F.sum, "max": F.max}[kind](name).alias(f"{name}_more") for name, (kind, _) in below.items()])
            out = out.join(gained, ["tree", "n"], "left")
        higher = rows.select("tree", F.col("n").alias("up"), F.col("up").alias("up_next"), *[F.col(name).alias(f"{name}_more") for name in above])
        out = out.join(higher, ["tree", "up"], "left")
        more = {name: F.coalesce(F.col(name) + F.col(f"{name}_more"), F.col(name)) if kind == "sum" else F.greatest(name, f"{name}_more") for name, (kind, _) in below.items()}
        more |= {name: F.coalesce(F.col(name) + F.col(f"{name}_more"), F.col(name)) for name in above}
        rows, seen = tables.counted(out.select("tree", "n", F.col("up_next").alias("up"), *[v.alias(name) for name, v in more.items()]), "fold", open_)
        for path in tables.paths["fold"][:-2]:  # read by nothing any more
            tables.paths["gone"] = [path]
            tables.drop("gone")
        tables.paths["fold"] = tables.paths["fold"][-2:]
    else:
        raise ValueError("parents form a circle")
    return rows.drop("up")


def heap_ancestors(edges: DataFrame) -> DataFrame:
    """Of heap-numbered trees: each edge once for itself and every edge above it, (tree, n, below, steps, len_m, flow)."""
    deep = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    steps = F.sequence(F.lit(0), deep)
    return edges.select("tree", F.col("n").alias("below"), "len_m", "flow", F.explode(steps).alias("steps")).select("tree", F.expr("shiftright(below, steps)").alias("n"), "below", "steps", "len_m", "flow")


def subtree_flow(edges: DataFrame, heap: bool = False) -> DataFrame:
    """(tree, n, total_flow): what an edge carries for all nodes behind it."""
    if heap:
        return heap_ancestors(edges).groupBy("tree", "n").agg(F.sum("flow").alias("total_flow"))
    return folded(edges, below={"total_flow": ("sum", F.col("flow"))})


def with_design(edges: DataFrame, c: Catalogues = DEFAULT, heap: bool = False) -> DataFrame:
    """Edges with total_flow and the least diameter that carries it (the largest where none does)."""
    out = edges.join(subtree_flow(edges, heap), ["tree", "n"])
    largest = c.diameters[-1][0]
    return out.withColumn("dn", F.coalesce(S.smallest_dn(F.col("total_flow"), c=c), F.lit(largest)))


def levels(edges: DataFrame) -> DataFrame:
    """(tree, n, level): how many edges are above an edge."""
    return folded(edges, above={"level": F.lit(1).cast("long")}).select("tree", "n", (F.col("level") - 1).alias("level"))


def longest_downstream(edges: DataFrame) -> DataFrame:
    """(tree, n, longest): the longest way from an edge's start to a leaf below it."""
    ways = folded(edges, above={"way": F.col("len_m")})
    far = folded(edges.join(ways, ["tree", "n"]), below={"far": ("max", F.col("way"))})
    return far.join(ways, ["tree", "n"]).join(edges.select("tree", "n", "len_m"), ["tree", "n"]).select("tree", "n", (F.col("far") - F.col("way") + F.col("len_m")).alias("longest"))


def with_run(designed: DataFrame) -> DataFrame:
    """``designed`` with ``run_parent``: the parent where it has the same diameter, else 0."""
    above = designed.select("tree", F.col("n").alias("parent"), F.col("dn").alias("dn_above"))
    same = F.col("dn") == F.col("dn_above")
    return designed.join(above, ["tree", "parent"], "left").withColumn("run_parent", F.when(same, F.col("parent")).otherwise(0)).drop("dn_above")


def run_lengths(designed: DataFrame) -> DataFrame:
    """(tree, n, run_m): length of the unbroken stretch of one diameter from where it begins down to this edge's end."""
    return folded(with_run(designed), above={"run_m": F.col("len_m")}, parent=F.col("run_parent"))


def required_run(designed: DataFrame) -> DataFrame:
    """(tree, n, required_m): the longest run that an edge is part of."""
    rows = with_run(designed)
    runs = folded(rows, above={"run_m": F.col("len_m")}, parent=F.col("run_parent"))
    return folded(rows.join(runs, ["tree", "n"]), below={"required_m": ("max", F.col("run_m"))}, parent=F.col("run_parent"))


#: An edge of one tree: (n, parent, length, diameter, flow carried).
Rows = list[tuple[int, int, int, int, int]]


def from_root(rows: Rows) -> list[int]:
    """Numbers in an order in which parents come before their children; a circle is an error."""
    known = {r[0] for r in rows}
    children: dict[int, list[int]] = defaultdict(list)
    for n, parent, *_ in rows:
        children[parent if parent in known else 0].append(n)
    out, open_ = [], sorted(children[0], reverse=True)
    while open_:
        out.append(open_.pop())
        open_ += sorted(children[out[-1]], reverse=True)
    if len(out) < len(rows):
        raise ValueError("parents form a circle")
    return out


def enforced(rows: Rows, c: Catalogues = DEFAULT, rounds: int = 64) -> dict[int, int | None]:
    """Diameters of one tree, raised until no run is too long and none grows away from the root.

    An edge of a run that is too long gets the least diameter, not below its own,
    that carries its flow over the whole run.  A tree for which there is none has
    no diameters: None for all its edges.
    """
    above = {n: p for n, p, *_ in rows}
    length, flow, dn = ({r[0]: r[i] for r in rows} for i in (2, 4, 3))
    order = from_root(rows)
    longest = {r[0]: r[2] for r in c.diameters}
    for _ in range(rounds):
        before = dict(dn)
        run: dict[int, int] = {}
        for n in order:
            run[n] = length[n] + (run[above[n]] if dn.get(above[n]) == dn[n] else 0)
        need = dict(run)
        for n in reversed(order):
            if dn.get(above[n]) == dn[n]:
                need[above[n]] = max(need[above[n]], need[n])
        for n in order:
            if need[n] > longest[dn[n]] + 1e-9:
                fitting = [d for d, capacity, most, _ in c.diameters if d >= before[n] and capacity >= flow[n] and most >= need[n] - 1e-9]
                if not fitting:
                    return dict.fromkeys(dn)
                dn[n] = fitting[0]
        for n in reversed(order):
            if dn.get(above[n], dn[n]) < dn[n]:
                dn[above[n]] = dn[n]
        if dn == before:
            break
    return dn


def per_tree(designed: DataFrame, solve: Callable[[Rows], list[tuple[int | None, ...]]], schema: str) -> DataFrame:
    """Rows that ``solve`` makes of each tree's edges (n, parent, length, diameter, flow).

    The JVM groups the edges, one row for each tree, and Python meets batches of
    whole trees, not one call for each.
    """
    trees = designed.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("parent", F.lit(0)).alias("parent"), "len_m", "dn", "total_flow"))).alias("edges"))
    names = [f.split()[0] for f in schema.split(", ")]
    whole = f"tree long, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *({"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", "))]
        for batch in batches:
            out: list[tuple[int | None, ...]] = []
            for tree, edges in zip(batch.column("tree").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                out += [(tree, *r) for r in solve([(e["n"], e["parent"], e["len_m"], e["dn"], e["total_flow"]) for e in edges])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["tree", *names])

    return trees.mapInArrow(run, whole)


def enforce_runs(designed: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(tree, n, dn): diameters after the run-length rule, a fixed point for each tree; null in a tree that has none."""
    return per_tree(designed, lambda rows: list(enforced(rows, c).items()), "n int, dn int")


class TooManyStates(Exception):
    """An exact choice would look at more states than allowed."""


def optimum(rows: Rows, c: Catalogues = DEFAULT, new_root: bool = True, states: int = 500_000) -> tuple[int, dict[int, int]] | None:
    """Least cost of one tree, pipes and new chambers, and its diameters, exactly; None if no choice is admissible.

    Diameters never grow away from the root, so a node's chamber (where two edges
    or more leave it) is priced by the edge that enters it, and subtrees are
    independent given that edge's diameter and where its run began.  So a state is
    (edge, edge where its run began, diameter), worked off from the leaves; the
    root's chamber is priced by the largest of the edges there.
    """
    order = from_root(rows)
    above, length, flow = ({r[0]: r[i] for r in rows} for i in (1, 2, 4))
    children: dict[int, list[int]] = defaultdict(list)
    for n in order:
        children[above[n] if above[n] in length else 0].append(n)
    chamber = {dn: next((p for most, p in c.chambers if dn <= most), c.chambers[-1][1]) for dn, *_ in c.diameters}
    largest = c.diameters[-1][0]
    need = {n: next((d for d, capacity, *_ in c.diameters if capacity >= f), largest) for n, f in flow.items()}
    cost: dict[int, dict[tuple[int, int], int]] = {}
    #: Cheapest run that begins with an edge, among diameters below each, and not above each: {dn: (cost, chosen)}.
    lesser: dict[int, dict[int, tuple[int, int]]] = {}
    upto: dict[int, dict[int, tuple[int, int]]] = {}
    seen = 0
    for n in reversed(order):
        mine: dict[tuple[int, int], int] = {}
        for dn, _, longest, price in c.diameters:
            if dn < need[n]:
                continue
            own = length[n] * price + (chamber[dn] if len(children[n]) > 1 else 0)
            start, run = n, length[n]
            while run <= longest + 1e-9:
                seen += 1
                if seen > states:
                    raise TooManyStates
                total: int | None = own
                for child in children[n]:
                    ways = [x for x in (cost[child].get((start, dn)), lesser[child].get(dn, (None,))[0]) if x is not None]
                    if not ways:
                        total = None
                        break
                    total += min(ways)
                if total is not None:
                    mine[start, dn] = total
                start = above[start]
                if start not in length:
                    break
                run += length[start]
        cost[n] = mine
        best: tuple[int, int] | None = None
        lesser[n], upto[n] = {}, {}
        for dn, *_ in c.diameters:
            if best is not None:
                lesser[n][dn] = best
            value = mine.get((n, dn))
            if value is not None and (best is None or value < best[0]):
                best = value, dn
            if best is not None:
                upto[n][dn] = best
    tops = children[0]
    totals = [(sum(upto[n][m][0] for n in tops) + (chamber[m] if new_root else 0), m) for m, *_ in c.diameters if all(m in upto[n] for n in tops)]
    if not totals:
        return None
    total, most = min(totals)
    chosen = {n: upto[n][most][1] for n in tops}
    start = {n: n for n in tops}
    for n in order:
        for child in children[n]:
            on, other = cost[child].get((start[n], chosen[n])), lesser[child].get(chosen[n])
            if other is not None and (on is None or other[0] < on):
                chosen[child], start[child] = other[1], child
            else:
                chosen[child], start[child] = chosen[n], start[n]
    return total, chosen


def optimal_diameters(designed: DataFrame, c: Catalogues = DEFAULT, states: int = 500_000) -> DataFrame:
    """(tree, n, dn, tree_cost, how) of the cheapest admissible choice for each tree.

    ``how``: ``optimum``; ``rule`` where that takes more than ``states`` states, and the
    run-length rule's diameters stand instead (tree_cost null); ``none`` where no
    choice is admissible (dn and tree_cost null).
    """

    def solve(rows: Rows) -> list[tuple[int | None, ...]]:
        try:
            found = optimum(rows, c, states=states)
        except TooManyStates:
            ruled = enforced(rows, c)
            return [(n, dn, None, "none" if dn is None else "rule") for n, dn in ruled.items()]
        if not found:
            return [(r[0], None, None, "none") for r in rows]
        return [(n, dn, found[0], "optimum") for n, dn in sorted(found[1].items())]

    return per_tree(designed, solve, "n int, dn int, tree_cost long, how string")


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge at both its nodes: (tree, node, *columns)."""
    return edges.select("tree", F.explode(F.array(F.coalesce("parent", F.lit(0)), F.col("n"))).alias("node"), *columns)


def node_dn(designed: DataFrame) -> DataFrame:
    return endpoints(designed, "dn").groupBy("tree", "node").agg(F.max("dn").alias("max_dn"))


def node_degree(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("tree", "node").agg(F.count("*").alias("degree"))


def node_type(edges: DataFrame) -> DataFrame:
    """Root or three and more edges: a chamber; two: a technical node; one: a connection point."""
    d = F.col("degree")
    return node_degree(edges).select("tree", "node", "degree", F.when((F.col("node") == 0) | (d >= 3), "CHAMBER").when(d == 2, "TECHNICAL_NODE").otherwise("CONNECTION_POINT").alias("kind"))


def tree_totals(designed: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(tree, pipe_cost, chamber_cost, tie_ins, length_m): edges and nodes are summed apart, then joined on the tree."""
    pipes = designed.groupBy("tree").agg(F.sum(S.segment_cost(F.col("len_m"), F.col("dn"), c=c)).alias("pipe_cost"), F.sum("len_m").alias("length_m"), F.count(F.when(F.coalesce("parent", F.lit(0)) == 0, 1)).alias("tie_ins"))
    chambers = endpoints(designed, "dn").groupBy("tree", "node").agg(F.max("dn").alias("max_dn"), F.count("*").alias("degree")).filter("degree >= 3 or node = 0")
    return pipes.join(chambers.groupBy("tree").agg(F.sum(S.chamber_price(F.col("max_dn"), c)).alias("chamber_cost")), "tree")


def ranked_variants(designed: DataFrame, variants: DataFrame, c: Catalogues = DEFAULT) -> DataFrame:
    """(plan, variant, cost, length_m, score, rank): totals of a plan's variants, best score first, three at most."""
    cost = F.sum(F.col("pipe_cost") + F.col("chamber_cost") + F.col("tie_ins") * c.tie_in)
    totals = tree_totals(designed, c).join(variants, "tree").groupBy("plan", "variant").agg(cost.alias("cost"), F.sum("length_m").alias("length_m"))
    totals = totals.withColumn("score", F.round(S.score(F.col("cost"), F.col("length_m"), c), 6))
    order = Window.partitionBy("plan").orderBy("score", "variant")
    return totals.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")

