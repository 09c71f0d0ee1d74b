"""Route search.  Relations stay outside: a planner gets one tile's rows and returns plain edge rows, which the
relational operators price, rank and validate again.

The shipped planner grows a forest on a grid: a wave runs from all tie-in places
at once; where it reaches a connection point, the way back joins the forest and
becomes a source of cost 0, so later points branch off it.  Turns are at most 90
degrees, corners are not cut, blocked cells are not entered, and connection
points are leaves.  The first pass weighs length; later passes weigh price by the
diameters that the pass before found.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.catalogues import DEFAULT, Catalogues
from netloom.operators.grid import Edge, Grid, Options, Segments, Tile, crosses, straight, turns_little
from netloom.operators.medians import median
from netloom.operators.repair import repaired
from netloom.operators.shapes import Shape

#: Rows of a plan: edges; ids of unconnected points; notes (warnings and counts, as ``CODE: text``).
EDGE = "tile long, variant int, edge int, parent int, node long, flow double, length double, line array<struct<x: double, y: double>>, unconnected long, root long, note string"


class Planner(Protocol):
    def plan(self, tile: Tile) -> tuple[list[list[Edge]], list[int]]:
        """Up to three variants, and the ids of points that none of them connects."""


class Registry:
    """Planners by name.  Names are unique, the default must be one of them, unknown names are errors."""

    def __init__(self, default: str) -> None:
        self.default, self.planners = default, {}

    def add(self, name: str, planner: Planner) -> None:
        if name in self.planners:
            raise ValueError(f"planner {name} is there already")
        self.planners[name] = planner

    def get(self, name: str | None = None) -> Planner:
        name = name or self.default
        if name not in self.planners:
            raise ValueError(f"no planner {name}; there are {', '.join(sorted(self.planners))}")
        return self.planners[name]

    def names(self) -> list[tuple[str, bool]]:
        return [(n, n == self.default) for n in sorted(self.planners)]


def grow(grid: Grid, sources: list[int], targets: set[int], price: dict[int, float] | None, back: dict[int, int] | None = None, limit: float = math.inf, degree: int = 4) -> tuple[dict[int, int], set[int]]:
    """Each forest cell's way back (its parent cell, -1 at a source), and the targets reached.

    ``back``: the sources' own ways back; ``limit``: how far the wave may run.
    """
    dist = {c: 0.0 for c in sources}
    parent = {c: back[c] if back else -1 for c in sources}
    forest: dict[int, int] = {}
    reached: set[int] = set()
    settled: set[int] = set()
    meets: dict[int, int] = defaultdict(int)
    heap = [(0.0, c) for c in sorted(sources)]
    blocked = grid.blocked.ravel()
    while heap and len(reached) < len(targets):
        d, c = heapq.heappop(heap)
        if c in settled or d > dist.get(c, math.inf):
            continue
        if d > limit:
            break
        settled.add(c)
        if c in targets and c not in reached:
            way, ways = [c], parent
            while ways[way[-1]] != -1 and way[-1] not in forest and (not back or way[-1] not in back):
                way.append(ways[way[-1]])
            if not back and meets[way[-1]] >= degree:
                # The fork has no place left: the way from the nearest place that has one.
                free = {k: p for k, p in forest.items() if k not in targets and meets[k] < degree} | {k: -1 for k in sources if k not in forest}
                ways, hit = grow(grid, sorted(free), {c}, price, {**forest, **free}, degree=degree)
                if not hit:
                    continue
                way = [c]
                while way[-1] not in forest and way[-1] not in free:
                    way.append(ways[way[-1]])
            reached.add(c)
            for k in way[:-1]:
                meets[k] += 2 if k != c else 1
            meets[way[-1]] += 1
            for k in way:
                if k in forest:
                    continue
                forest[k] = parent[k] = ways.get(k, -1)
                if k not in targets:
                    dist[k] = 0.0
                    settled.discard(k)
                    heapq.heappush(heap, (0.0, k))
            continue
        before, here = parent[c], grid.centre(c)
        ux, uy = (here[0] - grid.centre(before)[0], here[1] - grid.centre(before)[1]) if before != -1 else (0.0, 0.0)
        weight = (price.get(c, 1.0) if price else 1.0) * float(grid.factor.flat[c])
        for n, dx, dy, step in grid.beside(c):
            if dx * ux + dy * uy < -1e-9 or n in forest or back and n in back or blocked[n] and n not in targets:
                continue
            new = dist[c] + step * weight
            if new < dist.get(n, math.inf) and grid.step(c, n):
                dist[n], parent[n] = new, c
                settled.discard(n)
                heapq.heappush(heap, (new, n))
    return forest, reached


def relink(grid: Grid, forest: dict[int, int], reached: set[int], rounds: int, price: dict[int, float] | None, degree: int = 4) -> dict[int, int]:
    """Branches laid anew: a point's own way up to the next fork is taken out, and the shortest way from the rest of
    the forest takes its place if that is shorter."""

    def cost(way: list[int]) -> float:
        """As the wave counts it: a step weighs by the cell it leaves."""
        return sum(math.dist(grid.centre(a), grid.centre(b)) * (price.get(a, 1.0) if price else 1.0) * float(grid.factor.flat[a]) for a, b in zip(way, way[1:], strict=False))

    for _ in range(rounds):
        better = False
        count: dict[int, int] = defaultdict(int)
        for back in forest.values():
            count[back] += 1
        for target in sorted(reached):
            if count[target]:
                continue
            way = [target]
            while forest[way[-1]] != -1 and (len(way) == 1 or count[way[-1]] == 1 and way[-1] not in reached):
                way.append(forest[way[-1]])
            taken = {c: forest.pop(c) for c in way[:-1]}
            # From the forest near by; its points stay leaves.
            old = cost(way[::-1])
            near = [c for c in local(grid, forest, target, old) if c not in reached and (c == way[-1] or count[c] + (forest[c] != -1) < degree)]
            found, hit = grow(grid, near, {target}, price, forest, old)
            new = [target]
            while hit and new[-1] not in forest:
                new.append(found[new[-1]])
            if hit and cost(new[::-1]) < old - 1e-9:
                forest.update({c: found[c] for c in new[:-1]})
                count[way[-1]] -= 1
                count[new[-1]] += 1
                for c in way[1:-1]:
                    count[c] = 0
                for c in new[1:-1]:
                    count[c] = 1
                better = True
            else:
                forest.update(taken)
        if not better:
            break
    return forest


def local(grid: Grid, forest: dict[int, int], target: int, reach: float) -> list[int]:
    """Forest cells within ``reach`` of a cell (price factors are at most 1, so all cells where they apply)."""
    k = int(reach / grid.row) + 2
    if k * k > len(forest):
        return sorted(forest)
    col, row = target % grid.w, target // grid.w
    return sorted(c for y in range(max(0, row - k), min(grid.h, row + k + 1)) for x in range(max(0, col - k), min(grid.w, col + k + 1)) if (c := y * grid.w + x) in forest)


def pulled(grid: Grid, edges: list[Edge]) -> list[Edge]:
    """Edges with vertices left out where the straight way is free, turns stay small and no other edge is crossed."""
    by = {e.edge: e for e in edges}
    children: dict[int, list[Edge]] = defaultdict(list)
    segments = Segments(4 * grid.cell)
    for e in edges:
        children[e.parent].append(e)
        segments.put(e.edge, e.line)
    for e in edges:
        k = 1
        while k < len(e.line) - 1:
            line = e.line[:k] + e.line[k + 1 :]
            a, b = line[k - 1], line[k]
            above = by[e.parent].line[-2:-1] if e.parent else []
            sound = grid.free(a, b) and turns_little([*above, *line]) and all(turns_little([line[-2], *f.line[:2]]) for f in children[e.edge])
            if sound and segments.free({e.edge}, a, b):
                segments.put(e.edge, e.line, gone=True)
                segments.put(e.edge, line)
                e.line = line
                k = max(1, k - 1)
            else:
                k += 1
    return edges


def relocated(grid: Grid, edges: list[Edge], price: Callable[[float], float]) -> list[Edge]:
    """Forks moved to the price-weighted median of their neighbours, where ways are free, turns small and the sum falls."""
    by = {e.edge: e for e in edges}
    children: dict[int, list[Edge]] = defaultdict(list)
    segments = Segments(4 * grid.cell)
    for e in edges:
        children[e.parent].append(e)
        segments.put(e.edge, e.line)
    for e in edges:
        out = children[e.edge]
        if e.node >= 0 or len(out) < 2 or len(e.line) < 2:
            continue
        old = e.line[-1]
        arms = [(e.line[-2], price(e.flow)), *((f.line[1], price(f.flow)) for f in out)]
        new = median([(*p, w) for p, w in arms])
        gain = sum(w * (math.dist(old, p) - math.dist(new, p)) for p, w in arms)
        before = by[e.parent].line[-2:-1] if e.parent else []
        lines = [[*before, *e.line[:-1], new], *([e.line[-2], new, *f.line[1:]] for f in out)]
        below = [[new, f.line[1], g.line[1]] for f in out if len(f.line) == 2 for g in children[f.edge]]
        own = {e.edge, *(f.edge for f in out)}
        if gain > 1e-6 and all(map(turns_little, [*lines, *below])) and not grid.held(new) and all(grid.free(new, p) for p, _ in arms):
            if all(segments.free(own, new, p) for p, _ in arms):
                for f in (e, *out):
                    segments.put(f.edge, f.line, gone=True)
                e.line = [*e.line[:-1], new]
                for f in out:
                    f.line = [new, *f.line[1:]]
                for f in (e, *out):
                    segments.put(f.edge, f.line)
    return edges


def spanning(places: list[tuple[float, float]]) -> float:
    """Length of the least spanning tree of the places (Prim)."""
    if len(places) < 2:
        return 0.0
    p = np.array(places)
    far = np.hypot(*(p - p[0]).T)
    far[0] = -1.0
    total = 0.0
    for _ in range(len(p) - 1):
        k = int(np.where(far >= 0, far, np.inf).argmin())
        total += float(far[k])
        far = np.where(far >= 0, np.minimum(far, np.hypot(*(p - p[k]).T)), -1.0)
        far[k] = -1.0
    return total


@dataclass
class GridForest:
    options: Options = field(default_factory=Options)
    catalogues: Catalogues = DEFAULT

    def plan(self, tile: Tile) -> tuple[list[list[Edge]], list[int]]:
        """Variants of a tile; gates come closer while points stay unconnected and that connects more of them."""
        found = self.searched(tile)
        for k in range(self.options.gate_retries):
            step = min((s.step for s in tile.shapes if s.step), default=0.0) / 2
            if not found[1] or not tile.points or step < self.options.least_step:
                break
            tile = replace(tile, shapes=[replace(s, step=s.step / 2) if s.step else s for s in tile.shapes])
            again = self.searched(tile)
            if len(again[1]) < len(found[1]):
                tile.notes.append(f"GATES_RETRIED: gates every {step:g} m connect {len(found[1]) - len(again[1])} points more")
                found = again
        return found

    def searched(self, tile: Tile) -> tuple[list[list[Edge]], list[int]]:
        if not tile.points or not tile.ties:
            return [], [p[0] for p in tile.points]
        o, grid = self.options, Grid(tile, self.options)
        roots: dict[int, tuple[int, float, float]] = {}
        nearest = cache(lambda c: grid.nearest_free(c, o.snap))
        for tie in tile.ties:
            c = nearest(grid.at(tie[1], tie[2]))
            if c is None:
                tile.notes.append(f"TIE_IN_BLOCKED: {tie[0]}")
            elif c not in roots or tie[0] >= 0 > roots[c][0]:  # a chamber goes before a place on a pipe
                roots[c] = tie
        sources = sorted(roots)
        if not sources:
            return [], [p[0] for p in tile.points]
        where = {p[0]: (p[1], p[2]) for p in tile.points}
        if tile.others:
            seen = grid.reachable(sources)
            for p in tile.points:
                ways = [where[p[0]], *tile.others.get(p[0], ())]
                ok = [w for w in ways if seen[grid.at(*w)]]
                if ok and ok[0] != ways[0]:
                    tile.notes.append(f"EXIT_CHANGED: {p[0]}")
                where[p[0]] = ok[0] if ok else ways[0]
        at: dict[int, list[tuple[int, float, float, float]]] = defaultdict(list)
        for p in sorted(tile.points):
            if p[3] and p[3] > 0:  # points without flow are not connected
                at[grid.at(*where[p[0]])].append((p[0], *where[p[0]], p[3]))
        for c, ps in at.items():  # an edge ends in a cell's centre; further points of the cell must see it
            seen = {q: grid.free(grid.centre(c), q) for q in {(p[1], p[2]) for p in ps[c not in roots :]}}
            at[c] = [p for i, p in enumerate(ps) if i == 0 and c not in roots or seen[p[1], p[2]]]
        for c in [*sources, *at]:
            grid.blocked.ravel()[c] = False
        targets = set(at) - set(sources)
        variants: list[list[Edge]] = []
        price: dict[int, float] | None = None
        best = math.inf
        lost = {p[0] for p in tile.points} - {p[0] for c in at for p in at[c]}
        for number in range(o.passes):
            forest, reached = grow(grid, sources, targets, price, degree=o.max_degree)
            forest = relink(grid, forest, reached, o.relinks, price, o.max_degree)
            edges, cells = self.extract(grid, forest, at, sources, reached)
            for e in edges:
                if not e.parent:
                    e.root = roots[grid.at(*e.line[0])][0]
            if o.pull:
                edges = relocated(grid, pulled(grid, edges), self.price)
            if o.repair:
                edges = repaired(grid, edges, self.price, o.max_degree, self.catalogues.chambers[0][1], tile.notes)
            score = sum(e.length * self.price(e.flow) for e in edges)
            variants.append(edges)
            lost |= {p[0] for c in targets - reached for p in at[c]}
            tile.notes.append(f"SEARCHED: pass {number + 1}, cells {grid.w * grid.h}, blocked {int(grid.blocked.sum())}, reached {len(reached)} of {len(targets)}, score {score:.0f}")
            if score >= best:
                break
            best = score
            base = self.catalogues.diameters[0][3]
            price = {c: base / self.price(flow) for c, flow in cells.items()}
        return variants, sorted(lost)

    def price(self, flow: float) -> float:
        return next((r[3] for r in self.catalogues.diameters if flow <= r[1]), self.catalogues.diameters[-1][3])

    def extract(self, grid: Grid, forest: dict[int, int], at: dict, sources: list[int], reached: set[int]) -> tuple[list[Edge], dict[int, float]]:
        """Edges between sources, forks and points, and the flow through each cell."""
        flow: dict[int, float] = defaultdict(float)
        for c in reached:
            drawn = sum(p[3] for p in at[c])
            way = c
            while way != -1:
                flow[way] += drawn
                way = forest.get(way, -1)
        children: dict[int, list[int]] = defaultdict(list)
        for c, back in forest.items():
            if back != -1 and c in flow:
                children[back].append(c)
        edges: list[Edge] = []
        for source in sorted(sources):
            stack = [(source, child, 0) for child in sorted(children.get(source, []), reverse=True)]
            while stack:
                start, c, above = stack.pop()
                chain = [start, c]
                while c not in reached and len(children.get(c, [])) == 1:
                    c = children[c][0]
                    chain.append(c)
                number = len(edges) + 1
                line = [grid.centre(k) for k in straight(grid, chain)]
                node = at[c][0][0] if c in reached else -c - 1
                edges.append(Edge(number, above, node, flow[chain[1]], line))
                # Further points in the same cell share its end.
                for p in at[c][1:] if c in reached else ():
                    edges.append(Edge(len(edges) + 1, number, p[0], p[3], [grid.centre(c), (p[1], p[2])]))
                stack += [(c, child, number) for child in sorted(children.get(c, []), reverse=True)]
        for source in sources:  # points in a tie-in's own cell
            for p in at.get(source, ()):
                edges.append(Edge(len(edges) + 1, 0, p[0], p[3], [grid.centre(source), (p[1], p[2])]))
        return edges, dict(flow)


REGISTRY = Registry("grid-forest")
REGISTRY.add("grid-forest", GridForest())


def counts(rows: DataFrame) -> DataFrame:
    """(tile, pass, cells, blocked, reached, targets, score) of every search, read from the notes of a plan."""
    pattern = r"SEARCHED: pass (\d+), cells (\d+), blocked (\d+), reached (\d+) of (\d+), score (\d+)"
    names = ("pass", "cells", "blocked", "reached", "targets", "score")
    found = rows.filter(F.startswith("note", F.lit("SEARCHED")))
    return found.select("tile", *[F.regexp_extract("note", pattern, i + 1).cast("long").alias(n) for i, n in enumerate(names)])


SHAPE = "struct<sides: array<struct<ax: double, ay: double, bx: double, by: double>>, area: boolean, keep: double, factor: int, step: double>"


def values(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def plan(points: DataFrame, ties: DataFrame, boxes: DataFrame | None = None, planner: Planner | None = None, shapes: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Edges of all tiles.  points (tile, id, x, y, flow), ties (tile, id, x, y), boxes (tile, x0, y0, x1, y1).

    shapes (tile, sides, area, keep, factor, step): obstacles with the distance to keep
    (``step``: gates through their band), or, with a factor, dear ground.  others (tile,
    id, x, y, nth): further places that a point may be reached at.

    Rows of the inputs are tagged and grouped by tile in the JVM; they come in any order, and are sorted as columns.  A tile
    is the unit of search and must fit a task, which the tiling decides.
    """
    planner = planner or REGISTRY.get()

    number = ("kind", "id", "a", "b", "c", "d")

    def tagged(df: DataFrame, kind: int, id_: Column, *numbers: Column) -> DataFrame:
        four = [n.cast("double") for n in numbers] + [F.lit(0.0)] * (4 - len(numbers))
        r = F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), *[n.alias(a) for n, a in zip(four, "abcd", strict=True)])
        return df.select("tile", r.alias("r"), F.lit(None).cast(SHAPE).alias("shape"))

    c, zero = F.col, F.lit(0)
    rows = tagged(points, 0, c("id"), c("x"), c("y"), c("flow")).union(tagged(ties, 1, c("id"), c("x"), c("y")))
    if boxes is not None:
        rows = rows.union(tagged(boxes, 2, zero, c("x0"), c("y0"), c("x1"), c("y1")))
    if others is not None:
        rows = rows.union(tagged(others, 3, c("id"), c("nth"), c("x"), c("y")))
    if shapes is not None:
        shape = F.struct("sides", "area", c("keep").cast("double").alias("keep"), c("factor").cast("int").alias("factor"), c("step").cast("double").alias("step"))
        rows = rows.union(shapes.select("tile", F.lit(None).cast(rows.schema["r"].dataType).alias("r"), shape.cast(SHAPE).alias("shape")))
    tiles = rows.groupBy("tile").agg(F.collect_list("r").alias("rows"), F.sort_array(F.collect_list("shape")).alias("shapes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tile", "variant", "edge", "parent", "node", "flow", "length", "line", "unconnected", "root", "note"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for i, (tile, found) in enumerate(zip(batch.column("tile").to_pylist(), batch.column("shapes").to_pylist(), strict=True)):
                # Numbers stay columns until they are sorted and told apart by kind.
                table = pa.Table.from_arrays(batch.column("rows").slice(i, 1).flatten().flatten(), list(number))
                table = table.take(pc.sort_indices(table, sort_keys=[(n, "ascending") for n in number], null_placement="at_start"))
                of = [list(zip(*(values(v) for v in table.filter(pc.equal(table["kind"], k)).columns[1:]), strict=True)) for k in range(4)]
                more: dict[int, list[tuple[float, float]]] = defaultdict(list)
                for r in of[3]:  # sorted by point and place
                    more[r[0]].append(r[2:4])
                whole = [Shape(tuple((x["ax"], x["ay"], x["bx"], x["by"]) for x in r["sides"]), r["area"], r["keep"], r["factor"] or 0, r["step"] or 0.0) for r in found]
                t = Tile([r[:4] for r in of[0]], [r[:3] for r in of[1]], [r[1:] for r in of[2]], whole, dict(more))
                variants, lost = planner.plan(t)
                out = [(tile, v + 1, e.edge, e.parent, e.node, e.flow, e.length, [{"x": x, "y": y} for x, y in e.line], None, e.root, None) for v, edges in enumerate(variants) for e in edges]
                out += [(tile, 0, None, None, None, None, None, None, i, None, None) for i in lost]
                out += [(tile, 0, None, None, None, None, None, None, None, None, note) for note in dict.fromkeys(t.notes)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return tiles.mapInArrow(run, EDGE)


__all__ = ["Edge", "Grid", "GridForest", "Options", "REGISTRY", "Registry", "Segments", "Tile", "counts", "crosses", "plan", "replace", "spanning", "turns_little"]
