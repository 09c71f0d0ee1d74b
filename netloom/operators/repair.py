"""Repairs of a planned tree: searches that mind turns, ways around corners, crossings, close forks, tiny parts, last approaches.

Every repair is tried on its own and kept only if what it touches stays sound: ways
are free, turns small, nothing new is crossed.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np

from netloom.operators.grid import Edge, Grid, Segments, crosses, turns_little
from netloom.operators.shapes import Point

Way = list[Point]
Free = Callable[[Point, Point], bool]


def legal(a: Point, b: Point, c: Point) -> bool:
    """Whether going a, b, c turns by 90 degrees at most."""
    return (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) >= -1e-9


def may_leave(line: Way, k: int, free: Free, before: Point | None = None, after: Point | None = None) -> bool:
    """Whether vertex ``k`` of a line may be dropped: it is an inner one, the short cut is free, and no turn grows beyond 90 degrees."""
    if not 0 < k < len(line) - 1:
        return False
    rest = [*([before] if before else []), *line[:k], *line[k + 1 :], *([after] if after else [])]
    return free(line[k - 1], line[k + 1]) and turns_little(rest)


def connector_sound(a: Point, b: Point, after: Point | None, segments: Segments, own: set[int], free: Free) -> bool:
    """Whether a new straight piece may stand: free, turning on by 90 degrees at most, crossing no other edge."""
    return free(a, b) and (after is None or legal(a, b, after)) and segments.free(own, a, b)


def faults(edges: list[Edge]) -> list[tuple[str, int, int]]:
    """(what, edge, other): sharp turns within edges and from parents, edges that cross themselves or each other."""
    by = {e.edge: e for e in edges}
    out = []
    for e in edges:
        above = by[e.parent].line[-2:-1] if e.parent in by else []
        if not turns_little([*above, *e.line]):
            out.append(("TURN", e.edge, e.parent))
        parts = list(zip(e.line, e.line[1:], strict=False))
        if any(crosses(*p, *q) for i, p in enumerate(parts) for q in parts[i + 2 :]):
            out.append(("SELF", e.edge, e.edge))
    segments = Segments(25.0)
    for e in edges:
        segments.put(e.edge, e.line)
    for e in edges:
        for a, b in zip(e.line, e.line[1:], strict=False):
            out += [("CROSSING", e.edge, f) for f in segments.met({e.edge}, a, b) if f > e.edge]
    return sorted(set(out))


def turning_search(grid: Grid, start: Point, goal: Point, before: Point | None = None, after: Point | None = None, free: Free | None = None, budget: int = 20_000) -> Way | None:
    """The cheapest way over cells whose every turn is 90 degrees at most, the first from ``before`` and the last to ``after`` too.

    A state is a cell and the step that led there, so that a way is not lost to
    a shorter one which may not go on; at most ``budget`` states are expanded.
    """
    free = free or grid.free
    first, last = grid.at(*start), grid.at(*goal)
    place = lambda c: start if c == first else goal if c == last else grid.centre(c)
    heap = [(math.dist(start, goal), 0.0, first, -1)]
    known: dict[tuple[int, int], float] = {(first, -1): 0.0}
    back: dict[tuple[int, int], tuple[int, int]] = {}
    flat, done = grid.blocked.ravel(), set()
    while heap and len(done) < budget:
        _, cost, c, came = heapq.heappop(heap)
        if (c, came) in done:
            continue
        done.add((c, came))
        here, was = place(c), place(came) if came >= 0 else before
        if c == last:
            if after is not None and was is not None and not legal(was, here, after):
                continue
            out, at = [], (c, came)
            while at in back:
                out.append(place(at[0]))
                at = back[at]
            return [start, *out[::-1]]
        for n, *_ in grid.beside(c):
            there = place(n)
            if flat[n] and n != last or was is not None and not legal(was, here, there) or not free(here, there):
                continue
            new = cost + math.dist(here, there) * float(grid.factor.flat[c])
            if new < known.get((n, c), math.inf) - 1e-12:
                known[n, c] = new
                back[n, c] = c, came
                heapq.heappush(heap, (new + math.dist(there, goal), new, n, c))
    return None


def corner_search(grid: Grid, start: Point, goal: Point, before: Point | None = None, after: Point | None = None, free: Free | None = None, budget: int = 200) -> Way | None:
    """The shortest way over corners of the shapes that are near the straight line, pushed out of their bands, with small turns."""
    free = free or grid.free
    far = math.dist(start, goal)
    reach = max(2 * grid.cell, 0.5 * far)
    x0, y0, x1, y1 = grid.envelopes
    beside = (x1 < min(start[0], goal[0]) - reach) | (x0 > max(start[0], goal[0]) + reach) | (y1 < min(start[1], goal[1]) - reach) | (y0 > max(start[1], goal[1]) + reach)
    corners = sorted({c for i in np.flatnonzero(~beside).tolist() for c in grid.corners_out(i)}, key=lambda c: math.dist(start, c) + math.dist(c, goal))[:budget]
    places = [start, *corners, goal]
    heap, known, back, done = [(far, 0.0, 0, -1)], {(0, -1): 0.0}, {}, set()
    while heap and len(done) < budget:
        _, cost, k, came = heapq.heappop(heap)
        if (k, came) in done:
            continue
        done.add((k, came))
        here, was = places[k], places[came] if came >= 0 else before
        if k == len(places) - 1:
            if after is not None and was is not None and not legal(was, here, after):
                continue
            out, at = [here], (k, came)
            while at in back:
                at = back[at]
                out.append(places[at[0]])
            return out[::-1]
        for n in range(1, len(places)):
            there = places[n]
            new = cost + math.dist(here, there)
            if n == k or new >= known.get((n, k), math.inf) - 1e-12 or was is not None and not legal(was, here, there) or not free(here, there):
                continue
            known[n, k] = new
            back[n, k] = k, came
            heapq.heappush(heap, (new + math.dist(there, goal), new, n, k))
    return None


class Tree:
    """Edges with what a repair asks of them."""

    def __init__(self, grid: Grid, edges: list[Edge]) -> None:
        self.grid, self.edges = grid, edges
        self.by = {e.edge: e for e in edges}
        self.children: dict[int, list[Edge]] = defaultdict(list)
        self.segments = Segments(4 * grid.cell)
        for e in edges:
            self.children[e.parent].append(e)
            self.segments.put(e.edge, e.line)

    def before(self, e: Edge) -> Point | None:
        above = self.by.get(e.parent)
        return above.line[-2] if above and len(above.line) > 1 else None

    def sound(self, e: Edge, line: Way) -> bool:
        """Whether an edge may run along another line between the same ends."""
        before = self.before(e)
        whole = [*([before] if before else []), *line]
        own = {e.edge}
        parts = list(zip(line, line[1:], strict=False))
        return turns_little(whole) and all(legal(line[-2], line[-1], f.line[1]) for f in self.children[e.edge] if len(f.line) > 1) and all(self.grid.free(a, b) and self.segments.free(own, a, b) for a, b in parts)

    def lay(self, e: Edge, line: Way) -> None:
        self.segments.put(e.edge, e.line, gone=True)
        self.segments.put(e.edge, line)
        e.line = line


def trimmed(tree: Tree, least: float = 0.5) -> int:
    """Inner vertices nearer than ``least`` to a neighbour go, where the line stays sound."""
    gone = 0
    for e in tree.edges:
        k = 1
        while k < len(e.line) - 1:
            if min(math.dist(e.line[k], e.line[k - 1]), math.dist(e.line[k], e.line[k + 1])) < least and tree.sound(e, line := e.line[:k] + e.line[k + 1 :]):
                tree.lay(e, line)
                gone += 1
            else:
                k += 1
    return gone


def approached(tree: Tree, back: int = 8) -> int:
    """The last ways to points: from up to ``back`` vertices before, straight or around corners, if that is shorter."""
    better = 0
    for e in tree.edges:
        if e.node < 0 or tree.children[e.edge] or len(e.line) < 3:
            continue
        for k in range(max(0, len(e.line) - 1 - back), len(e.line) - 2):
            before = e.line[k - 1] if k else tree.before(e)
            own = {e.edge}
            old = sum(math.dist(a, b) for a, b in zip(e.line[k:], e.line[k + 1 :], strict=False))
            if old < math.dist(e.line[k], e.line[-1]) + 0.1:  # as good as straight
                continue
            end = corner_search(tree.grid, e.line[k], e.line[-1], before, None, lambda a, b, own=own: tree.grid.free(a, b) and tree.segments.free(own, a, b), 60)
            if end and sum(math.dist(a, b) for a, b in zip(end, end[1:], strict=False)) < old - 1e-6 and tree.sound(e, line := e.line[:k] + end):
                tree.lay(e, line)
                better += 1
                break
    return better


def uncrossed(tree: Tree, hole: float = 3.0) -> int:
    """Edges that cross are laid anew, the shorter one first, around all others; near its ends an edge may pass others' nodes."""
    mended = 0
    vain: set[tuple] = set()
    for what, i, j in faults(tree.edges):
        if what != "CROSSING":
            continue
        for e in sorted((tree.by[i], tree.by[j]), key=lambda e: e.length):
            own, ends = {e.edge}, (e.line[0], e.line[-1])

            def free(a: Point, b: Point, own=own, ends=ends) -> bool:
                if not tree.grid.free(a, b):
                    return False
                near = min(math.dist(p, q) for p in (a, b) for q in ends) < hole
                return tree.segments.free(own, a, b) or near and all({a, b} & set(tree.by[f].line[:: len(tree.by[f].line) - 1]) for f in tree.segments.met(own, a, b))

            if not tree.segments.crossed(e.edge, e.line):
                break
            nexts = [f.line[1] for f in tree.children[e.edge] if len(f.line) > 1]
            after = nexts[0] if nexts else None
            # An edge of many crossings, or edges that lie on each other, ask for the same: one search in vain is enough until an edge is laid anew.
            alike = mended, tuple(e.line), tree.before(e), tuple(nexts)
            if alike in vain:
                continue
            for search in (corner_search, turning_search):
                line = search(tree.grid, *ends, tree.before(e), after, free)
                if line and len(line) > 1 and tree.sound(e, line):
                    tree.lay(e, line)
                    mended += 1
                    break
            else:
                vain.add(alike)
                continue
            break
    return mended


def merged(tree: Tree, price: Callable[[float], float], chamber: float, most: int, near: float) -> int:
    """Forks that stand within ``near`` of the fork before them become one with it, where at most ``most`` edges then meet
    and pipes and chambers together get cheaper."""
    done = 0
    for e in sorted(tree.edges, key=lambda e: e.length):
        above, out = tree.by.get(e.parent), tree.children[e.edge]
        if above is None or e.node >= 0 or len(out) < 2 or e.length > near or e.edge not in tree.by:
            continue
        siblings = [f for f in tree.children[e.parent] if f is not e]
        if not siblings or not 3 <= 1 + len(siblings) + len(out) <= most:
            continue
        start = e.line[0]
        lines = [[start, *f.line[1:]] for f in out]
        own = {e.edge, above.edge, *(f.edge for f in (*out, *siblings))}
        cost = e.length * price(e.flow) + sum(f.length * price(f.flow) for f in out)
        new = sum(sum(math.dist(a, b) for a, b in zip(x, x[1:], strict=False)) * price(f.flow) for f, x in zip(out, lines, strict=True))
        if new >= cost + chamber - 1e-6 or not all(len(x) > 1 and tree.grid.free(x[0], x[1]) and tree.segments.free(own, x[0], x[1]) and turns_little([above.line[-2], *x]) for x in lines):
            continue
        tree.segments.put(e.edge, e.line, gone=True)
        for f, x in zip(out, lines, strict=True):
            tree.lay(f, x)
            f.parent = e.parent
        tree.children[e.parent] = [*siblings, *out]
        tree.children.pop(e.edge)
        tree.edges = [f for f in tree.edges if f is not e]
        del tree.by[e.edge]
        done += 1
    return done


def snapped(tree: Tree, within: float = 1.0) -> int:
    """Forks nearer than ``within`` to a vertex next to them move onto it, where all their ways stay sound."""
    done = 0
    for e in tree.edges:
        out = tree.children[e.edge]
        if e.node >= 0 or len(out) < 2 or len(e.line) < 2:
            continue
        for f in out:
            to = f.line[1]
            if len(f.line) < 3 or math.dist(e.line[-1], to) > within:
                continue
            lines = {e.edge: [*e.line[:-1], to], **{g.edge: [to, *(g.line[2:] if g is f else g.line[1:])] for g in out}}
            own = {e.edge, *(g.edge for g in out)}
            before = tree.before(e)
            sound = turns_little([*([before] if before else []), *lines[e.edge]]) and all(turns_little([e.line[-2], *lines[g.edge]]) for g in out)
            pieces = [(a, b) for x in lines.values() for a, b in zip(x, x[1:], strict=False) if to in (a, b)]
            if sound and all(tree.grid.free(a, b) and tree.segments.free(own, a, b) for a, b in pieces):
                for g in (e, *out):
                    tree.lay(g, lines[g.edge])
                done += 1
                break
    return done


def renumbered(edges: list[Edge]) -> list[Edge]:
    """Edges numbered from 1 again, parents first."""
    children: dict[int, list[Edge]] = defaultdict(list)
    for e in edges:
        children[e.parent].append(e)
    out, open_ = [], [(e, 0) for e in sorted(children[0], key=lambda e: -e.edge)]
    while open_:
        e, parent = open_.pop()
        below = sorted(children[e.edge], key=lambda f: -f.edge)
        e.edge, e.parent = len(out) + 1, parent
        out.append(e)
        open_ += [(f, e.edge) for f in below]
    return out


def repaired(grid: Grid, edges: list[Edge], price: Callable[[float], float], most: int, chamber: float = 0.0, notes: list[str] | None = None) -> list[Edge]:
    """All repairs, in this order: tiny parts, last approaches, snapping, merging, crossings."""
    tree = Tree(grid, edges)
    counts = {"trimmed": trimmed(tree), "approached": approached(tree), "snapped": snapped(tree), "merged": merged(tree, price, chamber, most, 3 * grid.cell), "uncrossed": uncrossed(tree)}
    if notes is not None:
        notes.append("REPAIRED: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
    return renumbered(tree.edges)
