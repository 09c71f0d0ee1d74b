"""What a planner works on: a tile and its options, the grid over it, edges, and their segments in blocks of space."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from netloom.operators.shapes import Point, Shape, barred_by_any, bars, cells_on, covered, held_by_any, holds


@dataclass(frozen=True)
class Options:
    cell: float = 10.0
    passes: int = 2
    #: Edges that may meet in a fork or tie-in place.
    max_degree: int = 4
    #: Rounds in which every branch may be laid anew.
    relinks: int = 2
    #: Straighten edges and move forks where nothing is in the way.
    pull: bool = True
    margin: float = 20.0
    max_cells: int = 4_000_000
    #: Cells are squares, or hexagons in rows.
    hexagons: bool = False
    #: Repair crossings, merge forks that stand close, drop tiny parts of lines.
    repair: bool = True
    #: How far a tie-in place in an obstacle is moved, in cells.
    snap: int = 128
    #: Halvings of the gates' distance while points stay unconnected, and the least distance.
    gate_retries: int = 2
    least_step: float = 0.5


@dataclass
class Tile:
    """One tile's input: points (id, x, y, flow), tie-in places (id, x, y), boxes to keep out of (x0, y0, x1, y1), and shapes.

    ``others``: further places that a point may be reached at, best first.  A planner
    may leave notes.
    """

    points: list[tuple[int, float, float, float]] = field(default_factory=list)
    ties: list[tuple[int, float, float]] = field(default_factory=list)
    boxes: list[tuple[float, float, float, float]] = field(default_factory=list)
    shapes: list[Shape] = field(default_factory=list)
    others: dict[int, list[tuple[float, float]]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


@dataclass
class Edge:
    edge: int
    parent: int
    node: int
    flow: float
    line: list[tuple[float, float]]
    #: The tie-in place that a first edge begins at.
    root: int | None = None

    @property
    def length(self) -> float:
        return sum(math.dist(a, b) for a, b in zip(self.line, self.line[1:], strict=False))


class Grid:
    def __init__(self, tile: Tile, o: Options) -> None:
        more = [p for ps in tile.others.values() for p in ps]
        xs = [p[1] for p in tile.points] + [t[1] for t in tile.ties] + [p[0] for p in more]
        ys = [p[2] for p in tile.points] + [t[2] for t in tile.ties] + [p[1] for p in more]
        margin = max(o.margin, 2 * o.cell)
        self.x0, self.y0 = min(xs) - margin, min(ys) - margin
        wide, high = max(xs) + margin - self.x0, max(ys) + margin - self.y0
        self.cell, self.hexagons = o.cell, o.hexagons
        self.row = self.cell * (math.sqrt(3) / 2 if o.hexagons else 1.0)
        if (wide / self.cell + 2) * (high / self.row + 2) > o.max_cells:
            raise ValueError(f"a tile of {wide:.0f} by {high:.0f} has more than {o.max_cells} cells of {o.cell}: plan smaller tiles or set another cell")
        self.w, self.h = int(wide / self.cell) + 1 + o.hexagons, int(high / self.row) + 1
        self.blocked, self.factor = np.zeros((self.h, self.w), bool), np.ones((self.h, self.w))
        self.cx = self.x0 + (np.arange(self.w) + 0.5) * self.cell + (np.arange(self.h) % 2 * self.cell / 2 if o.hexagons else np.zeros(self.h))[:, None]
        self.cy = np.broadcast_to((self.y0 + (np.arange(self.h) + 0.5) * self.row)[:, None], self.cx.shape)
        # Equal boxes are one.  Proper ones are tested by columns, all other shapes one by one.
        boxes = list(dict.fromkeys(tuple(map(float, b)) for b in tile.boxes))
        proper = [b for b in boxes if b[0] < b[2] and b[1] < b[3]]
        odd = [Shape.box(*b) for b in boxes if not (b[0] < b[2] and b[1] < b[3])]
        self.obstacles: list[tuple[float, ...] | Shape] = [*boxes, *(s for s in tile.shapes if not s.factor)]
        # Shapes by blocks of space, for exact tests of straight ways.
        self.size = 4 * self.cell
        self.near: dict[tuple[int, int], list[Shape]] = defaultdict(list)
        for shape in (*odd, *tile.shapes):
            x0, y0, x1, y1 = shape.envelope()
            rows = slice(max(0, int((y0 - self.y0) / self.row - 1)), max(0, int((y1 - self.y0) / self.row + 2)))
            cols = slice(max(0, int((x0 - self.x0) / self.cell - 2)), max(0, int((x1 - self.x0) / self.cell + 2)))
            hit = covered(shape, self.cx[rows, cols], self.cy[rows, cols])
            if shape.factor:
                self.factor[rows, cols] = np.where(hit, np.maximum(self.factor[rows, cols], shape.factor / 100), self.factor[rows, cols])
                continue
            self.blocked[rows, cols] |= hit
            for block in self.blocks(x0, y0, x1, y1):
                self.near[block].append(shape)
        within: dict[tuple[int, int], list[tuple[float, float, float, float]]] = defaultdict(list)
        for box in proper:
            for block in self.blocks(*box):
                within[block].append(box)
        self.boxes = {block: np.array(found).T for block, found in within.items()}
        if proper:
            self.cover(np.array(proper).T)
        self.dear = bool((self.factor > 1).any())
        self.steps: dict[tuple[int, int], bool] = {}
        self.outer: dict[int, list[Point]] = {}

    def blocks(self, x0: float, y0: float, x1: float, y1: float) -> Iterator[tuple[int, int]]:
        for x in range(int(x0 // self.size), int(x1 // self.size) + 1):
            for y in range(int(y0 // self.size), int(y1 // self.size) + 1):
                yield x, y

    def cover(self, boxes: np.ndarray) -> None:
        """Block the cells whose centres are inside a box: its corners in each kind of row are counted, then summed up."""
        top, bottom = (np.searchsorted(self.cy[:, 0], y) for y in (boxes[1], boxes[3]))
        for odd in (0, 1)[: 1 + self.hexagons]:
            left, right = (np.searchsorted(self.cx[min(odd, self.h - 1)], x) for x in (boxes[0], boxes[2]))
            corners = np.zeros((self.h + 1, self.w + 1), np.int64)
            for rows, cols, sign in ((top, left, 1), (top, right, -1), (bottom, left, -1), (bottom, right, 1)):
                np.add.at(corners, (rows, cols), sign)
            inside = corners.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
            every = slice(odd, None, 2) if self.hexagons else slice(None)
            self.blocked[every] |= inside[every]

    def around(self, a: tuple[float, float], b: tuple[float, float]) -> list[Shape]:
        """Shapes, but for proper boxes, that may be in the way of a segment: those of the blocks that it goes through."""
        seen = {id(s): s for block in cells_on(a, b, self.size) for s in self.near.get(block, ())}
        return list(seen.values())

    def free(self, a: tuple[float, float], b: tuple[float, float]) -> bool:
        """Whether the straight way keeps off all shapes, but for those that hold one of its ends."""
        if any(block in self.boxes and barred_by_any(self.boxes[block], a, b) for block in cells_on(a, b, self.size)):
            return False
        return not any(bars(shape, a, b) for shape in self.around(a, b))

    def held(self, p: tuple[float, float]) -> bool:
        block = int(p[0] // self.size), int(p[1] // self.size)
        return block in self.boxes and held_by_any(self.boxes[block], p) or any(holds(shape, p) for shape in self.near.get(block, ()))

    @cached_property
    def envelopes(self) -> np.ndarray:
        """x0, y0, x1, y1 of the boxes and shapes that are obstacles, by row."""
        return np.array([s.envelope() if isinstance(s, Shape) else (min(s[0], s[2]), min(s[1], s[3]), max(s[0], s[2]), max(s[1], s[3])) for s in self.obstacles]).reshape(-1, 4).T

    def corners_out(self, i: int) -> list[Point]:
        """Corners of an obstacle, pushed out of its band; those that no shape holds."""
        if i not in self.outer:
            shape = s if isinstance(s := self.obstacles[i], Shape) else Shape.box(*s)
            x0, y0, x1, y1 = shape.envelope()
            mx, my, push = (x0 + x1) / 2, (y0 + y1) / 2, 1.5 * shape.keep + 0.2
            offs = [(sx, sy, math.hypot(sx - mx, sy - my) or 1.0) for sx, sy, *_ in shape.sides]
            self.outer[i] = [c for c in ((sx + (sx - mx) / off * push, sy + (sy - my) / off * push) for sx, sy, off in offs) if not self.held(c)]
        return self.outer[i]

    def step(self, c: int, n: int) -> bool:
        key = (c, n) if c < n else (n, c)
        if key not in self.steps:
            self.steps[key] = self.free(self.centre(c), self.centre(n))
        return self.steps[key]

    def at(self, x: float, y: float) -> int:
        if not self.hexagons:
            return min(self.h - 1, max(0, int((y - self.y0) / self.cell))) * self.w + min(self.w - 1, max(0, int((x - self.x0) / self.cell)))
        rows = {min(self.h - 1, max(0, round((y - self.y0) / self.row - 0.5) + k)) for k in (-1, 0, 1)}
        best = []
        for row in rows:
            col = round((x - self.x0) / self.cell - 0.5 - row % 2 / 2)
            c = row * self.w + min(self.w - 1, max(0, col))
            best.append((math.dist(self.centre(c), (x, y)), c))
        return min(best)[1]

    def centre(self, c: int) -> tuple[float, float]:
        row, col = divmod(c, self.w)
        return self.x0 + (col + 0.5 + (row % 2 / 2 if self.hexagons else 0)) * self.cell, self.y0 + (row + 0.5) * self.row

    def beside(self, c: int) -> Iterator[tuple[int, float, float, float]]:
        """Neighbours of a cell, blocked ones too, with the step's vector and length; corners of blocked squares are not cut."""
        row, col = divmod(c, self.w)
        if self.hexagons:
            odd = row % 2
            for dx, dy in ((-1, 0), (1, 0), (odd - 1, -1), (odd, -1), (odd - 1, 1), (odd, 1)):
                x, y = col + dx, row + dy
                if 0 <= x < self.w and 0 <= y < self.h:
                    yield y * self.w + x, (dx + (0 if dy == 0 else 0.5 - odd)) * self.cell, dy * self.row, self.cell
            return
        for dx, dy, far in STEPS:
            x, y = col + dx, row + dy
            if 0 <= x < self.w and 0 <= y < self.h and not (dx and dy and (self.blocked[row, x] or self.blocked[y, col])):
                yield y * self.w + x, dx * self.cell, dy * self.cell, far * self.cell

    def nearest_free(self, c: int, most: int) -> int | None:
        """The free cell nearest to a cell, within ``most`` rings of neighbours; itself where it is free."""
        flat, seen, ring = self.blocked.ravel(), {c}, [c]
        for _ in range(most + 1):
            open_ = [n for n in ring if not flat[n]]
            if open_:
                x = self.centre(c)
                return min(open_, key=lambda n: (round(math.dist(self.centre(n), x), 9), n))
            more = []
            for n in ring:
                row, col = divmod(n, self.w)
                for y in range(max(0, row - 1), min(self.h, row + 2)):
                    for x in range(max(0, col - 1), min(self.w, col + 2)):
                        k = y * self.w + x
                        if k not in seen:
                            seen.add(k)
                            more.append(k)
            ring = more
        return None

    def reachable(self, sources: list[int]) -> np.ndarray:
        """Which free cells (and cells beside them) can be reached from the sources at all."""
        flat, seen = self.blocked.ravel(), np.zeros(self.h * self.w, bool)
        open_ = list(sources)
        seen[open_] = True
        while open_:
            c = open_.pop()
            for n, *_ in self.beside(c):
                if not seen[n] and self.step(c, n):
                    seen[n] = True
                    if not flat[n]:
                        open_.append(n)
        return seen


STEPS = [(dx, dy, math.hypot(dx, dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def crosses(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], d: tuple[float, float]) -> bool:
    """Whether two segments meet anywhere but at a shared end."""
    if {a, b} & {c, d}:
        return False

    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 1e-9) - (v < -1e-9)

    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def turns_little(line: list[tuple[float, float]]) -> bool:
    return all((b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) >= -1e-9 for a, b, c in zip(line, line[1:], line[2:], strict=False))


class Segments:
    """All edges' segments in blocks of space, to ask which may meet a new one."""

    def __init__(self, size: float) -> None:
        self.size = size
        #: In each block, the edges of each segment; many edges may lie on one.
        self.blocks: dict[tuple[int, int], dict[tuple[Point, Point], set[int]]] = defaultdict(dict)

    def around(self, a: tuple[float, float], b: tuple[float, float]) -> Iterator[tuple[int, int]]:
        for x in range(int(min(a[0], b[0]) // self.size), int(max(a[0], b[0]) // self.size) + 1):
            for y in range(int(min(a[1], b[1]) // self.size), int(max(a[1], b[1]) // self.size) + 1):
                yield x, y

    def put(self, edge: int, line: list[tuple[float, float]], gone: bool = False) -> None:
        for a, b in zip(line, line[1:], strict=False):
            for block in self.around(a, b):
                of = self.blocks[block].setdefault((a, b), set())
                (of.discard if gone else of.add)(edge)
                if not of:
                    del self.blocks[block][a, b]

    def met(self, own: set[int], a: tuple[float, float], b: tuple[float, float]) -> set[int]:
        """Edges that a new segment would meet, but for its own."""
        return {e for block in self.around(a, b) for s, of in self.blocks.get(block, {}).items() if not of <= own and crosses(a, b, *s) for e in of - own}

    def free(self, own: set[int], a: tuple[float, float], b: tuple[float, float]) -> bool:
        return not any(not of <= own and crosses(a, b, *s) for block in self.around(a, b) for s, of in self.blocks.get(block, {}).items())

    def crossed(self, edge: int, line: list[tuple[float, float]]) -> bool:
        return not all(self.free({edge}, a, b) for a, b in zip(line, line[1:], strict=False))


def straight(grid: Grid, chain: list[int]) -> list[int]:
    """The chain without cells on the way straight on."""
    out = chain[:1]
    for before, c, after in zip(chain, chain[1:], chain[2:], strict=False):
        p, q, r = grid.centre(before), grid.centre(c), grid.centre(after)
        if abs((q[0] - p[0]) * (r[1] - q[1]) - (q[1] - p[1]) * (r[0] - q[0])) > 1e-6 * grid.cell**2 or (q[0] - p[0]) * (r[0] - q[0]) + (q[1] - p[1]) * (r[1] - q[1]) < 0:
            out.append(c)
    return out + chain[-1:] if len(chain) > 1 else out
