"""Plain geometry within a planner's tile: what a shape holds, how near a segment comes to it, which cells a segment goes through."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Point = tuple[float, float]


@dataclass(frozen=True)
class Shape:
    """Sides of an area or a line, and the distance to keep from it; ``step``: gates through its band every so many metres."""

    sides: tuple[tuple[float, float, float, float], ...]
    area: bool = True
    keep: float = 0.0
    #: Price factor in percent where the shape is no obstacle.
    factor: int = 0
    step: float = 0.0
    gate: float = 1.0

    @staticmethod
    def box(x0: float, y0: float, x1: float, y1: float) -> Shape:
        return Shape(((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)))

    def envelope(self) -> tuple[float, float, float, float]:
        xs, ys = [v for s in self.sides for v in (s[0], s[2])], [v for s in self.sides for v in (s[1], s[3])]
        return min(xs) - self.keep, min(ys) - self.keep, max(xs) + self.keep, max(ys) + self.keep


def off_side(p: Point, s: tuple[float, float, float, float]) -> tuple[float, float]:
    """(distance, how far along) of the point of a side nearest to ``p``."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    square = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / square)) if square else 0.0
    return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy), t * math.sqrt(square)


def holds(shape: Shape, p: Point) -> bool:
    """Whether a point is inside an area; its border is outside."""
    if not shape.area:
        return False
    odd = False
    for a, b, c, d in shape.sides:
        if (b > p[1]) != (d > p[1]) and p[0] < (c - a) * (p[1] - b) / (d - b) + a:
            odd = not odd
    return odd and min(off_side(p, s)[0] for s in shape.sides) > 1e-9


def turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> int:
    v = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (v > 1e-9) - (v < -1e-9)


def meets(a: Point, b: Point, s: tuple[float, float, float, float]) -> bool:
    return turn(*a, *b, s[0], s[1]) * turn(*a, *b, s[2], s[3]) < 0 and turn(*s, *a) * turn(*s, *b) < 0


def nearness(a: Point, b: Point, shape: Shape) -> float:
    """How near a segment comes to a shape; 0 where it goes into it."""
    if holds(shape, a) or holds(shape, b) or any(meets(a, b, s) for s in shape.sides):
        return 0.0
    own = (*a, *b)
    return min(min(off_side(a, s)[0], off_side(b, s)[0], off_side(s[:2], own)[0], off_side(s[2:], own)[0]) for s in shape.sides)


def goes_inside(a: Point, b: Point, shape: Shape) -> bool:
    """Whether a segment has a part inside an area; touching a side or a corner is none."""
    if not shape.area:
        return any(meets(a, b, s) for s in shape.sides)
    cuts = [0.0, 1.0]
    dx, dy = b[0] - a[0], b[1] - a[1]
    for sx, sy, ex, ey in shape.sides:
        across = dx * (ey - sy) - dy * (ex - sx)
        if abs(across) > 1e-12:
            t = ((sx - a[0]) * (ey - sy) - (sy - a[1]) * (ex - sx)) / across
            u = ((sx - a[0]) * dy - (sy - a[1]) * dx) / across
            if 0 < t < 1 and -1e-9 <= u <= 1 + 1e-9:
                cuts.append(t)
    cuts.sort()
    return any(q - p > 1e-9 and holds(shape, (a[0] + (p + q) / 2 * dx, a[1] + (p + q) / 2 * dy)) for p, q in zip(cuts, cuts[1:], strict=False))


def in_gate(shape: Shape, at: float) -> bool:
    """Whether a place along the sides is in a gate: one stands every ``step`` metres."""
    return abs(at - round(at / shape.step) * shape.step) <= shape.gate / 2 + 1e-9


def through_gates(a: Point, b: Point, shape: Shape) -> bool:
    """Whether a segment crosses a gated shape only in its gates, and at 60 degrees or more."""
    before = 0.0
    for s in shape.sides:
        if meets(a, b, s):
            dx, dy, ex, ey = b[0] - a[0], b[1] - a[1], s[2] - s[0], s[3] - s[1]
            across = dx * ey - dy * ex
            u = ((s[0] - a[0]) * dy - (s[1] - a[1]) * dx) / across
            angle = math.degrees(math.atan2(abs(across), abs(dx * ex + dy * ey)))
            if angle < 60 or not in_gate(shape, before + u * math.hypot(ex, ey)):
                return False
        before += math.hypot(s[2] - s[0], s[3] - s[1])
    return True


def bars(shape: Shape, a: Point, b: Point) -> bool:
    """Whether a shape stands in the way of a segment.  A shape that holds one of its ends does not: that is a tail."""
    if holds(shape, a) or holds(shape, b):
        return False
    if shape.step:
        return not through_gates(a, b, shape)
    return goes_inside(a, b, shape) or shape.keep > 0 and nearness(a, b, shape) < shape.keep - 1e-3


def covered(shape: Shape, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of many points are inside a shape or within its distance; points in gates are not."""
    odd, near, along = np.zeros(x.shape, bool), np.full(x.shape, np.inf), np.zeros(x.shape)
    before = 0.0
    for a, b, c, d in shape.sides:
        if b != d:
            odd ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
        square = (c - a) ** 2 + (d - b) ** 2
        t = np.clip(((x - a) * (c - a) + (y - b) * (d - b)) / square, 0, 1)
        off = np.hypot(x - a - t * (c - a), y - b - t * (d - b))
        along = np.where(off < near, before + t * math.sqrt(square), along)
        near = np.minimum(near, off)
        before += math.sqrt(square)
    out = (odd if shape.area else np.zeros(x.shape, bool)) | (near < shape.keep - 1e-9)
    if shape.step:
        out &= np.abs(along - np.round(along / shape.step) * shape.step) > shape.gate / 2 + 1e-9
    return out


def depth(boxes: np.ndarray, x: np.ndarray | float, y: np.ndarray | float) -> np.ndarray:
    """How far inside each of many boxes (rows x0, y0, x1, y1) points are; below 0 outside."""
    return np.minimum(np.minimum(x - boxes[0], boxes[2] - x), np.minimum(y - boxes[1], boxes[3] - y))


def doubtful(*values: np.ndarray) -> np.ndarray:
    """Where a value is so near to the bound of 1e-9 that rounding may decide."""
    return np.logical_or.reduce([(v > 1e-10) & (v < 1e-8) for v in values])


def held_by_any(boxes: np.ndarray, p: Point) -> bool:
    """``holds`` of any of many boxes."""
    deep = depth(boxes, *p)
    doubt = doubtful(deep)
    return bool(((deep > 1e-9) & ~doubt).any()) or any(holds(Shape.box(*boxes[:, i].tolist()), p) for i in np.flatnonzero(doubt))


def barred_by_any(boxes: np.ndarray, a: Point, b: Point) -> bool:
    """``bars`` of any of many boxes: their bounds cut the segment, and what is left has its middle inside."""
    low, high = (min(a[0], b[0]), min(a[1], b[1])), (max(a[0], b[0]), max(a[1], b[1]))
    boxes = boxes[:, (boxes[0] < high[0]) & (boxes[2] > low[0]) & (boxes[1] < high[1]) & (boxes[3] > low[1])]
    if not boxes.shape[1]:
        return False
    start, end = np.zeros(boxes.shape[1]), np.ones(boxes.shape[1])
    for k in (0, 1):
        if d := b[k] - a[k]:
            s, e = (boxes[k] - a[k]) / d, (boxes[k + 2] - a[k]) / d
            start, end = np.maximum(start, np.minimum(s, e)), np.minimum(end, np.maximum(s, e))
    middle, left = (start + end) / 2, end - start
    inside = depth(boxes, a[0] + middle * (b[0] - a[0]), a[1] + middle * (b[1] - a[1]))
    ends = depth(boxes, *a), depth(boxes, *b)
    barring = (ends[0] <= 1e-9) & (ends[1] <= 1e-9) & (left > 1e-9) & (inside > 1e-9)
    doubt = doubtful(*ends, left, inside)
    if any(0 < abs(b[k] - a[k]) < 1e-6 for k in (0, 1)):
        doubt[:] = True
    return bool((barring & ~doubt).any()) or any(bars(Shape.box(*boxes[:, i].tolist()), a, b) for i in np.flatnonzero(doubt))


def cells_on(a: Point, b: Point, cell: float) -> Iterator[tuple[int, int]]:
    """(column, row) of every square cell that a segment goes through, in order (Amanatides and Woo)."""
    x, y = math.floor(a[0] / cell), math.floor(a[1] / cell)
    end = math.floor(b[0] / cell), math.floor(b[1] / cell)
    dx, dy = b[0] - a[0], b[1] - a[1]
    sx, sy = (dx > 0) - (dx < 0), (dy > 0) - (dy < 0)
    next_x = ((x + (sx > 0)) * cell - a[0]) / dx if dx else math.inf
    next_y = ((y + (sy > 0)) * cell - a[1]) / dy if dy else math.inf
    step_x, step_y = abs(cell / dx) if dx else math.inf, abs(cell / dy) if dy else math.inf
    yield x, y
    for _ in range(abs(end[0] - x) + abs(end[1] - y)):
        if next_x < next_y:
            x, next_x = x + sx, next_x + step_x
        else:
            y, next_y = y + sy, next_y + step_y
        yield x, y
