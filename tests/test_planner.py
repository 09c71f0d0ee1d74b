"""Plain geometry of tiles, the planner among shapes, and its repairs."""

import math
import random

import pytest
from netloom.operators import planner, repair, shapes
from netloom.operators.shapes import Shape

L = Shape(((0, 0, 30, 0), (30, 0, 30, 10), (30, 10, 10, 10), (10, 10, 10, 30), (10, 30, 0, 30), (0, 30, 0, 0)))


def grid(ties=(), points=(), o=None, **more):
    return planner.Grid(planner.Tile([(i, *p, 1.0) for i, p in enumerate(points)], [(i, *t) for i, t in enumerate(ties)], **more), o or planner.Options(cell=2.0))


def test_shapes_hold_and_bar():
    assert shapes.holds(L, (5, 25)) and not shapes.holds(L, (20, 20)) and not shapes.holds(L, (0, 5))
    assert shapes.goes_inside((-5, 5), (35, 5), L) and not shapes.goes_inside((15, 35), (35, 15), L)
    assert not shapes.goes_inside((-5, 0), (35, 0), L)  # along a side
    assert shapes.nearness((20, 12), (20, 40), L) == pytest.approx(2.0) and shapes.nearness((5, 5), (50, 50), L) == 0.0
    kept = Shape(L.sides, keep=3.0)
    assert shapes.bars(kept, (20, 12), (40, 12)) and not shapes.bars(kept, (20, 14), (40, 14)) and not shapes.bars(kept, (5, 5), (-20, 5))


def test_covered_equals_single_points():
    import numpy as np

    rng = random.Random(1)
    x, y = (np.array([rng.uniform(-10, 40) for _ in range(400)]) for _ in range(2))
    for keep in (0.0, 2.5):
        shape = Shape(L.sides, keep=keep)
        want = [shapes.holds(shape, p) or min(shapes.off_side(p, s)[0] for s in shape.sides) < keep - 1e-9 for p in zip(x, y, strict=True)]
        assert shapes.covered(shape, x, y).tolist() == want


def test_cells_on_a_segment():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ((rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(2))
        got = list(shapes.cells_on(a, b, 3.0))
        seen = {(math.floor((a[0] + t * (b[0] - a[0])) / 3), math.floor((a[1] + t * (b[1] - a[1])) / 3)) for t in (k / 997 for k in range(998))}
        assert seen <= set(got) and len(got) == len(set(got))
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(got, got[1:], strict=False))


def test_gates_let_through_straight_only():
    road = Shape(((0, 0, 100, 0),), area=False, keep=4.0, step=10.0)
    assert not shapes.bars(road, (20, -10), (20, 10)) and shapes.bars(road, (25, -10), (25, 10)) and shapes.bars(road, (12, -10), (28, 10))


@pytest.mark.parametrize("hexagons", [False, True])
def test_cells_and_places(hexagons):
    g = grid([(0, 0)], [(50, 40)], planner.Options(cell=3.0, hexagons=hexagons))
    for c in range(0, g.w * g.h, 7):
        assert g.at(*g.centre(c)) == c
    for c in (g.w * 5 + 5, g.w * 6 + 5):
        beside = list(g.beside(c))
        assert len(beside) == (6 if hexagons else 8)
        for n, dx, dy, far in beside:
            p, q = g.centre(c), g.centre(n)
            assert (q[0] - p[0], q[1] - p[1]) == pytest.approx((dx, dy)) and math.hypot(dx, dy) == pytest.approx(far)


def test_nearest_free_and_reachable():
    wall = Shape.box(-100, 20, 200, 30)
    g = grid([(0, 0), (5, 25)], [(10, 10), (10, 60)], shapes=[wall])
    assert g.nearest_free(g.at(0, 0), 8) == g.at(0, 0)
    moved = g.centre(g.nearest_free(g.at(5, 25), 8))
    assert moved[1] < 20 or moved[1] > 30
    assert g.nearest_free(g.at(5, 25), 0) is None
    seen = g.reachable([g.at(0, 0)])
    assert seen[g.at(10, 10)] and not seen[g.at(10, 60)]


def paths_keep_off(tile, edges):
    for e in edges:
        for a, b in zip(e.line, e.line[1:], strict=False):
            assert not any(shapes.bars(s, a, b) for s in tile.shapes if not s.factor), (e, a, b)


@pytest.mark.parametrize("hexagons", [False, True])
def test_plans_among_shapes(hexagons):
    shapes_ = [Shape(tuple((a + 20, b + 20, c + 20, d + 20) for a, b, c, d in L.sides), keep=2.0), Shape(((70, -20, 70, 60),), area=False, keep=1.0)]
    points = [(1, 60.0, 60.0, 5.0), (2, 60.0, 5.0, 8.0), (3, 90.0, 30.0, 3.0), (4, 35.0, 35.0, 0.0), (5, 15.0, 55.0, 2.0)]
    tile = planner.Tile(points, [(7, 0.0, 0.0)], shapes=shapes_)
    variants, lost = planner.GridForest(planner.Options(cell=2.0, hexagons=hexagons)).plan(tile)
    assert lost == [4] and 1 <= len(variants) <= 2 and any(n.startswith("SEARCHED: pass 1") for n in tile.notes)
    for edges in variants:
        paths_keep_off(tile, edges)
        assert sorted(e.node for e in edges if e.node >= 0) == [1, 2, 3, 5] and sum(e.flow for e in edges if e.parent == 0) == 18.0
        assert all(e.root == 7 for e in edges if e.parent == 0) and not [f for f in repair.faults(edges) if f[0] != "TURN"]
        assert all(planner.turns_little(e.line) for e in edges)


def test_dear_ground_is_gone_around():
    meadow = Shape(Shape.box(10, -6, 30, 14).sides, factor=900)
    tile = planner.Tile([(1, 40.0, 4.0, 5.0)], [(7, 0.0, 4.0)], shapes=[meadow])
    (edges, *_), _ = planner.GridForest(planner.Options(cell=2.0, passes=1, pull=False, repair=False)).plan(tile)
    assert all(not (10 < x < 30 and -6 < y < 14) for e in edges for x, y in e.line)


def test_another_exit_where_the_first_is_shut_in():
    walls = [Shape.box(30, 0, 50, 3), Shape.box(30, 17, 50, 20), Shape.box(30, 0, 33, 20), Shape.box(47, 0, 50, 20)]
    tile = planner.Tile([(1, 40.0, 10.0, 5.0)], [(7, 0.0, 0.0)], shapes=walls, others={1: [(40.0, 12.0), (60.0, 10.0)]})
    (edges, *_), lost = planner.GridForest(planner.Options(cell=2.0)).plan(tile)
    assert not lost and "EXIT_CHANGED: 1" in tile.notes and math.dist(edges[-1].line[-1], (60, 10)) < 2


def test_gates_come_closer_until_all_are_connected():
    fence = Shape(((-40, 10, 140, 10),), area=False, keep=3.0, step=400.0, gate=4.0)
    tile = planner.Tile([(1, 50.0, 30.0, 5.0)], [(7, 50.0, -10.0)], shapes=[fence])
    o = planner.Options(cell=2.0, gate_retries=0)
    assert planner.GridForest(o).plan(tile)[1] == [1]
    tile = planner.Tile(tile.points, tile.ties, shapes=[planner.replace(fence, step=90.0)])
    assert planner.GridForest(planner.Options(cell=2.0, gate_retries=2)).plan(tile)[1] == []


def test_searches_mind_turns_and_corners():
    wall = Shape.box(10, -20, 14, 20)
    g = grid([(0, 0)], [(24, 0), (12, 40), (12, -40)], shapes=[wall])
    for search in (repair.turning_search, repair.corner_search):
        way = search(g, (0.0, 0.0), (24.0, 0.0))
        assert way[0] == (0, 0) and way[-1] == (24, 0) and planner.turns_little(way)
        assert all(g.free(a, b) for a, b in zip(way, way[1:], strict=False))
        back = search(g, (0.0, 0.0), (24.0, 0.0), before=(5.0, 0.0))
        assert back is None or repair.legal((5.0, 0.0), back[0], back[1])
    assert repair.turning_search(g, (0.0, 0.0), (24.0, 0.0), budget=5) is None
    assert repair.corner_search(g, (0.0, 0.0), (24.0, 0.0)) and len(repair.corner_search(g, (0.0, 0.0), (24.0, 0.0))) <= 4


def edge(n, parent, node, flow, *line):
    return planner.Edge(n, parent, node, flow, [(float(x), float(y)) for x, y in line])


def test_faults_and_crossings():
    g = grid([(0, 0)], [(60, 60)])
    edges = [edge(1, 0, 10, 1.0, (0, 20), (40, 20)), edge(2, 0, 11, 1.0, (20, 0), (20, 40)), edge(3, 0, 12, 1.0, (50, 0), (50, 10), (45, 2))]
    assert repair.faults(edges) == [("CROSSING", 1, 2), ("TURN", 3, 0)]
    free = [edge(1, 0, 10, 1.0, (0, 20), (40, 20)), edge(2, 0, 11, 1.0, (20, 0), (21, 0))]
    assert repair.faults(free) == [] and repair.uncrossed(repair.Tree(g, free)) == 0
    loop = [edge(1, 0, 10, 1.0, (0, 0), (10, 0), (10, 10), (5, 10), (5, -5))]
    assert ("SELF", 1, 1) in repair.faults(loop)
    short = [edge(1, 0, 10, 1.0, (0, 20), (40, 20)), edge(2, 0, 11, 1.0, (36, 10), (36, 26), (50, 26))]
    tree = repair.Tree(g, short)
    assert repair.uncrossed(tree) == 1 and not [f for f in repair.faults(tree.edges) if f[0] == "CROSSING"]
    assert [e.line[0] for e in tree.edges] == [(0, 20), (36, 10)] and [e.line[-1] for e in tree.edges] == [(40, 20), (50, 26)]


def test_forks_merge_where_that_is_cheaper():
    g = grid([(0, 0)], [(60, 60)])

    def tree():
        return repair.Tree(g, [edge(1, 0, -1, 3.0, (0, 0), (20, 0)), edge(2, 1, 10, 1.0, (20, 0), (20, 20)), edge(3, 1, -2, 2.0, (20, 0), (22, 0)), edge(4, 3, 11, 1.0, (22, 0), (40, 4)), edge(5, 3, 12, 1.0, (22, 0), (40, -4))])

    t = tree()
    assert repair.merged(t, lambda f: 1.0, 100.0, 4, 6.0) == 1
    out = repair.renumbered(t.edges)
    assert [(e.edge, e.parent) for e in out] == [(1, 0), (2, 1), (3, 1), (4, 1)] and {e.node for e in out} == {-1, 10, 11, 12}
    assert all(e.line[0] == (20, 0) for e in out[1:])
    assert repair.merged(tree(), lambda f: 1.0, 100.0, 3, 6.0) == 0 and repair.merged(tree(), lambda f: 1.0, 100.0, 4, 1.0) == 0 and repair.merged(tree(), lambda f: 100.0, 1.0, 4, 6.0) == 0


def test_tiny_parts_and_near_vertices():
    g = grid([(0, 0)], [(60, 60)])
    t = repair.Tree(g, [edge(1, 0, 10, 1.0, (0, 0), (10, 0), (10.2, 0.1), (20, 0.1))])
    assert repair.trimmed(t) == 2 and len(t.edges[0].line) == 2 or repair.trimmed(t) == 0
    assert repair.may_leave([(0, 0), (5, 1), (10, 0)], 1, g.free) and not repair.may_leave([(0, 0), (5, 1), (10, 0)], 0, g.free)
    t = repair.Tree(g, [edge(1, 0, -1, 2.0, (0, 0), (10, 0)), edge(2, 1, 10, 1.0, (10, 0), (10.5, 0.5), (20, 20)), edge(3, 1, 11, 1.0, (10, 0), (30, 0))])
    assert repair.snapped(t) == 1 and t.edges[0].line[-1] == t.edges[1].line[0] == t.edges[2].line[0] == (10.5, 0.5)


def test_connectors():
    s = planner.Segments(10.0)
    s.put(1, [(0.0, 5.0), (20.0, 5.0)])
    free = lambda a, b: True
    assert repair.connector_sound((0, 0), (10, 0), (20, 0), s, set(), free) and not repair.connector_sound((0, 0), (10, 0), (0, 1), s, set(), free)
    assert not repair.connector_sound((10, 0), (10, 10), None, s, set(), free) and repair.connector_sound((10, 0), (10, 10), None, s, {1}, free)


def test_boxes_by_columns_bar_as_shapes_do():
    """Many boxes tested by columns, borders and corners too, are the shapes' own tests."""
    import numpy as np

    rng = random.Random(5)
    boxes = [(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(12))]
    columns = np.array(boxes, float).T
    whole = [Shape.box(*b) for b in boxes]
    for _ in range(1500):
        a, b = ((rng.choice((rng.uniform(-2, 25), float(rng.randrange(-2, 25)))), rng.choice((rng.uniform(-2, 25), float(rng.randrange(-2, 25))))) for _ in range(2))
        assert shapes.barred_by_any(columns, a, b) == any(shapes.bars(s, a, b) for s in whole), (a, b)
        assert shapes.held_by_any(columns, a) == any(shapes.holds(s, a) for s in whole), a


@pytest.mark.parametrize("hexagons", [False, True])
def test_cells_in_boxes_are_blocked(hexagons):
    rng = random.Random(6)
    boxes = [(x, y, x + rng.randrange(1, 40), y + rng.randrange(1, 30)) for x, y in ((rng.randrange(-60, 160), rng.randrange(-60, 160)) for _ in range(25))]
    g = grid([(0, 0)], [(100, 90)], planner.Options(cell=5.0, hexagons=hexagons), boxes=boxes)
    want = [any(shapes.covered(Shape.box(*b), g.cx[[r], [c]], g.cy[[r], [c]])[0] for b in boxes) for r in range(g.h) for c in range(g.w)]
    assert g.blocked.ravel().tolist() == want


def test_crowded_places_are_asked_for_once(monkeypatch):
    """Many points and tie-in places in few spots, many equal boxes: the work is that of the spots, and all points are planned."""
    asked: list[tuple] = []
    free, nearest = planner.Grid.free, planner.Grid.nearest_free
    monkeypatch.setattr(planner.Grid, "free", lambda g, a, b: asked.append((a, b)) or free(g, a, b))
    monkeypatch.setattr(planner.Grid, "nearest_free", lambda g, c, most: asked.append((c, most)) or nearest(g, c, most))
    spots = [(55.0, 5.0), (57.0, 8.0), (60.0, 60.0), (12.0, 70.0)]
    points = [(i, *spots[i % 4], 1.0) for i in range(400)]
    tile = planner.Tile(points, [(i, 0.0, 0.0) for i in range(100)], [(20, 20, 40, 40)] * 300)
    variants, lost = planner.GridForest(planner.Options(passes=1, pull=False, repair=False)).plan(tile)
    assert not lost and sorted(e.node for e in variants[0] if e.node >= 0) == list(range(400))
    assert len(asked) == len(set(asked)) < 400


def test_a_search_in_vain_is_not_repeated(monkeypatch):
    """An edge shut in between walls crosses edges that lie on each other; there is no other way, and one search says so."""
    walls = [Shape.box(-10, -3, 70, -1), Shape.box(-10, 1, 70, 3), Shape.box(-10, -3, -8, 3), Shape.box(68, -3, 70, 3)]
    g = grid([(0, 0)], [(60, 0)], shapes=walls)
    edges = [edge(1, 0, 10, 1.0, (0, 0), (60, 0)), *(edge(k, 0, 10 + k, 1.0, (30, -0.5), (30, 0.5)) for k in range(2, 32))]
    asked = []
    monkeypatch.setattr(repair, "turning_search", lambda *a: asked.append(1))
    monkeypatch.setattr(repair, "corner_search", lambda *a: None)
    assert len(repair.faults(edges)) == 30 and repair.uncrossed(repair.Tree(g, edges)) == 0 and len(asked) == 2


@pytest.mark.parametrize("name", ["val02_ends_meet", "val04_planned_crossings", "val01_routes_through_restrictions"])
def test_checks_of_a_plan_search_each_tile_once(spark, sf, tmp_path, monkeypatch, name):
    from netloom.plans import queries

    class Counting:
        def plan(self, tile):
            import uuid

            (tmp_path / f"{min(p[0] for p in tile.points) if tile.points else 'none'}-{uuid.uuid4().hex}").touch()
            return planner.GridForest().plan(tile)

    monkeypatch.setitem(planner.REGISTRY.planners, "grid-forest", Counting())
    queries.QUERIES[name](spark, sf).collect()
    tiles = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    with_points = [t for t in tiles if t != "none"]
    assert with_points and len(with_points) == len(set(with_points))


def test_a_tile_comes_sorted_and_whole(spark):
    """Rows of all kinds in any order: a planner gets each, by kind and in order, nulls and copies too."""

    class Telling:
        def plan(self, tile):
            tile.notes.append(repr((tile.points, tile.ties, tile.boxes, tile.shapes, tile.others)))
            return [], [p[0] for p in tile.points]

    points = [(2**60 + 1, 3.0, 1.0, None), (2**60, 3.0, 1.0, 2.0), (1, 0.5, 7.0, 1.0), (1, 0.5, 7.0, None)]
    ties, boxes = [(5, 1.0, 1.0), (-4, 9.0, 2.0), (5, 1.0, 0.0)], [(4, 4, 6, 6), (1, 2, 3, 4), (4, 4, 6, 6)]
    others = [(1, 2, 8.0, 8.0), (1, 1, 9.0, 9.0)]
    shapes_ = [([(0.0, 0.0, 5.0, 0.0)], False, 2.0, None, 1.5), ([(0.0, 0.0, 4.0, 0.0)], False, 1.0, 150, None)]
    side = "array<struct<ax: double, ay: double, bx: double, by: double>>"
    made = [
        spark.createDataFrame([(t, *r) for t in (1, 2) for r in rows], f"tile long, {kind}")
        for rows, kind in ((points, "id long, x double, y double, flow double"), (ties, "id long, x double, y double"), (boxes, "x0 long, y0 long, x1 long, y1 long"), (shapes_, f"sides {side}, area boolean, keep double, factor int, step double"), (others, "id long, nth int, x double, y double"))
    ]
    rows = planner.plan(made[0], made[1], made[2], Telling(), made[3], made[4])
    told = {r["tile"]: r["note"] for r in rows.filter("note is not null").collect()}
    nulls_first = sorted(points, key=lambda p: (*p[:3], p[3] or 0.0))
    whole = [Shape(((0.0, 0.0, 4.0, 0.0),), False, 1.0, 150, 0.0), Shape(((0.0, 0.0, 5.0, 0.0),), False, 2.0, 0, 1.5)]
    want = repr((nulls_first, sorted(ties), sorted(tuple(map(float, b)) for b in boxes), whole, {1: [(9.0, 9.0), (8.0, 8.0)]}))
    assert told == {1: want, 2: want}
    assert sorted(r["unconnected"] for r in rows.filter("tile = 1 and unconnected is not null").collect()) == sorted(p[0] for p in points)


def test_corners_of_boxes_are_those_of_shapes():
    """Boxes, turned ones too, give the corners and envelopes that shapes of their sides give."""
    boxes = [(10, 10, 20, 25), (30, 5, 33, 15), (50, 40, 42, 33)]
    a = grid([(0, 0)], [(60, 60)], boxes=boxes)
    b = grid([(0, 0)], [(60, 60)], shapes=[Shape.box(*map(float, x)) for x in boxes])
    assert a.envelopes.tolist() == b.envelopes.tolist()
    assert [a.corners_out(i) for i in range(3)] == [b.corners_out(i) for i in range(3)]
