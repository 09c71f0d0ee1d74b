"""Operators of the network planner on small hand-made tables, and every query against its SQL."""

import dataclasses
import itertools
import json
import math
import random

import duckdb
import pytest
from netloom.functions import scalars as S
from netloom.functions.catalogues import DEFAULT
from netloom.operators import planner, regions, sequences, spatial, trees
from netloom.plans import queries, registry
from netloom.sources import geojson, sinks
from netloom.streaming import progress
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def values(rows):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x

    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours = registry.queries()[name](spark, sf)
    other = con.execute(registry.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(c[0] for c in other.description)
    place = [[c[0] for c in other.description].index(n) for n in names]
    assert values(map(tuple, ours.select(names).collect())) == values([r[i] for i in place] for r in other.fetchall())


def test_distinct_plans_tell_every_edge_and_metre(spark, sf):
    trees_ = {}
    for r in queries.T.edges(spark, sf).collect():
        trees_.setdefault(r["tree"], []).append((r["n"], r["len_m"]))
    groups = {}
    for tree, edges in trees_.items():
        groups.setdefault(tuple(sorted(edges)), []).append(tree)
    found = registry.queries()["st02_distinct_plans"](spark, sf).collect()
    assert sorted((r["tree"], r["copies"]) for r in found) == sorted((min(g), len(g)) for g in groups.values())


def test_crossings_of_all_diagonals_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"

    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    lines = []
    for r in queries.T.rects(spark, d).collect():
        ya, yb = (r["y0"], r["y1"]) if r["r_id"] % 4 == 0 else (r["y1"], r["y0"])
        lines.append((r["r_id"], (r["x0"], ya), (r["x1"], yb)))
    lines.sort()
    want = [(i, j) for (i, a, b), (j, p, q) in itertools.combinations(lines, 2) if side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0]
    found = sorted(map(tuple, registry.queries()["jn20_crossing_edges"](spark, d).collect()))
    assert found == sorted(want)


def test_unconnected_points_are_the_planners(spark, sf):
    flows = {r["cp_id"]: r["flow"] for r in queries.T.connection_points(spark, sf).collect()}
    rows = queries.planned(spark, sf).filter("note is null").select("variant", "unconnected").collect()
    want = sorted((r["unconnected"], flows[r["unconnected"]]) for r in rows if r["unconnected"] is not None)
    penalty = sum(DEFAULT.penalty[0] + math.floor(f * DEFAULT.penalty[1] + 0.5) for _, f in want)
    assert want
    assert sorted(map(tuple, registry.queries()["jn22_planned_unconnected"](spark, sf).collect())) == want
    assert list(map(tuple, registry.queries()["ag08_planned_penalty"](spark, sf).collect())) == [(len(want), penalty)]
    summary = registry.queries()["gr36_planned_summary"](spark, sf).collect()
    assert {r["variant"] for r in summary} == {r["variant"] for r in rows if r["unconnected"] is None}
    assert all((r["lost"], r["penalty"]) == (len(want), penalty) for r in summary)
    assert all(r["calculated_cost"] == r["construction_cost"] + penalty and r["construction_cost"] > 0 for r in summary)


def test_tiles_of_too_many_cells_are_refused():
    o = planner.Options(max_cells=10_000)
    near, far = (planner.Tile([(1, 0.0, 0.0, 5.0)], [(2, x, x)], []) for x in (10.0, 10_000.0))
    assert planner.Grid(near, o).cell == o.cell
    with pytest.raises(ValueError, match="more than 10000 cells"):
        planner.Grid(far, o)


def test_every_query_runs(spark, sf):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        registry.queries()[name](spark, sf).collect()


def chosen_cost(rows, dn, c=DEFAULT, new_root=True):
    """Cost of a choice of diameters, or None where it is not admissible; straight from the rules."""
    row = {r[0]: r for r in c.diameters}
    above, run, total, children = {r[0]: r[1] for r in rows}, {}, 0, {}
    for n in trees.from_root(rows):
        _, parent, m, _, f = next(r for r in rows if r[0] == n)
        run[n] = m + (run[parent] if parent in run and dn[parent] == dn[n] else 0)
        if row[dn[n]][1] < f or run[n] > row[dn[n]][2] or parent in dn and dn[parent] < dn[n]:
            return None
        total += m * row[dn[n]][3]
        children.setdefault(above[n], []).append(n)
    price = {d: next(p for most, p in c.chambers if d <= most) for d in row}
    total += sum(price[dn[n]] for n in dn if len(children.get(n, ())) > 1)
    return total + (price[max(dn[n] for n in children[0])] if new_root else 0)


SHAPES = [
    [(1, 0, 40, 50, 50), (2, 1, 50, 50, 30), (3, 1, 30, 50, 20), (4, 2, 60, 50, 15), (5, 2, 20, 50, 10)],
    [(9, 0, 55, 50, 18), (4, 9, 30, 50, 18), (7, 4, 70, 50, 12), (1, 7, 10, 50, 5)],
    [(5, 0, 100, 50, 100), (6, 0, 20, 50, 10), (2, 5, 70, 50, 60), (3, 5, 50, 50, 40), (1, 2, 61, 50, 20)],
]


@pytest.mark.parametrize("rows", SHAPES)
def test_optimum_equals_enumeration(rows):
    dns = [r[0] for r in DEFAULT.diameters]
    for new_root in (True, False):
        cost, chosen = trees.optimum(rows, new_root=new_root)
        picks = (dict(zip([r[0] for r in rows], pick, strict=True)) for pick in itertools.product(dns, repeat=len(rows)))
        best = min(x for x in (chosen_cost(rows, dn, new_root=new_root) for dn in picks) if x is not None)
        assert cost == best == chosen_cost(rows, chosen, new_root=new_root)


def test_optimum_has_a_budget_and_may_fail(spark):
    chain = [(i, i - 1, 20, 50, 5) for i in range(1, 3001)]
    assert trees.optimum(chain, dataclasses.replace(DEFAULT, diameters=((50, 20, 60_000, 9000),)), states=10**7)[0] == 3000 * 20 * 9000 + 120_000
    with pytest.raises(trees.TooManyStates):
        trees.optimum(chain, states=100)
    assert trees.optimum([(1, 0, 5000, 50, 5)]) is None
    with pytest.raises(ValueError, match="circle"):
        trees.optimum([(1, 2, 5, 50, 5), (2, 1, 5, 50, 5)])
    table = spark.createDataFrame([(1, 1, 0, 5000, 50, 5), (2, 1, 0, 40, 50, 5), (2, 2, 1, 30, 50, 5)], "tree long, n int, parent int, len_m long, dn int, total_flow long")
    how = {(r["tree"], r["n"]): (r["how"], r["dn"]) for r in trees.optimal_diameters(table).collect()}
    assert how[1, 1] == ("none", None) and how[2, 1] == ("optimum", 80) and how[2, 2] == ("optimum", 50)
    assert {r["how"] for r in trees.optimal_diameters(table, states=1).collect()} == {"none", "rule"}


def test_run_rule_reaches_a_fixed_point():
    dn = trees.enforced([(1, 0, 100, 50, 10), (2, 1, 50, 50, 5), (3, 1, 20, 50, 5)])
    longest = {r[0]: r[2] for r in DEFAULT.diameters}
    assert dn[1] >= dn[2] and dn[1] >= dn[3] and 100 <= longest[dn[1]]
    # Straight to the row that holds the whole run, not one row up at a time.
    c = dataclasses.replace(DEFAULT, diameters=((50, 20, 60, 9000), (80, 60, 70, 12000), (100, 120, 1000, 15000)))
    assert trees.enforced([(7, 0, 50, 50, 5), (3, 7, 50, 50, 5)], c) == {7: 100, 3: 100}
    assert trees.enforced([(1, 0, 5000, 50, 5)]) == {1: None}
    # A change of diameter begins a new run, parallel branches do not add up, the larger child raises its parent.
    assert trees.enforced([(1, 0, 55, 80, 5), (2, 1, 55, 50, 5), (3, 1, 55, 50, 5)]) == {1: 80, 2: 50, 3: 50}
    assert trees.enforced([(1, 0, 10, 50, 5), (2, 1, 10, 200, 5)]) == {1: 200, 2: 200}


def test_trees_of_any_shape(spark):
    """Chains, stars and random trees with any numbers, against plain recursion."""
    rng = random.Random(3)
    rows, plain = [], {}
    for tree, shape in enumerate(("chain", "star", "random", "random")):
        ids = rng.sample(range(1, 500), 40)
        for i, n in enumerate(ids):
            parent = 0 if i == 0 else ids[i - 1] if shape == "chain" else ids[0] if shape == "star" else rng.choice([0, *ids[:i]])
            rows.append((tree, n, parent if parent or i % 2 else None, rng.randrange(1, 50), rng.randrange(1, 9)))
            plain[tree, n] = (parent, rows[-1][3], rows[-1][4])
    table = spark.createDataFrame(rows, "tree long, n int, parent int, len_m long, flow long")
    designed = trees.with_design(table)

    def up(tree, n):
        out = []
        while n:
            out.append(n)
            n = plain[tree, n][0]
        return out

    flow, way = dict.fromkeys(plain, 0), {}
    for tree, n in plain:
        for m in up(tree, n):
            flow[tree, m] += plain[tree, n][2]
        way[tree, n] = sum(plain[tree, m][1] for m in up(tree, n))
    dn = {(r["tree"], r["n"]): r["dn"] for r in designed.collect()}
    far = {k: max(way[t, n] for t, n in plain if t == k[0] and k[1] in up(t, n)) for k in plain}

    def run(tree, n):
        out = []
        for m in up(tree, n):
            if dn[tree, m] != dn[tree, n]:
                break
            out.append(m)
        return out

    runs = {k: sum(plain[k[0], m][1] for m in run(*k)) for k in plain}
    need = {k: max(runs[j] for j in plain if j[0] == k[0] and k[1] in run(*j)) for k in plain}

    def got(df, name):
        return {(r["tree"], r["n"]): r[name] for r in df.collect()}

    assert got(trees.subtree_flow(table), "total_flow") == flow
    assert got(trees.levels(table), "level") == {k: len(up(*k)) - 1 for k in plain}
    assert got(trees.longest_downstream(table), "longest") == {k: far[k] - way[k] + plain[k][1] for k in plain}
    assert got(trees.run_lengths(designed), "run_m") == runs and got(trees.required_run(designed), "required_m") == need
    with pytest.raises(ValueError, match="circle"):
        trees.subtree_flow(spark.createDataFrame([(1, 1, 2, 1, 1), (1, 2, 1, 1, 1)], table.schema))
    assert trees.subtree_flow(table.limit(0)).count() == 0


def test_nearest_however_far(spark):
    rng = random.Random(8)
    points = [(i, rng.randrange(1000), rng.randrange(1000)) for i in range(60)] + [(99, 50_000, 50_000)]
    others = [(i, rng.randrange(300), rng.randrange(300)) for i in range(40)]
    got = {}
    for r in spatial.nearest(spark.createDataFrame(points, "cp_id int, x int, y int"), spark.createDataFrame(others, "node_id int, x int, y int"), 5).collect():
        got.setdefault(r["cp_id"], []).append((r["dist2"], r["node_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in others)[:5] for i, x, y in points}


def test_small_boxes_never_meet_in_large_bins(spark):
    """One large box on a side: it meets all others in its bin, while small ones only meet those of their own small bin."""
    spots = [(64 * x + 10, 64 * y + 10) for x in range(4) for y in range(4)]
    a = spark.createDataFrame([(x, y, x + 5, y + 5) for x, y in spots] + [(1, 1, 250, 250)], "ax0 int, ay0 int, ax1 int, ay1 int")
    b = spark.createDataFrame([(x, y, x + 5, y + 5) for x, y in spots], "bx0 int, by0 int, bx1 int, by1 int")
    sides = (a, spatial.corners("ax0", "ay0", "ax1", "ay1")), (b, spatial.corners("bx0", "by0", "bx1", "by1"))
    for one, other in (sides, sides[::-1]):
        assert spatial.sharing_bins(*one, *other).count() == spatial.candidates(*one, *other).count() == 32


def test_candidates_of_all_sizes_meet_once(spark):
    rng = random.Random(5)
    boxes = []
    for i in range(150):
        x, y, w = rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), 4 ** rng.uniform(0, 6)
        boxes.append((i, x, y, x + w, y + w * rng.random()))
    a = spark.createDataFrame(boxes, "i int, x0 double, y0 double, x1 double, y1 double")
    b = a.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}_b") for c in ("x0", "y0", "x1", "y1")])
    for reach in (0.0, 75.0):
        found = sorted((r["i"], r["j"]) for r in spatial.candidates(a, spatial.corners("x0", "y0", "x1", "y1"), b, spatial.corners("x0_b", "y0_b", "x1_b", "y1_b"), reach).collect())
        assert found == sorted((p[0], q[0]) for p in boxes for q in boxes if p[1] - reach <= q[3] and q[1] <= p[3] + reach and p[2] - reach <= q[4] and q[2] <= p[4] + reach)


def test_utm_round_trip(spark):
    points = spark.createDataFrame([(36.0 + i / 10, 54.0 + i / 7) for i in range(30)], "lon double, lat double")
    x, y = S.to_utm(F.col("lon"), F.col("lat"))
    there = points.withColumn("x", x).withColumn("y", y)
    lon, lat = S.to_wgs84(F.col("x"), F.col("y"))
    for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b"), "x").collect():
        assert abs(r["a"] - r["lon"]) < 1e-8 and abs(r["b"] - r["lat"]) < 1e-8 and 2e5 < r["x"] < 8e5


def test_simplified_drops_what_goes_straight_on(spark):
    line = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(0, 0), (0, 0), (1, 0), (2, 0), (2, 1), (2, 3), (1, 3)])], "k int, pos int, x int, y int")
    assert [(r["x"], r["y"]) for r in sequences.simplified(line, "k", "pos").orderBy("pos").collect()] == [(0, 0), (2, 0), (2, 3), (1, 3)]


def test_points_on_edges_count_as_inside(spark):
    points = spark.createDataFrame([(1, 64, 64, 1), (2, 63, 10, 1), (3, 200, 200, 1)], "cp_id long, x long, y long, flow long")
    rects = spark.createDataFrame([(7, "oks", 0, 0, 64, 64), (5, "oks", 60, 0, 128, 64)], "r_id long, rtype string, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r["cp_id"], r["r_id"], r["on_edge"]) for r in spatial.containing(points, rects).collect()) == [(1, 5, True), (1, 7, True), (2, 5, False), (2, 7, False)]
    assert {r["cp_id"]: r["r_id"] for r in spatial.owning(points, rects).collect()} == {1: 5, 2: 5, 3: None}


# The planner.


def test_forest_connects_around_a_wall():
    tile = planner.Tile([(1, 100, 0, 5.0), (2, 100, 50, 7.0), (3, 100, 50, 1.0), (4, 0, 90, 0.0), (5, 2, 2, 3.0)], [(9, 0, 0)], [(45, -40, 55, 30)])
    variants, lost = planner.GridForest(planner.Options(cell=5.0)).plan(tile)
    assert lost == [4] and variants  # no flow
    for edges in variants:
        assert sorted(e.node for e in edges if e.node >= 0) == [1, 2, 3, 5]
        assert sum(e.flow for e in edges if e.parent == 0) == 16
        for e in edges:
            for x, y in e.line:
                assert not (45 < x < 55 and -40 < y < 30)
            for a, b, c in zip(e.line, e.line[1:], e.line[2:], strict=False):
                assert (b[0] - a[0]) * (c[0] - b[0]) + (b[1] - a[1]) * (c[1] - b[1]) >= -1e-9


def test_walled_in_points_are_reported():
    wall = [(80, -20, 130, -10), (80, 40, 130, 50), (80, -20, 90, 50), (120, -20, 130, 50)]
    variants, lost = planner.GridForest(planner.Options(cell=5.0)).plan(planner.Tile([(1, 105, 15, 5.0), (2, 20, 20, 1.0)], [(9, 0, 0)], wall))
    assert lost == [1] and [e.node for e in variants[0]] == [2]


def test_registry_contracts():
    r = planner.Registry("a")
    r.add("a", planner.GridForest())
    r.add("b", planner.GridForest())
    assert r.names() == [("a", True), ("b", False)] and r.get() is r.get("a")
    with pytest.raises(ValueError):
        r.add("a", planner.GridForest())
    with pytest.raises(ValueError):
        r.get("c")


def test_planned_points_are_leaves_and_turn_little(spark, sf):
    assert [r["illegal"] for r in registry.queries()["val05_planned_turns"](spark, sf).collect()] == [False]
    assert all(r["not_leaves"] == 0 for r in registry.queries()["val03_planned_leaves"](spark, sf).collect())


def test_segments_through_boxes_are_those_of_all_pairs(spark):
    """Against all pairs: segments through boxes, along sides, into boxes that hold an end; equal segments and boxes are one."""
    from netloom.operators import obstacles

    rng = random.Random(8)
    ways = [tuple(float(rng.randrange(0, 60)) for _ in range(4)) for _ in range(150)] + [(-200.0, 7.0, 400.0, 7.5)]
    boxes = [(x, y, x + rng.randrange(1, 15), y + rng.randrange(1, 15)) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(12))]

    def side(a, b, c, d, x, y):
        return (c - a) * (y - b) - (d - b) * (x - a)

    def through(w, box):
        x0, y0, x1, y1 = box
        if any(x0 < x < x1 and y0 < y < y1 for x, y in (w[:2], w[2:])):
            return False
        sides = (x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)
        return any(side(*w, *s[:2]) * side(*w, *s[2:]) < 0 and side(*s, *w[:2]) * side(*s, *w[2:]) < 0 for s in sides)

    want = sorted({w for w in ways if any(through(w, b) for b in boxes)})
    found = obstacles.through(spark.createDataFrame(ways * 2, "x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(boxes * 3, "x0 long, y0 long, x1 long, y1 long"))
    assert 0 < len(want) < len(set(ways)) and sorted(map(tuple, found.collect())) == want


def test_planned_routes_are_valid(spark, sf):
    run = registry.queries()
    assert [r["through"] for r in run["val01_routes_through_restrictions"](spark, sf).collect()] == [False]
    assert not [r for r in run["val04_planned_crossings"](spark, sf).collect() if r["same_tile"]]
    assert max(r["degree"] for r in run["val06_planned_degree"](spark, sf).collect()) <= 4
    assert all(r["apart"] == 0 for r in run["val02_ends_meet"](spark, sf).collect())
    assert all(r["length"] >= 0.866 * r["spanning"] - 1e-3 for r in run["val12_steiner_gap"](spark, sf).collect())


# Sources, sinks, streams.


def test_collection_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)], "id int, x double, y double").repartition(5)
    made = rows.select("id", sinks.feature(sinks.point(F.col("x"), F.col("y")), F.struct(F.col("id"), F.lit("heat_chamber").alias("object_type"))).alias("feature"))
    sinks.write_collection(made, str(tmp_path / "out"), ["id"])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "whole.json").write_text(whole)
    back = geojson.classified(geojson.read_collection(spark, str(tmp_path / "whole.json")))
    assert [(r["id"], r["status"], r["lines"]) for r in back.orderBy("feature_seq").collect()] == [(str(i), "OK", [[[float(i), float(-i)]]]) for i in range(50)]
    sinks.write_collection(made.limit(0), str(tmp_path / "none"), ["id"])
    (tmp_path / "none.json").write_text("".join(p.read_text() for p in (tmp_path / "none").glob("part-*")))
    assert geojson.read_collection(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('{"type": "Feature"}')
    with pytest.raises(Exception, match="features must be an array"):
        geojson.read_collection(spark, str(tmp_path / "bad.json")).collect()


def hard_collection(n: int, seed: int) -> tuple[dict, str]:
    """A collection whose strings, members and arrays look like borders of features, and its text."""
    rng = random.Random(seed)
    texts = ["a}b", "{", '"features": [{', "\\", '\\"}', "]},{", "é}\n", "", "[[", "x" * 300 + "}" * 40]
    rows = []
    for i in range(n):
        nested = {"deep": [{"k": [rng.choice(texts), {"z": {}}]}, []], rng.choice(texts) + "k": rng.choice(texts)}
        rows.append({"type": "Feature", "geometry": rng.choice([None, {"type": "Point", "coordinates": [i, -i]}]), "properties": {"id": i, "name": rng.choice(texts), **rng.choice([{}, nested])}})
    whole = {"name": rng.choice(texts), "crs": {"type": "n", "properties": {"a": [{"b": {}}] * 30, "t": texts}}, "boxes": [1, [2], "]}"], "more": [{"m": {"}": 1}}] * rng.choice([0, 9]), "features": rows, "tail": [{"type": "Feature", "properties": {}}, "}"], "end": {"a": texts}}
    return whole, json.dumps(whole, ensure_ascii=bool(seed % 2), indent=rng.choice([None, 1]))


@pytest.mark.parametrize("size", ["64b", "1000b", "128m"])
def test_collections_are_read_in_parts(spark, tmp_path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        for seed in (1, 2, 3) if size != "64b" else (4,):
            whole, text = hard_collection(9 if size == "64b" else 150, seed)
            (tmp_path / f"{seed}.json").write_text(" \n" + text + " \n")
            rows = geojson.read_collection(spark, str(tmp_path / f"{seed}.json")).orderBy("feature_seq").collect()
            assert [json.loads(r["feature"]) for r in rows] == whole["features"]
            assert len({r["feature_seq"] for r in rows}) == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collections_that_are_none(spark, tmp_path):
    good = '{"type": "Feature", "properties": {"id": 1}}'
    bad = [f"[{good}]", '{"features": {"a": 1}}', '{"features": [1, 2]}', f'{{"features": [{good}, null]}}', f'{{"features": [{good} {good}]}}', f'{{"features": [{good}', '{"a": "features"}', "", '{"features": [{"a": nonsense}]}', f'{{"x": {{"features": [{good}]}}}}']
    for i, text in enumerate(bad):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="features must|JSON|root"):
            geojson.read_collection(spark, str(tmp_path / f"{i}.json")).collect()
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(f'{{"features": [{good}, {good.replace("1", str(i))}]}}')
    rows = geojson.read_collection(spark, str(folder)).orderBy("feature_seq").collect()
    assert [r["feature_seq"] for r in rows] == list(range(6))
    assert [json.loads(r["feature"])["properties"]["id"] for r in rows] == [1, 0, 1, 1, 1, 2]


def test_lines_with_faults(spark, tmp_path):
    lines = [
        '{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"object_type":"source","id":7}}',
        "   ",
        '{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]},"properties":{"object_type":"restriction","id":"r","restriction_type":"road"}}',
        '{"geometry":null,"properties":{"object_type":"heat_chamber"}}',
        '{"geometry":{"type":"LineString","coordinates":[[0,"x"]]},"properties":{"object_type":"heat_network","diameter":"abc"}}',
        '{"properties":{}}',
        "not json",
    ]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    rows = geojson.classified(geojson.read_lines(spark, str(tmp_path / "f.jsonl"))).orderBy("feature_seq").collect()
    assert [r["status"] for r in rows] == ["OK", "OK", "MISSING_GEOMETRY", "INVALID_GEOMETRY", "UNKNOWN_OBJECT_TYPE", "UNKNOWN_OBJECT_TYPE"]
    assert [r["id_is_numeric"] for r in rows[:2]] == [True, False] and rows[4 - 1]["dn"] is None


def test_mask_is_packed_by_blocks(spark):
    import base64

    cells = spark.createDataFrame([(0, 0, True), (1, 1, False), (0, 5, False), (3, 19, True), (2, 0, False)], "row long, col long, blocked boolean")
    out = {r["row"]: list(base64.b64decode(r["bits"])) for r in sinks.packed_mask(cells, 2).collect()}
    assert out == {0: [1], 1: [0, 2]}


def test_stream_equals_table(spark, tmp_path):
    events = spark.createDataFrame([(r, s, None, f"stage{s}", 10 * s + r) for r in range(5) for s in range(1, 9)], progress.EVENTS)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = progress.latest(progress.read_events(spark, str(tmp_path / "in"), files_per_trigger=1))
    run = stream.writeStream.format("memory").queryName("progress_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = sorted(map(tuple, progress.latest(events).collect()))
    assert sorted(map(tuple, spark.table("progress_test").collect())) == want and want[0] == (0, "stage8", 80, 8)
    done = progress.status(progress.latest(events), spark.createDataFrame([(1, 5)], "run_id long, cp_id long"))
    assert {r["run_id"]: r["status"] for r in done.collect()} == {0: "RUNNING", 1: "PARTIAL", 2: "RUNNING", 3: "RUNNING", 4: "RUNNING"}


def test_refined_forests_are_sound_and_not_longer():
    rng = __import__("random").Random(7)
    for _ in range(6):
        points = [(i, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(1, 20)) for i in range(12)]
        boxes = [(x, y, x + 30, y + 20) for x, y in ((rng.uniform(20, 160), rng.uniform(20, 160)) for _ in range(4))]
        length = {}
        for name, options in {"plain": planner.Options(cell=10, passes=1, relinks=0, pull=False), "refined": planner.Options(cell=10, passes=1)}.items():
            variants, lost = planner.GridForest(options).plan(planner.Tile(points, [(99, 1.0, 1.0)], boxes))
            edges = variants[0]
            by = {e.edge: e for e in edges}
            assert sorted([*(e.node for e in edges if e.node >= 0), *lost]) == list(range(12))
            for e in edges:
                above = by[e.parent].line[-2:-1] if e.parent else []
                assert planner.turns_little([*above, *e.line]) or len(e.line) == 2
                assert not e.parent or by[e.parent].line[-1] == e.line[0]
            degree = {}
            for e in edges:
                for spot in (e.line[0], e.line[-1]):
                    degree[spot] = degree.get(spot, 0) + 1
            assert max(degree.values()) <= 4
            length[name] = sum(e.length for e in edges)
        assert length["refined"] <= length["plain"] + 1e-6


# Polygons.


def test_bands_of_shapes_equal_sampling(spark):
    """Parts of segments within a distance of lines and areas, against many points along each."""
    rng = random.Random(4)
    shapes, segments = [], []
    for i in range(12):
        x, y, r = rng.uniform(0, 80), rng.uniform(0, 80), rng.uniform(5, 25)
        ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(5))]
        lines = [ring] + ([[((a + x) / 2, (b + y) / 2) for a, b in ring]] if i % 3 == 0 else [])
        shapes.append((i, "t", lines, i % 2 == 0, rng.choice([0.5, 3.0, 8.0])))
    for i in range(25):
        segments.append((i, *[rng.uniform(-10, 90) for _ in range(4)]))
    table = spark.createDataFrame(shapes, "r_id int, rtype string, lines array<array<struct<x: double, y: double>>>, area boolean, keep double")
    lines = spark.createDataFrame(segments, "seg_id int, x1 double, y1 double, x2 double, y2 double")
    found = {}
    for r in regions.band_spans(lines, table, 8.0).collect():
        found.setdefault((r["seg_id"], r["r_id"]), []).append((r["s0"], r["s1"]))
    inside = {}
    for r in regions.spans(lines, table).collect():
        inside.setdefault((r["seg_id"], r["r_id"]), []).append((r["s0"], r["s1"]))
    near = {(r["seg_id"], r["r_id"]): r["dist"] for r in regions.blocked(lines, table, 8.0).collect()}

    def far(p, a, b):
        t = max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    for s, x1, y1, x2, y2 in segments:
        for i, _, rings, area, keep in shapes:
            sides = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + (ring[:1] if area else []), strict=False)]
            least = math.inf
            for k in range(401):
                t = k / 400
                p = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
                held = area and sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2 == 1
                off = min(far(p, a, b) for a, b in sides)
                least = min(least, 0.0 if held else off)
                if abs(off - keep) > 1e-6:
                    assert any(u <= t <= v for u, v in found.get((s, i), ())) == (held or off < keep), (s, i, t)
                if area and off > 1e-6:
                    assert any(u <= t <= v for u, v in inside.get((s, i), ())) == held
            if least < keep - 0.5:
                assert near[s, i] <= least + 1e-9


def test_ways_out_of_buildings(spark):
    def box(a, b, c, d):
        return [[(a, b), (c, b), (c, d), (a, d)]]

    rows = [(1, "oks", box(0, 0, 20, 20), True, 3.0), (2, "oks", box(24, 0, 40, 20), True, 3.0), (3, "park", box(-30, -30, 60, -4), True, 2.0), (4, "oks", [*box(100, 0, 110, 10), *box(112, 0, 120, 10)], True, 3.0), (5, "oks", [[(200, 0), (230, 0), (230, 30), (220, 30), (220, 10), (210, 10), (210, 30), (200, 30)]], True, 1.0)]
    rows = [(i, t, [[(float(x), float(y)) for x, y in ring] for ring in rings], *more) for i, t, rings, *more in rows]
    table = spark.createDataFrame(rows, "r_id int, rtype string, lines array<array<struct<x: double, y: double>>>, area boolean, keep double")
    points = [(1, 4.0, 12.0, 1, 3.0), (2, 0.0, 5.0, 1, 3.0), (3, 106.0, 5.0, 4, 3.0), (4, 205.0, 25.0, 5, 1.0)]
    got = {}
    for r in regions.exits(spark.createDataFrame(points, "cp_id int, x double, y double, r_id int, keep double"), table, 3.0, 15.0, 10.0).orderBy("cp_id", "nth").collect():
        got.setdefault(r["cp_id"], []).append((r["ex"], r["ey"], r["tail"]))
    # West and north; east ends between two buildings nearer than their bands; south is too near the park.
    assert got[1] == [(-3.0, 12.0, 7.0), (4.0, 23.0, 11.0)]
    assert got[2][0] == (-3.0, 5.0, 3.0)  # on a side: out along its normal
    # East of the first part stands the second: ways through it lead back into the building.
    assert (97.0, 5.0, 9.0) in got[3] and all(x[0] < 111 for x in got[3])
    # Within one arm of a U: not through the other arm.
    assert (199.0, 25.0, 6.0) in got[4] and all(x[0] < 221 for x in got[4])


def test_masks_of_regions_join_nothing_by_id_and_equal_distances_cell_by_cell(spark):
    rng = random.Random(3)
    shapes = [[[(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(rng.choice((3, 4, 9)))]] for _ in range(40)]
    rows = [(i, [[{"x": x, "y": y} for x, y in line] for line in s], i % 5 > 0, float(i % 3 * 7), i) for i, s in enumerate(shapes)]
    rows.append((99, [], True, 5.0, 1000))
    table = spark.createDataFrame(rows, "r_id int, lines array<array<struct<x: double, y: double>>>, area boolean, keep double, value long")

    def near(px, py, line, area):
        ring = [*line, line[0]] if area else line
        sides = list(zip(ring, ring[1:]))
        met = sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides)
        far = []
        for a, b in sides:
            t = max(0.0, min(1.0, ((px - a[0]) * (b[0] - a[0]) + (py - a[1]) * (b[1] - a[1])) / ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2)))
            far.append(math.hypot(px - a[0] - t * (b[0] - a[0]), py - a[1] - t * (b[1] - a[1])))
        return area and met % 2 == 1, min(far)

    wanted = {}
    for c in range(-30, 30):
        for r in range(-30, 30):
            for (i, _, area, keep, value), s in zip(rows, shapes):
                inside, far = near(c * 2 + 1, r * 2 + 1, s[0], area)
                if inside or keep > 0 and far < keep - 1e-9:
                    wanted[c, r] = max(value, wanted.get((c, r), 0))
    found = regions.mask(table, 2.0)
    assert found.dtypes == [("col", "int"), ("row", "int"), ("value", "bigint")]
    assert {(r["col"], r["row"]): r["value"] for r in found.collect()} == wanted
    plan = registry.queries()["jn21_plot_cell_factors"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the catalogue's rules only


def test_points_of_one_place_share_the_answer_of_their_areas(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 8.0, "y": 0.0}, {"x": 8.0, "y": 6.0}, {"x": 0.0, "y": 6.0}]
    lines = "lines array<array<struct<x: double, y: double>>>"
    table = spark.createDataFrame([(i, "oks", [ring], True, 2.0) for i in (4, 7)], f"r_id long, rtype string, {lines}, area boolean, keep double")
    spots = [(1, 3, 2, 100), (2, 3, 2, 5), (3, 3, 2, 700), (4, 0, 0, 1), (5, 90, 90, 10), (6, None, 2, 1)]
    points = spark.createDataFrame(spots, "cp_id long, x long, y long, flow long")
    inside = regions.containing(points, table)
    assert values(map(tuple, inside.collect())) == values((p, r, "oks", p == 4) for p in (1, 2, 3, 4) for r in (4, 7))
    assert values(map(tuple, regions.owning(points, table).collect())) == values([*((p, 4) for p in (1, 2, 3, 4)), (5, None), (6, None)])
    assert values(map(tuple, regions.owning(points, table, False).collect())) == values([*((p, 4) for p in (1, 2, 3)), (4, None), (5, None), (6, None)])
    assert values(map(tuple, regions.least_dn(points, table).collect())) == values([(4, 50), (7, 50)])
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan  # nothing of unknown size goes to the driver


def test_parts_near_sides_equal_the_expression(spark):
    rng = random.Random(5)
    shape = lambda: [{"ax": a, "ay": b, "bx": a + rng.choice((0.0, 3.0, -4.5)), "by": b + 2.0} for a, b in ((float(rng.randint(-9, 9)), float(rng.randint(-9, 9))) for _ in range(rng.randint(1, 6)))]
    rows = [(i, i, *(float(rng.randint(-12, 12)) for _ in range(4)), rng.choice((0.0, 1.0, 2.5)), False, shape()) for i in range(300)]
    rows.append((300, 300, 1.0, 1.0, 1.0, 1.0, 2.0, False, shape()))
    pairs = spark.createDataFrame(rows, "seg_id long, r_id long, x1 double, y1 double, x2 double, y2 double, keep double, area boolean, sides array<struct<ax: double, ay: double, bx: double, by: double>>")
    plain = F.filter(F.transform("sides", lambda s: regions.P.near_side(*map(F.col, regions.SEGMENT), s, F.col("keep"))), lambda x: x.isNotNull())
    both = [(r["near"], r["plain"]) for r in regions.near_spans(pairs).withColumn("plain", plain).collect()]
    assert len(both) == 301 and any(a for a, _ in both) and all(a == b for a, b in both)


def test_points_of_one_place_have_the_same_ways_out(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 8.0, "y": 0.0}, {"x": 8.0, "y": 6.0}, {"x": 0.0, "y": 6.0}]
    table = spark.createDataFrame([(i, "oks", [ring], True, 2.0) for i in (4, 7)], "r_id long, rtype string, lines array<array<struct<x: double, y: double>>>, area boolean, keep double")
    points = spark.createDataFrame([(p, 3, 2) for p in (1, 2, 3)], "cp_id long, x long, y long")
    owned = regions.owning(points, table).join(points.select("cp_id", "x", "y"), "cp_id").withColumn("keep", F.lit(2.0))
    ways = regions.exits(owned, table.filter("r_id = 4"), 1.0, 15.0, 10.0).collect()
    by = {p: sorted((r["side"], r["ex"], r["ey"], r["tail"], r["nth"]) for r in ways if r["cp_id"] == p) for p in (1, 2, 3)}
    assert by[1] == by[2] == by[3] == [(0, 3.0, -2.0, 4.0, 1), (1, 10.0, 2.0, 7.0, 4), (2, 3.0, 8.0, 6.0, 3), (3, -2.0, 2.0, 5.0, 2)]
