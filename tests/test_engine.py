"""The API end to end on an invented district, and depth, median and assembly rules."""

import json
import random

import pytest
from netloom.engine import STAGES, Engine, Settings
from netloom.functions import catalogues
from netloom.functions import lines as L
from netloom.functions import scalars as S
from netloom.functions.catalogues import DEFAULT
from netloom.operators import assembly, depth, medians, regions
from pyspark.sql import functions as F


def district() -> dict:
    """Two chambers, a source, five points, a park between them, and faulty features."""

    def at(x, y):
        return [37.5 + x / 63_000, 55.7 + y / 111_000]

    def made(kind, gtype, coordinates, **more):
        return {"type": "Feature", "geometry": {"type": gtype, "coordinates": coordinates}, "properties": {"object_type": kind, **more}}

    ring = [at(40, -30), at(60, -30), at(60, 30), at(40, 30), at(40, -30)]
    rows = [made("source", "Point", at(0, 0), id=1), made("heat_chamber", "Point", at(10, 0), id="c1"), made("heat_chamber", "Point", at(10, 50), id="c2")]
    rows += [made("oks_connection_point", "Point", at(100, 20 * i - 40), id=10 + i, flow_tph=3.5 + i) for i in range(5)]
    rows += [made("oks_connection_point", "Point", at(90, 90), id="dry"), made("restriction", "Polygon", [ring], id="p", restriction_type="park")]
    rows += [made("oks_future", "Point", at(0, 0)), made("mystery", "Point", at(0, 0)), made("restriction", "Polygon", [ring]), {"type": "Feature", "geometry": None, "properties": {"object_type": "source"}}]
    return {"type": "FeatureCollection", "features": rows}


def made(kind, gtype, coordinates, **more):
    def at(p):
        return [37.5 + p[0] / 63_000, 55.7 + p[1] / 111_000] if isinstance(p[0], (int, float)) else [at(q) for q in p]

    return {"type": "Feature", "geometry": {"type": gtype, "coordinates": at(coordinates)}, "properties": {"object_type": kind, **more}}


def town() -> dict:
    """A pipe with a chamber, two buildings with points in them, a bent river to go around, a road and a gas pipe to cross."""
    rows = [made("source", "Point", (-40, 0), id=1), made("heat_network", "LineString", [(-40, 0), (0, 0), (0, 80)], id=2, diameter=300), made("heat_chamber", "Point", (0, 0), id="c")]
    house = [(60, 40), (90, 40), (90, 60), (75, 60), (75, 80), (60, 80), (60, 40)]
    rows += [made("restriction", "Polygon", [house], id="h1", restriction_type="oks"), made("restriction", "MultiPolygon", [[[(100, -40), (120, -40), (120, -20), (100, -20), (100, -40)]]], id="h2", restriction_type="oks")]
    rows += [made("oks_connection_point", "Point", (64, 50), id=11, flow_tph=12.0), made("oks_connection_point", "Point", (104, -30), id=12, flow_tph=30.0), made("oks_connection_point", "Point", (70, 0), id="free", flow_tph=5.0), made("oks_connection_point", "Point", (70, -10), id=14)]
    rows += [made("restriction", "LineString", [(40, -100), (40, 20), (48, 100)], id="r", restriction_type="road"), made("restriction", "LineString", [(52, -100), (52, 100)], id="g", restriction_type="gas_pipeline")]
    rows += [made("restriction", "Polygon", [[(20, 10), (30, 10), (30, -60), (20, -60), (20, 10)]], id="w", restriction_type="water"), made("restriction", "LineString", [(300, 0), (310, 0)], id="x", restriction_type="something_new")]
    return {"type": "FeatureCollection", "features": rows}


def collection(folder) -> list[dict]:
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))["features"]


def test_register_and_refuse(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(district()))
    engine = Engine(spark, f"file://{tmp_path}/engine")
    name = engine.register(str(tmp_path / "d.json"))
    found = {(r["object_type"], r["status"]): r["n"] for r in engine.diagnostics(name).collect()}
    assert found == {
        ("source", "OK"): 1, ("heat_chamber", "OK"): 2, ("oks_connection_point", "OK"): 6, ("restriction", "OK"): 1,
        ("oks_future", None): 1, ("mystery", "UNKNOWN_OBJECT_TYPE"): 1, ("restriction", "MISSING_RESTRICTION_TYPE"): 1, ("source", "MISSING_GEOMETRY"): 1,
    }
    kept = engine.dataset(name)
    assert kept["features"] == 14 and kept["faults"] == 3 and engine.dataset("none") is None
    for bad in (lambda: engine.run(name, "other"), lambda: engine.run(name, mode="3d"), lambda: engine.result("../x")):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "none.json").write_text('{"features": []}')
    with pytest.raises(ValueError, match="no features"):
        engine.register(str(tmp_path / "none.json"))
    assert engine.info()["modes"] == ["2d", "depth"] and engine.info()["default_algorithm"] in engine.info()["algorithms"]


def test_a_town_end_to_end(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(town()))
    engine = Engine(spark, f"file://{tmp_path}/engine")
    name = engine.register(str(tmp_path / "t.json"))
    run = engine.run(name, settings=Settings(trace=True))
    assert engine.run_info(run)["status"] == "PARTIAL" and engine.run_info(run)["lost"] == 1 and engine.run_info("none") is None
    assert [r["stage"] for r in engine.progress(run).collect()] == list(STAGES) and engine.progress(run).collect()[-1]["progress"] == 100
    warnings = {(r["code"], r["message"]) for r in engine.table(run, "warnings").collect()}
    assert ("UNKNOWN_RESTRICTION_TYPE", "something_new: 1") in warnings and ("NO_FLOW", "14") in warnings and not [w for w in warnings if w[0] == "NO_EXIT"]

    out = collection(tmp_path / "engine" / "runs" / run / "result")
    kinds = [f["properties"]["object_type"] for f in out]
    assert set(kinds) >= {"heat_network", "technical_node", "variant_summary"}
    variants = {f["properties"]["variant_id"] for f in out}
    for v in variants:
        mine = [f["properties"] | {"line": (f["geometry"] or {}).get("coordinates")} for f in out if f["properties"]["variant_id"] == v]
        segs = [f for f in mine if f["object_type"] == "heat_network"]
        summary = next(f for f in mine if f["object_type"] == "variant_summary")
        ids = {f["id"] for f in mine if f["object_type"] in ("heat_chamber", "technical_node")}
        # No reference hangs: every end is a node given out, an existing chamber, or a point.
        for f in segs:
            assert {f["start_node_id"], f["end_node_id"]} <= ids | {"c", "1", "11", "12", "free"}, f
            if f["laying_method"] == "special":
                assert len(f["line"]) == 2
        assert {f["end_node_id"] for f in segs} >= {"11", "12", "free"}
        assert summary["unconnected_oks_ids"] == [14] and summary["new_network_length"] == pytest.approx(sum(f["length"] for f in segs), abs=1e-3)
        chambers = sum(f["cost"] for f in mine if f["object_type"] == "heat_chamber")
        assert summary["chamber_construction_cost"] == chambers
        assert summary["construction_cost"] == sum(f["cost"] for f in segs) + chambers + summary["existing_chamber_tie_in_cost"]
        assert summary["calculated_cost"] == summary["construction_cost"] + DEFAULT.penalty[0] and summary["unconnected_penalty"] == DEFAULT.penalty[0]
        assert [f for f in segs if f["laying_method"] == "special"] and all(f["depth_start"] is None for f in segs)
    assert sorted(f["properties"]["rank"] for f in out if f["properties"]["object_type"] == "variant_summary") == list(range(1, len(variants) + 1))

    # Routes keep off the river and off houses that are not their point's own.
    edges = engine.table(run, "edges")
    parts = edges.select("eid", "node", F.posexplode(L.steps(F.col("line"))).alias("pos", "s")).select(F.concat_ws("#", "eid", "pos").alias("seg_id"), "node", F.col("s.ax").alias("x1"), F.col("s.ay").alias("y1"), F.col("s.bx").alias("x2"), F.col("s.by").alias("y2"))
    closed = engine.table(run, "restrictions").filter("mode = 'PROHIBITED'")
    through = regions.interior_blocked(parts, closed).join(closed.select("r_id", "rtype"), "r_id").join(parts.select("seg_id", "node"), "seg_id").collect()
    assert all(r["rtype"] == "oks" and r["node"] >= 0 for r in through) and len({r["node"] for r in through}) <= 2
    assert {r["dn"] for r in edges.collect()} <= {r[0] for r in DEFAULT.diameters}

    stages = {s["id"]: s["features"] for s in engine.stages(run)}
    assert stages["points"] == 4 and stages["restrictions"] == 6 and stages["pass-1"] >= 3
    assert len(json.loads(engine.stage_text(run, "pass-1"))["features"]) == stages["pass-1"]
    with pytest.raises(ValueError, match="no stage"):
        engine.stage_text(run, "nothing")
    nodes = {r["node_id"]: r for r in engine.incidence(run).filter("variant = 1").collect()}
    assert nodes["11"]["after"] == [] and len(nodes["11"]["before"]) == 1
    assert engine.compared(run).first()["cost_more"] == 0
    lines = "".join(p.read_text() for p in (tmp_path / "engine" / "runs" / run / "summary-json").glob("part-*")).splitlines()
    assert [json.loads(x)["rank"] for x in lines] == list(range(1, len(variants) + 1))
    assert list((tmp_path / "engine" / "runs" / run / "warnings-json").glob("part-*")) and list((tmp_path / "engine" / "runs" / run / "grid-json").glob("part-*"))

    deep = engine.run(name, mode="depth")
    assert [r["run_id"] for r in engine.runs(name).collect()] == [deep, run] and engine.stages(deep) == []
    segs = engine.table(deep, "segments").collect()
    assert all(0.7 - 1e-9 <= min(r["depth_start"], r["depth_end"]) and abs(r["depth_end"] - r["depth_start"]) <= 0.1 * (r["s1"] - r["s0"]) + 1e-3 for r in segs)
    assert any(r["depth_start"] != 3.0 for r in segs)  # over or under the gas pipe


def test_catalogues_from_text():
    c = catalogues.load('{"diameters": [[50, 20, 60, 1], [80, 60, 120, 2]], "tie_in": 5}')
    assert c.diameters == ((50, 20, 60, 1), (80, 60, 120, 2)) and c.tie_in == 5 and c.rules == DEFAULT.rules
    for bad in ('{"nothing": 1}', '{"diameters": [[80, 1, 1, 1], [50, 1, 1, 1]]}', '{"diameters": []}'):
        with pytest.raises(ValueError):
            catalogues.load(bad)


def test_depth_targets_and_warnings(spark):
    rows = spark.createDataFrame([(2.0, 0.5, 0.3), (1.0, 0.4, 0.3), (0.1, 0.2, 0.3)], "top double, height double, new double")
    assert [round(r[0], 6) for r in rows.select(S.avoidance_depth(F.col("top"), F.col("height"), F.col("new"))).collect()] == [1.5, 1.6, -1.0]
    edges = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0)], "edge long, length double")
    asked = spark.createDataFrame([(1, 48.0, 52.0, 2.5), (2, 1.0, 4.0, 1.5), (3, 50.0, 51.0, -1.0)], "edge long, start double, end double, depth double")
    assert sorted(map(tuple, depth.warnings(edges, asked).collect())) == [(2, "DEPTH_SLOPE_EXCEEDED"), (3, "DEPTH_OBSTACLE_UNRESOLVED")]
    assert [tuple(r) for r in depth.profiles(edges, asked).filter("edge = 3").collect()] == [(3, 0.0, 100.0, 3.0, 3.0)]


def test_depth_profiles_cover_the_edge_and_keep_the_rules():
    rules = depth.Rules()
    assert depth.profile(50.0, []) == [(0.0, 50.0, 3.0, 3.0)]
    assert depth.profile(100.0, [(48, 52, 2.5)]) == [(0.0, 43.0, 3.0, 3.0), (43.0, 48, 3.0, 2.5), (48, 52, 2.5, 2.5), (52, 57.0, 2.5, 3.0), (57.0, 100.0, 3.0, 3.0)]
    assert depth.merged([(10, 12, 2.5), (20, 22, 3.8)], rules) == [(10, 22, 3.8)]
    rng = random.Random(1)
    for _ in range(300):
        length = rng.uniform(5, 200)
        asked = [(a, a + rng.uniform(0, 20), rng.choice([0.8, 2.0, 2.9, 3.4, 5.0])) for a in (rng.uniform(-5, length) for _ in range(rng.randrange(5)))]
        pieces = depth.profile(length, asked)
        assert pieces[0][0] == 0 and pieces[-1][1] == pytest.approx(length)
        for (_, b, _, h), (c, _, k, _) in zip(pieces, pieces[1:], strict=False):
            assert b == pytest.approx(c) and h == pytest.approx(k)
        for a, b, h, k in pieces:
            assert abs(h - k) <= rules.slope * (b - a) + 1e-6 and min(h, k) >= rules.least


def test_median_is_no_worse_than_points_near_it():
    rng = random.Random(2)
    points = [(rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(1, 5)) for _ in range(9)]
    x, y = medians.median(points)

    def pull(a, b):
        return sum(w * ((a - p) ** 2 + (b - q) ** 2) ** 0.5 for p, q, w in points)

    assert all(pull(x, y) <= pull(x + dx, y + dy) + 1e-3 for dx in (-0.1, 0, 0.1) for dy in (-0.1, 0, 0.1))
    assert medians.median([(1, 2, 3)]) == (1, 2) and medians.median([(0, 0, 1), (2, 4, 9)]) == (1, 2) and medians.median([]) is None


def test_pieces_add_up_and_take_the_largest_factor(spark):
    edges = spark.createDataFrame([(1, 10.0), (2, 5.0)], "edge long, length double")
    spans = spark.createDataFrame([(1, 2.0, 6.0, 150), (1, 4.0, 8.0, 170)], "edge long, s0 double, s1 double, factor long")
    rows = assembly.pieces(edges, spans).orderBy("edge", "s0").collect()
    assert [(r["edge"], r["s0"], r["s1"], r["factor"], r["technical"]) for r in rows] == [(1, 0, 2, 100, False), (1, 2, 4, 150, True), (1, 4, 6, 170, True), (1, 6, 8, 170, True), (1, 8, 10, 100, True), (2, 0, 5, 100, False)]
