"""The engine's API: register data sets, plan, and read results.  Everything it keeps is a table or file under one folder."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import catalogues as K
from netloom.functions import lines as L
from netloom.functions import scalars as S
from netloom.operators import planner, regions, results, spatial
from netloom.sources import geojson, sinks

MODES = ("2d", "depth")
RUNS = "run_id string, dataset_id string, algorithm string, mode string, created_at timestamp, status string, lost long"
STAGES = ("ingest", "graph", "obstacles", "exits", "generate", "assemble", "write", "done")


@dataclass(frozen=True)
class Settings:
    #: Cell of the search grid, in metres; hexagons or squares.
    cell: float = 2.0
    hexagons: bool = False
    passes: int = 2
    tile_m: int = 100_000
    #: Distance of places on pipes where new ones may begin, and to chambers that make such a place needless.
    sample_step: float = 25.0
    chamber_radius: float = 10.0
    max_degree: int = 4
    most_tail: float = 15.0
    #: Special restrictions are passed in gates only.
    strict: bool = False
    gate_step: float = 5.0
    trace: bool = False


class Engine:
    def __init__(self, spark: SparkSession, folder: str, catalogues: K.Catalogues = K.DEFAULT) -> None:
        self.spark, self.folder, self.catalogues = spark, folder.rstrip("/"), catalogues

    def path(self, *parts: str) -> str:
        for p in parts:
            if not re.fullmatch(r"[a-z0-9-]{1,40}", p):
                raise ValueError(f"not a name: {p}")
        return "/".join((self.folder, *parts))

    @staticmethod
    def mode(text: str | None) -> str:
        text = (text or "").strip().lower() or MODES[0]
        if text not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        return text

    @staticmethod
    def algorithms() -> list[tuple[str, bool]]:
        return planner.REGISTRY.names()

    def info(self) -> dict[str, object]:
        """What this engine can do."""
        return {"algorithms": [n for n, _ in self.algorithms()], "default_algorithm": planner.REGISTRY.default, "modes": list(MODES), "diameters": [r[0] for r in self.catalogues.diameters], "restriction_types": [r[0] for r in self.catalogues.rules]}

    # Data sets.

    def register(self, source: str, lines: bool = False) -> str:
        """Read a collection, keep its text, its good rows in metres and its diagnostics; an empty collection is an error."""
        read = geojson.read_lines if lines else geojson.read_collection
        name = uuid.uuid4().hex[:12]
        geojson.classified(read(self.spark, source)).write.parquet(self.path("datasets", name, "bronze"))
        rows = self.spark.read.parquet(self.path("datasets", name, "bronze"))
        if rows.isEmpty():
            raise ValueError("the collection has no features")
        geojson.projected(rows.filter("status = 'OK'")).write.partitionBy("object_type").parquet(self.path("datasets", name, "silver"))
        geojson.diagnostics(rows).coalesce(1).write.json(self.path("datasets", name, "diagnostics"))
        found = rows.agg(F.count("*").alias("features"), F.count(F.when(F.col("status") != "OK", 1)).alias("faults"))
        found.select(F.lit(name).alias("dataset_id"), F.lit(source).alias("source"), "features", "faults", F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(self.path("data"))
        return name

    def dataset(self, name: str) -> dict | None:
        """What is kept about one data set; None if there is none of that name."""
        self.path(name)
        row = self.spark.read.parquet(self.path("data")).filter(F.col("dataset_id") == name).first()
        return row.asDict() if row else None

    def features(self, dataset: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(self.path("datasets", dataset, "silver")).filter(F.col("object_type") == kind)

    def diagnostics(self, dataset: str) -> DataFrame:
        return self.spark.read.schema("object_type string, status string, n long").json(self.path("datasets", dataset, "diagnostics"))

    # Input relations of a run.

    def spots(self, dataset: str, kind: str) -> DataFrame:
        first = F.col("lines")[0][0]
        return self.features(dataset, kind).select(F.col("feature_seq").alias("seq"), "id", "id_is_numeric", F.col("flow_tph").alias("flow"), first["x"].alias("x"), first["y"].alias("y"))

    def pipes(self, dataset: str) -> DataFrame:
        """Straight parts of the existing network."""
        rows = self.features(dataset, "heat_network").select("feature_seq", F.explode("lines").alias("line"))
        parts = rows.select("feature_seq", F.posexplode(L.steps(F.col("line"))).alias("pos", "s"))
        return parts.select((F.col("feature_seq") * 100_000 + F.col("pos")).alias("seg_id"), F.col("s.ax").alias("x1"), F.col("s.ay").alias("y1"), F.col("s.bx").alias("x2"), F.col("s.by").alias("y2"))

    def restrictions(self, dataset: str, dn: int) -> DataFrame:
        """(r_id, rtype, lines, area, mode, factor, keep, known): every restriction with its rule for a diameter; unknown types have the fallback."""
        c = self.catalogues
        mode, least, factor = c.fallback
        rows = self.features(dataset, "restriction").select(F.col("feature_seq").alias("r_id"), "rtype", "lines", F.col("gtype").isin("Polygon", "MultiPolygon").alias("area"))
        rows = rows.join(F.broadcast(K.rules(self.spark, c)), "rtype", "left")
        near = F.lit(None).cast("long")
        for t, most, dist in sorted(c.bands, key=lambda b: -b[1]):
            near = F.when((F.col("rtype") == t) & (F.lit(dn) <= most), F.lit(dist).cast("long")).otherwise(near)
        keep = F.coalesce(near, "min_dist", F.lit(least).cast("long")) / 10.0 + S.pair_width(F.lit(dn), c) / 200.0
        return rows.select("r_id", "rtype", "lines", "area", F.coalesce("mode", F.lit(mode)).alias("mode"), F.coalesce("factor", F.lit(factor).cast("long")).alias("factor"), keep.alias("keep"), F.col("mode").isNotNull().alias("known"))

    def run(self, dataset: str, algorithm: str | None = None, mode: str | None = None, settings: Settings = Settings()) -> str:
        """Plan a data set: graph, obstacles, exits, search by tiles, diameters, pieces, costs, ranks; all kept under the run's name."""
        s, c = settings, self.catalogues
        mode, chosen = self.mode(mode), planner.REGISTRY.get(algorithm)
        if algorithm is None and isinstance(chosen, planner.GridForest):
            chosen = planner.GridForest(replace(chosen.options, cell=s.cell, hexagons=s.hexagons, passes=s.passes, max_degree=s.max_degree), c)
        name = uuid.uuid4().hex[:12]
        at = {n: i for i, n in enumerate(STAGES)}
        self.told: list[tuple] = []

        def kept(df: DataFrame, what: str) -> DataFrame:
            df.write.parquet(self.path("runs", name, what))
            return self.spark.read.schema(df.schema).parquet(self.path("runs", name, what))

        def told(stage: str) -> None:
            self.told.append((name, len(self.told) + 1, stage, round(100 * (at[stage] + 1) / len(STAGES)), time.time()))
            self.spark.createDataFrame([self.told[-1]], "run_id string, seq int, stage string, progress int, ts double").coalesce(1).write.mode("append").json(self.path("events"))

        told("ingest")
        points = kept(self.spots(dataset, "oks_connection_point"), "points")
        chambers = kept(self.spots(dataset, "heat_chamber").unionByName(self.spots(dataset, "source")), "chambers")
        pipes = kept(self.pipes(dataset), "pipes")
        warnings = self.diagnostics(dataset).filter("status != 'OK'").select(F.col("status").alias("code"), F.concat("object_type", F.lit(": "), "n").alias("message"))

        told("graph")
        as_nodes = chambers.select(F.col("seq").alias("node_id"), "x", "y")
        attached = spatial.attachments(pipes, as_nodes)
        full = attached.filter(F.col("n") > s.max_degree)
        warnings = warnings.unionByName(full.select(F.lit("CHAMBER_DEGREE_EXCEEDED").alias("code"), F.concat("node_id", F.lit(": "), "n").alias("message")))
        ties = kept(self.ties(points, chambers, pipes, attached, s), "ties")

        told("obstacles")
        least = points.agg(F.min(S.smallest_dn(F.when(F.col("flow") > 0, F.col("flow")), c=c)).alias("dn")).first()["dn"] or c.diameters[0][0]
        ruled = kept(self.restrictions(dataset, least), "restrictions")
        closed = ruled.filter("mode = 'PROHIBITED'")
        special = ruled.filter("mode = 'SPECIAL'")
        warnings = warnings.unionByName(ruled.filter("not known").groupBy("rtype").count().select(F.lit("UNKNOWN_RESTRICTION_TYPE").alias("code"), F.concat("rtype", F.lit(": "), "count").alias("message")))
        reach = float(ruled.agg(F.max("keep").alias("m")).first()["m"] or 0.0)

        told("exits")
        targets, others, shut = self.targets(points, closed, s, reach)
        targets, others = kept(targets, "targets"), kept(others, "others")
        warnings = warnings.unionByName(points.filter("coalesce(flow, 0) <= 0").select(F.lit("NO_FLOW").alias("code"), F.coalesce("id", F.col("seq").cast("string")).alias("message"))).unionByName(shut)

        told("generate")
        tile = lambda x, y: (F.floor(F.col(x) / s.tile_m) * 100_000 + F.floor(F.col(y) / s.tile_m)).cast("long").alias("tile")
        placed = targets.select(tile("x", "y"), "id", "x", "y", "flow")
        shapes = regions.shaped(closed.select("r_id", "lines", "area", "keep", F.lit(0).alias("factor"), F.lit(0.0).alias("step")))
        dear = special.select("r_id", "lines", "area", "keep", (F.lit(0) if s.strict else F.col("factor")).cast("int").alias("factor"), F.lit(s.gate_step if s.strict else 0.0).alias("step"))
        shapes = shapes.unionByName(regions.shaped(dear))
        span = [F.sequence(F.floor((F.col(a) - F.col("keep")) / s.tile_m), F.floor((F.col(b) + F.col("keep")) / s.tile_m)) for a, b in (("ex0", "ex1"), ("ey0", "ey1"))]
        shapes = shapes.withColumn("tc", F.explode(span[0])).withColumn("tr", F.explode(span[1])).withColumn("tile", (F.col("tc") * 100_000 + F.col("tr")).cast("long"))
        # Each tile has its own tie-in places, and those nearest to its points.
        nearest = spatial.nearest(placed.select(F.col("id").alias("cp_id"), "x", "y"), ties.select(F.col("id").alias("node_id"), "x", "y"), 4)
        near = nearest.join(placed.select(F.col("id").alias("cp_id"), "tile"), "cp_id").select("tile", F.col("node_id").alias("id")).distinct().join(ties, "id")
        roots = ties.select(tile("x", "y"), "id", "x", "y").unionByName(near.select("tile", "id", "x", "y")).distinct()
        more = others.join(placed.select("id", "tile"), "id").select("tile", "id", "x", "y", "nth")
        plan = kept(planner.plan(placed, roots, None, chosen, shapes.select("tile", "sides", "area", "keep", "factor", "step"), more), "plan")
        warnings = warnings.unionByName(plan.filter("note is not null and not startswith(note, 'SEARCHED') and not startswith(note, 'REPAIRED')").select(F.substring_index("note", ":", 1).alias("code"), F.trim(F.substring_index("note", ":", -1)).alias("message")))

        told("assemble")
        edges = kept(results.node_ids(results.designed(results.edges(plan, targets, c), c), points.select("seq", F.col("id").alias("name")).unionByName(chambers.select("seq", F.col("id").alias("name")))), "edges")
        spans = kept(results.zone_spans(edges, special, reach).join(special.select("r_id", "rtype", "factor"), "r_id"), "spans")
        profiles = None
        if mode == "depth":
            profiles, deep = results.depth_profiles(edges, spans, c)
            profiles = kept(profiles, "profiles")
            warnings = warnings.unionByName(deep.select("code", F.col("eid").alias("message")))
        parts = results.pieces(edges, spans.select("eid", "s0", "s1", "factor"), profiles)
        segments = kept(results.segments(edges, parts, c=c), "segments")
        places = kept(results.chambers(edges, c), "places")
        joints = kept(results.technical_nodes(segments, edges), "joints")
        choice = kept(results.merged(segments, places, c), "choice")
        lost = plan.filter("unconnected is not null").select(F.col("unconnected").alias("seq")).unionByName(points.join(targets.select(F.col("id").alias("seq")), "seq", "left_anti").select("seq")).distinct()
        lost = kept(lost.join(points, "seq").select("seq", "id", "id_is_numeric", F.col("seq").alias("cp_id"), F.coalesce("flow", F.lit(0.0)).alias("flow")), "lost")
        summary = kept(results.summaries(segments, places, choice, lost.select("cp_id", "flow"), c), "summary")

        told("write")
        kept(warnings.distinct(), "warnings")
        self.write_files(name, s)
        number = lost.count()
        status = "DONE" if not number and not summary.isEmpty() else "PARTIAL"
        meta = self.spark.createDataFrame([(name, dataset, algorithm or planner.REGISTRY.default, mode, status, number)], "run_id string, dataset_id string, algorithm string, mode string, status string, lost long")
        meta.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path("meta"))
        told("done")
        return name

    def ties(self, points: DataFrame, chambers: DataFrame, pipes: DataFrame, attached: DataFrame, s: Settings) -> DataFrame:
        """(id, x, y): places where new pipes may begin.  Chambers with a free side come first (their number is the id); places on
        pipes (ids below 0) are every ``sample_step`` metres and nearest to points, away from such chambers, one for each centimetre."""
        spare = chambers.join(attached.select(F.col("node_id").alias("seq"), "n"), "seq", "left").filter(F.coalesce("n", F.lit(0)) < s.max_degree).select(F.col("seq").alias("id"), "x", "y")
        spots = points.select(F.col("seq").alias("cp_id"), "x", "y")
        on = spatial.tie_candidates(spare, pipes, spots, s.sample_step).filter("source > 1")
        # Numbers below 0 from a hash of the place, so that no order over all places is needed.
        on = on.select((-1 - F.shiftrightunsigned(F.xxhash64("x_cm", "y_cm"), 2)).alias("id"), "x", "y")
        away = spatial.free_candidates(on.select(F.col("id").alias("cp_id"), "x", "y"), spare.select(F.col("id").alias("node_id"), "x", "y"), s.chamber_radius)
        return spare.unionByName(away.select(F.col("cp_id").alias("id"), "x", "y"))

    def targets(self, points: DataFrame, closed: DataFrame, s: Settings, reach: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Where points are reached (id, x, y, flow, tail_x, tail_y): their best exit, or themselves where no building holds them;
        further exits (id, x, y, nth); and warnings for points without any."""
        spots = points.select(F.col("seq").alias("cp_id"), "x", "y")
        owned = regions.owning(spots, closed.filter("rtype = 'oks'"))
        inside = owned.filter("r_id is not null").join(closed.select("r_id", "keep"), "r_id").join(spots, "cp_id")
        wide = max((w for _, w in self.catalogues.envelopes), default=0) / 100
        ways = regions.exits(inside, closed.select("r_id", "rtype", "lines", "area", "keep"), wide, s.most_tail, max(reach, wide))
        best = ways.filter("nth = 1").select("cp_id", "ex", "ey")
        rows = points.select(F.col("seq").alias("cp_id"), "x", "y", "flow").join(owned, "cp_id").join(best, "cp_id", "left")
        found = rows.filter("r_id is null or ex is not null")
        targets = found.select(F.col("cp_id").alias("id"), F.coalesce("ex", "x").alias("x"), F.coalesce("ey", "y").alias("y"), "flow", F.col("x").alias("tail_x"), F.col("y").alias("tail_y"))
        others = ways.filter("nth > 1").select(F.col("cp_id").alias("id"), F.col("ex").alias("x"), F.col("ey").alias("y"), "nth")
        shut = rows.filter("r_id is not null and ex is null").select(F.lit("NO_EXIT").alias("code"), F.col("cp_id").cast("string").alias("message"))
        return targets, others, shut

    # Results.

    def table(self, run: str, what: str) -> DataFrame:
        return self.spark.read.parquet(self.path("runs", run, what))

    def result(self, run: str) -> DataFrame:
        """The planner's own rows."""
        return self.table(run, "plan")

    def collection(self, run: str, zone: int = 37) -> DataFrame:
        """(variant, kind, place, feature): all features of the result, by variant: segments, chambers, technical nodes, a summary."""
        choice = self.table(run, "choice")

        def degrees(p: Column) -> Column:
            lon, lat = S.to_wgs84(p["x"], p["y"], zone)
            return F.struct(lon.alias("x"), lat.alias("y"))

        def spot(p: Column) -> Column:
            lon, lat = S.to_wgs84(p["x"], p["y"], zone)
            return sinks.point(lon, lat)

        def of(df: DataFrame) -> DataFrame:
            return df.join(choice, ["tile", "variant"])

        v = F.concat(F.lit("v"), "k").alias("variant_id")
        told = F.struct("id", F.lit("heat_network").alias("object_type"), v, "start_node_id", "end_node_id", F.col("flow").alias("flow_tph"), F.col("dn").alias("diameter"), "length", "laying_method", "depth_start", "depth_end", "cost")
        rows = of(self.table(run, "segments")).select("k", F.lit(0).alias("kind"), F.col("id").alias("place"), sinks.feature(sinks.line(F.transform("line", degrees)), told).alias("feature"))
        here = F.struct("x", "y")
        told = F.struct("id", F.lit("heat_chamber").alias("object_type"), v, F.col("dn").alias("diameter"), "cost")
        rows = rows.unionByName(of(self.table(run, "places").filter("not existing")).select("k", F.lit(1).alias("kind"), F.col("id").alias("place"), sinks.feature(spot(here), told).alias("feature")))
        told = F.struct("id", F.lit("technical_node").alias("object_type"), v)
        rows = rows.unionByName(of(self.table(run, "joints")).select("k", F.lit(2).alias("kind"), F.col("id").alias("place"), sinks.feature(spot(here), told).alias("feature")))
        rows = rows.unionByName(self.summary_rows(run).select("k", F.lit(3).alias("kind"), F.lit("").alias("place"), F.concat(F.lit('{"type":"Feature","geometry":null,"properties":'), "summary", F.lit("}")).alias("feature")))
        return rows.withColumnRenamed("k", "variant")

    def summary_rows(self, run: str) -> DataFrame:
        """(k, rank, summary): each variant's summary as JSON text.  Its list of unconnected points is one row, as the format asks."""
        text = F.when(F.col("id_is_numeric"), F.col("id")).otherwise(F.to_json(F.array(F.coalesce("id", F.col("seq").cast("string")))))
        bare = F.when(F.col("id_is_numeric"), text).otherwise(F.expr("substring(t, 2, length(t) - 2)"))
        ids = self.table(run, "lost").withColumn("t", text).select(F.struct("seq", bare.alias("t")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("ids"))
        told = F.struct(
            F.concat(F.lit("summary_v"), "k").alias("id"), F.lit("variant_summary").alias("object_type"), F.concat(F.lit("v"), "k").alias("variant_id"), "rank", F.col("k").alias("pass"), F.col("construction").alias("construction_cost"),
            F.col("chambers").alias("chamber_construction_cost"), F.col("tie_ins").alias("existing_chamber_tie_in_count"), F.col("tie_cost").alias("existing_chamber_tie_in_cost"), F.col("penalty").alias("unconnected_penalty"),
            F.col("calculated").alias("calculated_cost"), F.round("length", 6).alias("new_network_length"), "score",
        )
        rows = self.table(run, "summary").withColumn("told", F.to_json(told)).crossJoin(F.broadcast(ids))  # one row beside three
        return rows.select("k", "rank", F.concat(F.expr("substring(told, 1, length(told) - 1)"), F.lit(',"unconnected_oks_ids":['), "ids", F.lit("]}")).alias("summary"))

    def write_files(self, run: str, s: Settings) -> None:
        """result, summary, warnings and grid as files of the run; with ``trace`` each stage as a collection, and a manifest."""
        sinks.write_collection(self.collection(run), self.path("runs", run, "result"), ["variant", "kind", "place"])
        self.summary_rows(run).orderBy("rank").select(F.col("summary").alias("value")).coalesce(1).write.text(self.path("runs", run, "summary-json"))
        self.table(run, "warnings").orderBy("code", "message").write.json(self.path("runs", run, "warnings-json"))
        grid = self.table(run, "plan").filter("note is not null and (startswith(note, 'SEARCHED') or startswith(note, 'REPAIRED'))").select("tile", "note")
        grid.write.json(self.path("runs", run, "grid-json"))
        if not s.trace:
            return
        stages = {"points": "x, y, id", "chambers": "x, y, id", "ties": "x, y, id", "targets": "x, y, id"}
        found = []
        for name, columns in stages.items():
            rows = self.table(run, name).selectExpr(*columns.split(", "))
            lon, lat = S.to_wgs84(F.col("x"), F.col("y"))
            found.append((name, self.stage(run, name, rows.select(sinks.feature(sinks.point(lon, lat), F.struct("id", F.lit(name).alias("object_type"))).alias("feature"), F.xxhash64("id", "x", "y").alias("o")))))
        degrees = lambda line: F.transform(line, lambda p: F.struct(S.to_wgs84(p["x"], p["y"])[0].alias("x"), S.to_wgs84(p["x"], p["y"])[1].alias("y")))
        shapes = self.table(run, "restrictions").select(F.explode("lines").alias("line"), "r_id", "rtype", "mode")
        found.append(("restrictions", self.stage(run, "restrictions", shapes.select(sinks.feature(sinks.line(degrees(F.col("line"))), F.struct("r_id", "rtype", "mode")).alias("feature"), F.xxhash64("r_id", "line").alias("o")))))
        for k in (1, 2, 3):
            rows = self.table(run, "plan").filter((F.col("variant") == k) & F.col("edge").isNotNull())
            if not rows.isEmpty():
                found.append((f"pass-{k}", self.stage(run, f"pass-{k}", rows.select(sinks.feature(sinks.line(degrees(F.col("line"))), F.struct("tile", "edge", "parent", "flow")).alias("feature"), F.xxhash64("tile", "edge").alias("o")))))
        manifest = json.dumps({"run": run, "stages": [{"id": n, "features": k} for n, k in found]})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(self.path("runs", run, "stages", "manifest"))

    def stage(self, run: str, name: str, features: DataFrame) -> int:
        sinks.write_collection(features, self.path("runs", run, "stages", name), ["o"])
        return features.count()

    def stages(self, run: str) -> list[dict]:
        """What was traced: ids and numbers of features; empty without a trace."""
        try:
            text = self.spark.read.text(self.path("runs", run, "stages", "manifest")).first()["value"]
        except Exception as e:  # Spark says in words that a path is not there
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return json.loads(text)["stages"]

    def stage_text(self, run: str, name: str) -> str:
        """One traced stage's collection, as text."""
        if name not in {s["id"] for s in self.stages(run)}:
            raise ValueError(f"no stage {name}")
        return "".join(r["value"] for r in self.spark.read.text(self.path("runs", run, "stages", name)).select("value", F.input_file_name().alias("f")).orderBy("f").collect())

    def export(self, run: str, path: str, zone: int = 37) -> None:
        """The run's result as one GeoJSON collection elsewhere."""
        sinks.write_collection(self.collection(run, zone), path, ["variant", "kind", "place"])

    # Runs.

    def runs(self, dataset: str) -> DataFrame:
        """Runs of a data set, newest first."""
        rows = self.spark.read.schema(RUNS).parquet(self.path("meta"))
        return rows.filter(F.col("dataset_id") == dataset).orderBy(F.desc("created_at"), "run_id")

    def run_info(self, run: str) -> dict | None:
        """What is kept about one run; None if there is none of that name."""
        self.path(run)
        row = self.spark.read.schema(RUNS).parquet(self.path("meta")).filter(F.col("run_id") == run).first()
        return row.asDict() if row else None

    def progress(self, run: str) -> DataFrame:
        """(run_id, seq, stage, progress, ts) of a run, in order."""
        rows = self.spark.read.schema("run_id string, seq int, stage string, progress int, ts double").json(self.path("events"))
        return rows.filter(F.col("run_id") == run).orderBy("seq")

    def incidence(self, run: str) -> DataFrame:
        """(variant, node_id, before, after): the segments that end and begin at each node."""
        rows = self.table(run, "segments").join(self.table(run, "choice"), ["tile", "variant"])
        ends = rows.select("k", F.inline(F.array(F.struct(F.col("start_node_id").alias("node_id"), F.lit(None).cast("string").alias("before"), F.col("id").alias("after")), F.struct(F.col("end_node_id").alias("node_id"), F.col("id").alias("before"), F.lit(None).cast("string").alias("after")))))
        return ends.groupBy(F.col("k").alias("variant"), "node_id").agg(F.sort_array(F.collect_list("before")).alias("before"), F.sort_array(F.collect_list("after")).alias("after"))

    def compared(self, run: str) -> DataFrame:
        """Each variant beside the best: costs, lengths and scores, and how far they are off."""
        rows = self.table(run, "summary")
        best = rows.filter("rank = 1").select(F.col("calculated").alias("least_cost"), F.col("length").alias("best_length"), F.col("score").alias("best_score"))  # one row
        return rows.crossJoin(F.broadcast(best)).select("k", "rank", "calculated", "length", "score", (F.col("calculated") - F.col("least_cost")).alias("cost_more"), F.round(F.col("length") - F.col("best_length"), 6).alias("length_more"), F.round(F.col("score") - F.col("best_score"), 9).alias("score_more")).orderBy("rank")


__all__ = ["Engine", "Settings"]
