"""Progress of runs as a stream: the latest stage and the greatest progress of each run, and its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = "run_id long, seq int, ts timestamp, stage string, progress int"


def read_events(spark: SparkSession, path: str, schema: str | StructType = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """(run_id, stage, shown, events): keyed state of one row a run; works on streams and tables alike."""
    return events.groupBy("run_id").agg(F.max_by("stage", "seq").alias("stage"), F.greatest(F.lit(0), F.least(F.lit(100), F.max("progress"))).alias("shown"), F.count("*").alias("events"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, stage, events, mean progress) with events up to ``late`` behind the newest."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("events"), F.sum("progress").alias("progress"))


def status(done: DataFrame, unconnected: DataFrame) -> DataFrame:
    """DONE, or PARTIAL where a run left points unconnected."""
    lost = unconnected.groupBy("run_id").agg(F.count("*").alias("lost"))
    return done.join(lost, "run_id", "left").select("run_id", F.when(F.coalesce("lost", F.lit(0)) > 0, "PARTIAL").when(F.col("shown") >= 100, "DONE").when(F.col("events") > 0, "RUNNING").otherwise("PENDING").alias("status"))
