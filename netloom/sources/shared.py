"""Tables in the folder that driver and executors share: where lineage ends, and a lost executor costs one step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        own = tempfile.mkdtemp(prefix="netloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables of one operator, which go when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.counted(df, name)[0]

    def counted(self, df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
        """The table, and measures of its rows (their number, if no other are named) taken as they were written."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        seen = Observation()
        df.observe(seen, *(measures or (F.count(F.lit(1)).alias("n"),))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def drop(self, *names: str) -> None:
        """Remove these tables; all if none is named."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, ()):
                removed(self.spark, path)


def removed(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
