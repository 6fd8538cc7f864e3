"""Reading and writing of the catalogue tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKET_COUNT = 512
FILE_ROWS = 5_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location of the session. Only a session in one
    JVM may name none and gets a local one; executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "mediaplan")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to shared storage and read it back: cuts the lineage and survives
    the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_table(df: DataFrame, path: str, project: str = "project_id",
               buckets: int = BUCKET_COUNT, mode: str = "overwrite", salts: int = 8) -> None:
    """Parquet, one folder per bucket of projects, so that reads of some projects
    prune folders. Rows are spread by bucket and row, not by project alone: one
    large project does not end up in a single task, and a bucket has at most ``salts`` files
    (more only where a file would pass ``FILE_ROWS``)."""
    bucket = F.pmod(F.xxhash64(project), F.lit(buckets)).cast("int")
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    (df.withColumn("project_bucket", bucket)
     .repartition("project_bucket", F.pmod(F.xxhash64(*plain), F.lit(salts)))
     .write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("project_bucket").parquet(path))


def load_table(spark: SparkSession, path: str, projects: list | None = None,
               project: str = "project_id", buckets: int = BUCKET_COUNT) -> DataFrame:
    """Read a saved table; given project keys prune to their folders."""
    df = spark.read.parquet(path)
    if projects is not None:
        wanted = spark.createDataFrame([(p,) for p in projects], [project]).select(
            F.col(project).cast(dict(df.dtypes)[project]).alias(project))
        keys = [r[0] for r in wanted.select(
            F.pmod(F.xxhash64(project), F.lit(buckets)).cast("int")).distinct().collect()]
        df = df.filter(F.col("project_bucket").isin(keys)).filter(
            F.col(project).isin(list(projects)))
    return df.drop("project_bucket")


def log_replacements(df: DataFrame, path: str) -> None:
    """Append the history of replaced segments; never rewrites earlier rows."""
    (df.select("plan_id", "seg_no", "old_scene_id", "new_scene_id", "replaced_at")
     .write.mode("append").parquet(path))
