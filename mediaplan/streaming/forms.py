"""Streaming forms: files that arrive, states that change, loudness and pauses over time.

Each takes a streaming frame, a sink folder and a checkpoint folder, works through what is
there (``availableNow``) and gives back what the sink holds. State is bounded by the
watermark, or by the number of projects."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What is at a path; nothing if nothing has been written there yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def _finish(query, path: str) -> DataFrame:
    query.awaitTermination()
    return SparkSession.active().read.parquet(path)


def arrivals(files: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Takes in each fingerprint once, ever. ``files``: file_id, path, fingerprint. A batch
    is checked against the table itself, so a batch run again adds nothing; it reads only the folders of
    its own ``buckets`` of fingerprints."""
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int")

    def take(batch: DataFrame, _: int) -> None:
        first = batch.groupBy("fingerprint").agg(F.min(F.struct("file_id", "path")).alias("f")).select(
            "fingerprint", "f.file_id", "f.path", bucket.alias("bucket"))
        touched = [r.bucket for r in first.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        known = _stored(batch.sparkSession, path, first).filter(F.col("bucket").isin(touched)).select("fingerprint")
        (first.join(known, "fingerprint", "left_anti").repartition("bucket")
         .write.mode("append").partitionBy("bucket").parquet(path))

    return _finish(files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start(), path).drop("bucket")


def latest_status(events: DataFrame, path: str, checkpoint: str, every: int = 20) -> DataFrame:
    """The last status of every project. ``events``: project_id, status, ts, event_id. Every
    batch writes the projects it changed to a folder of its own, over what an earlier try left there. After
    each ``every`` batches the newest rows go to a base of one row a project; readers take the last base and
    the batches behind it, so a read costs the projects and a few batches however long the stream runs."""
    last = events.groupBy("project_id").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("m"))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("project_id", "m.*")
        rows.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        if (number + 1) % every == 0:
            _newest(batch.sparkSession, path, rows).write.mode("overwrite").parquet(f"{path}/base/upto={number}")

    like = last.select("project_id", "m.*")
    (last.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return _newest(events.sparkSession, path, like).select("project_id", "status")


def _newest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    shape = like.limit(0)
    base = _stored(spark, f"{path}/base", shape.withColumn("upto", F.lit(0).cast("long")))
    log = _stored(spark, f"{path}/log", shape.withColumn("batch", F.lit(0).cast("long")))
    upto = base.agg(F.max("upto")).first()[0]
    rows = log
    if upto is not None:
        rows = base.filter(F.col("upto") == upto).select(*like.columns).unionByName(
            log.filter(F.col("batch") > upto).select(*like.columns))
    return rows.groupBy("project_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m")).select("project_id", "m.*")


def tumbling_energy(samples: DataFrame, path: str, checkpoint: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mean loudness per track and window; rows later than ``delay`` are dropped and a
    window appears once the watermark has passed its end. ``samples``: track_id, ts, rms."""
    out = (samples.withWatermark("ts", delay).groupBy("track_id", F.window("ts", size).alias("w"))
           .agg(F.avg("rms").alias("energy"), F.count("*").alias("samples"))
           .select("track_id", F.col("w.start").alias("w_start"), "energy", "samples"))
    return _finish(out.writeStream.outputMode("append").format("parquet").option("path", path)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), path)


def freeze_episodes(samples: DataFrame, path: str, checkpoint: str, max_diff: float = 2.0, gap: str = "6 hours",
                    delay: str = "1 hour") -> DataFrame:
    """Episodes of a still picture per video: still samples less than ``gap`` apart.
    ``samples``: video_id, ts, diff. For samples at a steady rate this is the batch rule; an
    episode here ends by time alone, not by a moving sample in between."""
    still = samples.filter(F.col("diff") < max_diff).withWatermark("ts", delay)
    out = (still.groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("samples"))
           .select("video_id", F.col("w.start").alias("e_start"), F.col("w.end").alias("e_end"), "samples"))
    return _finish(out.writeStream.outputMode("append").format("parquet").option("path", path)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), path)
