"""Queries for the streaming forms (group W), run to the end of the given tables."""

from pyspark.sql import functions as F

from mediaplan.sources.tables import scratch_path
from mediaplan.streaming import forms as W
from .fixtures import FILE_COLS, exprs
from .registry import query


def stream(fx, name):
    # a pattern, as a plain path must be a folder: a table is one file or a folder of them
    return fx.spark.readStream.schema(fx.table(name).schema).parquet(f"{fx.dir}/{name}[.]parquet")


def events(fx):
    return stream(fx, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def places(fx, name):
    return scratch_path(fx.spark, name), scratch_path(fx.spark, f"{name}-checkpoint")


@query("W1_arrivals", "SELECT fingerprint, MIN(file_id) AS file_id FROM fx_files GROUP BY 1")
def arrivals(fx):
    return W.arrivals(stream(fx, "pages").selectExpr(*exprs(FILE_COLS)), *places(fx, "arrivals")).select("fingerprint", "file_id")


@query("W2_latest_status", "SELECT user_id AS project_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status FROM events GROUP BY 1")
def latest(fx):
    return W.latest_status(events(fx).selectExpr("user_id AS project_id", "event_type AS status", "ts", "event_id"), *places(fx, "status"))


@query("W3_tumbling_energy", """SELECT user_id AS track_id, epoch_us(date_trunc('day', ts)) AS w_start_us, round(AVG(value) + 1e-9, 6) AS energy, COUNT(*) AS samples FROM events
 GROUP BY user_id, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)""")
def energy(fx):
    out = W.tumbling_energy(events(fx).selectExpr("user_id AS track_id", "ts", "value AS rms"), *places(fx, "energy"))
    return out.select("track_id", F.unix_micros("w_start").alias("w_start_us"), F.round(F.col("energy") + 1e-9, 6).alias("energy"), "samples")


@query("W4_freeze_episodes", """WITH s AS (SELECT user_id AS video_id, ts FROM events WHERE value < 3e1), o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY video_id ORDER BY ts)),
 g AS (SELECT *, SUM(n) OVER (PARTITION BY video_id ORDER BY ts) AS e FROM o)
 SELECT video_id, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts) + INTERVAL 6 HOURS) AS end_us, COUNT(*) AS samples FROM g GROUP BY video_id, e
 HAVING MAX(ts) + INTERVAL 6 HOURS <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM s)""")
def episodes(fx):
    out = W.freeze_episodes(events(fx).selectExpr("user_id AS video_id", "ts", "value AS diff"), *places(fx, "episodes"), max_diff=30.0)
    return out.select("video_id", F.unix_micros("e_start").alias("start_us"), F.unix_micros("e_end").alias("end_us"), "samples")
