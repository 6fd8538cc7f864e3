"""Queries for frame and motion signals (group Q)."""

from pyspark.sql import functions as F

from mediaplan.operators import signals as Q
from .ranking import CHECK_SQL, clock20
from .registry import query


@query("Q1_sample_times", """SELECT scene_id, i - 1 AS burst, round(start_s + i * (end_s - start_s) / 5 + 1e-9, 6) AS t
 FROM fx_scenes, range(1, 5) r(i)""")
def sample_times(fx):
    return Q.sample_times(fx.scenes, 4).select(
        "scene_id", "burst", F.round(F.col("t") + 1e-9, 6).alias("t"))


@query("Q2_change_profile", """WITH l AS (SELECT video_id, frame_no, embedding AS e, lag(embedding) OVER (PARTITION BY video_id ORDER BY frame_no) AS p,
  COUNT(*) OVER (PARTITION BY video_id) AS c FROM fx_frames)
 SELECT video_id, frame_no - 1 AS sample_no, round((frame_no - 5e-1) / 8 + 1e-9, 6) AS t,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(e[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) / 64 + 1e-9, 6) AS diff FROM l WHERE p IS NOT NULL AND c >= 3""")
def change_profile(fx):
    frames = fx.frames.selectExpr("video_id", "frame_no", "embedding AS luma")
    return Q.change_profile(frames).select(
        "video_id", "sample_no", F.round(F.col("t") + 1e-9, 6).alias("t"),
        F.round(F.col("diff") + 1e-9, 6).alias("diff"))


@query("Q3_frame_measures", """WITH px AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, CAST(embedding[k + 1] AS DOUBLE) * 100 AS v FROM embeddings, range(0, 64) r(k)),
 nb AS (SELECT vec_id, y, x, v, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS up, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS dn,
  CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS lf, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS rt FROM px),
 lap AS (SELECT n.vec_id, n.v, a.v + b.v + c.v + d.v - 4 * n.v AS l FROM nb n
  JOIN px a ON a.vec_id = n.vec_id AND a.y = n.up AND a.x = n.x JOIN px b ON b.vec_id = n.vec_id AND b.y = n.dn AND b.x = n.x
  JOIN px c ON c.vec_id = n.vec_id AND c.y = n.y AND c.x = n.lf JOIN px d ON d.vec_id = n.vec_id AND d.y = n.y AND d.x = n.rt)
 SELECT vec_id, round(var_pop(l) + 1e-9, 5) AS sharpness, round(avg(v) + 1e-9, 6) + 0e0 AS brightness FROM lap GROUP BY vec_id""")
def frame_measures(fx):
    frames = fx.table("embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("luma"))
    return Q.frame_measures(frames, 8, 8).select(
        "vec_id", (F.round(F.col("sharpness") + 1e-9, 5)).alias("sharpness"),
        (F.round(F.col("brightness") + 1e-9, 6) + 0.0).alias("brightness"))


MEASURE_SQL = "SELECT l_orderkey AS scene_id, l_quantity * 4 AS sharpness, l_extendedprice / 4e2 AS brightness FROM lineitem"


def measures(fx):
    return fx.table("lineitem").selectExpr(
        "l_orderkey AS scene_id", "l_quantity * 4 AS sharpness", "l_extendedprice / 4e2 AS brightness")


@query("Q4_scene_measures", f"""SELECT scene_id, round(quantile_cont(sharpness, 5e-1) + 1e-9, 6) AS sharpness,
 round(quantile_cont(brightness, 5e-1) + 1e-9, 6) AS brightness FROM ({MEASURE_SQL}) m GROUP BY scene_id""")
def scene_measures(fx):
    m = Q.scene_measures(measures(fx))
    return m.select("scene_id", F.round(F.col("sharpness") + 1e-9, 6).alias("sharpness"),
                    F.round(F.col("brightness") + 1e-9, 6).alias("brightness"))


VECTOR_SQL = """SELECT CAST(video_id AS VARCHAR) || '/' || CAST(n // 12 AS VARCHAR) AS scene_id, n // 3 % 4 AS burst, n % 3 AS k, dx, dy,
 CASE WHEN n % 3 = 0 THEN (event_id % 17 - 8) / 1e0 END AS radial FROM fx_samples"""
FLOW_SQL = f"""vec AS ({VECTOR_SQL}),
 sc AS (SELECT DISTINCT CAST(video_id AS VARCHAR) || '/' || CAST(n // 12 AS VARCHAR) || CASE WHEN n % 12 = 0 AND n > 48 THEN '/empty' ELSE '' END AS scene_id FROM fx_samples),
 lagged AS (SELECT *, sqrt(dx * dx + dy * dy) AS norm, lag(dx) OVER w AS px, lag(dy) OVER w AS py, lag(sqrt(dx * dx + dy * dy)) OVER w AS pn
  FROM vec WINDOW w AS (PARTITION BY scene_id, burst ORDER BY k)),
 st AS (SELECT scene_id, quantile_cont(norm, 5e-1) AS speed, quantile_cont(sqrt((dx - px) * (dx - px) + (dy - py) * (dy - py)), 75e-2) AS accel,
  COUNT(CASE WHEN norm > 15e-1 AND pn > 15e-1 AND dx * px + dy * py < 0 THEN 1 END) AS fl, COUNT(px) AS pairs, quantile_cont(radial, 5e-1) AS radial
  FROM lagged GROUP BY scene_id),
 stats AS (SELECT sc.scene_id, speed, coalesce(accel, 0e0) AS accel, CASE WHEN pairs > 0 THEN fl / CAST(pairs AS DOUBLE) ELSE 0e0 END AS flip_ratio, coalesce(radial, 0e0) AS radial
  FROM sc LEFT JOIN st ON sc.scene_id = st.scene_id),
 jerk AS (SELECT *, CASE WHEN speed IS NULL THEN 0e0 ELSE least(5e-1 * least(accel / 14e0, 2e0) + 3e-1 * least(flip_ratio / 4e-1, 2e0) + 2e-1 * least(speed / 45e0, 2e0), 2e0) / 2e0 END AS jerkiness,
  CASE WHEN speed IS NULL OR speed * 30 < 8 THEN 'static' WHEN speed * 30 < 120 THEN 'slow' ELSE 'fast' END AS motion FROM stats),
 cls AS (SELECT *, CASE WHEN motion = 'static' THEN 'none' WHEN jerkiness >= 5e-1 THEN 'shake'
   WHEN abs(radial) > 5e-1 * speed AND speed > 1 AND radial > 0 THEN 'zoom_in' WHEN abs(radial) > 5e-1 * speed AND speed > 1 THEN 'zoom_out' ELSE 'pan' END AS motion_type,
  greatest(least(1e0 - jerkiness, 1e0), 0e0) AS stability FROM jerk)"""


def vectors(fx):
    return fx.samples.selectExpr(
        "concat_ws('/', video_id, n div 12) AS scene_id", "n div 3 % 4 AS burst", "n % 3 AS k", "dx", "dy",
        "CASE WHEN n % 3 = 0 THEN (event_id % 17 - 8) / 1e0 END AS radial")


def flow_scenes(fx):
    """Scenes of the vectors, and some in which no vector was found."""
    return fx.samples.selectExpr(
        "concat(video_id, '/', n div 12, CASE WHEN n % 12 = 0 AND n > 48 THEN '/empty' ELSE '' END) AS scene_id").distinct()


def classified(fx):
    return Q.classify_motion(Q.flow_stats(flow_scenes(fx), vectors(fx)))


@query("Q5_flow_stats", f"""WITH {FLOW_SQL} SELECT scene_id, round(speed + 1e-9, 6) AS speed, round(accel + 1e-9, 6) AS accel,
 round(flip_ratio + 1e-9, 6) AS flip_ratio, radial FROM stats""")
def flow_stats(fx):
    s = Q.flow_stats(flow_scenes(fx), vectors(fx))
    return s.select("scene_id", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("speed", "accel", "flip_ratio")], "radial")


@query("Q6_motion_class", f"WITH {FLOW_SQL} SELECT scene_id, motion FROM cls")
def motion_class(fx):
    return classified(fx).select("scene_id", "motion")


@query("Q7_jerkiness", f"WITH {FLOW_SQL} SELECT scene_id, round(jerkiness + 1e-9, 6) AS jerkiness, round(stability + 1e-9, 6) AS stability FROM cls")
def jerkiness(fx):
    return classified(fx).select("scene_id", F.round(F.col("jerkiness") + 1e-9, 6).alias("jerkiness"),
                                 F.round(F.col("stability") + 1e-9, 6).alias("stability"))


@query("Q8_motion_type", f"WITH {FLOW_SQL} SELECT scene_id, motion_type FROM cls")
def motion_type(fx):
    return classified(fx).select("scene_id", "motion_type")


QUALITY_SQL = f"""m AS (SELECT scene_id, quantile_cont(sharpness, 5e-1) AS sharpness, quantile_cont(brightness, 5e-1) AS brightness FROM ({MEASURE_SQL}) x GROUP BY scene_id),
 j AS (SELECT s.scene_id, s.motion, s.motion_type, s.stability_score AS stability, m.sharpness, m.brightness FROM fx_scenes s JOIN m ON s.scene_id = m.scene_id),
 q AS (SELECT *, round((45e-2 * least(sharpness / 150e0, 1e0) + 25e-2 * CASE WHEN brightness < 35 THEN greatest(brightness / 35e0, 1e-1)
   WHEN brightness > 225 THEN greatest((255e0 - brightness) / 30e0, 1e-1) ELSE 1e0 END + 3e-1 * stability)
  * CASE WHEN motion_type = 'shake' THEN 5e-1 WHEN motion = 'fast' AND sharpness < 100 THEN 7e-1 ELSE 1e0 END + 1e-9, 3) AS quality_score FROM j)"""


def measured(fx):
    s = fx.scenes.selectExpr("scene_id", "motion", "motion_type", "stability_score AS stability")
    return Q.quality_score(s.join(Q.scene_measures(measures(fx)), "scene_id"))


@query("Q9_quality_score", f"WITH {QUALITY_SQL} SELECT scene_id, quality_score FROM q")
def quality(fx):
    return measured(fx).select("scene_id", "quality_score")


@query("Q10_keyframes", """WITH r AS (SELECT scene_id, t, ROW_NUMBER() OVER (PARTITION BY scene_id ORDER BY sharpness DESC, sample_no DESC) AS k
  FROM (SELECT plan_id AS scene_id, seg_no AS sample_no, seg_no * 25e-2 AS t, floor(src_end - src_start) AS sharpness FROM fx_segments) s)
 SELECT scene_id, MIN(t) AS best_moment, MAX(t) AS last_keyframe, COUNT(*) AS keyframes FROM r WHERE k <= 2 GROUP BY scene_id""")
def keyframes(fx):
    return Q.keyframes(fx.segments.selectExpr(
        "plan_id AS scene_id", "seg_no AS sample_no", "seg_no * 25e-2 AS t", "floor(src_end - src_start) AS sharpness"))


@query("Q11_reject_low_quality", f"""WITH {QUALITY_SQL} SELECT scene_id, quality_score,
 CASE WHEN motion_type = 'shake' THEN 'new,jerky' ELSE 'new' END AS tags FROM q WHERE quality_score >= 25e-2""")
def reject(fx):
    kept = Q.reject_low_quality(measured(fx).withColumn("tags", F.array(F.lit("new"))))
    return kept.select("scene_id", "quality_score", F.array_join("tags", ",").alias("tags"))


@query("Q12_window_motion", f"""WITH windows AS (SELECT scene_id AS window_id, video_id, start_s AS a, end_s AS b, motion = 'fast' AS allow_fast FROM fx_scenes),
 {CHECK_SQL} SELECT window_id, ok, badness FROM verdict""")
def window_motion(fx):
    windows = fx.scenes.selectExpr("scene_id AS window_id", "video_id", "start_s AS a", "end_s AS b", "motion = 'fast' AS allow_fast")
    return Q.window_motion(windows, clock20(fx))


SMOOTH_SQL = """sm AS (SELECT video_id, n, t8 AS t, SUM(diff / 20) OVER (PARTITION BY video_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4e0 AS smooth FROM fx_samples)"""


def clock8(fx):
    return fx.samples.selectExpr("video_id", "n", "t8 AS t", "diff / 20 AS diff")


@query("Q13_smooth_same", f"WITH {SMOOTH_SQL} SELECT video_id, n, round(smooth + 1e-9, 6) AS smooth FROM sm")
def smooth(fx):
    return Q.smooth_same(clock8(fx), "diff", 4).select(
        "video_id", "n", F.round(F.col("smooth") + 1e-9, 6).alias("smooth"))


@query("Q14_freeze_spans", f"""WITH {SMOOTH_SQL.replace("diff / 20", "diff / 40")},
 f AS (SELECT *, smooth < 2 AS h, SUM(CASE WHEN smooth < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY n) AS g,
  lead(t) OVER (PARTITION BY video_id ORDER BY n) AS nt FROM sm),
 r AS (SELECT video_id, g, MIN(t) AS f_start, MAX(coalesce(nt, t)) AS f_end FROM f WHERE h GROUP BY 1, 2)
 SELECT video_id, f_start, f_end FROM r WHERE f_end - f_start >= 25e-1""")
def freeze(fx):
    return Q.freeze_spans(fx.samples.selectExpr("video_id", "n", "t8 AS t", "diff / 40 AS diff"))
