"""Queries for interval algebra (group V)."""

from pyspark.sql import functions as F

from mediaplan.functions.expr import rnd
from mediaplan.operators import intervals as V, ranking as R
from .ranking import INTEREST_SQL, detected
from .registry import query


def merge_sql(src: str, key: str, lo: str, hi: str, gap: str) -> str:
    return f"""SELECT {key}, MIN({lo}) AS {lo}, MAX({hi}) AS {hi} FROM (
  SELECT *, SUM(opens) OVER (PARTITION BY {key} ORDER BY {lo}, {hi}, rid) AS island FROM (
   SELECT *, CASE WHEN reach IS NULL OR {lo} - reach > {gap} THEN 1 ELSE 0 END AS opens FROM (
    SELECT *, MAX({hi}) OVER (PARTITION BY {key} ORDER BY {lo}, {hi}, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT {key}, {lo}, {hi}, ROW_NUMBER() OVER () AS rid FROM {src} WHERE {hi} >= {lo}) q0) q1) q2) q3 GROUP BY {key}, island"""


@query("V1_merge_spans", merge_sql("fx_segments", "plan_id", "src_start", "src_end", "5e-1"))
def merge(fx):
    return V.merge_spans(fx.segments, ["plan_id"], "src_start", "src_end", 0.5)


def people(fx):
    return R.interest(fx.scenes, detected(fx))


SUBJECT_SQL = f"""people AS ({INTEREST_SQL}),
 subj AS (SELECT video_id, start_s AS s_start, end_s AS s_end FROM people WHERE has_person),
 subject_spans AS ({merge_sql("subj", "video_id", "s_start", "s_end", "2e0")}),
 still AS (SELECT video_id, start_s AS f_start, end_s AS f_end FROM people WHERE motion = 'static' AND NOT has_person),
 frozen_spans AS (SELECT * FROM ({merge_sql("still", "video_id", "f_start", "f_end", "5e-1")}) m WHERE f_end - f_start >= 25e-1)"""


@query("V2_subject_spans", f"WITH {SUBJECT_SQL} SELECT * FROM subject_spans")
def subject(fx):
    return V.subject_spans(people(fx))


@query("V3_frozen_scene_spans", f"WITH {SUBJECT_SQL} SELECT * FROM frozen_spans")
def frozen(fx):
    return V.frozen_scene_spans(people(fx))


# zones of a video, and the slow scenes inside them moved by three seconds
PIECES_SQL = f"""cut AS (SELECT video_id, start_s + 3 AS lo, end_s + 3 AS hi FROM fx_scenes WHERE motion = 'slow'),
 solid AS ({merge_sql("cut", "video_id", "lo", "hi", "0e0")}),
 clip AS (SELECT z.video_id, z.zone_no, z.z_start, z.z_end, greatest(z.z_start, s.lo) AS lo, least(z.z_end, s.hi) AS hi FROM fx_zones z
  JOIN solid s ON s.video_id = z.video_id AND s.hi > z.z_start AND s.lo < z.z_end),
 edge AS (SELECT video_id, zone_no, z_end, hi AS p_lo, lead(lo) OVER (PARTITION BY video_id, zone_no ORDER BY lo) AS nxt FROM clip
  UNION ALL SELECT z.video_id, z.zone_no, z.z_end, z.z_start, (SELECT MIN(lo) FROM clip c WHERE c.video_id = z.video_id AND c.zone_no = z.zone_no) FROM fx_zones z),
 outside AS (SELECT video_id, zone_no, p_lo, coalesce(nxt, z_end) AS p_hi FROM edge WHERE p_lo < coalesce(nxt, z_end))"""


def cut(fx):
    return fx.scenes.filter("motion = 'slow'").selectExpr("video_id", "start_s + 3 AS lo", "end_s + 3 AS hi")


@query("V4_subtract_spans", f"WITH {PIECES_SQL} SELECT * FROM outside WHERE p_hi - p_lo >= 4e-1")
def subtract(fx):
    base = fx.zones.select("video_id", "zone_no", "z_start", "z_end")
    return V.subtract_spans(base, cut(fx), ["video_id"], ("z_start", "z_end"), ("lo", "hi")).select(
        "video_id", "zone_no", "p_lo", "p_hi")


@query("V5_split_by_spans", f"""WITH {PIECES_SQL} SELECT *, false AS inside FROM outside
 UNION ALL SELECT video_id, zone_no, lo, hi, true FROM clip""")
def split(fx):
    base = fx.zones.select("video_id", "zone_no", "z_start", "z_end")
    solid = V.merge_spans(cut(fx), ["video_id"], "lo", "hi", 0.0)
    return V.split_by_spans(base, solid, ["video_id"], ("z_start", "z_end"), ("lo", "hi")).select(
        "video_id", "zone_no", "p_lo", "p_hi", "inside")


@query("V6_net_length", """WITH r AS (SELECT video_id, MIN(z_start) AS r_lo, MAX(z_end) - 4 AS r_hi FROM fx_zones GROUP BY video_id),
 t AS (SELECT video_id, start_s + 3 AS t_lo, end_s + 3 AS t_hi FROM fx_scenes WHERE motion = 'fast'),
 c AS (SELECT scene_id AS span_id, s.video_id, greatest(start_s, r_lo) AS lo, least(end_s, r_hi) AS hi FROM fx_scenes s JOIN r ON s.video_id = r.video_id)
 SELECT span_id, video_id, CASE WHEN lo < hi THEN greatest(hi - lo - coalesce((SELECT SUM(greatest(least(hi, t_hi) - greatest(lo, t_lo), 0e0)) FROM t WHERE t.video_id = c.video_id), 0e0), 0e0) ELSE 0e0 END AS net_len FROM c""")
def net_length(fx):
    s = fx.scenes
    spans = s.selectExpr("scene_id AS span_id", "video_id", "start_s AS lo", "end_s AS hi")
    routes = fx.zones.groupBy("video_id").agg(F.min("z_start").alias("r_lo"), (F.max("z_end") - 4).alias("r_hi"))
    tech = s.filter("motion = 'fast'").selectExpr("video_id", "start_s + 3 AS t_lo", "end_s + 3 AS t_hi")
    return V.net_length(spans, routes, tech)


def windows(fx):
    return fx.zones.selectExpr("concat_ws('/', video_id, zone_no) AS window_id", "video_id", "z_start + 5 AS a", "z_end + 5 AS b")


WINDOW_SQL = "w AS (SELECT CAST(video_id AS VARCHAR) || '/' || CAST(zone_no AS VARCHAR) AS window_id, video_id, z_start + 5 AS a, z_end + 5 AS b FROM fx_zones)"


@query("V7_overlap_len", f"""WITH {WINDOW_SQL} SELECT window_id, coalesce(SUM(greatest(least(b, end_s) - greatest(a, start_s), 0e0)), 0e0) AS overlap
 FROM w LEFT JOIN fx_scenes s ON w.video_id = s.video_id GROUP BY window_id""")
def overlap_len(fx):
    return V.overlap_len(windows(fx), fx.scenes.selectExpr("video_id", "start_s AS lo", "end_s AS hi"))


@query("V8_weighted_overlap", f"""WITH {WINDOW_SQL}, o AS (SELECT window_id, greatest(least(b, end_s) - greatest(a, start_s), 0e0) AS ov, quality_score AS q
  FROM w LEFT JOIN fx_scenes s ON w.video_id = s.video_id)
 SELECT window_id, CASE WHEN SUM(ov) > 0 THEN round(SUM(ov * q) / SUM(ov) + 1e-9, 6) ELSE 0e0 END AS mean FROM o GROUP BY window_id""")
def weighted(fx):
    return V.weighted_overlap(windows(fx), fx.scenes, "quality_score").select("window_id", rnd("mean", 6).alias("mean"))


@query("V9_scene_at", """WITH p AS (SELECT CAST(video_id AS VARCHAR) || '/' || CAST(zone_no AS VARCHAR) AS point_id, video_id, z_end - 5e-1 + zone_no % 3 * 7e0 AS t FROM fx_zones),
 h AS (SELECT point_id, arg_min(scene_id, struct_pack(a := start_s, b := scene_id)) AS scene_id FROM p JOIN fx_scenes s ON p.video_id = s.video_id AND start_s <= t AND t < end_s GROUP BY point_id),
 l AS (SELECT video_id, arg_max(scene_id, struct_pack(a := start_s, b := scene_id)) AS scene_id FROM fx_scenes GROUP BY video_id)
 SELECT p.point_id, coalesce(h.scene_id, l.scene_id) AS scene_id FROM p LEFT JOIN h ON p.point_id = h.point_id LEFT JOIN l ON p.video_id = l.video_id""")
def scene_at(fx):
    points = fx.zones.selectExpr("concat_ws('/', video_id, zone_no) AS point_id", "video_id", "z_end - 5e-1 + zone_no % 3 * 7e0 AS t")
    return V.scene_at(points, fx.scenes)


def ranges_sql(src: str, key: str, cond: str) -> str:
    return f"""SELECT {key}, CAST(MIN(sec) AS DOUBLE) AS r_start, CAST(MAX(sec) + 1 AS DOUBLE) AS r_end FROM (
  SELECT *, sec - ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY sec) AS grp FROM {src} WHERE {cond}) q GROUP BY {key}, grp HAVING COUNT(*) >= 2"""


@query("V10_threshold_ranges", f"WITH v AS (SELECT video_id, n AS sec, rms FROM fx_samples) {ranges_sql('v', 'video_id', 'rms >= 40')}")
def threshold(fx):
    return V.threshold_ranges(fx.samples.selectExpr("video_id", "n AS sec", "rms"), ["video_id"], F.col("rms") >= 40)
