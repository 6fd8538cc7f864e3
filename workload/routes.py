"""Queries for route zones and timing (group Z)."""

import re

from pyspark.sql import functions as F

from mediaplan.functions.expr import rnd
from mediaplan.operators import catalogue as C, intervals as V, signals as Q, spans as S
from mediaplan.plans import routes as Z
from mediaplan.sources.tables import keep
from .annotate import range_replies
from .intervals import SUBJECT_SQL, merge_sql, people
from .music import FINISH_SQL, curve
from .ranking import CHECK_SQL, INTEREST_SQL
from .registry import query
from .spans import views

RANGE_SQL = """rg AS (SELECT video_id, zone_no AS no, zone_no * 3 AS a, zone_no * 3 + 1 + video_id % 3 AS b, title, technical FROM fx_zones),
 num AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start_s, scene_id) - 1 AS i FROM fx_scenes),
 zr AS (SELECT r.video_id, r.no, r.title, r.technical, MIN(start_s) AS z_start, arg_max(end_s, i) AS z_end, round(AVG(CASE WHEN aesthetic_score = 0 THEN quality_score ELSE aesthetic_score END) + 1e-9, 3) AS score,
   MIN(i) + COUNT(*) // 2 AS mid FROM rg r JOIN num n ON n.video_id = r.video_id AND n.i BETWEEN r.a AND r.b GROUP BY 1, 2, 3, 4)"""


@query("Z1_zones_from_ranges", f"""WITH {RANGE_SQL} SELECT z.video_id, z.no, z.title, NOT z.technical AS required, z.z_start, z.z_end, z.score, n.scene_id AS thumb_scene
 FROM zr z JOIN num n ON n.video_id = z.video_id AND n.i = z.mid""")
def from_ranges(fx):
    fx.settle("scenes", "samples")
    r = fx.zones.selectExpr("video_id", "zone_no AS no", "zone_no * 3 AS first_index", "zone_no * 3 + 1 + video_id % 3 AS last_index", "title", "technical")
    return Z.zones_from_ranges(fx.scenes, r).select("video_id", "no", "title", "required", "z_start", "z_end", "score", "thumb_scene")


def lane_sql(p: str, routes: str) -> str:
    """CTEs ending in {p}lanes: the moments of routes (route_id, video_id, r_lo, r_hi, target, width)."""
    return f"""{p}k AS (SELECT *, CAST(CASE WHEN width IS NOT NULL THEN greatest(round_even((r_hi - r_lo) / width, 0), 1) ELSE least(greatest(round_even(target / 10, 0), 4), 10) END AS BIGINT) AS k FROM {routes} WHERE r_hi > r_lo),
 {p}l AS (SELECT route_id, video_id, i AS lane, r_lo + i * ((r_hi - r_lo) / k) AS lo, r_lo + (i + 1) * ((r_hi - r_lo) / k) AS hi FROM (SELECT *, unnest(range(k)) AS i FROM {p}k) q),
 {p}h AS (SELECT l.route_id, l.lane, s.*, ROW_NUMBER() OVER (PARTITION BY l.route_id, l.lane ORDER BY interest DESC, start_s, scene_id) AS r, bool_or(has_person) OVER (PARTITION BY l.route_id) AS anyp
   FROM {p}l l JOIN people s ON s.video_id = l.video_id AND s.end_s > l.lo AND s.start_s < l.hi),
 {p}o AS (SELECT *, lag(scene_id) OVER (PARTITION BY route_id ORDER BY lane) AS prev FROM {p}h WHERE r = 1 AND interest >= 15e-2 AND (NOT anyp OR has_person)),
 {p}lanes AS (SELECT route_id, video_id, lane, scene_id, start_s AS z_start, end_s AS z_end, coalesce(nullif(trim(substring(description, 1, 32)), ''), 'момент ' || CAST(lane + 1 AS VARCHAR)) AS title, interest AS score
   FROM {p}o WHERE prev IS NULL OR prev <> scene_id)"""


VSET_SQL = """vset AS (SELECT v.video_id, p.target_duration, p.fpv_style, p.pause_out, CASE p.fpv_style WHEN 'dynamic' THEN 12e-1 ELSE 1e0 END AS zone_speed,
   CASE p.fpv_style WHEN 'dynamic' THEN 12e0 WHEN 'premium' THEN 6e0 ELSE 8e0 END AS gap_max, CASE p.fpv_style WHEN 'dynamic' THEN 25e-2 WHEN 'premium' THEN 6e-1 ELSE 5e-1 END AS fade,
   CASE p.fpv_style WHEN 'dynamic' THEN 25e-1 WHEN 'premium' THEN 35e-1 ELSE 3e0 END AS w_min, CASE p.fpv_style WHEN 'dynamic' THEN 5e0 WHEN 'premium' THEN 7e0 ELSE 6e0 END AS w_max
  FROM fx_videos v JOIN fx_projects p ON p.project_id = v.project_id)"""


def settings(fx):
    return fx.videos.select("video_id", "project_id").join(
        fx.projects.select("project_id", "target_duration", "fpv_style", "pause_out"), "project_id").drop("project_id")


ROUTE_SQL = """rt AS (SELECT s.video_id AS route_id, s.video_id, MIN(start_s) AS r_lo, MAX(end_s) AS r_hi, MIN(v.target_duration) AS target, CAST(NULL AS DOUBLE) AS width
  FROM people s JOIN vset v ON v.video_id = s.video_id GROUP BY 1, 2)"""


@query("Z2_lane_zones", f"""WITH people AS ({INTEREST_SQL}), {VSET_SQL}, {ROUTE_SQL}, {lane_sql('z2', 'rt')} SELECT route_id, lane, scene_id, z_start, z_end, title, score FROM z2lanes""")
def lanes(fx):
    fx.settle("scenes", "samples")
    s = people(fx)
    routes = s.groupBy("video_id").agg(F.min("start_s").alias("r_lo"), F.max("end_s").alias("r_hi")).join(settings(fx), "video_id")
    return Z.lane_zones(s, routes.withColumn("route_id", F.col("video_id")).withColumn("lane_width", F.lit(None).cast("double"))).select(
        "route_id", F.col("lane").cast("long").alias("lane"), "scene_id", "z_start", "z_end", "title", "score")


def expand_sql(p: str, zones: str) -> str:
    """CTEs ending in {p}zones from zones (zone_key, video_id, z_start, z_end, title, target_span)."""
    return f"""{p}rt AS (SELECT zone_key AS route_id, video_id, z_start AS r_lo, z_end AS r_hi, 0e0 AS target, target_span AS width FROM {zones} WHERE round(z_end - z_start + 1e-9, 3) > target_span * 18e-1),
 {lane_sql(p, p + 'rt')}, {p}two AS (SELECT route_id FROM {p}lanes GROUP BY 1 HAVING COUNT(*) >= 2),
 {p}zones AS (SELECT zone_key, video_id, z_start, z_end, title FROM {zones} WHERE zone_key NOT IN (SELECT route_id FROM {p}two)
  UNION ALL SELECT route_id || '/' || CAST(lane AS VARCHAR), video_id, z_start, z_end, title FROM {p}lanes WHERE route_id IN (SELECT route_id FROM {p}two))"""


WHOLE_SQL = """wz AS (SELECT CAST(s.video_id AS VARCHAR) AS zone_key, s.video_id, MIN(start_s) AS z_start, MAX(end_s) AS z_end, 'whole' AS title, 18e0 AS target_span FROM fx_scenes s GROUP BY 1, 2)"""


@query("Z3_expand_zones", f"WITH people AS ({INTEREST_SQL}), {WHOLE_SQL}, {expand_sql('z3', 'wz')} SELECT * FROM z3zones")
def expand(fx):
    fx.settle("scenes", "samples")
    whole = fx.scenes.groupBy("video_id").agg(F.min("start_s").alias("z_start"), F.max("end_s").alias("z_end"))
    whole = whole.withColumn("zone_key", F.col("video_id").cast("string")).withColumn("title", F.lit("whole")).withColumn("target_span", F.lit(18.0))
    return Z.expand_zones(whole, people(fx)).select("zone_key", "video_id", "z_start", "z_end", "title")


# a model named zones for two videos of three; every eleventh video is too short to split
MODEL_SQL = """people AS ({interest}), mz AS (SELECT video_id, z_start, z_end, title, technical FROM fx_zones WHERE {model} AND video_id IN (SELECT video_id FROM people)),
 en AS (SELECT video_id, MIN(start_s) AS f, arg_max(end_s, struct_pack(a := start_s, b := scene_id)) AS l FROM people GROUP BY 1),
 fa AS (SELECT m.video_id, COUNT(CASE WHEN NOT technical THEN 1 END) AS plain, bool_or(NOT technical AND round(z_end - z_start + 1e-9, 3) > (l - f) * 45e-2) AS huge,
   MAX(CASE WHEN technical AND z_start <= f + (l - f) * 3e-1 THEN z_end END) AS fr, MIN(CASE WHEN technical AND z_end >= l - (l - f) * 3e-1 THEN z_start END) AS tt FROM mz m JOIN en ON en.video_id = m.video_id GROUP BY 1),
 rt AS (SELECT en.video_id AS route_id, en.video_id, coalesce(fr, f) AS r_lo, coalesce(tt, l) AS r_hi, v.target_duration AS target, CAST(NULL AS DOUBLE) AS width FROM en LEFT JOIN fa ON fa.video_id = en.video_id
  JOIN vset v ON v.video_id = en.video_id WHERE (coalesce(plain, 0) < 4 OR coalesce(huge, false)) AND l - f > 15)"""


@query("Z4_decide_zones", f"""WITH {VSET_SQL}, {MODEL_SQL.format(interest=INTEREST_SQL, model='video_id % 3 <> 0')}, {lane_sql('z4', 'rt')},
 cx AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.video_id ORDER BY start_s, scene_id) - 1 AS n, lag(start_s) OVER (PARTITION BY s.video_id ORDER BY start_s, scene_id) AS ps
   FROM people s WHERE video_id NOT IN (SELECT video_id FROM mz) AND video_id NOT IN (SELECT video_id FROM z4lanes)),
 cg AS (SELECT *, SUM(CASE WHEN ps IS NOT NULL AND start_s - ps < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY n) AS g FROM cx)
 SELECT video_id, z_start, z_end, title, technical, 'model' AS origin FROM mz WHERE technical OR video_id NOT IN (SELECT video_id FROM z4lanes)
 UNION ALL SELECT video_id, z_start, z_end, title, false, 'moment' FROM z4lanes
 UNION ALL SELECT video_id, MIN(start_s), arg_max(end_s, n), trim(coalesce(nullif(arg_min(substring(description, 1, 40), n), ''), 'зона ' || CAST(MIN(n) + 1 AS VARCHAR))), false, 'chain' FROM cg GROUP BY video_id, g""")
def decide(fx):
    fx.settle("scenes", "samples")
    s = S.scene_views(people(fx), fx.tokens)
    return Z.decide_zones(s, fx.zones.filter("video_id % 3 <> 0"), settings(fx))


@query("Z5_zone_source", """SELECT video_id, COUNT(CASE WHEN llm_status = 'done' AND description <> '' THEN 1 END) AS described, COUNT(*) AS scenes,
 CASE WHEN COUNT(CASE WHEN llm_status = 'done' AND description <> '' THEN 1 END) < COUNT(*) * 6e-1 THEN 'fallback' ELSE 'model' END AS source FROM fx_scenes GROUP BY 1""")
def source(fx):
    return C.zone_source(fx.scenes)


def timing_sql(routes: str, zones: str) -> str:
    """CTE timing from routes (route_id, route_len, target, zone_speed, gap_max, w_min, w_max, subject_len, frozen_len, frozen_out) and zones (route_id, zone_len)."""
    return f"""gr AS (SELECT r.*, w_max - i * 5e-1 AS w FROM {routes} r, range(0, 8) t(i) WHERE w_max - i * 5e-1 > w_min - 1e-2),
 sh AS (SELECT *, coalesce((SELECT SUM(least(gr.w, z.zone_len)) FROM {zones} z WHERE z.route_id = gr.route_id), 0e0) AS shown FROM gr),
 s1 AS (SELECT *, greatest(route_len - shown, 0e0) AS gap FROM sh), s2 AS (SELECT *, least(greatest(subject_len - shown, 0e0), gap) AS subj FROM s1),
 s3 AS (SELECT *, gap - subj - least(frozen_len, gap - subj) AS emp, shown / zone_speed AS zo, target - shown / zone_speed - frozen_out AS rest FROM s2),
 s4 AS (SELECT *, CASE WHEN subj > 0 THEN CASE WHEN rest - emp / gap_max > 0 THEN greatest(subj / (rest - emp / gap_max), 1e0) END ELSE 1e0 END AS ss FROM s3),
 s5 AS (SELECT *, CASE WHEN emp > 0 THEN emp / greatest(rest - subj / ss, 1e-9) ELSE 1e0 END AS e0 FROM s4),
 s6 AS (SELECT *, least(greatest(e0, 1e0), gap_max) AS ee FROM s5),
 s7 AS (SELECT *, coalesce(rest > 0 AND ss <= 3 AND zo + frozen_out + subj / ss + emp / ee <= target + 1, false) AS fits, zo + frozen_out + emp / gap_max + subj / 3 AS need FROM s6),
 s8 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY route_id ORDER BY fits DESC, CASE WHEN fits THEN -w ELSE w END) AS r FROM s7),
 timing AS (SELECT route_id, CASE WHEN fits THEN round(w + 1e-9, 2) ELSE w_min END AS window_s, zone_speed, CASE WHEN fits THEN round(ee + 1e-9, 2) ELSE gap_max END AS gap_speed, fits,
  CASE WHEN fits THEN round(ss + 1e-9, 2) ELSE 3e0 END AS subject_speed, CASE WHEN NOT fits THEN round(need + 1e-9, 3) END AS least_s FROM s8 WHERE r = 1)"""


TIMING_SQL = f"""{VSET_SQL}, tr AS (SELECT z.video_id AS route_id, SUM(z_end - z_start) + 2e1 AS route_len, MIN(v.target_duration) AS target, MIN(zone_speed) AS zone_speed, MIN(gap_max) AS gap_max, MIN(w_min) AS w_min, MIN(w_max) AS w_max,
   z.video_id % 70 * 1e0 AS subject_len, z.video_id % 20 * 1e0 AS frozen_len, z.video_id % 3 * 6e-1 AS frozen_out FROM fx_zones z JOIN vset v ON v.video_id = z.video_id GROUP BY z.video_id),
 tz AS (SELECT video_id AS route_id, round(z_end - z_start + 1e-9, 3) AS zone_len FROM fx_zones), {timing_sql('tr', 'tz')}"""


@query("Z6_solve_timing", f"WITH {TIMING_SQL} SELECT * FROM timing")
def solve(fx):
    r = fx.zones.groupBy("video_id").agg((F.sum(F.col("z_end") - F.col("z_start")) + 20).alias("route_len")).join(settings(fx), "video_id")
    r = r.selectExpr("video_id AS route_id", "route_len", "target_duration", "fpv_style", "video_id % 70 * 1e0 AS subject_len",
                     "video_id % 20 * 1e0 AS frozen_len", "video_id % 3 * 6e-1 AS frozen_out")
    z = fx.zones.selectExpr("video_id AS route_id", "round(z_end - z_start, 3) AS zone_len")
    return Z.solve_timing(r, z)


# spans in which the measured picture stands still, on a clock of 1.2 s
STILL_SQL = """sm AS (SELECT video_id, n, n * 12e-1 AS t, SUM(diff / 40) OVER (PARTITION BY video_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4e0 AS smooth FROM fx_samples),
 sf AS (SELECT *, smooth < 1 AS h, SUM(CASE WHEN smooth < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY n) AS g, lead(t) OVER (PARTITION BY video_id ORDER BY n) AS nt FROM sm),
 stl AS (SELECT video_id, MIN(t) AS f_start, MAX(coalesce(nt, t)) AS f_end FROM sf WHERE h GROUP BY video_id, g HAVING MAX(coalesce(nt, t)) - MIN(t) >= 25e-1)"""


def still(fx):
    return Q.freeze_spans(fx.samples.selectExpr("video_id", "n", "n * 12e-1 AS t", "diff / 40 AS diff"), max_diff=1.0)


def net_sql(lo: str, hi: str, alias: str) -> str:
    return f"""CASE WHEN greatest({alias}.{lo}, r.r_lo) < least({alias}.{hi}, r.r_hi) THEN greatest(least({alias}.{hi}, r.r_hi) - greatest({alias}.{lo}, r.r_lo)
   - coalesce((SELECT SUM(greatest(least(t.t_hi, least({alias}.{hi}, r.r_hi)) - greatest(t.t_lo, greatest({alias}.{lo}, r.r_lo)), 0e0)) FROM tech t WHERE t.video_id = {alias}.video_id), 0e0), 0e0) ELSE 0e0 END"""


ZONES_SQL = """zz AS (SELECT video_id, zone_no, z_start, z_end, title, technical OR (zone_no = 2 AND video_id % 7 = 1) AS technical, zone_no % 2 = 0 OR video_id % 4 = 0 AS required FROM fx_zones)"""


def route_zones(fx):
    """Zones with technical ones inside the route and some that need not be shown."""
    return fx.zones.withColumn("technical", F.expr("technical OR (zone_no = 2 AND video_id % 7 = 1)")).withColumn(
        "required", F.expr("zone_no % 2 = 0 OR video_id % 4 = 0"))


INPUT_SQL = f"""{VSET_SQL}, {ZONES_SQL}, {SUBJECT_SQL}, {STILL_SQL},
 tech AS (SELECT video_id, z_start AS t_lo, z_end AS t_hi FROM zz WHERE technical),
 r AS (SELECT video_id, MIN(z_start) AS r_lo, arg_max(z_end, z_start) AS r_hi, bool_or(required) AS marked FROM zz WHERE NOT technical GROUP BY 1),
 wz AS (SELECT CAST(z.video_id AS VARCHAR) || '/' || CAST(zone_no AS VARCHAR) AS zone_key, z.video_id, z_start, z_end, title, v.w_max * 3 AS target_span FROM zz z JOIN r ON r.video_id = z.video_id
   JOIN vset v ON v.video_id = z.video_id WHERE NOT technical AND (required OR NOT marked)),
 {expand_sql('z7', 'wz')},
 fraw AS (SELECT video_id, f_start, f_end FROM frozen_spans UNION ALL SELECT video_id, f_start, f_end FROM stl),
 fm AS ({merge_sql('fraw', 'video_id', 'f_start', 'f_end', '5e-1')}),
 fz AS (SELECT * FROM (SELECT f.*, {net_sql('f_start', 'f_end', 'f')} AS net FROM fm f JOIN r ON r.video_id = f.video_id) q WHERE net >= 25e-1),
 sn AS (SELECT s.video_id, greatest({net_sql('s_start', 's_end', 's')} - coalesce((SELECT SUM(greatest(least(s.s_end, f.f_end) - greatest(s.s_start, f.f_start), 0e0)) FROM fz f WHERE f.video_id = s.video_id), 0e0), 0e0) AS len
   FROM subject_spans s JOIN r ON r.video_id = s.video_id),
 za AS (SELECT z.*, coalesce((SELECT SUM(greatest(least(z.z_end, f.f_end) - greatest(z.z_start, f.f_start), 0e0)) FROM fz f WHERE f.video_id = z.video_id), 0e0) < 7e-1 * round(z.z_end - z.z_start + 1e-9, 3) AS awake FROM z7zones z),
 req AS (SELECT zone_key, video_id, z_start, z_end, title FROM (SELECT *, bool_or(awake) OVER (PARTITION BY video_id) AS any_awake FROM za) q WHERE awake OR NOT any_awake),
 routes AS (SELECT r.video_id AS route_id, r.video_id, r.r_lo, r.r_hi, r.r_hi - r.r_lo - coalesce((SELECT SUM(greatest(least(t_hi, r.r_hi) - greatest(t_lo, r.r_lo), 0e0)) FROM tech t WHERE t.video_id = r.video_id), 0e0) AS route_len,
   v.target_duration AS target, v.zone_speed, v.gap_max, v.w_min, v.w_max, v.fade, coalesce((SELECT SUM(len) FROM sn WHERE sn.video_id = r.video_id), 0e0) AS subject_len, coalesce((SELECT SUM(net) FROM fz WHERE fz.video_id = r.video_id), 0e0) AS frozen_len,
   greatest(CASE WHEN v.pause_out = 0 THEN 5e-1 ELSE v.pause_out END, 1e-1, v.fade + 1e-1) AS pause_s,
   greatest(CASE WHEN v.pause_out = 0 THEN 5e-1 ELSE v.pause_out END, 1e-1, v.fade + 1e-1) * (SELECT COUNT(*) FROM fz WHERE fz.video_id = r.video_id) AS frozen_out FROM r JOIN vset v ON v.video_id = r.video_id),
 zl AS (SELECT video_id AS route_id, round(z_end - z_start + 1e-9, 3) AS zone_len FROM req), {timing_sql('routes', 'zl')}"""


def inputs(fx):
    return Z.route_inputs(route_zones(fx), people(fx), still(fx), settings(fx))


@query("Z7_route_inputs", f"""WITH {INPUT_SQL} SELECT video_id, r_lo, r_hi, round(route_len + 1e-9, 6) AS route_len, round(subject_len + 1e-9, 6) AS subject_len, round(frozen_len + 1e-9, 6) AS frozen_len, pause_s, round(frozen_out + 1e-9, 6) AS frozen_out FROM routes""")
def route_inputs(fx):
    fx.settle("scenes", "samples")
    r = inputs(fx)["routes"]
    return r.select("video_id", "r_lo", "r_hi", rnd("route_len", 6).alias("route_len"), rnd("subject_len", 6).alias("subject_len"),
                    rnd("frozen_len", 6).alias("frozen_len"), "pause_s", rnd("frozen_out", 6).alias("frozen_out"))


@query("Z7_required_zones", f"WITH {INPUT_SQL} SELECT * FROM req")
def required(fx):
    fx.settle("scenes", "samples")
    return inputs(fx)["required"]


@query("Z7_route_timing", f"WITH {INPUT_SQL} SELECT route_id AS video_id, window_s, zone_speed, gap_speed, fits, subject_speed, least_s FROM timing")
def route_timing(fx):
    fx.settle("scenes", "samples")
    return Z.timing_of(inputs(fx))


def clock4(fx):
    """Motion samples spread over the route."""
    return fx.samples.selectExpr("video_id", "n", "n * 4e-1 AS t", "dx / 3 AS dx", "dy / 3 AS dy")


def window_sql(zones: str, frozen: str) -> str:
    """CTEs ending in zw (zone_key, video_id, w_start, w_end) from zones (zone_key, video_id, z_start, z_end, window_s)."""
    return f"""zq AS (SELECT *, round(z_end - z_start + 1e-9, 3) AS zd, least(window_s, round(z_end - z_start + 1e-9, 3)) AS w FROM {zones}),
 zf AS (SELECT zone_key, video_id, least(greatest(z_start + zd / 2 - w / 2, z_start), z_end - w) AS st, w FROM zq WHERE zd <= w + 2e-1),
 zg AS (SELECT zone_key, video_id, w, z_start + i * 5e-1 AS st FROM (SELECT *, unnest(range(CAST(ceil((z_end - w + 1e-2 - z_start) / 5e-1) AS BIGINT))) AS i FROM zq WHERE zd > w + 2e-1) q),
 windows AS (SELECT struct_pack(z := zone_key, s := st) AS window_id, video_id, st AS a, st + w AS b, false AS allow_fast FROM zg),
 {CHECK_SQL.replace('t20 AS t', 'n * 4e-1 AS t')},
 zi AS (SELECT g.zone_key, g.video_id, g.st, g.w, coalesce(SUM(greatest(least(g.st + g.w, p.end_s) - greatest(g.st, p.start_s), 0e0) * p.interest) / nullif(SUM(greatest(least(g.st + g.w, p.end_s) - greatest(g.st, p.start_s), 0e0)), 0), 0e0) AS it
   FROM zg g LEFT JOIN people p ON p.video_id = g.video_id GROUP BY 1, 2, 3, 4),
 zs AS (SELECT z.*, round(CASE WHEN v.ok THEN v.badness ELSE v.badness + 50 END - 8 * it + 40 * coalesce((SELECT SUM(greatest(least(z.st + z.w, f.f_end) - greatest(z.st, f.f_start), 0e0)) FROM {frozen} f WHERE f.video_id = z.video_id), 0e0) / z.w + 1e-9, 6) AS score
   FROM zi z JOIN verdict v ON v.window_id.z = z.zone_key AND v.window_id.s = z.st),
 zb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone_key ORDER BY score, st) AS r FROM zs),
 zw AS (SELECT zone_key, video_id, round(st + 1e-9, 3) AS w_start, round(st + w + 1e-9, 3) AS w_end FROM zf UNION ALL SELECT zone_key, video_id, round(st + 1e-9, 3), round(st + w + 1e-9, 3) FROM zb WHERE r = 1)"""


def seen(fx):
    """What spans and windows ask of scenes, stored: they are read many times."""
    return keep(people(fx).select("video_id", "start_s", "end_s", "motion", "has_person", "interest"), "people")


def window_zones(fx):
    return fx.zones.selectExpr("concat_ws('/', CAST(video_id AS STRING), CAST(zone_no AS STRING)) AS zone_key", "video_id", "z_start", "z_end", "CAST(4 + video_id % 3 AS DOUBLE) AS window_s")


@query("Z8_zone_windows", f"""WITH {SUBJECT_SQL}, wzn AS (SELECT CAST(video_id AS VARCHAR) || '/' || CAST(zone_no AS VARCHAR) AS zone_key, video_id, z_start, z_end, CAST(4 + video_id % 3 AS DOUBLE) AS window_s FROM fx_zones), {window_sql('wzn', 'frozen_spans')} SELECT * FROM zw""")
def zone_windows(fx):
    fx.settle("scenes", "samples")
    s = seen(fx)
    return Z.zone_windows(window_zones(fx), clock4(fx), s, V.frozen_scene_spans(s))


def piece_sql(gaps: str, tech: str, frozen: str) -> str:
    """CTEs ending in pieces from gaps (gap_id, video_id, g_lo, g_hi, label): cut at every border, label each piece, join neighbours of a kind, then glue."""
    return f"""bd AS (SELECT g.gap_id, g.video_id, g.label, g.g_lo, g.g_hi, u.x FROM {gaps} g, LATERAL (SELECT g.g_lo AS x UNION SELECT g.g_hi
    UNION SELECT t_lo FROM {tech} t WHERE t.video_id = g.video_id AND t_lo < t_hi UNION SELECT t_hi FROM {tech} t WHERE t.video_id = g.video_id AND t_lo < t_hi
    UNION SELECT f_start FROM {frozen} f WHERE f.video_id = g.video_id UNION SELECT f_end FROM {frozen} f WHERE f.video_id = g.video_id
    UNION SELECT s_start FROM subject_spans s WHERE s.video_id = g.video_id UNION SELECT s_end FROM subject_spans s WHERE s.video_id = g.video_id) u WHERE u.x BETWEEN g.g_lo AND g.g_hi),
 el AS (SELECT *, lead(x) OVER (PARTITION BY gap_id ORDER BY x) AS y FROM bd),
 lb AS (SELECT e.*, EXISTS (SELECT 1 FROM {tech} t WHERE t.video_id = e.video_id AND t_lo < e.y AND t_hi > e.x AND t_lo < t_hi) AS cut,
   CASE WHEN EXISTS (SELECT 1 FROM {frozen} f WHERE f.video_id = e.video_id AND f_start < e.y AND f_end > e.x) THEN 'frozen'
    WHEN EXISTS (SELECT 1 FROM subject_spans s WHERE s.video_id = e.video_id AND s_start < e.y AND s_end > e.x) THEN 'subject' ELSE 'empty' END AS kind FROM el e WHERE y IS NOT NULL),
 pn AS (SELECT *, SUM(CASE WHEN pc IS NULL OR pc THEN 1 ELSE 0 END) OVER (PARTITION BY gap_id ORDER BY x) AS part FROM (SELECT *, lag(cut) OVER (PARTITION BY gap_id ORDER BY x) AS pc FROM lb) q),
 pt AS (SELECT *, MAX(y) OVER (PARTITION BY gap_id, part) - MIN(x) OVER (PARTITION BY gap_id, part) AS plen, lag(kind) OVER (PARTITION BY gap_id, part ORDER BY x) AS pk, lag(x) OVER (PARTITION BY gap_id, part ORDER BY x) AS px FROM pn WHERE NOT cut),
 kd AS (SELECT *, SUM(CASE WHEN pk IS NULL OR pk <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY gap_id, part ORDER BY x) AS kg FROM pt WHERE plen >= 4e-1),
 pc1 AS (SELECT gap_id, video_id, label, part, kg, kind, MIN(x) AS lo, MAX(y) AS hi FROM kd GROUP BY 1, 2, 3, 4, 5, 6),
 pc2 AS (SELECT *, SUM(CASE WHEN kg = 1 OR hi - lo >= 4e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY gap_id, part ORDER BY lo) AS gg FROM pc1),
 pc3 AS (SELECT gap_id, video_id, label, part, gg, MIN(lo) AS lo, MAX(hi) AS hi, arg_min(kind, lo) AS kind FROM pc2 GROUP BY 1, 2, 3, 4, 5),
 pc4 AS (SELECT *, COUNT(*) OVER (PARTITION BY gap_id, part) AS ng, MIN(lo) OVER (PARTITION BY gap_id, part) AS lo1, MIN(CASE WHEN gg = 1 THEN hi - lo END) OVER (PARTITION BY gap_id, part) AS len1 FROM pc3),
 pieces AS (SELECT video_id, label, CASE WHEN ng > 1 AND len1 < 4e-1 AND gg = 2 THEN lo1 ELSE lo END AS p_lo, hi AS p_hi, kind FROM pc4 WHERE NOT (ng > 1 AND len1 < 4e-1 AND gg = 1))"""


GAP_SQL = """gp AS (SELECT CAST(video_id AS VARCHAR) || '/' || CAST(zone_no AS VARCHAR) AS gap_id, video_id, z_start + video_id % 13 / 1e1 AS g_lo, z_end + 7 AS g_hi, 'переезд' AS label FROM fx_zones)"""


def some_gaps(fx):
    return fx.zones.selectExpr("concat_ws('/', video_id, zone_no) AS gap_id", "video_id", "z_start + video_id % 13 / 1e1 AS g_lo", "z_end + 7 AS g_hi", "'переезд' AS label")


def some_tech(fx):
    return fx.scenes.filter("motion = 'fast' AND user_flag = ''").selectExpr("video_id", "start_s + 17e-1 AS t_lo", "start_s + 29e-1 AS t_hi")


TECH_SQL = "tq AS (SELECT video_id, start_s + 17e-1 AS t_lo, start_s + 29e-1 AS t_hi FROM fx_scenes WHERE motion = 'fast' AND user_flag = '')"
PIECE_SQL = f"{SUBJECT_SQL}, {GAP_SQL}, {TECH_SQL}, {piece_sql('gp', 'tq', 'frozen_spans')}"


def some_pieces(fx):
    s = seen(fx)
    return Z.gap_pieces(some_gaps(fx), some_tech(fx), V.frozen_scene_spans(s), V.subject_spans(s))


@query("Z9_gap_pieces", f"WITH {PIECE_SQL} SELECT video_id, label, round(p_lo + 1e-9, 6) AS p_lo, round(p_hi + 1e-9, 6) AS p_hi, kind FROM pieces")
def pieces(fx):
    fx.settle("scenes")
    return some_pieces(fx).select("video_id", "label", rnd("p_lo", 6).alias("p_lo"), rnd("p_hi", 6).alias("p_hi"), "kind")


SEG_SQL = """sg0 AS (SELECT p.*, CASE kind WHEN 'frozen' THEN greatest((p_hi - p_lo) / o.pause_s, t.gap_speed) WHEN 'subject' THEN t.subject_speed ELSE t.gap_speed END AS sp,
   CASE kind WHEN 'frozen' THEN 'статичная пауза ' || CAST(CAST(round_even(round(p_hi - p_lo + 1e-9, 6), 0) AS BIGINT) AS VARCHAR) || 'с — сжата до ' || regexp_replace(printf('%.2f', o.pause_s), '\\.?0+$', '') || 'с'
    WHEN 'subject' THEN 'щадящая перемотка ×' || regexp_replace(printf('%.2f', t.subject_speed), '\\.?0+$', '') || ' — в кадре люди' ELSE 'перемотка ×' || regexp_replace(printf('%.2f', t.gap_speed), '\\.?0+$', '') || ' по маршруту' END AS reason
   FROM pieces p JOIN {timing} t ON t.route_id = p.video_id JOIN {routes} o ON o.video_id = p.video_id),
 mv AS (SELECT video_id, round(p_lo + 1e-9, 3) AS src_start, round(p_hi + 1e-9, 3) AS src_end, label AS slot, round(sp + 1e-9, 2) AS speed, reason, p_lo AS raw FROM sg0)"""
AT_SQL = """spot AS (SELECT video_id, raw, arg_min(scene_id, struct_pack(a := start_s, b := scene_id)) AS scene_id FROM (SELECT DISTINCT m.video_id, m.raw, s.start_s, s.scene_id FROM {segs} m JOIN fx_scenes s ON s.video_id = m.video_id AND s.start_s <= m.raw AND m.raw < s.end_s) q GROUP BY 1, 2),
 la AS (SELECT video_id, arg_max(scene_id, struct_pack(a := start_s, b := scene_id)) AS scene_id FROM fx_scenes GROUP BY 1)"""


@query("Z10_route_segments", f"""WITH {PIECE_SQL}, tm AS (SELECT video_id AS route_id, 2e0 + video_id % 5 / 2e0 AS gap_speed, 1e0 + video_id % 4 / 4e0 AS subject_speed FROM fx_videos), ro AS (SELECT video_id, 5e-1 + video_id % 3 / 1e1 AS pause_s FROM fx_videos),
 {SEG_SQL.format(timing='tm', routes='ro')}, {AT_SQL.format(segs='mv')}
 SELECT m.video_id, m.src_start, m.src_end, m.slot, m.speed, m.reason, coalesce(spot.scene_id, la.scene_id) AS scene_id FROM mv m LEFT JOIN spot ON spot.video_id = m.video_id AND spot.raw = m.raw JOIN la ON la.video_id = m.video_id""")
def segments(fx):
    fx.settle("scenes")
    v = fx.videos
    tm = v.selectExpr("video_id", "2e0 + video_id % 5 / 2e0 AS gap_speed", "1e0 + video_id % 4 / 4e0 AS subject_speed")
    ro = v.selectExpr("video_id", "5e-1 + video_id % 3 / 1e1 AS pause_s")
    return Z.route_segments(some_pieces(fx), tm, ro, fx.scenes).select("video_id", "src_start", "src_end", "slot", "speed", "reason", "scene_id")


PLAN_SQL = f"""{INPUT_SQL}, wzn AS (SELECT q.zone_key, q.video_id, q.z_start, q.z_end, q.title, t.window_s, t.zone_speed FROM req q JOIN timing t ON t.route_id = q.video_id), {window_sql('wzn', 'fz')},
 ww AS (SELECT n.zone_key, n.video_id, n.z_start, n.title, n.zone_speed, zw.w_start, zw.w_end FROM wzn n JOIN zw ON zw.zone_key = n.zone_key),
 cu AS (SELECT ww.*, coalesce(lag(w_end) OVER (PARTITION BY ww.video_id ORDER BY z_start, zone_key), r_lo) AS cur FROM ww JOIN r ON r.video_id = ww.video_id),
 le AS (SELECT video_id, arg_max(w_end, struct_pack(a := z_start, b := zone_key)) AS e FROM ww GROUP BY 1),
 g0 AS (SELECT video_id, cur AS g_lo, w_start AS g_hi, 'переезд' AS label FROM cu WHERE w_start - cur >= 4e-1 UNION ALL SELECT r.video_id, e, r_hi, 'финал' FROM r JOIN le ON le.video_id = r.video_id WHERE r_hi - e >= 4e-1),
 gp AS (SELECT CAST(video_id AS VARCHAR) || ':' || CAST(g_lo AS VARCHAR) AS gap_id, * FROM g0), {piece_sql('gp', 'tech', 'fz')}, {SEG_SQL.format(timing='timing', routes='routes')},
 stops AS (SELECT video_id, round(CASE WHEN w_start - cur >= 4e-1 THEN w_start ELSE cur END + 1e-9, 3) AS src_start, w_end AS src_end, substring(title, 1, 24) AS slot, zone_speed AS speed,
  'обязательная зона «' || title || '»' || CASE WHEN zone_speed <> 1 THEN ' ×' || regexp_replace(printf('%.2f', zone_speed), '\\.?0+$', '') ELSE '' END AS reason,
   CASE WHEN w_start - cur >= 4e-1 THEN w_start ELSE cur END AS raw FROM cu),
 seg AS (SELECT * FROM mv UNION ALL SELECT * FROM stops), {AT_SQL.format(segs='seg')}"""


def built(fx):
    return Z.build_route_plans(route_zones(fx), people(fx), clock4(fx), still(fx), settings(fx))


@query("Z11_route_plan", f"""WITH {PLAN_SQL} SELECT m.video_id, ROW_NUMBER() OVER (PARTITION BY m.video_id ORDER BY m.src_start, m.src_end) - 1 AS seg_no, m.src_start, m.src_end, m.slot, m.speed, m.reason, coalesce(spot.scene_id, la.scene_id) AS scene_id
 FROM seg m LEFT JOIN spot ON spot.video_id = m.video_id AND spot.raw = m.raw JOIN la ON la.video_id = m.video_id""")
def route_plan(fx):
    fx.settle("scenes", "samples")
    return built(fx)[0].select("video_id", "seg_no", "src_start", "src_end", "slot", "speed", "reason", "scene_id")


@query("Z11_route_totals", f"""WITH {PLAN_SQL} SELECT m.video_id, round(SUM(round((src_end - src_start) / speed + 1e-9, 3)) + 1e-9, 3) AS total_s, any_value(t.fits) AS fits, any_value(t.least_s) AS least_s, any_value(o.fade) AS transition_s
 FROM seg m JOIN timing t ON t.route_id = m.video_id JOIN routes o ON o.video_id = m.video_id GROUP BY 1""")
def route_totals(fx):
    fx.settle("scenes", "samples")
    return built(fx)[1].select("video_id", "total_s", "fits", "least_s", "transition_s")


# the film of a route asks for music as a film of its length does; names that both parts use are told apart
MUSIC_SQL = re.sub(r"\b(req|pairs|r)\b", r"m_\1", FINISH_SQL.replace("range(0, 200) r(sec)", "range(0, 5000) r(sec)"))
MUSIC_SQL = re.sub(r"SELECT c.plan_id, c.track_id, c.target_duration, CASE .*? AS preset_id", "SELECT c.plan_id, c.track_id, c.target_duration, 'drone_cinematic' AS preset_id", MUSIC_SQL, flags=re.S)
MUSIC_SQL = MUSIC_SQL.replace("FROM fx_cues c", "FROM (SELECT video_id AS plan_id, video_id AS track_id, total_s AS target_duration FROM tot) c")


@query("Z11_route_film", f"""WITH {PLAN_SQL}, tot AS (SELECT m.video_id, round(SUM(round((src_end - src_start) / speed + 1e-9, 3)) + 1e-9, 3) AS total_s, any_value(t.fits) AS fits, any_value(t.least_s) AS least_s,
   any_value(v.target_duration) AS target FROM seg m JOIN timing t ON t.route_id = m.video_id JOIN vset v ON v.video_id = m.video_id GROUP BY 1),
 nz AS (SELECT video_id, COUNT(*) AS zones FROM req GROUP BY 1), {MUSIC_SQL}
 SELECT tot.video_id, total_s, fits, CASE WHEN fits THEN '' ELSE 'Тайминг ' || CAST(CAST(round_even(target, 0) AS BIGINT) AS VARCHAR) || 'с слишком короткий: ' || CAST(zones AS VARCHAR) || ' обязательных зон + маршрут займут минимум ~'
   || CAST(CAST(round_even(least_s, 0) AS BIGINT) AS VARCHAR) || 'с (кадры с людьми не перематываются быстрее ×3 — танец должен остаться смотрибельным). Варианты: увеличить длительность ролика; снять отметку с части зон; выбрать стиль «динамичный» (сильнее ускоряет); согласиться с '
   || CAST(CAST(round_even(least_s, 0) AS BIGINT) AS VARCHAR) || 'с.' END AS warnings, "offset" AS music_offset, fade_in AS music_fade_in, fade_out AS music_fade_out
 FROM tot JOIN nz ON nz.video_id = tot.video_id LEFT JOIN fin ON fin.plan_id = tot.video_id""")
def route_film(fx):
    """Route films with their warnings, set to the track that has the number of the video."""
    fx.settle("scenes", "samples")
    tracks_of = fx.tracks.select(F.col("track_id").alias("video_id"), "track_id")
    films = Z.build_route_films(route_zones(fx), people(fx), clock4(fx), still(fx), settings(fx), tracks_of, curve(fx), fx.tracks, fx.beats)[1]
    return films.select("video_id", "total_s", "fits", F.array_join("warnings", "; ").alias("warnings"), "music_offset", "music_fade_in", "music_fade_out")


@query("Z11_route_problems", """WITH z AS (SELECT video_id, bool_and(technical OR video_id % 3 = 0) AS off FROM fx_zones GROUP BY 1)
 SELECT v.video_id, CASE WHEN z.off IS NULL THEN 'Зоны не найдены — сначала выполните детекцию зон' ELSE 'Все зоны помечены техническими' END AS problem
 FROM fx_videos v LEFT JOIN z ON z.video_id = v.video_id WHERE coalesce(z.off, true)""")
def route_problems(fx):
    return Z.route_problems(fx.videos, fx.zones.selectExpr("video_id", "technical OR video_id % 3 = 0 AS technical"))


EDIT = "video_id, zone_no, CASE WHEN zone_no = 1 THEN 'hall' ELSE title END AS new_title, zone_no <> 2 AS new_required, technical AS new_technical, z_start + CASE WHEN video_id % 3 = 0 THEN 5e-3 ELSE 1e0 END AS new_start, z_end - video_id % 4 * 9e0 AS new_end"


@query("Z12_apply_zone_edits", f"""WITH e AS (SELECT {EDIT} FROM fx_zones WHERE video_id % 2 = 0)
 SELECT z.video_id, z.zone_no, coalesce(new_title, title) AS title, coalesce(new_required, required) AS required,
  CASE WHEN new_end > new_start AND (abs(new_start - z_start) > 1e-2 OR abs(new_end - z_end) > 1e-2 OR new_title <> title OR new_required <> required OR new_technical <> technical) THEN new_start ELSE z_start END AS z_start,
  CASE WHEN new_end > new_start AND (abs(new_start - z_start) > 1e-2 OR abs(new_end - z_end) > 1e-2 OR new_title <> title OR new_required <> required OR new_technical <> technical) THEN new_end ELSE z_end END AS z_end
 FROM fx_zones z LEFT JOIN e ON e.video_id = z.video_id AND e.zone_no = z.zone_no""")
def edits(fx):
    from .fixtures import exprs
    return Z.apply_zone_edits(fx.zones, fx.zones.filter("video_id % 2 = 0").selectExpr(*exprs(EDIT))).select(
        "video_id", "zone_no", "title", "required", "z_start", "z_end")
