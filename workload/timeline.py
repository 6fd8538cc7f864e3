"""Queries for frame geometry and time lines (group T)."""

from pyspark.sql import functions as F

from mediaplan.operators import presets, timeline as T
from .registry import query

DIM_SQL = """dim AS (SELECT v.*, CASE WHEN (orientation = 'vertical' AND width > height) OR (orientation = 'horizontal' AND height > width) THEN height ELSE width END AS src_w,
  CASE WHEN (orientation = 'vertical' AND width > height) OR (orientation = 'horizontal' AND height > width) THEN width ELSE height END AS src_h FROM fx_videos v)"""
CROP_SQL = f"""{DIM_SQL}, asp AS (SELECT * FROM (VALUES ('9:16', 1080, 1920), ('16:9', 1920, 1080), ('1:1', 1080, 1080)) v(aspect, tw, th)),
 c0 AS (SELECT d.video_id, src_w, src_h, tw / CAST(th AS DOUBLE) AS art, CASE WHEN video_id % 4 = 3 THEN NULL ELSE video_id % 11 / 1e1 END AS fx, CASE WHEN video_id % 4 = 3 THEN NULL ELSE video_id % 7 / 6e0 END AS fy
   FROM dim d JOIN fx_projects p ON d.project_id = p.project_id JOIN asp ON asp.aspect = p.aspect),
 c1 AS (SELECT *, CASE WHEN src_w / CAST(src_h AS DOUBLE) > art THEN least(CAST(round_even(src_h * art, 0) AS BIGINT), src_w) ELSE src_w END AS cw,
   CASE WHEN src_w / CAST(src_h AS DOUBLE) > art THEN src_h ELSE least(CAST(round_even(src_w / art, 0) AS BIGINT), src_h) END AS ch FROM c0),
 crop AS (SELECT *, greatest(0, least(CAST(round_even(coalesce(fx, 5e-1) * src_w - cw / 2e0, 0) AS BIGINT), src_w - cw)) AS crop_x,
   greatest(0, least(CAST(round_even(coalesce(fy, 5e-1) * src_h - ch / 2e0, 0) AS BIGINT), src_h - ch)) AS crop_y, cw - cw % 2 AS crop_w, ch - ch % 2 AS crop_h FROM c1)"""


def framed(fx):
    df = T.display_dims(fx.videos).join(fx.projects.select("project_id", "aspect"), "project_id")
    df = df.join(F.broadcast(presets.aspects(fx.spark)), "aspect")
    return df.withColumn("focus_x", F.expr("CASE WHEN video_id % 4 = 3 THEN NULL ELSE video_id % 11 / 1e1 END")).withColumn(
        "focus_y", F.expr("CASE WHEN video_id % 4 = 3 THEN NULL ELSE video_id % 7 / 6e0 END"))


@query("T1_crop_window", f"WITH {CROP_SQL} SELECT video_id, CAST(crop_w AS BIGINT) AS crop_w, CAST(crop_h AS BIGINT) AS crop_h, CAST(crop_x AS BIGINT) AS crop_x, CAST(crop_y AS BIGINT) AS crop_y FROM crop")
def crop(fx):
    return T.crop_window(framed(fx)).select("video_id", "crop_w", "crop_h", "crop_x", "crop_y")


@query("T2_crop_rect_norm", f"""WITH {CROP_SQL} SELECT video_id, round(crop_x / CAST(src_w AS DOUBLE) + 1e-9, 4) AS x0, round(crop_y / CAST(src_h AS DOUBLE) + 1e-9, 4) AS y0,
 round((crop_x + crop_w) / CAST(src_w AS DOUBLE) + 1e-9, 4) AS x1, round((crop_y + crop_h) / CAST(src_h AS DOUBLE) + 1e-9, 4) AS y1 FROM crop""")
def crop_norm(fx):
    return T.crop_rect_norm(framed(fx)).select("video_id", "x0", "y0", "x1", "y1")


BOX = """l_orderkey AS segment_id, CASE WHEN l_linenumber = 1 THEN 'face' ELSE 'body' END AS kind, l_partkey % 500 * 1e0 AS x, l_suppkey % 300 * 1e0 AS y,
 l_quantity AS w, l_quantity * 2 AS h, 640e0 AS frame_w, 360e0 AS frame_h, l_discount * 10 AS confidence"""
FOCUS_SQL = f"""bx AS (SELECT {BOX} FROM lineitem), wt AS (SELECT segment_id, kind = 'face' AS face, w * h * CASE WHEN kind = 'face' THEN 1e0 ELSE confidence END AS wt, (x + w / 2) / frame_w AS cx, (y + h / 2) / frame_h AS cy
   FROM bx WHERE kind = 'face' OR confidence >= 3e-1),
 hs AS (SELECT *, bool_or(face) OVER (PARTITION BY segment_id) AS any_face FROM wt),
 focus AS (SELECT segment_id, round(SUM(cx * wt) / SUM(wt) + 1e-9, 4) AS focus_x, round(SUM(cy * wt) / SUM(wt) + 1e-9, 4) AS focus_y FROM hs WHERE face = any_face GROUP BY 1)"""


def focus_of(fx):
    from .fixtures import exprs
    return T.focus_point(fx.table("lineitem").selectExpr(*exprs(BOX)))


@query("T3_focus_point", f"WITH {FOCUS_SQL} SELECT * FROM focus")
def focus(fx):
    return focus_of(fx)


CROPS = """o_orderkey AS segment_id, CASE WHEN o_orderkey % 5 = 0 THEN 'center' ELSE 'smart' END AS crop,
 CASE WHEN o_orderkey % 3 = 0 THEN 5e-1 ELSE o_orderkey % 10 / 1e1 END AS subject_x, CASE WHEN o_orderkey % 2 = 0 THEN 5e-1 ELSE o_orderkey % 9 / 1e1 END AS subject_y"""


@query("T4_segment_focus", f"""WITH {FOCUS_SQL}, s AS (SELECT {CROPS} FROM orders)
 SELECT s.segment_id, CASE WHEN crop = 'center' THEN NULL WHEN focus_x IS NOT NULL THEN focus_x WHEN subject_x <> 5e-1 OR subject_y <> 5e-1 THEN subject_x END AS focus_x,
  CASE WHEN crop = 'center' THEN NULL WHEN focus_x IS NOT NULL THEN focus_y WHEN subject_x <> 5e-1 OR subject_y <> 5e-1 THEN subject_y END AS focus_y FROM s LEFT JOIN focus f ON f.segment_id = s.segment_id""")
def segment_focus(fx):
    from .fixtures import exprs
    return T.segment_focus(fx.table("orders").selectExpr(*exprs(CROPS)), focus_of(fx)).select("segment_id", "focus_x", "focus_y")


@query("T5_display_dims", f"WITH {DIM_SQL} SELECT video_id, CAST(src_w AS BIGINT) AS src_w, CAST(src_h AS BIGINT) AS src_h FROM dim")
def dims(fx):
    return T.display_dims(fx.videos).select("video_id", "src_w", "src_h")


@query("T6_plan_fps", """WITH h AS (SELECT g.plan_id, bool_and(abs(v.fps % 25) < 6e-1 OR abs(v.fps % 25 - 25) < 6e-1) AS ok FROM fx_segments g JOIN fx_scenes s ON s.scene_id = g.scene_id JOIN fx_videos v ON v.video_id = s.video_id WHERE v.fps <> 0 GROUP BY 1)
 SELECT p.plan_id, CASE WHEN h.ok THEN 25 ELSE 30 END AS fps FROM (SELECT DISTINCT plan_id FROM fx_segments) p LEFT JOIN h ON h.plan_id = p.plan_id""")
def fps(fx):
    return T.plan_fps(fx.shown, fx.shot, fx.videos)


PLANS = "o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cut' ELSE 'crossfade' END AS transition, o_orderkey % 4 * 2e-1 AS transition_s"


def plans(fx):
    from .fixtures import exprs
    return fx.table("orders").selectExpr(*exprs(PLANS))


OUT_SQL = "out AS (SELECT *, round((src_end - src_start) / greatest(speed, 1e-2) + 1e-9, 3) AS out_s FROM fx_segments)"


@query("T7_crossfade_timeline", f"""WITH {OUT_SQL}, p AS (SELECT {PLANS} FROM orders),
 a AS (SELECT plan_id, COUNT(*) AS n, MIN(out_s) AS mn, SUM(out_s) AS sm FROM out GROUP BY 1),
 f AS (SELECT a.*, CASE WHEN transition = 'crossfade' AND transition_s > 0 AND n > 1 THEN least(transition_s, mn * 45e-2) ELSE 0e0 END AS fade FROM a JOIN p ON p.plan_id = a.plan_id)
 SELECT o.plan_id, o.seg_no, o.out_s, round(fade + 1e-9, 6) AS fade_s, round(SUM(out_s) OVER (PARTITION BY o.plan_id ORDER BY seg_no) - out_s - seg_no * fade + 1e-9, 3) + 0e0 AS offset_s, round(sm - (n - 1) * fade + 1e-9, 3) AS total_s
 FROM out o JOIN f ON f.plan_id = o.plan_id""")
def crossfade(fx):
    return T.crossfade_timeline(fx.segments, plans(fx))


RECIPE = """scene_id, src_start, src_end, speed, 1080 AS out_w, 1920 AS out_h, 30 AS fps, false AS final, CAST(608 + scene_id % 2 * 2 AS BIGINT) AS crop_w, CAST(1080 AS BIGINT) AS crop_h,
 CAST(scene_id % 300 AS BIGINT) AS crop_x, CAST(0 AS BIGINT) AS crop_y, scene_id % 6 = 0 AS stabilise, 'libx264' AS codec"""
KEY_SQL = f"""rc AS (SELECT {RECIPE} FROM fx_segments),
 keys AS (SELECT substring(md5(CAST(scene_id AS VARCHAR) || ':' || printf('%.3f', src_start) || ':' || printf('%.3f', src_end) || ':1080x1920@30:p:' || CAST(crop_w AS VARCHAR) || 'x1080+' || CAST(crop_x AS VARCHAR) || '+0' ||
  CASE WHEN stabilise THEN ':stab' ELSE '' END || CASE WHEN speed <> 1 THEN ':x3' ELSE '' END || ':libx264'), 1, 16) AS render_key, speed FROM rc)"""


@query("T8_render_backlog", f"WITH {KEY_SQL} SELECT render_key, COUNT(*) AS segments FROM keys WHERE render_key NOT IN (SELECT render_key FROM keys WHERE speed <> 1) GROUP BY 1")
def render(fx):
    from .fixtures import exprs
    seg = fx.segments.selectExpr(*exprs(RECIPE))
    return T.render_backlog(seg, T.render_key(seg.filter("speed <> 1")))


@query("T9_retain_newest", """WITH f AS (SELECT CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id, o_orderkey AS name, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, epoch(o_orderdate) AS mtime FROM orders),
 r AS (SELECT *, SUM(size_bytes) OVER (PARTITION BY project_id ORDER BY mtime DESC, name DESC ROWS UNBOUNDED PRECEDING) AS kept FROM f) SELECT project_id, name, CAST(kept AS BIGINT) AS kept_bytes FROM r WHERE kept <= 4000000""")
def retain(fx):
    files = fx.table("orders").selectExpr("CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id", "o_orderkey AS name", "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes",
                                          "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS mtime")
    return T.retain_newest(files, 4000000, 86400.0 * 30).select("project_id", "name", "kept_bytes")


@query("T10_audio_fades", f"""WITH {OUT_SQL}, t AS (SELECT plan_id, round(SUM(out_s) + 1e-9, 3) AS total_s FROM out GROUP BY 1)
 SELECT plan_id, greatest(plan_id % 3 * 5e-1, 1e-2) AS fade_in_s, 15e-1 AS fade_out_s, greatest(round(total_s - 15e-1 + 1e-9, 3), 0e0) AS fade_out_at FROM t""")
def fades(fx):
    from mediaplan.plans.drafts import plan_durations
    total = plan_durations(fx.segments).withColumn("fade_in", F.expr("plan_id % 3 * 5e-1")).withColumn("fade_out", F.lit(1.5))
    return T.audio_fades(total).select("plan_id", "fade_in_s", "fade_out_s", "fade_out_at")


@query("T11_timeline", f"""WITH {OUT_SQL}, t AS (SELECT plan_id, greatest(round(SUM(out_s) + 1e-9, 3), 1e-1) AS total FROM out GROUP BY 1)
 SELECT o.plan_id, seg_no, round(SUM(out_s) OVER (PARTITION BY o.plan_id ORDER BY seg_no) - out_s + 1e-9, 3) + 0e0 AS out_start, out_s, round(greatest(out_s / total * 100, 3e0) + 1e-9, 1) AS width_pct FROM out o JOIN t ON t.plan_id = o.plan_id""")
def timeline(fx):
    return T.timeline(fx.segments)
