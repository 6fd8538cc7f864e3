"""Queries over the catalogue (group C)."""

from pyspark.sql import functions as F

from mediaplan.operators import catalogue as C, presets
from . import music
from .registry import query


@query("C1_list_scenes", "SELECT scene_id, project_id FROM fx_scenes WHERE llm_status = 'done'")
def list_scenes(fx):
    return C.list_scenes(fx.scenes, status="done").select("scene_id", "project_id")


@query("C2_browse_scenes", "SELECT scene_id, quality_score FROM fx_scenes WHERE quality_score >= 4e-1 AND scene_type IN ('detail', 'action', 'food')")
def browse(fx):
    return C.browse_scenes(fx.scenes, 0.4, ["detail", "action", "food"], "quality").select("scene_id", "quality_score")


PLANS = "o_orderkey AS plan_id, CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id, o_totalprice AS created_at"
LATEST_SQL = f"latest AS (SELECT project_id, arg_max(plan_id, struct_pack(a := created_at, b := plan_id)) AS plan_id FROM (SELECT {PLANS} FROM orders) q GROUP BY 1)"


def plans(fx):
    from .fixtures import exprs
    return fx.table("orders").selectExpr(*exprs(PLANS))


@query("C3_mark_used", f"""WITH {LATEST_SQL}, u AS (SELECT DISTINCT l.project_id, g.scene_id FROM latest l JOIN fx_segments g ON g.plan_id = l.plan_id)
 SELECT s.scene_id, u.scene_id IS NOT NULL AS used FROM fx_scenes s LEFT JOIN u ON u.project_id = s.project_id AND u.scene_id = s.scene_id""")
def mark_used(fx):
    return C.mark_used(fx.scenes, plans(fx), fx.segments).select("scene_id", "used")


SUMMARY_SQL = """SELECT p.project_id, p.created_at, coalesce(n, 0) AS scenes, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM fx_projects p
 LEFT JOIN (SELECT project_id, COUNT(*) AS n FROM fx_scenes GROUP BY 1) s ON s.project_id = p.project_id LEFT JOIN (SELECT project_id, SUM(file_bytes) AS b FROM fx_videos GROUP BY 1) v ON v.project_id = p.project_id"""


@query("C4_project_summary", SUMMARY_SQL)
def summary(fx):
    return C.project_summary(fx.projects, fx.scenes, fx.videos)


@query("C4_home_screen", f"{SUMMARY_SQL} ORDER BY p.created_at DESC, p.project_id DESC LIMIT 20")
def home(fx):
    return C.project_summary(fx.projects, fx.scenes, fx.videos, limit=20)


@query("C5_latest_plan", f"WITH {LATEST_SQL} SELECT * FROM latest")
def latest(fx):
    return C.latest_plan(plans(fx)).select("project_id", "plan_id")


STEP = {"plan": "created_at > 480000", "scene": "quality_score > 97e-2", "source": "fps > 50"}


@query("C6_infer_step", f"""SELECT project_id, CASE WHEN project_id IN (SELECT project_id FROM (SELECT {PLANS} FROM orders) q WHERE {STEP['plan']}) THEN 'draft'
 WHEN project_id IN (SELECT project_id FROM fx_scenes WHERE {STEP['scene']}) THEN 'scenes' WHEN project_id IN (SELECT project_id FROM fx_videos WHERE {STEP['source']}) THEN 'settings' ELSE 'material' END AS step FROM fx_projects""")
def step(fx):
    return C.infer_step(fx.projects, fx.scenes.filter(STEP["scene"]), plans(fx).filter(STEP["plan"]), fx.videos.filter(STEP["source"]))


@query("C7_annotation_progress", """SELECT project_id, COUNT(*) AS scenes, COUNT(CASE WHEN llm_status = 'done' THEN 1 END) AS done, COUNT(CASE WHEN llm_status IN ('pending', 'failed') THEN 1 END) AS waiting,
 round(COUNT(CASE WHEN llm_status = 'done' THEN 1 END) / CAST(COUNT(*) AS DOUBLE) + 1e-9, 4) AS done_share FROM fx_scenes GROUP BY 1""")
def progress(fx):
    return C.annotation_progress(fx.scenes)


@query("C8_scene_types", "SELECT DISTINCT project_id, scene_type FROM fx_scenes WHERE scene_type <> ''")
def types(fx):
    return C.scene_types(fx.scenes)


CLICK = "l_orderkey AS scene_id, split_part('pinned,banned,good', ',', CAST(l_partkey % 3 + 1 AS INT)) AS flag"


@query("C9_toggle_flags", f"""WITH c AS (SELECT {CLICK}, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax) AS i FROM lineitem),
 f AS (SELECT scene_id, 0 AS i, user_flag FROM fx_scenes UNION ALL SELECT f.scene_id, c.i, CASE WHEN f.user_flag = c.flag THEN '' ELSE c.flag END FROM f JOIN c ON c.scene_id = f.scene_id AND c.i = f.i + 1)
 SELECT scene_id, arg_max(user_flag, i) AS user_flag FROM f GROUP BY 1""")
def toggle(fx):
    seg = fx.segments.selectExpr("plan_id AS scene_id", "split_part('pinned,banned,good', ',', CAST(scene_id % 3 + 1 AS INT)) AS flag", "seg_no AS click_no")
    return C.toggle_flags(fx.scenes, seg).select("scene_id", "user_flag")


@query("C10_list_zones", "SELECT z.video_id, z.zone_no, CASE WHEN technical THEN 'T' WHEN required THEN 'R' ELSE '' END AS mark FROM fx_zones z JOIN fx_videos v ON v.video_id = z.video_id WHERE v.fpv_showroom")
def zones(fx):
    return C.list_zones(fx.zones, fx.videos).select("video_id", "zone_no", "mark")


@query("C11_plan_listing", "SELECT g.plan_id, g.seg_no, g.scene_id, coalesce(s.scene_type, '?') AS scene_type FROM fx_segments g LEFT JOIN fx_scenes s ON s.scene_id = g.scene_id")
def listing(fx):
    return C.plan_listing(fx.segments, fx.scenes).select("plan_id", "seg_no", "scene_id", "scene_type")


@query("C12_track_facts", f"""WITH {music.CURVE_SQL}, {music.CLIMAX_SQL}, a AS ({music.ranges_sql('curve', 'track_id', 'energy_raw < 4e-1')}), b AS ({music.ranges_sql('curve', 'track_id', 'energy_raw >= 7e-1')}),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id, kind ORDER BY r_start) AS i FROM (SELECT *, 'calm' AS kind FROM a UNION ALL SELECT *, 'energetic' FROM b) q),
 x AS (SELECT track_id, string_agg(CASE WHEN kind = 'calm' THEN CAST(CAST(r_start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r_end AS BIGINT) AS VARCHAR) END, ' ' ORDER BY r_start) AS calm,
   string_agg(CASE WHEN kind = 'energetic' THEN CAST(CAST(r_start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(r_end AS BIGINT) AS VARCHAR) END, ' ' ORDER BY r_start) AS energetic FROM r WHERE i <= 3 GROUP BY 1)
 SELECT t.track_id, t.bpm, t.duration, (SELECT COUNT(*) FROM fx_beats b WHERE b.track_id = t.track_id) AS beats, climax_t, coalesce(calm, '') AS calm, coalesce(energetic, '') AS energetic
 FROM fx_tracks t JOIN climax c ON c.track_id = t.track_id LEFT JOIN x ON x.track_id = t.track_id""")
def facts(fx):
    fx.settle("samples")
    from mediaplan.operators import music as M
    curve = music.curve(fx)
    return C.track_facts(fx.tracks, fx.beats, M.climax(curve, fx.tracks), M.energy_ranges(curve))


@query("C13_lookup", "SELECT scene_id, video_id FROM fx_scenes WHERE video_id IN (SELECT video_id FROM fx_videos WHERE fpv_showroom)")
def lookup(fx):
    return C.lookup(fx.scenes, fx.videos.filter("fpv_showroom").select("video_id")).select("scene_id", "video_id")


@query("C14_default_project", "SELECT arg_max(project_id, struct_pack(a := created_at, b := project_id)) AS project_id FROM fx_projects")
def default(fx):
    return C.default_project(fx.projects)


@query("C15_list_presets", "SELECT h.preset_id, title, dynamics, COUNT(p.project_id) AS projects FROM fx_preset_heads h LEFT JOIN fx_projects p ON p.preset_id = h.preset_id GROUP BY 1, 2, 3")
def list_presets(fx):
    """The presets, each with the number of projects that use it."""
    used = fx.projects.groupBy("preset_id").agg(F.count("*").alias("n"))
    return presets.list_presets(fx.spark).join(used, "preset_id", "left").select(
        "preset_id", "title", "dynamics", F.coalesce("n", F.lit(0).cast("long")).alias("projects"))
