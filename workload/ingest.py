"""Queries for sources, incremental load and sinks (group I)."""

from pyspark.sql import functions as F

from mediaplan.sources import ingest as I, tables as T
from .registry import query

LISTING = """'/media/import' || CASE page_id % 5 WHEN 0 THEN '/.cache' WHEN 1 THEN '/day/.old' ELSE '/day' END || '/clip' || CAST(page_id % 200 AS VARCHAR(20)) ||
 CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' ELSE '.Mkv' END AS path, '/media/import' AS root, page_id % 7 = 0 AS explicit"""


@query("I1_select_media", f"""SELECT DISTINCT path FROM (SELECT {LISTING} FROM pages) q
 WHERE lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('mp4', 'mov', 'm4v', 'avi', 'mkv') AND (explicit OR NOT contains(substring(path, 14), '/.'))""")
def select_media(fx):
    from .fixtures import exprs
    return I.select_media(fx.table("pages").selectExpr(*exprs(LISTING)))


@query("I2_fingerprint", """SELECT page_id, md5(CAST(octet_length(encode(html)) AS VARCHAR) || ':' || CAST(page_id * 1000 AS VARCHAR) || html) AS fingerprint FROM pages""")
def fingerprint(fx):
    pages = fx.table("pages").select("page_id", F.encode("html", "utf-8").alias("content"), (F.col("page_id") * 1000).alias("mtime"),
                                     F.octet_length("html").alias("size_bytes"))
    return I.fingerprint(pages).select("page_id", "fingerprint")


VIDEO_FILES = "fx_files_v AS (SELECT file_id AS video_id, project_id, path, fingerprint FROM fx_files WHERE mtime_ms % 3000 <> 0)"


def earlier(fx):
    """Videos of an earlier import."""
    return fx.files.filter("mtime_ms % 3000 <> 0").selectExpr("file_id AS video_id", "project_id", "path", "fingerprint")


@query("I3_plan_increment", f"""WITH {VIDEO_FILES}, k AS (SELECT project_id, fingerprint, MAX(video_id) AS video_id FROM fx_files_v GROUP BY 1, 2)
 SELECT f.file_id, CASE WHEN k.video_id IN (SELECT video_id FROM fx_scenes) THEN 'cached' ELSE 'analyse' END AS action
 FROM fx_files f LEFT JOIN k ON f.project_id = k.project_id AND f.fingerprint = k.fingerprint""")
def plan_increment(fx):
    return I.plan_increment(fx.files, earlier(fx), fx.scenes).select("file_id", "action")


SUPERSEDE = """gone AS (SELECT video_id FROM fx_videos WHERE width = 1920)"""


@query("I4_supersede", f"""WITH {SUPERSEDE} SELECT 'videos' AS part, video_id, COUNT(*) AS kept FROM fx_videos WHERE video_id NOT IN (SELECT * FROM gone) GROUP BY 1, 2
 UNION ALL SELECT 'scenes', video_id, COUNT(*) FROM fx_scenes WHERE video_id NOT IN (SELECT * FROM gone) GROUP BY 1, 2
 UNION ALL SELECT 'zones', video_id, COUNT(*) FROM fx_zones WHERE video_id NOT IN (SELECT * FROM gone) GROUP BY 1, 2""")
def supersede(fx):
    left = I.supersede(fx.videos, fx.scenes, fx.zones, fx.videos.filter("width = 1920"))
    out = [df.groupBy("video_id").agg(F.count("*").alias("kept")).withColumn("part", F.lit(n)) for n, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("I5_upsert", """WITH d AS (SELECT l_orderkey AS scene_id, arg_max(l_linestatus || l_returnflag, struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_linenumber, e := l_extendedprice)) AS status FROM lineitem GROUP BY 1)
 SELECT coalesce(o.o_orderkey, d.scene_id) AS scene_id, coalesce(d.status, o.o_orderstatus) AS status FROM orders o FULL JOIN d ON d.scene_id = o.o_orderkey""")
def upsert(fx):
    base = fx.table("orders").selectExpr("o_orderkey AS scene_id", "o_orderstatus AS status")
    delta = fx.table("lineitem").selectExpr("l_orderkey AS scene_id", "l_linestatus || l_returnflag AS status",
                                            "struct(l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS at")
    return I.upsert(base, delta, ["scene_id"], F.col("at"))


GONE = "project_id IN (SELECT project_id FROM fx_projects WHERE stabilize_shaky)"
PLAN_SQL = "plans AS (SELECT o_orderkey AS plan_id, CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id FROM orders)"


@query("I6_delete_projects", f"""WITH {PLAN_SQL} SELECT 'projects' AS part, COUNT(*) AS kept FROM fx_projects WHERE NOT {GONE}
 UNION ALL SELECT 'scenes', COUNT(*) FROM fx_scenes WHERE NOT {GONE} UNION ALL SELECT 'plans', COUNT(*) FROM plans WHERE NOT {GONE}
 UNION ALL SELECT 'replacements', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT plan_id FROM plans WHERE {GONE})""")
def delete(fx):
    left = I.delete_projects(
        {"projects": fx.projects, "scenes": fx.scenes, "plans": plans(fx),
         "replacements": fx.table("lineitem").selectExpr("l_orderkey AS plan_id", "l_partkey")},
        fx.projects.filter("stabilize_shaky"))
    parts = [df.agg(F.count("*").alias("kept")).withColumn("part", F.lit(n)) for n, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plans(fx):
    return fx.table("orders").selectExpr("o_orderkey AS plan_id", "CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id")


@query("I7_load_documents", """SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END, -1) AS k,
 CASE WHEN event_type = 'view' THEN event_type ELSE 'none' END AS label FROM events""")
def documents(fx):
    raw = fx.table("events").selectExpr("event_id", "CASE WHEN event_type = 'view' THEN '{\"label\":\"view\",\"later\":[1,2]}' ELSE props END AS data")
    return I.load_documents(raw, "k BIGINT, label STRING", {"k": -1, "label": "none"}).select("event_id", "k", "label")


SEG_DOC = """'{"segments":[{"scene_id":"' || CAST(o_orderkey AS VARCHAR(20)) || '","order":0,"src_start":1.5,"src_end":4.0,"slot":"intro"},{"scene_id":"b","order":1,"src_start":0.0,"src_end":2.0,"slot":"main","speed":2.0}]}'"""


@query("I7_load_segments", """SELECT o_orderkey AS plan_id, CAST(i AS BIGINT) AS seg_no, CASE i WHEN 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'b' END AS scene_id,
 CASE i WHEN 0 THEN 25e-1 ELSE 2e0 END AS len, CASE i WHEN 0 THEN 1e0 ELSE 2e0 END AS speed, 'center' AS crop FROM orders, range(0, 2) r(i)""")
def segments(fx):
    docs = fx.table("orders").selectExpr("o_orderkey AS plan_id", f"{SEG_DOC} AS data")
    return I.load_segments(docs).selectExpr("plan_id", "seg_no", "scene_id", "src_end - src_start AS len", "speed", "crop")


@query("I8_log_replacements", """SELECT plan_id, COUNT(*) AS replaced, MAX(scene_id) AS last_scene FROM fx_segments GROUP BY 1""")
def replacements(fx):
    """History in two appends, one per half of the log, and read back."""
    path = T.scratch_path(fx.spark, "replacements")
    log = fx.segments.selectExpr("plan_id", "seg_no", "scene_id AS old_scene_id", "scene_id AS new_scene_id", "src_start AS replaced_at", "speed")
    T.log_replacements(log.filter("speed = 1"), path)
    T.log_replacements(log.filter("speed <> 1"), path)
    return fx.spark.read.parquet(path).groupBy("plan_id").agg(
        F.count("*").alias("replaced"), F.max("new_scene_id").alias("last_scene"))


@query("I9_flatten_probe", """WITH j AS (SELECT video_id, json_extract_string(probe_json, '$.format.duration') AS d, json_extract_string(probe_json, '$.format.bit_rate') AS br,
  json_extract_string(probe_json, '$.streams[0].width') AS w, json_extract_string(probe_json, '$.streams[0].height') AS h, json_extract_string(probe_json, '$.streams[0].avg_frame_rate') AS r,
  json_extract_string(probe_json, '$.streams[0].side_data_list[0].rotation') AS rot, json_extract_string(probe_json, '$.streams[1].codec_type') AS a FROM fx_probe),
 t AS (SELECT video_id, CAST(d AS DOUBLE) AS duration, CAST(br AS BIGINT) AS bitrate, CAST(w AS INT) AS width, CAST(h AS INT) AS height, a IS NOT NULL AS has_audio,
  CASE WHEN split_part(r, '/', 2) = '0' THEN 0e0 ELSE round(CAST(split_part(r, '/', 1) AS DOUBLE) / CAST(split_part(r, '/', 2) AS DOUBLE) + 1e-9, 3) END AS fps, abs(coalesce(CAST(rot AS INT), 0)) IN (90, 270) AS turned FROM j)
 SELECT video_id, duration, bitrate, width, height, has_audio, fps, CASE WHEN width = height THEN 'square' WHEN (width > height) <> turned THEN 'horizontal' ELSE 'vertical' END AS orientation,
  'h264' AS codec, duration > 0 AND width > 0 AS valid FROM t""")
def probe(fx):
    return I.flatten_probe(fx.probe)


@query("I10_save_and_load", "SELECT project_id, COUNT(*) AS scenes, SUM(scene_id)::BIGINT AS ids FROM fx_scenes GROUP BY 1")
def save_load(fx):
    path = T.scratch_path(fx.spark, "scenes")
    T.save_table(fx.scenes, path, buckets=8)
    return T.load_table(fx.spark, path).groupBy("project_id").agg(F.count("*").alias("scenes"), F.sum("scene_id").alias("ids"))


@query("I11_replace_zones", f"""SELECT video_id, zone_no, z_start FROM fx_zones WHERE video_id NOT IN (SELECT video_id FROM fx_videos WHERE width = 1920)
 UNION ALL SELECT video_id, zone_no + 100, z_start + 1 FROM fx_zones WHERE technical AND video_id IN (SELECT video_id FROM fx_videos WHERE width = 1920)""")
def replace_zones(fx):
    new = fx.zones.filter("technical").withColumn("zone_no", F.col("zone_no") + 100).withColumn("z_start", F.col("z_start") + 1)
    videos = fx.videos.filter("width = 1920")
    return I.replace_zones(fx.zones, new.join(videos, "video_id", "left_semi"), videos).select("video_id", "zone_no", "z_start")


@query("I11_delete_zones", "SELECT video_id, zone_no FROM fx_zones WHERE NOT technical")
def delete_zones(fx):
    return I.delete_zones(fx.zones, fx.zones.filter("technical")).select("video_id", "zone_no")


@query("I12_force_increment", f"""WITH {VIDEO_FILES} SELECT 'file' AS part, file_id AS id, 'analyse' AS action FROM fx_files
 UNION ALL SELECT 'kept', video_id, 'kept' FROM fx_files_v WHERE (project_id, path) NOT IN (SELECT project_id, path FROM fx_files)""")
def force(fx):
    plan = I.plan_increment(fx.files, earlier(fx), fx.scenes, force=True)
    left = I.supersede(earlier(fx), fx.scenes, fx.zones, plan.filter("action = 'analyse'"))["videos"]
    return plan.select(F.lit("file").alias("part"), F.col("file_id").alias("id"), "action").unionByName(
        left.select(F.lit("kept").alias("part"), F.col("video_id").alias("id"), F.lit("kept").alias("action")))
