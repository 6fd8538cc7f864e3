"""Queries for model output and text (group L)."""

from pyspark.sql import functions as F

from mediaplan.operators import annotate as L, presets
from .ranking import TEXT_SQL, chosen, tagged
from .registry import query

PARSE_SQL = r"""t0 AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS s FROM {src}),
 t1 AS (SELECT *, regexp_replace(s, '^`+|`+$', '', 'g') AS b FROM t0),
 t2 AS (SELECT *, CASE WHEN starts_with(s, '```') THEN CASE WHEN instr(b, chr(10)) > 0 THEN substring(b, instr(b, chr(10)) + 1) ELSE b END ELSE s END AS x FROM t1),
 t3 AS (SELECT *, CASE WHEN instr(x, '{{') > 0 THEN regexp_replace(regexp_replace(substring(x, instr(x, '{{')), '\s+$', ''), ',+$', '') END AS f0 FROM t2),
 t4 AS (SELECT *, CASE WHEN (length(f0) - length(replace(f0, '"', ''))) % 2 = 1 THEN regexp_replace(f0, ',[^,]*$', '', 's') ELSE f0 END AS f FROM t3),
 parsed AS (SELECT *, CASE WHEN json_valid(x) THEN x WHEN json_valid(regexp_extract(x, '\{{.*\}}', 0, 's')) THEN regexp_extract(x, '\{{.*\}}', 0, 's')
  WHEN json_valid(f || '}}') THEN f || '}}' WHEN json_valid(f || ']}}') THEN f || ']}}' WHEN json_valid(f || '"]}}') THEN f || '"]}}' WHEN json_valid(f || '}}}}') THEN f || '}}}}' END AS j FROM t4)"""


@query("L1_parse_reply", f"""WITH {PARSE_SQL.format(src='fx_replies')} SELECT scene_id, j IS NOT NULL AS parsed, CAST(json_extract_string(j, '$.k') AS DOUBLE) AS k FROM parsed""")
def parse(fx):
    df = L.parse_reply(fx.replies)
    return df.select("scene_id", F.col("reply").isNotNull().alias("parsed"), F.try_variant_get("reply", "$.k", "double").alias("k"))


REPLY_TEXT = """event_id AS scene_id, CASE WHEN event_id % 11 = 5 THEN 'no reply' WHEN event_id % 13 = 0 THEN '{}' ELSE
 '{"scene_description":"' || event_type || ' seen","people_count":' || CAST(event_id % 4 AS VARCHAR(20)) || ',"aesthetic_score":' || CAST(event_id % 12 AS VARCHAR(20)) || '.5' ||
 ',"subject_x":0.' || CAST(event_id % 10 AS VARCHAR(20)) || ',"scene_type":"detail","tags":["' || event_type || '","wide"]' ||
 CASE event_id % 5 WHEN 0 THEN ',"usable_for_edit":false' WHEN 1 THEN ',"usable_for_edit":true' ELSE '' END ||
 CASE event_id % 3 WHEN 0 THEN '}' WHEN 1 THEN ',"lighting":"so' ELSE '} end' END END AS content"""


@query("L2_apply_annotations", f"""WITH r AS (SELECT {REPLY_TEXT} FROM events), {PARSE_SQL.format(src='r')},
 m AS (SELECT s.*, p.scene_id IS NOT NULL AS asked, coalesce(j IS NOT NULL AND j <> '{{}}' AND json_type(j) = 'OBJECT', false) AS ok, j FROM fx_scenes s LEFT JOIN parsed p ON s.scene_id = p.scene_id),
 a AS (SELECT *, coalesce(CAST(json_extract(j, '$.aesthetic_score') AS DOUBLE), 0e0) AS raw, coalesce(CAST(json_extract(j, '$.subject_x') AS DOUBLE), 0e0) AS sx FROM m)
 SELECT scene_id, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.scene_description'), '') ELSE description END AS description,
  CASE WHEN ok THEN coalesce(CAST(json_extract(j, '$.people_count') AS BIGINT), 0) ELSE people_count END AS people_count,
  CASE WHEN ok THEN round(least(CASE WHEN raw > 1 THEN raw / 10 ELSE raw END, 1e0) + 1e-9, 6) ELSE aesthetic_score END AS aesthetic_score,
  CASE WHEN ok THEN CASE WHEN sx = 0 THEN 5e-1 ELSE least(greatest(sx, 0e0), 1e0) END END AS subject_x,
  CASE WHEN ok THEN json_extract_string(j, '$.scene_type') ELSE scene_type END AS scene_type,
  CASE WHEN ok THEN json_extract_string(j, '$.tags[0]') || ',wide' || CASE WHEN json_extract_string(j, '$.usable_for_edit') = 'false' THEN ',not-usable' ELSE '' END ELSE tag END AS tags,
  CASE WHEN ok THEN 'done' WHEN asked THEN 'failed' ELSE llm_status END AS llm_status FROM a""")
def apply(fx):
    replies = L.parse_reply(fx.table("events").selectExpr(*exprs(REPLY_TEXT)))
    df = L.apply_annotations(tagged(fx), replies)
    asked = F.col("aesthetic_score")
    return df.select("scene_id", "description", F.col("people_count").cast("long").alias("people_count"),
                     F.when(F.col("subject_x").isNull(), asked).otherwise(F.round(asked + 1e-9, 6)).alias("aesthetic_score"),
                     "subject_x", "scene_type", F.array_join("tags", ",").alias("tags"), "llm_status")


def exprs(text):
    from .fixtures import exprs as split
    return split(text)


@query("L3_annotation_backlog", """SELECT scene_id, CAST(CASE llm_status WHEN 'pending' THEN 0 ELSE 1 END AS INT) AS queue FROM fx_scenes WHERE llm_status IN ('pending', 'failed')""")
def backlog(fx):
    return L.annotation_backlog(fx.scenes).select("scene_id", "queue")


@query("L3_fail_without_frame", """SELECT scene_id, CASE WHEN llm_status IN ('pending', 'failed') AND scene_id NOT IN (SELECT l_orderkey FROM lineitem) THEN 'failed' ELSE llm_status END AS llm_status FROM fx_scenes""")
def no_frame(fx):
    return L.fail_without_frame(fx.scenes, fx.table("lineitem").selectExpr("l_orderkey AS scene_id")).select("scene_id", "llm_status")


@query("L4_scene_cards", """SELECT scene_id, CAST(json_object('id', scene_id, 'duration', round(end_s - start_s + 1e-9, 3), 'description', description, 'tags', [tag], 'scene_type', scene_type,
 'quality', round(quality_score + 1e-9, 2), 'aesthetic', round(aesthetic_score + 1e-9, 2), 'motion', motion, 'motion_type', motion_type, 'people_count', people_count) AS VARCHAR) AS card FROM fx_scenes""")
def cards(fx):
    return L.scene_cards(tagged(fx))


KEY_SQL = f"""{TEXT_SQL}, k AS (SELECT p.project_id, substring(md5(CASE WHEN p.scenario_text <> '' THEN p.scenario_text ELSE t.preset_text END), 1, 12) AS skey
  FROM fx_projects p JOIN texts t ON t.preset_id = CASE WHEN p.preset_id IN (SELECT preset_id FROM fx_preset_heads) THEN p.preset_id ELSE 'generic' END),
 s AS (SELECT s.*, k.skey, CASE WHEN s.scene_id % 5 = 0 THEN k.skey WHEN s.scene_id % 5 = 1 THEN '' ELSE 'old' END AS scenario_match_key FROM fx_scenes s JOIN k ON s.project_id = k.project_id),
 todo AS (SELECT * FROM s WHERE llm_status = 'done' AND scenario_match_key <> skey)"""


def todo(fx):
    projects = chosen(fx)
    keys = projects.select("project_id", L.scenario_key("scenario").alias("_k"))
    s = fx.scenes.join(keys, "project_id").withColumn(
        "scenario_match_key", F.expr("CASE WHEN scene_id % 5 = 0 THEN _k WHEN scene_id % 5 = 1 THEN '' ELSE 'old' END"))
    return L.rank_backlog(s.drop("_k"), projects)


@query("L5_rank_backlog", f"WITH {KEY_SQL} SELECT scene_id, skey AS scenario_key FROM todo")
def rank_backlog(fx):
    return todo(fx).select("scene_id", "scenario_key")


@query("L6_batch_rows", f"WITH {KEY_SQL} SELECT scene_id, project_id, (ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY video_id, start_s, scene_id) - 1) // 25 AS batch_no FROM todo")
def batches(fx):
    return L.batch_rows(todo(fx), ["project_id"], F.struct("video_id", F.floor(F.col("start_s") / 3600)), ["video_id", "start_s", "scene_id"]).select("scene_id", "project_id", "batch_no")


@query("L7_apply_match", """WITH l AS (SELECT l_orderkey AS scene_id, arg_max(l_extendedprice / 5e4, struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_linenumber, e := l_extendedprice)) AS m FROM lineitem GROUP BY 1)
 SELECT s.scene_id, CASE WHEN m IS NULL THEN scenario_match_score ELSE least(greatest(m, 0e0), 1e0) END AS scenario_match_score, CASE WHEN m IS NULL THEN '' ELSE 'k1' END AS scenario_match_key
 FROM fx_scenes s LEFT JOIN l ON s.scene_id = l.scene_id""")
def match(fx):
    scores = fx.table("lineitem").selectExpr("l_orderkey AS scene_id", "l_extendedprice / 5e4 AS match", "'k1' AS scenario_key",
                                             "struct(l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS seq")
    return L.apply_match(fx.scenes.withColumn("scenario_match_key", F.lit("")), scores).select(
        "scene_id", "scenario_match_score", "scenario_match_key")


@query("L8_scenario_text", f"WITH {TEXT_SQL}, used AS (SELECT DISTINCT preset_id FROM fx_projects) SELECT t.preset_id, t.preset_text FROM texts t JOIN used ON t.preset_id = used.preset_id")
def scenario(fx):
    return presets.scenario_text(fx.spark).join(fx.projects.select("preset_id").distinct(), "preset_id")


def longer_is_better(frame):
    """A stand-in scorer: the share of a card's length in 400 characters."""
    return (frame["card"].str.len() / 400.0).clip(0, 1)


@query("L9_score_with", """SELECT scene_id, least(length(CAST(json_object('id', scene_id, 'duration', round(end_s - start_s + 1e-9, 3), 'description', description, 'tags', [tag], 'scene_type', scene_type,
 'quality', round(quality_score + 1e-9, 2), 'aesthetic', round(aesthetic_score + 1e-9, 2), 'motion', motion, 'motion_type', motion_type, 'people_count', people_count) AS VARCHAR)) / 4e2, 1e0) AS match FROM fx_scenes""")
def score_with(fx):
    return L.score_with(L.scene_cards(tagged(fx)), longer_is_better)


@query("L10_repair_ranges", """WITH raw AS (SELECT video_id, zone_no AS no, zone_no * 3 - 1 AS a, zone_no * 3 + video_id % 4 AS b, COUNT(*) OVER (PARTITION BY video_id) * 3 - 1 AS sc FROM fx_zones),
 o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY no) AS i FROM raw),
 f AS (SELECT video_id, i, no, greatest(a, 0) AS a2, least(b, sc - 1) AS b2, CASE WHEN greatest(a, 0) <= least(b, sc - 1) THEN least(b, sc - 1) ELSE -1 END AS prev FROM o WHERE i = 1
  UNION ALL SELECT o.video_id, o.i, o.no, greatest(o.a, f.prev + 1), least(o.b, o.sc - 1), CASE WHEN greatest(o.a, f.prev + 1) <= least(o.b, o.sc - 1) THEN least(o.b, o.sc - 1) ELSE f.prev END
  FROM f JOIN o ON o.video_id = f.video_id AND o.i = f.i + 1)
 SELECT video_id, no, a2 AS first_index, b2 AS last_index FROM f WHERE a2 <= b2""")
def repair(fx):
    return L.repair_ranges(range_replies(fx))


def range_replies(fx):
    """One model reply per video: index ranges that overlap and run over the end."""
    r = fx.zones.selectExpr("video_id", "struct(zone_no AS no, zone_no * 3 - 1 AS a, zone_no * 3 + video_id % 4 AS b) AS r")
    return r.groupBy("video_id").agg(F.sort_array(F.collect_list("r")).alias("ranges"), (F.count("*") * 3 - 1).alias("scene_count"))
