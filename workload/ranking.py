"""Queries for scene scoring and ranking (group R)."""

from pyspark.sql import functions as F

from mediaplan.operators import presets, ranking as R
from .registry import query

SCORE_SQL = """
 SELECT s.*, p.slot_no, p.slot, p.preset_id, p.min_fragment, p.max_fragment, p.types, p.motions,
  round(35e-2 * CASE WHEN coalesce(list_position(string_split(p.types, ','), s.scene_type), 0) > 0
     THEN 1e0 - 15e-2 * (list_position(string_split(p.types, ','), s.scene_type) - 1)
    WHEN s.recommended_slot = p.slot THEN 7e-1 ELSE 3e-1 END
   + 15e-2 * CASE WHEN p.motions = '' OR list_contains(string_split(p.motions, ','), s.motion) THEN 1e0
    WHEN s.motion = 'fast' AND p.slot IN ('intro', 'ending') THEN 1e-1 ELSE 3e-1 END
   + 25e-2 * (6e-1 * s.quality_score + 4e-1 * CASE WHEN s.aesthetic_score = 0 THEN s.quality_score ELSE s.aesthetic_score END)
   + 25e-2 * CASE WHEN s.scenario_match_score = 0 THEN 5e-1 ELSE s.scenario_match_score END
   + CASE s.user_flag WHEN 'pinned' THEN 5e-1 WHEN 'good' THEN 2e-1 WHEN 'bad' THEN -4e-1 ELSE 0e0 END + 1e-9, 4) AS score
 FROM usable s JOIN chosen c ON s.project_id = c.project_id JOIN fx_presets p ON p.preset_id = c.used_preset"""

POOL_SQL = f"""usable AS (SELECT * FROM fx_scenes WHERE user_flag <> 'banned' AND tag <> 'not-usable'),
 chosen AS (SELECT project_id, CASE WHEN preset_id IN (SELECT preset_id FROM fx_presets) THEN preset_id ELSE 'generic' END AS used_preset FROM fx_projects),
 scored AS ({SCORE_SQL}),
 ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id, preset_id, slot ORDER BY score DESC, video_id, start_s, scene_id) AS rank
  FROM scored WHERE round(end_s - start_s + 1e-9, 3) >= min_fragment)"""


def tagged(fx):
    return fx.scenes.withColumn("tags", F.array("tag"))


def chosen(fx):
    return presets.resolve_presets(fx.projects)


def scored(fx):
    pool = R.usable_scenes(tagged(fx))
    return R.slot_scores(R.with_slots(pool, chosen(fx), presets.preset_slots(fx.spark)))


@query("R1_usable_scenes", f"""SELECT scene_id, video_id, project_id FROM fx_scenes
 WHERE user_flag <> 'banned' AND tag <> 'not-usable'""")
def usable(fx):
    return R.usable_scenes(tagged(fx)).select("scene_id", "video_id", "project_id")


GATE_SQL = """m AS (SELECT s.*, p.stabilize_shaky AS keep,
   (user_flag = 'pinned' OR (motion_type <> 'shake' AND stability_score >= 55e-2)) AS steady
  FROM fx_scenes s JOIN fx_projects p ON s.project_id = p.project_id
  WHERE user_flag <> 'banned' AND tag <> 'not-usable'),
 c AS (SELECT *, COUNT(*) OVER (PARTITION BY project_id) AS n,
   SUM(CASE WHEN steady THEN 1 ELSE 0 END) OVER (PARTITION BY project_id) AS ok,
   ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY jerkiness, video_id, start_s, scene_id) - 1 AS r FROM m)"""


@query("R2_stability_gate", f"""WITH {GATE_SQL}
 SELECT scene_id, project_id FROM c WHERE keep OR (ok >= 3 AND steady) OR (ok < 3 AND r < greatest(n // 2, 3))""")
def gate(fx):
    return R.stability_gate(R.usable_scenes(tagged(fx)), fx.projects).select("scene_id", "project_id")


@query("R2_stability_gate_fallback", f"""WITH {GATE_SQL.replace("stability_score >= 55e-2", "stability_score >= 995e-3").replace("user_flag = 'pinned'", "user_flag = 'none'")}
 SELECT scene_id, project_id FROM c WHERE keep OR (ok >= 3 AND steady) OR (ok < 3 AND r < greatest(n // 2, 3))""")
def gate_fallback(fx):
    pool = R.usable_scenes(tagged(fx)).withColumn(
        "user_flag", F.when(F.col("user_flag") == "pinned", "").otherwise(F.col("user_flag")))
    return R.stability_gate(pool, fx.projects, min_stability=0.995).select("scene_id", "project_id")


@query("R2_pool_report", """WITH p AS (SELECT project_id, stabilize_shaky FROM fx_projects UNION ALL SELECT -1, false),
 u AS (SELECT project_id, COUNT(*) AS usable, COUNT(CASE WHEN user_flag = 'pinned' OR (motion_type <> 'shake' AND stability_score >= 9e-1) THEN 1 END) AS steady
  FROM fx_scenes WHERE user_flag <> 'banned' AND tag <> 'not-usable' GROUP BY 1)
 SELECT p.project_id, coalesce(usable, 0) AS usable, coalesce(steady, 0) AS steady, NOT stabilize_shaky AND coalesce(usable, 0) > 0 AND coalesce(steady, 0) < 3 AS fallback,
  CASE WHEN coalesce(usable, 0) = 0 THEN 'Нет пригодных сцен для монтажа' END AS problem FROM p LEFT JOIN u ON u.project_id = p.project_id""")
def pool_report(fx):
    """The given projects, and one that has no scenes."""
    projects = fx.projects.select("project_id", "stabilize_shaky").union(fx.spark.sql("SELECT -1L, false"))
    return R.pool_report(tagged(fx), projects, min_stability=0.9)


@query("R3_slot_scores", f"WITH {POOL_SQL} SELECT scene_id, project_id, preset_id, slot, score FROM scored")
def slot_scores(fx):
    return scored(fx).select("scene_id", "project_id", "preset_id", "slot", "score")


GROUNDS_SQL = """list_filter([
  CASE WHEN coalesce(list_position(string_split(types, ','), scene_type), 0) > 0 THEN 'тип «' || scene_type || '» подходит слоту'
   WHEN recommended_slot = slot THEN 'LLM рекомендовала это место в ролике' END,
  CASE WHEN motions <> '' AND list_contains(string_split(motions, ','), motion) THEN 'движение «' || motion || '» соответствует динамике' END,
  CASE WHEN aesthetic_score >= 7e-1 THEN 'высокая эстетика кадра' END,
  CASE WHEN scenario_match_score >= 7e-1 THEN 'высокое соответствие сценарию' END,
  CASE WHEN user_flag = 'pinned' THEN 'закреплена пользователем' END], lambda x: x IS NOT NULL)"""
REASON_SQL = """CASE WHEN len(l) = 0 THEN 'лучший доступный кандидат (q=' || printf('%.2f', round(quality_score + 1e-9, 2)) || ')'
  ELSE array_to_string(l[1:3], '; ') END"""


@query("R4_slot_reasons", f"""WITH {POOL_SQL}, g AS (SELECT scene_id, slot, quality_score, {GROUNDS_SQL} AS l FROM scored)
 SELECT scene_id, slot, {REASON_SQL} AS reason FROM g""")
def slot_reasons(fx):
    return R.slot_reasons(scored(fx)).select("scene_id", "slot", "reason")


@query("R5_rank_for_slot", f"WITH {POOL_SQL} SELECT scene_id, project_id, preset_id, slot, score, rank FROM ranked WHERE rank <= 3")
def rank_top(fx):
    return R.rank_for_slot(scored(fx), 3).select(
        "scene_id", "project_id", "preset_id", "slot", "score", "rank")


def slim(fx, *more):
    """Scored pairs with no more than a full ranking reads: it moves and stores every column it gets."""
    return scored(fx).select("project_id", "preset_id", "slot", "score", *R.CATALOGUE_ORDER, "end_s", "min_fragment", *more)


@query("R5_rank_all", f"WITH {POOL_SQL} SELECT scene_id, project_id, slot, rank FROM ranked")
def rank_all(fx):
    return R.rank_for_slot(slim(fx)).select("scene_id", "project_id", "slot", "rank")


@query("R6_variant_order", f"""WITH {POOL_SQL} SELECT scene_id, project_id, slot,
  CASE WHEN rank <= 6 THEN ROW_NUMBER() OVER (PARTITION BY project_id, preset_id, slot, rank <= 6
    ORDER BY user_flag <> 'pinned', md5('2:' || slot || ':' || CAST(scene_id AS VARCHAR))) ELSE rank END AS position FROM ranked""")
def variant_order(fx):
    return R.variant_order(R.rank_for_slot(slim(fx, "user_flag")), 2).select(
        "scene_id", "project_id", "slot", "position")


CENTRED = """least(greatest(CASE WHEN best_moment > start_s AND best_moment < end_s THEN best_moment
  ELSE start_s + round(end_s - start_s + 1e-9, 3) / 2 END - {n} / 2, start_s), end_s - {n})"""


@query("R7_center_fragment", f"""SELECT scene_id,
 CASE WHEN round(end_s - start_s + 1e-9, 3) <= 45e-1 THEN start_s ELSE round({CENTRED.format(n='45e-1')} + 1e-9, 3) END AS src_start,
 CASE WHEN round(end_s - start_s + 1e-9, 3) <= 45e-1 THEN end_s ELSE round({CENTRED.format(n='45e-1')} + 45e-1 + 1e-9, 3) END AS src_end
 FROM fx_scenes""")
def center_fragment(fx):
    return R.center_fragment(fx.scenes, 4.5).select("scene_id", "src_start", "src_end")


def frags(fx):
    """One fragment to place per scene, at most four seconds."""
    return fx.scenes.selectExpr(
        "scene_id AS frag_id", "video_id", "start_s", "end_s", "best_moment",
        "least(round(end_s - start_s, 3), 4D) AS frag_len", "motion = 'fast' AS allow_fast")


def clock20(fx):
    """Calmer motion samples, so that some windows pass."""
    return fx.samples.selectExpr("video_id", "n", "t20 AS t", "dx / 3 AS dx", "dy / 3 AS dy")


CHECK_SQL = """prev AS (SELECT video_id, n, t20 AS t, dx / 3 AS dx, dy / 3 AS dy, sqrt(dx / 3 * (dx / 3) + dy / 3 * (dy / 3)) AS speed FROM fx_samples),
 pairs AS (SELECT *, lag(t) OVER w AS pt, abs(speed - lag(speed) OVER w) AS acc,
   coalesce(dx * lag(dx) OVER w + dy * lag(dy) OVER w < 0 AND speed * lag(speed) OVER w > 9e0, false) AS flip
  FROM prev WINDOW w AS (PARTITION BY video_id ORDER BY n)),
 checked AS (SELECT w.window_id, w.allow_fast, COUNT(p.t) AS n, quantile_cont(p.speed, 95e-2) AS sp,
   quantile_cont(CASE WHEN p.pt >= w.a THEN p.acc END, 95e-2) AS ac, COUNT(CASE WHEN p.pt >= w.a AND p.flip THEN 1 END) AS fl
  FROM windows w LEFT JOIN pairs p ON w.video_id = p.video_id AND p.t >= w.a AND p.t <= w.b GROUP BY 1, 2),
 verdict AS (SELECT window_id,
   n < 4 OR (sp <= CASE WHEN allow_fast THEN 22e0 ELSE 10e0 END AND ac <= CASE WHEN allow_fast THEN 12e0 ELSE 6e0 END
    AND fl <= CASE WHEN allow_fast THEN 3 ELSE 1 END) AS ok,
   CASE WHEN n < 4 THEN 0e0 ELSE round(ac + 4e-1 * sp + 2e0 * fl + 1e-9, 3) END AS badness FROM checked)"""


@query("R8_best_window", f"""WITH f AS (SELECT scene_id AS frag_id, video_id, start_s, end_s, best_moment,
   least(round(end_s - start_s, 3), 4e0) AS len, motion = 'fast' AS allow_fast FROM fx_scenes),
 g AS (SELECT *, CASE WHEN round(end_s - start_s + 1e-9, 3) <= len + 2e-1 THEN [start_s]
   ELSE list_transform(range(CAST(ceil((end_s - len - start_s + 1e-2) / 5e-1) AS BIGINT)), lambda i: start_s + i * 5e-1) END AS grid FROM f),
 h AS (SELECT *, CASE WHEN round(end_s - start_s + 1e-9, 3) > len + 2e-1 AND grid[-1] < end_s - len - 5e-2 THEN list_append(grid, end_s - len) ELSE grid END AS filled FROM g),
 tries AS (SELECT frag_id, video_id, len, allow_fast, unnest(filled) AS st,
   CASE WHEN round(end_s - start_s + 1e-9, 3) <= len THEN start_s ELSE round({CENTRED.format(n='len')} + 1e-9, 3) END AS centre FROM h),
 windows AS (SELECT struct_pack(f := frag_id, s := st) AS window_id, video_id, st AS a, st + len AS b, allow_fast FROM tries),
 {CHECK_SQL},
 best AS (SELECT t.frag_id, t.len, arg_min(t.st, struct_pack(b := round(v.badness + 5e-2 * abs(t.st - t.centre) + 1e-9, 6), s := t.st)) AS st
  FROM tries t JOIN verdict v ON v.window_id.f = t.frag_id AND v.window_id.s = t.st WHERE v.ok GROUP BY 1, 2),
 seen AS (SELECT DISTINCT h.frag_id FROM h JOIN prev p ON h.video_id = p.video_id AND p.t >= h.start_s AND p.t <= h.end_s)
 SELECT h.frag_id,
  CASE WHEN s.frag_id IS NOT NULL THEN round(b.st + 1e-9, 3) WHEN round(end_s - start_s + 1e-9, 3) <= h.len THEN start_s
   ELSE round({CENTRED.format(n='h.len')} + 1e-9, 3) END AS src_start,
  CASE WHEN s.frag_id IS NOT NULL THEN round(b.st + b.len + 1e-9, 3) WHEN round(end_s - start_s + 1e-9, 3) <= h.len THEN end_s
   ELSE round({CENTRED.format(n='h.len')} + h.len + 1e-9, 3) END AS src_end
 FROM h LEFT JOIN seen s ON h.frag_id = s.frag_id LEFT JOIN best b ON h.frag_id = b.frag_id""")
def best_window(fx):
    return R.best_window(frags(fx), clock20(fx))


INTEREST_SQL = """SELECT s.*, (s.people_count > 0 OR d.scene_id IS NOT NULL) AS has_person,
  round(CASE WHEN motion = 'static' AND NOT (s.people_count > 0 OR d.scene_id IS NOT NULL) THEN 25e-2 ELSE 1e0 END
   * (CASE WHEN s.people_count > 0 OR d.scene_id IS NOT NULL THEN 55e-2 ELSE 0e0 END + 35e-2 * aesthetic_score + 1e-1 * quality_score) + 1e-9, 4) AS interest
 FROM fx_scenes s LEFT JOIN (SELECT DISTINCT l_orderkey AS scene_id FROM lineitem WHERE l_quantity >= 48) d ON s.scene_id = d.scene_id"""


def detected(fx):
    """Scenes in which a detector saw somebody."""
    return fx.table("lineitem").filter("l_quantity >= 48").selectExpr("l_orderkey AS scene_id")


@query("R9_interest", f"SELECT scene_id, has_person, interest FROM ({INTEREST_SQL}) q")
def interest(fx):
    return R.interest(fx.scenes, detected(fx)).select("scene_id", "has_person", "interest")


TEXT_SQL = """texts AS (SELECT h.preset_id, 'Идея ролика: ' || idea || chr(10) || 'Динамика: ' || dynamics || '.' || chr(10) || 'Структура:' || chr(10) ||
  (SELECT string_agg('- ' || slot || ' (~' || CAST(CAST(floor(share * 100) AS INT) AS VARCHAR) || '%): типы сцен ' || replace(types, ',', ', '), chr(10) ORDER BY slot_no)
   FROM fx_presets p WHERE p.preset_id = h.preset_id)
  || chr(10) || 'Вступление: ' || intro_rule || chr(10) || 'Финал: ' || ending_rule AS preset_text FROM fx_preset_heads h)"""


@query("R10_resolve_presets", f"""WITH {TEXT_SQL} SELECT p.project_id, t.preset_id AS used_preset,
  CASE WHEN p.scenario_text <> '' THEN p.scenario_text ELSE t.preset_text END AS scenario
 FROM fx_projects p JOIN texts t ON t.preset_id = CASE WHEN p.preset_id IN (SELECT preset_id FROM fx_preset_heads) THEN p.preset_id ELSE 'generic' END""")
def resolve(fx):
    return chosen(fx).select("project_id", "used_preset", "scenario")
