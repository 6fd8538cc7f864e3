"""Queries for draft plans (group P)."""

from pyspark.sql import functions as F

from mediaplan.plans import drafts as P
from mediaplan.sources.tables import keep
from .ranking import GATE_SQL, GROUNDS_SQL, REASON_SQL, SCORE_SQL, chosen, clock20, tagged
from .registry import query
from .spans import A_SQL, CORR_SQL, HIST_SQL, hists

CUTS_SQL = """oc AS (SELECT DISTINCT plan_id, overlap, track_id FROM (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE 4e-1 END AS overlap, CAST(floor(o_custkey / 1e1) AS BIGINT) AS track_id FROM orders) q),
 cl AS (SELECT track_id, list_sort(list(DISTINCT cut_t)) AS cuts FROM fx_cuts GROUP BY 1),
 sg AS (SELECT g.plan_id, g.seg_no, g.src_start, g.src_end, coalesce(oc.overlap, 0e0) AS overlap, cl.cuts, MAX(g.seg_no) OVER (PARTITION BY g.plan_id) AS last_no
  FROM fx_segments g LEFT JOIN oc ON oc.plan_id = g.plan_id LEFT JOIN cl ON cl.track_id = oc.track_id)"""
STEP = """SELECT sg.plan_id, sg.seg_no, sg.src_start, sg.src_end, sg.overlap, sg.last_no, {at} AS at0, round(sg.src_end - sg.src_start + 1e-9, 3) AS dur,
   CASE WHEN sg.cuts IS NULL THEN NULL ELSE list_sort(list_transform(sg.cuts, lambda c: [abs(c - ({at} + round(sg.src_end - sg.src_start + 1e-9, 3) - CASE WHEN sg.seg_no < sg.last_no THEN sg.overlap / 2 ELSE 0e0 END)), c]))[1][2]
    - ({at} + round(sg.src_end - sg.src_start + 1e-9, 3) - CASE WHEN sg.seg_no < sg.last_no THEN sg.overlap / 2 ELSE 0e0 END) END AS delta FROM {src}"""


def played(fx):
    """Which track the film of a plan plays, from its start."""
    return fx.table("orders").selectExpr("o_orderkey AS plan_id", "CAST(floor(o_custkey / 1e1) AS BIGINT) AS track_id", "0D AS offset")


def overlaps(fx):
    return fx.table("orders").selectExpr("o_orderkey AS plan_id", "CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE 4e-1 END AS overlap")


@query("P3_snap_to_cuts", f"""WITH RECURSIVE {CUTS_SQL},
 snap AS (SELECT *, CASE WHEN abs(delta) <= 35e-2 AND dur + delta >= 1 THEN round(src_end + delta + 1e-9, 3) ELSE src_end END AS new_end FROM ({STEP.format(at='0e0', src='sg')}) q WHERE seg_no = 0
  UNION ALL SELECT *, CASE WHEN abs(delta) <= 35e-2 AND dur + delta >= 1 THEN round(src_end + delta + 1e-9, 3) ELSE src_end END FROM (
   {STEP.format(at='(p.at0 + round(p.new_end - p.src_start + 1e-9, 3) - CASE WHEN p.seg_no < p.last_no THEN p.overlap ELSE 0e0 END)', src='snap p JOIN sg ON sg.plan_id = p.plan_id AND sg.seg_no = p.seg_no + 1')}) q2)
 SELECT plan_id, seg_no, new_end AS src_end, coalesce(abs(delta) <= 35e-2 AND dur + delta >= 1, false) AS beat_synced FROM snap""")
def snap(fx):
    segments = fx.segments.select("plan_id", "seg_no", "src_start", "src_end")
    return P.snap_to_track(segments, played(fx), fx.cuts, overlaps(fx)).select("plan_id", "seg_no", "src_end", "beat_synced")


@query("P4_renumber", "SELECT plan_id, scene_id, ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY seg_no) - 1 AS seg_no FROM fx_segments WHERE speed = 1")
def renumber(fx):
    return P.renumber(fx.segments.filter("speed = 1")).select("plan_id", "scene_id", "seg_no")


@query("P5_segment_durations", """SELECT plan_id, seg_no, round(src_end - src_start + 1e-9, 3) AS source_s, round((src_end - src_start) / greatest(speed, 1e-2) + 1e-9, 3) AS out_s FROM fx_segments""")
def durations(fx):
    return P.segment_durations(fx.segments).select("plan_id", "seg_no", "source_s", "out_s")


@query("P5_plan_durations", "SELECT plan_id, round(SUM(round((src_end - src_start) / greatest(speed, 1e-2) + 1e-9, 3)) + 1e-9, 3) AS total_s FROM fx_segments GROUP BY 1")
def totals(fx):
    return P.plan_durations(fx.segments)


REQUEST_SQL = "rq AS (SELECT o_orderkey AS plan_id, CAST(o_orderkey % 3 AS BIGINT) AS seg_no, o_custkey * 7 AS new_scene_id, o_totalprice AS replaced_at FROM orders)"
REPLACE_SQL = f"""{REQUEST_SQL}, j AS (SELECT g.*, r.new_scene_id, r.replaced_at, s.scene_id IS NOT NULL AS hit, s.start_s, least(round(g.src_end - g.src_start + 1e-9, 3), round(s.end_s - s.start_s + 1e-9, 3)) AS len,
   round(s.end_s - s.start_s + 1e-9, 3) AS sd FROM fx_segments g LEFT JOIN rq r ON r.plan_id = g.plan_id AND r.seg_no = g.seg_no LEFT JOIN fx_scenes s ON s.scene_id = r.new_scene_id),
 rp AS (SELECT *, round(start_s + greatest((sd - len) / 2, 0e0) + 1e-9, 3) AS fr FROM j)"""


def replaced(fx):
    requests = fx.table("orders").selectExpr("o_orderkey AS plan_id", "CAST(o_orderkey % 3 AS BIGINT) AS seg_no",
                                             "o_custkey * 7 AS new_scene_id", "o_totalprice AS replaced_at")
    seg = fx.segments.withColumn("reason", F.lit("auto")).withColumn("beat_synced", F.col("speed") == 1)
    return P.replace_segments(seg, requests, fx.scenes)


@query("P6_replace_segments", f"""WITH {REPLACE_SQL} SELECT plan_id, seg_no, CASE WHEN hit THEN new_scene_id ELSE scene_id END AS scene_id, CASE WHEN hit THEN fr ELSE src_start END AS src_start,
 CASE WHEN hit THEN round(fr + len + 1e-9, 3) ELSE src_end END AS src_end, CASE WHEN hit THEN 'заменено пользователем' ELSE 'auto' END AS reason, (speed = 1 AND NOT hit) AS beat_synced FROM rp""")
def replace(fx):
    return replaced(fx)[0].select("plan_id", "seg_no", "scene_id", "src_start", "src_end", "reason", "beat_synced")


@query("P6_replacement_history", f"WITH {REPLACE_SQL} SELECT plan_id, seg_no, scene_id AS old_scene_id, new_scene_id, replaced_at FROM rp WHERE hit")
def history(fx):
    return replaced(fx)[1]


ALT = "plan_id, slot, seg_no AS pos, scene_id * 5 + 1 AS scene_id"


@query("P7_replacement_candidates", f"""WITH al AS (SELECT {ALT} FROM fx_segments WHERE seg_no >= 2), pl AS (SELECT o_orderkey AS plan_id, CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id FROM orders),
 rq AS (SELECT g.plan_id, g.seg_no, g.slot, g.scene_id AS cur, pl.project_id, s.scene_type AS ctype FROM fx_segments g JOIN pl ON pl.plan_id = g.plan_id LEFT JOIN fx_scenes s ON s.scene_id = g.scene_id),
 cd AS (SELECT r.plan_id, r.seg_no, a.scene_id, 0 AS g, CAST(a.pos AS DOUBLE) AS x, 0e0 AS y FROM rq r JOIN al a ON a.plan_id = r.plan_id AND a.slot = r.slot
    WHERE NOT EXISTS (SELECT 1 FROM fx_segments u WHERE u.plan_id = r.plan_id AND u.scene_id = a.scene_id)
  UNION ALL SELECT r.plan_id, r.seg_no, s.scene_id, 1, CAST(s.video_id AS DOUBLE), s.start_s FROM rq r JOIN fx_scenes s ON s.project_id = r.project_id
   WHERE s.user_flag <> 'banned' AND (s.recommended_slot = r.slot OR s.scene_type = r.ctype) AND NOT EXISTS (SELECT 1 FROM fx_segments u WHERE u.plan_id = r.plan_id AND u.scene_id = s.scene_id)
    AND NOT EXISTS (SELECT 1 FROM al a WHERE a.plan_id = r.plan_id AND a.slot = r.slot AND a.scene_id = s.scene_id)),
 rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY plan_id, seg_no ORDER BY g, x, y, scene_id) AS choice FROM cd)
 SELECT plan_id, seg_no, choice, scene_id FROM rk WHERE choice <= 4 AND scene_id IN (SELECT scene_id FROM fx_scenes)""")
def candidates(fx):
    from .ingest import plans
    fx.settle("scenes", "segments")
    seg = fx.segments
    return P.replacement_candidates(seg.select("plan_id", "seg_no"), seg,
                                    seg.filter("seg_no >= 2").selectExpr("plan_id", "slot", "seg_no AS pos", "scene_id * 5 + 1 AS scene_id"),
                                    plans(fx), fx.scenes)


@query("P8_preset_transition", """SELECT p.project_id, h.transition, CASE WHEN h.transition = 'cut' THEN 0e0 ELSE h.transition_s END AS transition_s
 FROM fx_projects p JOIN fx_preset_heads h ON h.preset_id = CASE WHEN p.preset_id IN (SELECT preset_id FROM fx_preset_heads) THEN p.preset_id ELSE 'generic' END""")
def transition(fx):
    return P.preset_transition(chosen(fx))


# Drafts in SQL: one step of the recursion looks at one candidate of every project. A slot is a list of its candidates in
# order; who looks alike and what is filmed in a scene are lists prepared before.
ALIKE_SQL = f"""{HIST_SQL}, tok AS (SELECT u.scene_id, any_value(u.project_id) AS project_id, any_value(u.scene_type) AS scene_type, list(t.token) AS tokens
  FROM usable u JOIN fx_tokens t ON t.scene_id = u.scene_id WHERE u.scene_type <> '' GROUP BY 1),
 pairs AS (SELECT a.scene_id AS scene_a, b.scene_id AS scene_b FROM tok a JOIN tok b ON a.project_id = b.project_id AND a.scene_type = b.scene_type AND a.scene_id <> b.scene_id
  WHERE len(list_intersect(a.tokens, b.tokens)) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE) >= 65e-2),
 hp AS (SELECT scene_a, scene_b, a.h AS ha, b.h AS hb FROM pairs JOIN hist a ON scene_a = a.scene_id JOIN hist b ON scene_b = b.scene_id),
 corr AS ({CORR_SQL}),
 like_ AS (SELECT p.scene_a, p.scene_b FROM pairs p LEFT JOIN corr c ON c.scene_a = p.scene_a AND c.scene_b = p.scene_b WHERE c.corr IS NULL OR c.corr > 88e-2
  UNION SELECT a.scene_id, b.scene_id FROM usable a JOIN usable b ON a.video_id = b.video_id AND a.scene_id <> b.scene_id AND abs(a.start_s - b.start_s) < 20),
 alike AS (SELECT scene_a AS scene_id, list(scene_b) AS l FROM like_ GROUP BY 1)"""

FILMED_SQL = """prev AS (SELECT video_id, n, t20 AS t, dx / 3 AS dx, dy / 3 AS dy, sqrt(dx / 3 * (dx / 3) + dy / 3 * (dy / 3)) AS speed FROM fx_samples),
 sample AS (SELECT *, lag(t) OVER w AS pt, abs(speed - lag(speed) OVER w) AS acc,
   coalesce(dx * lag(dx) OVER w + dy * lag(dy) OVER w < 0 AND speed * lag(speed) OVER w > 9e0, false) AS flip
  FROM prev WINDOW w AS (PARTITION BY video_id ORDER BY n)),
 filmed AS (SELECT u.scene_id, list(struct_pack(t := p.t, pt := p.pt, speed := p.speed, acc := p.acc, flip := p.flip) ORDER BY p.t, p.n) AS l
  FROM usable u JOIN sample p ON p.video_id = u.video_id AND p.t >= u.start_s AND p.t <= u.end_s GROUP BY 1)"""

P95 = "list_transform([list_sort({0})], lambda v: v[1 + CAST(floor(95e-2 * (len(v) - 1)) AS INT)] + (v[1 + CAST(ceil(95e-2 * (len(v) - 1)) AS INT)] - v[1 + CAST(floor(95e-2 * (len(v) - 1)) AS INT)]) * (95e-2 * (len(v) - 1) - floor(95e-2 * (len(v) - 1))))[1]"
WINDOW_SQL = f"""list_sort(list_filter(list_transform(grid, lambda st: list_transform([list_filter(film, lambda x: x.t >= st AND x.t <= st + need)], lambda w:
   list_transform([struct_pack(n := len(w), sp := {P95.format('list_transform(w, lambda x: x.speed)')}, ac := {P95.format('list_transform(list_filter(w, lambda x: x.pt >= st), lambda x: x.acc)')},
     fl := len(list_filter(w, lambda x: x.pt >= st AND x.flip)))], lambda m: struct_pack(
    bad := round(CASE WHEN m.n < 4 THEN 0e0 ELSE round(m.ac + 4e-1 * m.sp + 2e0 * m.fl + 1e-9, 3) END + 5e-2 * abs(st - round(centre + 1e-9, 3)) + 1e-9, 6), st := st,
    ok := m.n < 4 OR (m.sp <= CASE WHEN fast THEN 22e0 ELSE 10e0 END AND m.ac <= CASE WHEN fast THEN 12e0 ELSE 6e0 END AND m.fl <= CASE WHEN fast THEN 3 ELSE 1 END)))[1])[1]),
  lambda x: x.ok))[1].st"""


def draft_sql(variant: int) -> str:
    head = f"""list_transform(list_sort(list_transform(list_filter(range(1, len(cands) + 1), lambda i: NOT list_contains(used, cands[i].scene_id))[1:6],
     lambda i: struct_pack(p := cands[i].flag <> 'pinned', d := md5('{variant}:' || slot || ':' || CAST(cands[i].scene_id AS VARCHAR)), i := i))), lambda x: x.i)""" if variant else "CAST([] AS BIGINT[])"
    return f"""WITH RECURSIVE {GATE_SQL},
 usable AS (SELECT * FROM c WHERE keep OR (ok >= 3 AND steady) OR (ok < 3 AND r < greatest(n // 2, 3))),
 chosen AS (SELECT project_id, target_duration, CASE WHEN preset_id IN (SELECT preset_id FROM fx_presets) THEN preset_id ELSE 'generic' END AS used_preset FROM fx_projects),
 scored AS ({SCORE_SQL}), {ALIKE_SQL}, {FILMED_SQL},
 told AS (SELECT *, {GROUNDS_SQL} AS l FROM scored),
 slots AS (SELECT g.project_id, g.slot_no, g.slot, g.min_fragment, g.max_fragment, any_value(h.target_duration * p.share) AS slot_s, any_value(list_contains(string_split(g.motions, ','), 'fast')) AS fast,
   ROW_NUMBER() OVER (PARTITION BY g.project_id ORDER BY g.slot_no) AS si,
   list(struct_pack(scene_id := g.scene_id, video_id := g.video_id, flag := user_flag, start_s := start_s, end_s := end_s, best_moment := best_moment,
    full_s := least(round(end_s - start_s + 1e-9, 3), g.max_fragment), reason := {REASON_SQL.replace("(l)", "(g.l)").replace("l[", "g.l[")}, score := score, alike := coalesce(a.l, [])) ORDER BY score DESC, g.video_id, start_s, g.scene_id) AS cands
  FROM told g JOIN chosen h ON h.project_id = g.project_id JOIN fx_presets p ON p.preset_id = g.preset_id AND p.slot_no = g.slot_no LEFT JOIN alike a ON a.scene_id = g.scene_id
  WHERE round(end_s - start_s + 1e-9, 3) >= g.min_fragment GROUP BY 1, 2, 3, 4, 5),
 walk AS (SELECT DISTINCT project_id, CAST(1 AS BIGINT) AS si, CAST(NULL AS BIGINT[]) AS ord, CAST(1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(-1 AS BIGINT) AS run, 0e0 AS remaining,
   CAST([] AS BIGINT[]) AS alts, CAST([] AS STRUCT(scene_id BIGINT, slot VARCHAR, a DOUBLE, b DOUBLE, max_len DOUBLE, reason VARCHAR, score DOUBLE)[]) AS segs,
   CAST([] AS STRUCT(slot VARCHAR, l BIGINT[])[]) AS spare FROM slots
  UNION ALL
  SELECT project_id, CASE WHEN closes THEN si + 1 ELSE si END, CASE WHEN opens THEN list_concat({head}, list_filter(range(1, len(cands) + 1), lambda i: NOT list_contains({head}, i))) WHEN NOT closes THEN ord END,
   CASE WHEN opens OR closes THEN 1 ELSE k + 1 END, CASE WHEN picked IS NULL THEN used ELSE list_append(used, c.scene_id) END, CASE WHEN picked IS NULL THEN run ELSE c.video_id END,
   CASE WHEN opens THEN slot_s WHEN picked IS NULL THEN remaining ELSE remaining - need END, CASE WHEN opens OR closes THEN CAST([] AS BIGINT[]) ELSE alts2 END,
   CASE WHEN picked IS NULL THEN segs ELSE list_append(segs, struct_pack(scene_id := c.scene_id, slot := slot, a := picked.a, b := picked.b, max_len := max_fragment, reason := c.reason, score := c.score)) END,
   CASE WHEN closes THEN list_append(spare, struct_pack(slot := slot, l := alts2[1:4])) ELSE spare END
  FROM (SELECT *, CASE WHEN stops OR opens THEN alts WHEN NOT gone AND (ends OR skips) THEN list_append(alts, c.scene_id) ELSE alts END AS alts2, stops OR (NOT opens AND k = len(ord)) AS closes
   FROM (SELECT *, CASE WHEN tried AND film IS NULL THEN CASE WHEN whole <= need THEN struct_pack(a := c.start_s, b := c.end_s) ELSE struct_pack(a := round(centre + 1e-9, 3), b := round(centre + need + 1e-9, 3)) END
      WHEN tried AND st IS NOT NULL THEN struct_pack(a := round(st + 1e-9, 3), b := round(st + need + 1e-9, 3)) END AS picked
    FROM (SELECT *, CASE WHEN tried AND film IS NOT NULL THEN {WINDOW_SQL} END AS st
     FROM (SELECT *, CASE WHEN tried AND film IS NOT NULL THEN CASE WHEN whole <= need + 2e-1 THEN [c.start_s] ELSE CASE WHEN grid0[-1] < c.end_s - need - 5e-2 THEN list_append(grid0, c.end_s - need) ELSE grid0 END END END AS grid
      FROM (SELECT *, CASE WHEN whole <= need THEN c.start_s ELSE least(greatest(CASE WHEN c.best_moment > c.start_s AND c.best_moment < c.end_s THEN c.best_moment ELSE c.start_s + whole / 2 END - need / 2, c.start_s), c.end_s - need) END AS centre,
         CASE WHEN tried AND whole > need + 2e-1 THEN list_transform(range(CAST(ceil((c.end_s - need - c.start_s + 1e-2) / 5e-1) AS BIGINT)), lambda i: c.start_s + i * 5e-1) END AS grid0
       FROM (SELECT *, NOT opens AND NOT stops AND NOT gone AND NOT ends AND NOT skips AND need >= min_fragment AS tried
        FROM (SELECT *, CASE WHEN opens OR gone OR ends THEN false WHEN same THEN true ELSE c.flag <> 'pinned' AND list_has_any(c.alike, used)
           AND len(list_filter(cands, lambda x: NOT list_contains(used, x.scene_id) AND NOT list_has_any(x.alike, used))) > 0 END AS skips
         FROM (SELECT *, CASE WHEN opens OR gone OR ends OR c.video_id <> run THEN false ELSE len(list_filter(cands, lambda x: x.video_id <> run AND NOT list_contains(used, x.scene_id))) > 0 END AS same
          FROM (SELECT *, ord IS NULL AS opens, ord IS NOT NULL AND remaining < min_fragment AS ends, ord IS NOT NULL AND remaining < min_fragment AND len(alts) >= 4 AS stops,
             coalesce(list_contains(used, c.scene_id), false) AS gone, least(c.full_s, remaining) AS need, round(c.end_s - c.start_s + 1e-9, 3) AS whole
           FROM (SELECT q.*, f.l AS film FROM (SELECT w.*, s.slot, s.slot_s, s.fast, s.min_fragment, s.max_fragment, s.cands, s.cands[w.ord[w.k]] AS c
             FROM walk w JOIN slots s ON s.project_id = w.project_id AND s.si = w.si) q LEFT JOIN filmed f ON f.scene_id = q.c.scene_id) q0) q1) q2) q3) q4) q5) q6) q7) q8) q9),
 done AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.project_id = w.project_id AND s.si = w.si))"""


CUT_SQL = """, flat AS (SELECT project_id, unnest(range(len(segs))) AS seg_no, unnest(segs) AS g FROM done),
 own AS (SELECT f.project_id, f.seg_no, f.g.scene_id AS scene_id, f.g.slot AS slot, f.g.a AS src_start, f.g.b AS src_end, f.g.max_len AS max_len, f.g.reason AS reason, f.g.score AS score,
   s.video_id, s.start_s, s.end_s FROM flat f JOIN fx_scenes s ON s.scene_id = f.g.scene_id),
 said AS (SELECT o.scene_id, list(struct_pack(a := p.p_start, b := p.p_end) ORDER BY p.p_start, p.p_end) AS ph
  FROM (SELECT DISTINCT scene_id, video_id, start_s, end_s FROM own) o JOIN fx_phrases p ON o.video_id = p.video_id AND p.p_end > start_s AND p.p_start < end_s GROUP BY 1),
 safe AS (SELECT own.*, list_reduce(said.ph, lambda acc, p: struct_pack(a := {a}, b := CASE WHEN p.a < acc.b AND acc.b < p.b THEN
    CASE WHEN p.b - ({a}) <= max_len AND p.b <= end_s THEN p.b ELSE greatest(p.a, {a}) END ELSE acc.b END), struct_pack(a := src_start, b := src_end)) AS z FROM own LEFT JOIN said ON said.scene_id = own.scene_id)
 SELECT project_id, seg_no, scene_id, slot, CASE WHEN z IS NULL OR z.b - z.a < 1 THEN src_start ELSE round(z.a + 1e-9, 3) END AS src_start,
  CASE WHEN z IS NULL OR z.b - z.a < 1 THEN src_end ELSE round(z.b + 1e-9, 3) END AS src_end, reason, score FROM safe""".format(a=A_SQL)


def draft(fx, variant=0, page=48):
    from mediaplan.operators.spans import scene_views
    from mediaplan.plans import greedy
    fx.settle("scenes", "samples")
    views = scene_views(tagged(fx), fx.tokens, hists(fx))
    return greedy.build_drafts(chosen(fx), views, clock20(fx), fx.phrases, variant, page)


@query("P1_build_drafts", draft_sql(0) + CUT_SQL)
def build_drafts(fx):
    return draft(fx)[0]


@query("P1_build_drafts_variant", draft_sql(2) + CUT_SQL)
def build_variant(fx):
    return draft(fx, variant=2)[0]


@query("P4_film")
def film(fx):
    """P1, M8, M9, M10, P3 and P4 as one: drafts set to the music of their projects."""
    from mediaplan.plans import films
    from .music import curve
    projects = chosen(fx).withColumn("sync_to_music", F.expr("project_id % 3 <> 0"))
    segments = draft(fx)[0]
    tracks = fx.tracks
    music = fx.cues.selectExpr("plan_id AS project_id", "track_id")
    return films.set_to_music(keep(segments, "drafts"), projects, music, curve(fx), tracks, fx.beats, fx.cuts)[0]


@query("P2_alternatives", draft_sql(0) + """, lists AS (SELECT project_id, unnest(spare) AS a FROM done)
 SELECT project_id, a.slot AS slot, unnest(range(len(a.l))) AS pos, unnest(a.l) AS scene_id FROM lists""")
def alternatives(fx):
    return draft(fx)[1]
