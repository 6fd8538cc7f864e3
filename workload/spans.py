"""Queries for scene spans, speech and likeness (group S)."""

from pyspark.sql import functions as F

from mediaplan.functions.expr import rnd
from mediaplan.operators import ranking as R, spans as S
from .ranking import CENTRED
from .registry import query

CUT_SQL = """a AS (SELECT video_id, n, t8 AS t, diff AS score, (SUM(diff) OVER w - diff) / (COUNT(*) OVER w - 1) AS around, COUNT(*) OVER w AS c FROM fx_samples
  WINDOW w AS (PARTITION BY video_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
 b AS (SELECT *, coalesce(c > 1 AND score >= 15 AND score >= 3 * around AND n > 0, false) AS cut FROM a),
 c AS (SELECT *, SUM(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY n) AS g FROM b),
 d AS (SELECT video_id, g, MIN(t) AS start_s, MAX(t) AS last_t FROM c GROUP BY 1, 2),
 e AS (SELECT video_id, start_s, coalesce(lead(start_s) OVER (PARTITION BY video_id ORDER BY g), last_t) AS end_s FROM d),
 cuts AS (SELECT * FROM e WHERE end_s > start_s)"""


def cuts(fx):
    return S.adaptive_cuts(fx.samples.selectExpr("video_id", "n", "t8 AS t", "diff AS score"))


@query("S1_adaptive_cuts", f"WITH {CUT_SQL} SELECT * FROM cuts")
def adaptive_cuts(fx):
    return cuts(fx)


@query("S2_cover_uncut", f"""WITH {CUT_SQL} SELECT * FROM cuts UNION ALL SELECT c_custkey, 0e0, c_custkey % 50 * 1e0 FROM customer
 WHERE c_custkey % 50 > 0 AND c_custkey NOT IN (SELECT video_id FROM cuts)""")
def cover(fx):
    return S.cover_uncut(fx.table("customer").selectExpr("c_custkey AS video_id", "c_custkey % 50 AS duration"), cuts(fx))


@query("S3_normalize_spans", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 3e-1 AS a, l_partkey * 3e-1 + l_quantity AS b FROM lineitem),
 n AS (SELECT *, CASE WHEN b - a <= 10 THEN 1 ELSE CAST(floor((b - a) / 10) AS INT) + 1 END AS n FROM r WHERE b - a >= 15e-1),
 p AS (SELECT n.*, i, a + i * ((b - a) / n) AS lo, CASE WHEN n = 1 THEN b ELSE least(a + (i + 1) * ((b - a) / n), b) END AS hi FROM n, range(0, 10) t(i) WHERE i < n)
 SELECT l_orderkey, l_linenumber, l_partkey, round(lo + 1e-9, 3) AS start_s, round(hi + 1e-9, 3) AS end_s FROM p WHERE hi - lo >= 15e-1""")
def normalize(fx):
    raw = fx.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_partkey * 3e-1 AS start_s", "l_partkey * 3e-1 + l_quantity AS end_s")
    return S.normalize_spans(raw)


@query("S4_phrases_in_scene", """SELECT s.scene_id, p.p_start, p.p_end FROM fx_scenes s JOIN fx_phrases p ON s.video_id = p.video_id AND p.p_end > s.start_s AND p.p_start < s.end_s""")
def phrases(fx):
    return S.phrases_in_scene(fx.scenes, fx.phrases).select("scene_id", "p_start", "p_end")


@query("S5_clean_phrases", r"""SELECT video_id, round(p_start + 1e-9, 3) AS p_start, round(p_end + 1e-9, 3) AS p_end, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text
 FROM fx_phrases WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 2 AND no_speech_prob <= 6e-1""")
def clean(fx):
    return S.clean_phrases(fx.phrases).select("video_id", "p_start", "p_end", "text")


A_SQL = """CASE WHEN p.a < acc.a AND acc.a < p.b THEN CASE WHEN acc.a - p.a <= 15e-1 AND p.a >= start_s THEN p.a ELSE least(p.b, acc.b) END ELSE acc.a END"""


@query("S6_speech_safe", f"""WITH f AS (SELECT scene_id, video_id, start_s, end_s,
   CASE WHEN round(end_s - start_s + 1e-9, 3) <= 45e-1 THEN start_s ELSE round({CENTRED.format(n='45e-1')} + 1e-9, 3) END AS src_start,
   CASE WHEN round(end_s - start_s + 1e-9, 3) <= 45e-1 THEN end_s ELSE round({CENTRED.format(n='45e-1')} + 45e-1 + 1e-9, 3) END AS src_end FROM fx_scenes),
 l AS (SELECT f.scene_id, list(struct_pack(a := p.p_start, b := p.p_end) ORDER BY p.p_start, p.p_end) AS ph FROM f JOIN fx_phrases p ON f.video_id = p.video_id AND p.p_end > start_s AND p.p_start < end_s GROUP BY 1),
 r AS (SELECT f.*, list_reduce(l.ph, lambda acc, p: struct_pack(a := {A_SQL}, b := CASE WHEN p.a < acc.b AND acc.b < p.b THEN
    CASE WHEN p.b - ({A_SQL}) <= 5 AND p.b <= end_s THEN p.b ELSE greatest(p.a, {A_SQL}) END ELSE acc.b END), struct_pack(a := src_start, b := src_end)) AS z FROM f LEFT JOIN l ON f.scene_id = l.scene_id)
 SELECT scene_id, CASE WHEN z IS NULL OR z.b - z.a < 1 THEN src_start ELSE round(z.a + 1e-9, 3) END AS src_start,
  CASE WHEN z IS NULL OR z.b - z.a < 1 THEN src_end ELSE round(z.b + 1e-9, 3) END AS src_end FROM r""")
def speech_safe(fx):
    frag = R.center_fragment(fx.scenes, 4.5).withColumn("max_len", F.lit(5.0))
    return S.speech_safe(S.with_phrases(frag, fx.scenes, fx.phrases)).select("scene_id", "src_start", "src_end")


@query("S7_near_scenes", """SELECT a.video_id, a.scene_id AS scene_a, b.scene_id AS scene_b FROM fx_scenes a JOIN fx_scenes b
 ON a.video_id = b.video_id AND (a.start_s < b.start_s OR a.start_s = b.start_s AND a.scene_id < b.scene_id) AND b.start_s - a.start_s < 20""")
def near(fx):
    return S.near_scenes(fx.scenes)


LOOK_SQL = """sets AS (SELECT s.scene_id, s.project_id, s.scene_type, list_sort(list(t.token)) AS tokens FROM fx_scenes s JOIN fx_tokens t ON s.scene_id = t.scene_id WHERE scene_type <> '' GROUP BY 1, 2, 3),
 looks AS (SELECT *, md5(CAST(project_id AS VARCHAR) || chr(1) || scene_type || chr(1) || array_to_string(tokens, chr(1))) AS look_id FROM sets),
 l AS (SELECT project_id, scene_type, look_id, any_value(tokens) AS tokens, COUNT(*) AS c FROM looks GROUP BY 1, 2, 3)"""


@query("S7_similar_looks", f"""WITH {LOOK_SQL}, p AS (SELECT a.project_id, a.scene_type, a.look_id AS look_a, b.look_id AS look_b,
  len(list_intersect(a.tokens, b.tokens)) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE) AS j, a.c * b.c AS scene_pairs
  FROM l a JOIN l b ON a.project_id = b.project_id AND a.scene_type = b.scene_type AND a.look_id < b.look_id)
 SELECT project_id, scene_type, look_a, look_b, round(j + 1e-9, 6) AS jaccard, scene_pairs FROM p WHERE j >= 65e-2""")
def looks(fx):
    return S.similar_looks(S.scene_looks(fx.scenes, fx.tokens))


@query("S7_look_links", f"""WITH {LOOK_SQL}, p AS (SELECT a.look_id AS x, b.look_id AS y, b.c FROM l a JOIN l b ON a.project_id = b.project_id AND a.scene_type = b.scene_type AND a.look_id <> b.look_id
  WHERE len(list_intersect(a.tokens, b.tokens)) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE) >= 65e-2)
 SELECT l.project_id, l.scene_type, l.look_id, any_value(l.c) AS scenes, COUNT(p.y) AS links, CAST(coalesce(SUM(p.c), 0) AS BIGINT) AS linked_scenes FROM l LEFT JOIN p ON p.x = l.look_id GROUP BY 1, 2, 3""")
def links(fx):
    return S.look_links(S.scene_looks(fx.scenes, fx.tokens))


HIST_SQL = "hist AS (SELECT vec_id * 3 AS scene_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS h FROM embeddings)"


def hists(fx):
    """Histograms for some scenes; the others have no thumbnail."""
    return fx.table("embeddings").select((F.col("vec_id") * 3).alias("scene_id"), F.col("embedding").cast("array<double>").alias("hist"))


def views(fx):
    return S.scene_views(fx.scenes, fx.tokens, hists(fx))


CORR_SQL = """SELECT scene_a, scene_b, (SELECT CASE WHEN SUM((x - ma) * (x - ma)) * SUM((y - mb) * (y - mb)) <= 2.220446049250313e-16 THEN 1e0
   ELSE SUM((x - ma) * (y - mb)) / sqrt(SUM((x - ma) * (x - ma)) * SUM((y - mb) * (y - mb))) END
  FROM (SELECT ha[i] AS x, hb[i] AS y, list_avg(ha) AS ma, list_avg(hb) AS mb FROM range(1, 65) r(i)) v) AS corr FROM hp"""

SIMILAR_SQL = f"""{HIST_SQL}, tok AS (SELECT scene_id, list(token) AS tokens FROM fx_tokens GROUP BY 1),
 hp AS (SELECT scene_a, scene_b, a.h AS ha, b.h AS hb FROM pairs JOIN hist a ON scene_a = a.scene_id JOIN hist b ON scene_b = b.scene_id),
 corr AS ({CORR_SQL}),
 verdict AS (SELECT p.scene_a, p.scene_b, coalesce(a.video_id = b.video_id AND abs(a.start_s - b.start_s) < 20
   OR (a.scene_type <> '' AND a.scene_type = b.scene_type AND len(ta.tokens) > 0 AND len(tb.tokens) > 0
    AND len(list_intersect(ta.tokens, tb.tokens)) / CAST(len(list_distinct(list_concat(ta.tokens, tb.tokens))) AS DOUBLE) >= 65e-2
    AND (c.corr IS NULL OR c.corr > 88e-2)), false) AS similar
  FROM pairs p JOIN fx_scenes a ON a.scene_id = p.scene_a JOIN fx_scenes b ON b.scene_id = p.scene_b
  LEFT JOIN tok ta ON ta.scene_id = p.scene_a LEFT JOIN tok tb ON tb.scene_id = p.scene_b LEFT JOIN corr c ON c.scene_a = p.scene_a AND c.scene_b = p.scene_b)"""


@query("S7_similar_pairs", f"""WITH pairs AS (SELECT scene_id AS scene_a, lead(scene_id) OVER (PARTITION BY project_id, scene_type ORDER BY video_id, start_s, scene_id) AS scene_b FROM fx_scenes),
 {SIMILAR_SQL} SELECT * FROM verdict""")
def pairs(fx):
    """Scenes next to each other in the catalogue of a project and type."""
    from mediaplan.functions.sequences import previous_row
    s = previous_row(fx.scenes, ["project_id", "scene_type"], F.col("video_id"), ["video_id", "start_s", "scene_id"],
                     {"scene_a": F.col("scene_id")}).filter("scene_a IS NOT NULL")
    return S.similar_pairs(s.select("scene_a", F.col("scene_id").alias("scene_b")), views(fx))


@query("S8_hist_corr", f"""WITH {HIST_SQL}, hp AS (SELECT a.scene_id AS scene_a, b.scene_id AS scene_b, a.h AS ha, b.h AS hb FROM hist a JOIN hist b ON b.scene_id = a.scene_id + 3)
 SELECT scene_a, scene_b, round(corr + 1e-9, 6) + 0e0 AS corr FROM ({CORR_SQL}) q""")
def hist_corr(fx):
    h = hists(fx)
    p = h.select(F.col("scene_id").alias("scene_a"), F.col("hist").alias("ha")).join(
        h.select((F.col("scene_id") - 3).alias("scene_a"), F.col("scene_id").alias("scene_b"), F.col("hist").alias("hb")), "scene_a")
    return p.select("scene_a", "scene_b", rnd(S.hist_corr("ha", "hb"), 6).alias("corr"))


GROUP_SQL = f"""sc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY start_s, scene_id) - 1 AS n FROM fx_scenes),
 pairs AS (SELECT * FROM (SELECT lag(scene_id) OVER (PARTITION BY video_id ORDER BY n) AS scene_a, scene_id AS scene_b FROM sc) q WHERE scene_a IS NOT NULL),
 {SIMILAR_SQL},
 isl AS (SELECT sc.*, SUM(CASE WHEN v.similar THEN 0 ELSE 1 END) OVER (PARTITION BY sc.video_id ORDER BY n) AS group_no FROM sc LEFT JOIN verdict v ON v.scene_b = sc.scene_id)"""


@query("S9_group_neighbours", f"""WITH {GROUP_SQL} SELECT video_id, CAST(group_no AS BIGINT) AS group_no, MIN(n) AS first_index, MAX(n) AS last_index, MIN(start_s) AS z_start, arg_max(end_s, n) AS z_end,
 trim(coalesce(nullif(arg_min(substring(description, 1, 40), n), ''), 'зона ' || CAST(MIN(n) + 1 AS VARCHAR))) AS title FROM isl GROUP BY 1, 2""")
def groups(fx):
    return S.group_neighbours(views(fx))
