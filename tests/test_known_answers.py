"""Small cases with answers that can be checked by hand."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from mediaplan.operators import catalogue as C, intervals as V, music as M, presets, ranking as R, signals as Q, spans as S
from mediaplan.plans import drafts as P, routes as Z
from mediaplan.sources import ingest as I, tables as T


def test_normalize_spans(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.0, 5.0), (3, 0.0, 25.0), (4, 0.0, 20.0)], "id int, start_s double, end_s double")
    out = rows(S.normalize_spans(df))
    assert (2, 0.0, 5.0) in out and not [r for r in out if r[0] == 1]
    assert [r[1:] for r in out if r[0] == 3] == [(0.0, 8.333), (8.333, 16.667), (16.667, 25.0)]
    assert len([r for r in out if r[0] == 4]) == 3


PHRASES = [(2.0, 5.0), (10.0, 14.0), (20.0, 29.0)]


@pytest.mark.parametrize("start,end,phrases,scene,max_len,want", [
    (6.0, 9.0, PHRASES, 30.0, 6.0, (6.0, 9.0)),
    (3.0, 8.0, PHRASES, 30.0, 6.0, (2.0, 8.0)),
    (25.0, 30.0, PHRASES, 30.0, 6.0, (29.0, 30.0)),
    (8.0, 12.0, PHRASES, 30.0, 6.0, (8.0, 14.0)),
    (16.0, 22.0, PHRASES, 30.0, 6.0, (16.0, 20.0)),
    (4.0, 9.0, [(0.0, 9.8)], 10.0, 5.0, (4.0, 9.0)),
])
def test_speech_safe(spark, start, end, phrases, scene, max_len, want):
    df = spark.createDataFrame([(start, end, 0.0, scene, max_len, phrases)],
                               "src_start double, src_end double, start_s double, end_s double, max_len double,"
                               " phrases array<struct<p_start:double,p_end:double>>")
    assert rows(S.speech_safe(df).select("src_start", "src_end")) == [want]


@pytest.mark.parametrize("tech,want", [
    ([(70.0, 79.0)], [(65.0, 70.0), (79.0, 85.0)]),
    ([(60.0, 90.0)], []),
    ([(200.0, 210.0)], [(65.0, 85.0)]),
    ([(68.0, 71.0), (80.0, 83.0)], [(65.0, 68.0), (71.0, 80.0), (83.0, 85.0)]),
])
def test_subtract_spans(spark, tech, want):
    base = spark.createDataFrame([(1, 65.0, 85.0)], "video_id int, a double, b double")
    cut = spark.createDataFrame([(1, *t) for t in tech], "video_id int, lo double, hi double")
    assert rows(V.subtract_spans(base, cut, ["video_id"], ("a", "b"), ("lo", "hi")).select("p_lo", "p_hi")) == want


def test_frozen_scene_spans(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0, "slow", False), (1, 10.0, 20.0, "static", False), (1, 20.0, 30.0, "static", False),
                               (1, 30.0, 40.0, "static", True), (1, 40.0, 42.0, "static", False)],
                              "video_id int, start_s double, end_s double, motion string, has_person boolean")
    assert rows(V.frozen_scene_spans(s)) == [(1, 10.0, 30.0)]


def test_threshold_ranges(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([.1, .1, .1, .9, .9, .1, .1, .1])], "track_id int, sec long, energy_raw double")
    assert rows(M.energy_ranges(s)) == [(1, 0.0, 3.0, "calm"), (1, 3.0, 5.0, "energetic"), (1, 5.0, 8.0, "calm")]


@pytest.mark.parametrize("start,end,best,length,want", [
    (10.0, 20.0, 12.0, 4.0, (10.0, 14.0)), (10.0, 20.0, 0.0, 4.0, (13.0, 17.0)), (5.0, 8.0, 0.0, 5.0, (5.0, 8.0))])
def test_center_fragment(spark, start, end, best, length, want):
    df = spark.createDataFrame([(start, end, best)], "start_s double, end_s double, best_moment double")
    assert rows(R.center_fragment(df, length).select("src_start", "src_end")) == [want]


@pytest.mark.parametrize("ends,cuts,overlap,want", [
    ([3.8], [4.0, 8.0], 0.0, [4.0]), ([4.0, 4.0], [4.0], 0.4, [4.2, 4.0]), ([3.0], [4.0], 0.0, [3.0]), ([0.8], [0.9], 0.0, [0.8])])
def test_snap_to_cuts(spark, ends, cuts, overlap, want):
    seg = spark.createDataFrame([(1, i, 0.0, e) for i, e in enumerate(ends)], "plan_id int, seg_no long, src_start double, src_end double")
    c = spark.createDataFrame([(1, x) for x in cuts], "plan_id int, cut_t double")
    o = spark.createDataFrame([(1, overlap)], "plan_id int, overlap double")
    assert [r[1] for r in rows(P.snap_to_cuts(seg, c, o).select("seg_no", "src_end"))] == want


def timing(spark, zones, route, target, style, subject=0.0, frozen=0.0, out=0.0):
    r = spark.createDataFrame([(1, route, target, style, subject, frozen, out)],
                              "route_id int, route_len double, target_duration double, fpv_style string, subject_len double, frozen_len double, frozen_out double")
    z = spark.createDataFrame([(1, float(x)) for x in zones], "route_id int, zone_len double")
    return Z.solve_timing(r, z).first()


def test_solve_timing(spark):
    a = timing(spark, [20] * 6, 300.0, 60.0, "smooth")
    assert a.fits and a.subject_speed == 1.0
    assert abs(6 * min(a.window_s, 20) + (300 - 6 * min(a.window_s, 20)) / a.gap_speed - 60) < 1.0
    assert not timing(spark, [20] * 10, 400.0, 15.0, "smooth").fits
    assert timing(spark, [15] * 5, 400.0, 45.0, "dynamic").fits
    b = timing(spark, [10] * 2, 60.0, 55.0, "smooth")
    assert b.fits and b.gap_speed < 1.5
    c = timing(spark, [10] * 3, 120.0, 40.0, "smooth", subject=40.0)
    assert c.fits and 1.0 <= c.subject_speed <= 3.0 and c.gap_speed >= c.subject_speed
    d = timing(spark, [10] * 3, 120.0, 20.0, "smooth", subject=110.0)
    assert not d.fits and d.subject_speed <= 3.0 and d.least_s > 21
    assert timing(spark, [10] * 3, 120.0, 40.0, "smooth", 40.0, 40.0, 0.5).fits


def test_route_segment_is_looked_up_before_rounding(spark):
    pieces = spark.createDataFrame([(1, "a", 9.9996, 14.0, "empty")], "video_id long, label string, p_lo double, p_hi double, kind string")
    timing = spark.createDataFrame([(1, 4.0, 2.0)], "video_id long, gap_speed double, subject_speed double")
    routes = spark.createDataFrame([(1, 0.5)], "video_id long, pause_s double")
    scenes = spark.createDataFrame([(7, 1, 0.0, 10.0), (8, 1, 10.0, 20.0)], "scene_id long, video_id long, start_s double, end_s double")
    out = Z.route_segments(pieces, timing, routes, scenes).collect()
    assert [(r.src_start, r.scene_id) for r in out] == [(10.0, 7)]


def test_presets(spark):
    slots = presets.preset_slots(spark)
    assert slots.count() == 65
    assert all(abs(r[1] - 1) < 1e-9 for r in slots.groupBy("preset_id").agg(F.sum("share")).collect())
    assert rows(slots.filter("slot_no = 0").select("slot").distinct()) == [("intro",)]
    used = presets.resolve_presets(spark.createDataFrame([(1, "nope", ""), (2, "family", "mine")], "project_id int, preset_id string, scenario_text string"))
    got = {r.project_id: (r.used_preset, r.scenario) for r in used.collect()}
    assert got[1][0] == "generic" and got[1][1].startswith("Идея ролика: ") and got[2] == ("family", "mine")


def test_interest(spark):
    s = spark.createDataFrame([(1, 0, 0.95, 0.95, "slow"), (2, 1, 0.3, 0.4, "fast"), (3, 0, 0.9, 0.9, "static")],
                              "scene_id int, people_count int, aesthetic_score double, quality_score double, motion string")
    got = {r.scene_id: r.interest for r in R.interest(s).collect()}
    assert got[2] > got[1] > got[3]


def test_best_window_rejects_jerky_scene(spark):
    f = spark.createDataFrame([(1, 1, 0.0, 6.0, 3.0, 2.0, False), (2, 2, 0.0, 6.0, 3.0, 2.0, False)],
                              "frag_id int, video_id int, start_s double, end_s double, best_moment double, frag_len double, allow_fast boolean")
    shaky = [(1, n, n / 20, 20.0 * (-1) ** n, 0.0) for n in range(120)]
    smooth = [(2, n, n / 20, 1.0, 0.0) for n in range(120)]
    s = spark.createDataFrame(shaky + smooth, "video_id int, n long, t double, dx double, dy double")
    assert rows(R.best_window(f, s)) == [(1, None, None), (2, 2.0, 4.0)]


def test_select_media_reads_folders(spark, tmp_path):
    for name in ("a.MP4", "deep/b.mov", ".hidden.mp4", ".cache/c.mp4", "notes.txt"):
        p = tmp_path / "in.d" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    listed = I.list_files(spark, f"file:{tmp_path}/in.d")
    kept = [r.path.split("/in.d/")[1] for r in I.select_media(listed).collect()]
    assert kept == ["a.MP4", "deep/b.mov"]


def test_save_and_load_prunes(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, i) for i in range(500)], "project_id long, scene_id long")
    T.save_table(df, str(tmp_path / "t"), buckets=16)
    part = T.load_table(spark, str(tmp_path / "t"), [7, 8], buckets=16)
    assert sorted(r[0] for r in part.select("project_id").distinct().collect()) == [7, 8]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "project_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert T.load_table(spark, str(tmp_path / "t")).count() == 500


def test_toggle_flags(spark):
    s = spark.createDataFrame([(1, ""), (2, "good"), (3, "good"), (4, "bad")], "scene_id int, user_flag string")
    c = spark.createDataFrame([(1, "good", 1), (1, "good", 2), (2, "good", 1), (3, "bad", 1), (3, "good", 2), (3, "good", 3), (3, "good", 4)],
                              "scene_id int, flag string, click_no int")
    assert rows(C.toggle_flags(s, c).select("scene_id", "user_flag")) == [(1, ""), (2, ""), (3, "good"), (4, "bad")]


def test_replacement_candidates_with_text_and_large_ids(spark):
    big = 2**53  # big and big + 1 are one double
    scenes = spark.createDataFrame(
        [(7, f"s{i}", v, 0.0, "walk", "hook", "") for i, v in enumerate([big + 1, big, big + 3])] + [(7, "cur", 1, 0.0, "walk", "hook", "")],
        "project_id int, scene_id string, video_id long, start_s double, scene_type string, recommended_slot string, user_flag string")
    segments = spark.createDataFrame([(1, 0, "hook", "cur")], "plan_id int, seg_no int, slot string, scene_id string")
    stored = spark.createDataFrame([(1, "hook", 0, "s2")], "plan_id int, slot string, pos int, scene_id string")
    plans = spark.createDataFrame([(1, 7)], "plan_id int, project_id int")
    for kind in ("long", "string"):
        pool = scenes.withColumn("video_id", F.col("video_id").cast(kind))
        got = P.replacement_candidates(segments.select("plan_id", "seg_no"), segments, stored, plans, pool)
        assert [r.scene_id for r in got.orderBy("choice").collect()] == ["s2", "s1", "s0"]
