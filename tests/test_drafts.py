"""Drafts: page sizes change nothing, and what holds for every draft."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaplan.operators import presets, ranking as R
from mediaplan.operators.signals import motion_pairs
from mediaplan.operators.spans import similar_sql
from mediaplan.plans import drafts as plans, greedy


def catalogue(seed, n, copies):
    """Scenes of three projects; one holds most of them, many alike."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        project = 0 if rnd.random() < 0.7 else rnd.randrange(1, 3)
        same = rnd.random() < copies
        video = project * 10 + (0 if rnd.random() < 0.5 else rnd.randrange(4))
        out.append(dict(scene_id=i, video_id=video, project_id=project, start_s=float(15 * i), end_s=15.0 * i + rnd.choice([1.0, 2.5, 4.0, 8.0]),
                        best_moment=15.0 * i + 1.25, quality_score=0.9 if same else round(rnd.random(), 2), aesthetic_score=round(rnd.random(), 2),
                        jerkiness=0.1, stability_score=0.9, motion=rnd.choice(["slow", "static", "fast"]), motion_type="pan",
                        scene_type="action" if same else rnd.choice(["action", "people", "ending", ""]), recommended_slot=rnd.choice(["intro", "main", ""]),
                        user_flag=rnd.choice(["", "", "", "pinned", "bad"]), scenario_match_score=0.0, tags=["t"],
                        tokens=["a", "b"] if same else rnd.sample(["a", "b", "c", "d"], rnd.randrange(0, 3))))
    return out


COLS = ("scene_id long, video_id long, project_id long, start_s double, end_s double, best_moment double, quality_score double,"
        " aesthetic_score double, jerkiness double, stability_score double, motion string, motion_type string, scene_type string,"
        " recommended_slot string, user_flag string, scenario_match_score double, tags array<string>, tokens array<string>")


def drafts(spark, data, page, variant=0, samples=None):
    scenes = spark.createDataFrame([tuple(d[c.split()[0]] for c in COLS.split(", ")) for d in data], COLS).withColumn(
        "hist", F.lit(None).cast("array<double>"))
    projects = spark.createDataFrame([(p, "generic", 40.0, False) for p in range(3)],
                                     "project_id long, used_preset string, target_duration double, stabilize_shaky boolean")
    return [sorted(map(tuple, d.collect())) for d in greedy.build_drafts(projects, scenes, samples, variant=variant, page=page)]


@pytest.mark.parametrize("seed, copies, page, variant", [(11, 0.3, 4, 0), (12, 0.9, 6, 0), (13, 0.5, 4, 2)])
def test_small_pages_change_nothing(spark, seed, copies, page, variant):
    data = catalogue(seed, 160, copies)
    segments, alternatives = drafts(spark, data, 1000, variant)  # every list is one page
    assert drafts(spark, data, page, variant) == [segments, alternatives]
    slots = {s.slot: s for s in presets.preset_slots(spark).filter("preset_id = 'generic'").collect()}
    for p in range(3):
        mine = [g for g in segments if g[0] == p]
        shown = [g[2] for g in mine]
        assert [g[1] for g in mine] == list(range(len(mine))) and len(set(shown)) == len(shown) > 0
        assert all(data[i]["project_id"] == p for i in shown)
        for name, slot in slots.items():
            lengths = [g[5] - g[4] for g in mine if g[3] == name]
            assert sum(lengths) <= 40.0 * slot.share + 1e-6
            assert all(slot.min_fragment - 1e-6 <= x <= slot.max_fragment + 1e-6 for x in lengths)
            spare = [a[3] for a in alternatives if a[:2] == (p, name)]
            assert len(spare) == len(set(spare)) <= greedy.ALTERNATIVES
        assert all(data[g[2]]["start_s"] - 1e-6 <= g[4] and g[5] <= data[g[2]]["end_s"] + 1e-6 and g[6] for g in mine)


def test_what_is_left_of_a_slot_costs_no_round(spark, monkeypatch):
    """A fragment shortened to what is left of its slot is placed in the walk, not by another round over all candidates."""
    data = catalogue(15, 80, 0.2)
    draw = random.Random(2)
    samples = spark.createDataFrame([(v, n, n / 20, draw.uniform(-4, 4), draw.uniform(-1, 1)) for v in sorted({d["video_id"] for d in data}) for n in range(0, 24_000, 7)],
                                    "video_id long, n long, t double, dx double, dy double")
    monkeypatch.setattr(greedy, "_next_pages", lambda *a: pytest.fail("another round"))
    segments, _ = drafts(spark, data, 1000, samples=samples)
    slots = {s.slot: s for s in presets.preset_slots(spark).filter("preset_id = 'generic'").collect()}
    cut = [g for g in segments if g[5] - g[4] < min(data[g[2]]["end_s"] - data[g[2]]["start_s"], slots[g[3]].max_fragment) - 1e-6]
    assert cut


def test_best_place_is_the_best_window(spark):
    draw = random.Random(8)
    scenes = [(i, i % 5, 2.0 * i + draw.choice([0.0, 0.25]), draw.choice([1.0, 3.3, 6.125, 9.0]), draw.choice([0.0, 1.7, 40.0, None]), draw.random() < 0.5) for i in range(300)]
    frags = [(i, v, a, a + d, None if m is None else a + m, max(0.5, round(d * draw.choice([0.3, 0.62, 0.97, 1.0]), 4)), fast) for i, v, a, d, m, fast in scenes]
    samples = [(v, n, n / 20, draw.gauss(0, 1 + n // 900 % 9), draw.gauss(0, 1)) for v in range(4) for n in range(9000) if n // 400 % 4 != v]
    frame = spark.createDataFrame(frags, "frag_id long, video_id long, start_s double, end_s double, best_moment double, frag_len double, allow_fast boolean")
    filmed = spark.createDataFrame(samples, "video_id long, n long, t double, dx double, dy double")
    want = {r.frag_id: (r.src_start, r.src_end) for r in R.best_window(frame, filmed).collect()}
    films = {r.frag_id: {c: np.array([float("nan") if x is None else x for x in r[c]]) for c in ("t", "pt", "speed", "acc")} | {"flip": np.array(r.flip, bool)}
             for r in R.scene_films(frame, motion_pairs(filmed), ["frag_id"]).collect()}
    got = {i: R.best_place(films.get(i), a, b, m, length, fast) or (None, None) for i, _, a, b, m, length, fast in frags}
    assert got == want and 0 < len(films) < 300 and (None, None) in want.values()


def test_a_large_project_meets_its_state_in_parts(spark, monkeypatch):
    data = catalogue(14, 90, 0.5)
    whole = drafts(spark, data, 1000)
    monkeypatch.setattr(greedy, "PART_ROWS", 40)
    pages, taken = greedy._next_pages, []

    def next_pages(open_, *more):
        taken.append(pages(open_, *more))
        return taken[-1]

    monkeypatch.setattr(greedy, "_next_pages", next_pages)
    assert drafts(spark, data, 6) == whole
    # a state stays behind: no candidate carries it on
    assert taken and all("state" not in t.columns for t in taken)


@pytest.mark.parametrize("page", [4, 1000])
def test_variant_draws_from_the_best_free_scenes(spark, page):
    # one project of scenes that no rule passes over: each slot opens with the first of its six best free ones as drawn
    data = [d | dict(project_id=0, video_id=i, end_s=d["start_s"] + 9.0, scene_type="", tokens=[], user_flag="pinned" if i == 25 else "")
            for i, d in enumerate(catalogue(5, 60, 0.0))]
    segments, _ = drafts(spark, data, page, variant=3)
    slots = presets.preset_slots(spark).filter("preset_id = 'generic'").orderBy("slot_no").collect()
    scenes = spark.createDataFrame([tuple(d[c.split()[0]] for c in COLS.split(", ")) for d in data], COLS)
    ranked = R.rank_for_slot(R.slot_scores(R.with_slots(R.usable_scenes(scenes), spark.createDataFrame(
        [(0, "generic")], "project_id long, used_preset string"), presets.preset_slots(spark)))).orderBy("rank").collect()
    used = []
    for slot in slots:
        mine = [g[2] for g in segments if g[3] == slot.slot]
        free = [r for r in ranked if r.slot == slot.slot and r.scene_id not in used][:6]
        assert mine[0] == min(free, key=lambda r: (r.user_flag != "pinned", hashlib.md5(f"3:{slot.slot}:{r.scene_id}".encode()).hexdigest())).scene_id
        used += mine


def test_looks_agree_with_the_column_rule(spark):
    data = catalogue(3, 60, 0.4)
    for d in data:
        d["hist"] = None if d["scene_id"] % 3 == 0 else [float(x) for x in random.Random(d["scene_id"] % 7).choices(range(9), k=4)]
    shape = "scene_id long, video_id long, start_s double, scene_type string, tokens array<string>, hist array<double>"
    rows = spark.createDataFrame([tuple(d[c.split()[0]] for c in shape.split(", ")) for d in data], shape)
    a, b = (rows.select(F.struct(*rows.columns).alias(n)) for n in "ab")
    want = {(r.x, r.y) for r in a.crossJoin(b).filter(similar_sql("a", "b")).select("a.scene_id", "b.scene_id").toDF("x", "y").collect()}
    for d in data:
        seen = greedy._Looks(data, [d]).seen
        assert {(e["scene_id"], d["scene_id"]) for e, like in zip(data, seen) if like} == {p for p in want if p[1] == d["scene_id"]}


def test_replacements_of_a_group_with_many_requests(spark, monkeypatch):
    """A group's head is copied as often as its requests ask for, and a request leaves it with k scenes at most."""
    draw = random.Random(4)
    kinds, slots = ["walk", "talk", ""], ["intro", "main"]
    scenes = [(i, draw.choice([0, 0, 0, 1]), draw.randrange(4), float(draw.randrange(20)), draw.choice(kinds), draw.choice(slots), draw.choice(["", "banned"])) for i in range(120)]
    segments = [(p, n, draw.choice(slots), draw.randrange(130)) for p in range(30) for n in range(3)]
    stored = [(p, s, n, draw.randrange(130)) for p in range(30) for s in slots for n in range(draw.randrange(3))]
    plan_of = {p: draw.choice([0, 0, 1]) for p in range(30)}
    want, have = [], {s[0] for s in scenes}
    for p, n, slot, cur in segments:
        shown = {s[3] for s in segments if s[0] == p}
        alts = [a[3] for a in sorted(stored) if a[:2] == (p, slot)]
        kind = next((s[4] for s in scenes if s[0] == cur), None)
        more = sorted((s[2], s[3], s[0]) for s in scenes if s[1] == plan_of[p] and s[6] != "banned" and (s[5] == slot or s[4] == kind))
        found = [a for a in alts if a not in shown] + [m[2] for m in more if m[2] not in shown and m[2] not in alts]
        want += [(p, n, i + 1, s) for i, s in enumerate(found[:4]) if s in have]
    frame = spark.createDataFrame
    seg = frame(segments, "plan_id long, seg_no long, slot string, scene_id long")
    args = (seg.select("plan_id", "seg_no"), seg, frame(stored, "plan_id long, slot string, pos long, scene_id long"),
            frame(list(plan_of.items()), "plan_id long, project_id long"),
            frame(scenes, "scene_id long, project_id long, video_id long, start_s double, scene_type string, recommended_slot string, user_flag string"))
    store, stored_ = plans.keep, {}

    def kept(df, name):
        stored_[name] = store(df, name)
        return stored_[name]

    monkeypatch.setattr(plans, "keep", kept)
    for most in (2, 4096):
        monkeypatch.setattr(plans, "ASKED_ROWS", most)
        assert sorted(map(tuple, plans.replacement_candidates(*args).collect())) == sorted(want)
        assert stored_["asked"].count() == 30  # a plan moves once, not once a request
