"""Sweeps, sliding windows and ranged numbering against plain rules: small chunks, ties, hot keys, awkward rows."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaplan.functions.sequences import number_ranged
from mediaplan.functions.sweep import sweep
from mediaplan.operators import intervals as V, music as M, ranking as R, signals as Q
from mediaplan.plans import drafts as P, routes
from workload import routes as W
from workload.fixtures import Fixtures


def plain_pieces(lo, hi, spans, inside):
    """Pieces of one interval, by going through all borders."""
    if not lo < hi:
        return []
    points = sorted({lo, hi, *(x for s in spans for x in s if lo < x < hi)})
    out = []
    for a, b in zip(points, points[1:]):
        over = [s for s in spans if s[0] <= a and b <= s[1]]
        if over and not inside:
            continue
        if out and out[-1][1] == a and not over and not out[-1][2] and not any(s[0] == a or s[1] == a for s in spans if s[0] < s[1]):
            out[-1] = (out[-1][0], b, False)
        else:
            out.append((a, b, bool(over)))
    # a span that begins where another ends leaves no piece between; outside pieces on both sides of nothing are one
    joined = []
    for p in out:
        if joined and not p[2] and not joined[-1][2] and joined[-1][1] == p[0]:
            joined[-1] = (joined[-1][0], p[1], False)
        else:
            joined.append(p)
    return joined


@pytest.mark.parametrize("seed, inside", [(1, False), (2, True), (3, False), (4, True)])
def test_sweep_against_plain_cutting(spark, seed, inside):
    draw = random.Random(seed)
    spans = collections.defaultdict(list)
    for key in (1, 2, 3):
        at = 0
        for _ in range(draw.randint(0, 40)):
            a = at + draw.choice([0, 0.5, 1, 2, 8]) if inside else draw.uniform(0, 100) // 0.5 * 0.5
            b = a + draw.choice([0.5, 1, 2, 4, 20]) if inside else a + draw.choice([-1, 0, 0.5, 1, 3, 30])
            spans[key].append((float(a), float(b)))
            at = b
    base = [(draw.choice([1, 1, 1, 2, 3, 4]), i % 35, a := draw.uniform(-5, 100) // 0.5 * 0.5, a + draw.choice([-1, 0, 0.5, 3, 16, 70])) for i in range(60)]
    base += [base[0], base[0], (None, 99, 0.0, 50.0), (1, 100, 0.0, 64.0), (1, 101, 8.0, 16.0)]
    frame = spark.createDataFrame(base, "k long, id long, a double, b double").repartition(3)
    cuts = spark.createDataFrame([(k, *s) for k, own in spans.items() for s in own] + [(None, 0.0, 9.0)], "k long, lo double, hi double")
    got = collections.Counter(tuple(r) for r in sweep(frame, cuts, ["k"], ("a", "b"), ("lo", "hi"), inside, chunk_s=8.0).collect())
    want = collections.Counter((*r, *p) for r in base if r[0] is not None for p in plain_pieces(r[2], r[3], [s for s in spans[r[0]] if s[0] < s[1]], inside))
    assert got == want and sum(want.values()) > 40
    assert sweep(frame.limit(0), cuts, ["k"], ("a", "b"), ("lo", "hi"), inside).count() == 0
    whole = sweep(frame, cuts.limit(0), ["k"], ("a", "b"), ("lo", "hi"), inside, chunk_s=8.0).collect()
    assert sorted((r.a, r.b) for r in whole) == sorted((r.p_lo, r.p_hi) for r in whole) and len(whole) == sum(r[0] is not None and r[2] < r[3] for r in base)


def test_a_sweep_shuffles_all_rows_once(spark):
    """By key and time; the rest is about what reaches over the edge of a chunk."""
    import re

    base = spark.range(50).selectExpr("id % 3 AS k", "id * 40.0D AS a", "id * 40.0D + 100 AS b")
    out = sweep(base, base.selectExpr("k", "a + 3 AS lo", "a + 9 AS hi"), ["k"], ("a", "b"), ("lo", "hi"), chunk_s=64.0)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"\bExchange\b", final)) <= 3 and "CartesianProduct" not in plan


def test_ranged_numbers_of_ties_and_hot_keys(spark):
    draw = random.Random(8)
    rows = [(None if draw.random() < 0.02 else "hot" if draw.random() < 0.8 else f"k{draw.randrange(40)}", 0.5, i) for i in range(5000)]
    frame = spark.createDataFrame(rows, "k string, score double, id long").repartition(5)
    got = collections.defaultdict(list)
    for r in number_ranged(frame, ["k"], [F.col("score").desc(), "id"]).collect():
        got[r.k].append((r.n, r.id))
    want = collections.defaultdict(list)
    for k, _, i in rows:
        want[k].append(i)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == want
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in got.values())
    assert number_ranged(frame.limit(0), ["k"], ["id"]).count() == 0


def plain_motion(samples, a, b, fast):
    """Smoothness of one window over (n, t, dx, dy) in order."""
    inside = [(s, samples[i - 1] if i else None) for i, s in enumerate(samples) if a <= s[1] <= b]
    if len(inside) < 4:
        return True, 0.0
    size = lambda s: math.hypot(s[2], s[3])
    pairs = [(s, p) for s, p in inside if p and p[1] >= a]
    top = float(np.percentile([size(s) for s, _ in inside], 95))
    acc = float(np.percentile([abs(size(s) - size(p)) for s, p in pairs], 95))
    flips = sum(s[2] * p[2] + s[3] * p[3] < 0 and size(s) * size(p) > 9 for s, p in pairs)
    limit = (22, 12, 3) if fast else (10, 6, 1)
    return top <= limit[0] and acc <= limit[1] and flips <= limit[2], math.floor((acc + 0.4 * top + 2 * flips + 1e-9) * 1000 + 0.5) / 1000


def film(seed, count):
    draw = random.Random(seed)
    return [(i, i / 20, draw.uniform(-3, 3) * (8 if i // 200 % 4 == 3 else 1), draw.uniform(-2, 2)) for i in range(count)]


def test_sliding_windows_against_a_plain_check(spark):
    draw = random.Random(3)
    films = {v: film(v, draw.choice([0, 3, 900, 3000])) for v in range(6)}
    films[7] = film(7, 4000)
    samples = spark.createDataFrame([(v, *s) for v, own in films.items() for s in own], "video_id long, n long, t double, dx double, dy double")
    windows = [(i, draw.choice([*range(6), 7, 7, 7, 8]), a := round(draw.uniform(0, 190), 2), a + draw.choice([0.0, 0.1, 0.3, 2.0, 5.0, 130.0]), draw.random() < 0.5) for i in range(400)]
    windows += [windows[0][:1] + windows[0][1:]]
    frame = spark.createDataFrame(windows, "window_id long, video_id long, a double, b double, allow_fast boolean")
    got = collections.Counter((r.window_id, r.ok, r.badness) for r in Q.window_motion(frame, samples).collect())
    want = collections.Counter((w[0], *plain_motion(films.get(w[1], []), *w[2:])) for w in windows)
    assert got == want and {ok for _, ok, _ in want} == {True, False}
    assert Q.window_motion(frame.limit(0), samples).count() == 0 and Q.window_motion(frame, samples.limit(0)).filter("ok AND badness = 0").count() == len(windows)


def test_best_windows_against_trying_all(spark):
    draw = random.Random(5)
    films = {v: film(20 + v, 1200) for v in range(3)}
    samples = spark.createDataFrame([(v, *s) for v, own in films.items() for s in own], "video_id long, n long, t double, dx double, dy double")
    frags = []
    for i in range(60):
        a = round(draw.uniform(0, 55), 2)
        b = round(a + draw.choice([1.0, 2.0, 4.15, 9.5]), 3)
        frags.append((i, draw.choice([0, 1, 2, 9]), a, b, draw.choice([None, a - 1, round(a + 0.4, 2), b]), draw.choice([1.0, 2.0, 4.0]), draw.random() < 0.5))
    frame = spark.createDataFrame(frags, "frag_id long, video_id long, start_s double, end_s double, best_moment double, frag_len double, allow_fast boolean")
    got = {r.frag_id: (r.src_start, r.src_end) for r in R.best_window(frame, samples).collect()}
    r3 = lambda x: math.floor((x + 1e-9) * 1000 + 0.5) / 1000
    alone = {r.frag_id: (r.src_start, r.src_end) for r in R.center_fragment(frame, "frag_len").collect()}
    for i, v, a, b, _, n, fast in frags:
        own = films.get(v, [])
        if not any(a <= s[1] <= b for s in own):
            assert got[i] == alone[i]
            continue
        starts = [a]
        if r3(b - a) > n + 0.2:
            starts = [a + 0.5 * k for k in range(math.ceil((b - n - a + 0.01) / 0.5))]
            starts += [b - n] if starts[-1] < b - n - 0.05 else []
        tried = [(math.floor((bad + 0.05 * abs(s - alone[i][0]) + 1e-9) * 1e6 + 0.5) / 1e6, s) for s in starts for ok, bad in [plain_motion(own, s, s + n, fast)] if ok]
        assert got[i] == ((r3(min(tried)[1]), r3(min(tried)[1] + n)) if tried else (None, None))
    assert (None, None) in got.values()


def plain_cue(energy, desired):
    """Best start of a film over a curve, by trying all."""
    n, d = len(desired), np.array(desired)
    best = None
    for at in range(len(energy) - n + 1):
        w = np.array(energy[at:at + n])
        flat = w.std() < 1e-6 or ((d - d.mean()) ** 2).sum() <= 1e-18
        like = 0.0 if flat else float(((w - w.mean()) * (d - d.mean())).sum() / math.sqrt(((w - w.mean()) ** 2).sum() * ((d - d.mean()) ** 2).sum()))
        score = math.floor((like - 0.5 * float(np.abs(w - d).mean()) + 1e-9) * 1e8 + 0.5) / 1e8
        if best is None or score > best[0]:
            best = (score, at)
    return best


def test_cues_in_small_blocks_against_trying_all(spark):
    draw = random.Random(4)
    length = {1: 180, 2: 45, 3: 12}
    curve = {t: [round(draw.random(), 3) if t != 3 else 0.5 for _ in range(n + 1)] for t, n in length.items()}
    tracks = spark.createDataFrame([(t, float(n)) for t, n in length.items()], "track_id long, duration double")
    points = spark.createDataFrame([(t, s, e) for t, own in curve.items() for s, e in enumerate(own)], "track_id long, sec long, energy double")
    films = [(i, draw.choice([1, 1, 1, 2, 3]), draw.choice(["generic", "drone_cinematic"]), float(draw.choice([5, 9, 20, 33, 60, 170]))) for i in range(40)]
    requests = spark.createDataFrame(films, "plan_id long, track_id long, preset_id string, target_duration double")
    profiles = {(r.preset_id, r.n): r.desired for r in M.desired_profile(spark, requests.selectExpr("preset_id", "CAST(target_duration AS INT) AS n").distinct()).collect()}
    want = {}
    for i, t, preset, n in films:
        want[i] = None if length[t] <= n + 2 else plain_cue(curve[t], profiles[preset, int(n)])
    for size, most in ((512, 4096), (8, 2)):
        got = {r.plan_id: None if r.short else (r.cue_score, int(r.best_start)) for r in M.music_cue(requests, points, tracks, size, most).collect()}
        assert {i: v and v[1] for i, v in got.items()} == {i: v and v[1] for i, v in want.items()}
        assert all(v is None or v[0] == pytest.approx(want[i][0], abs=2e-8) for i, v in got.items())


def test_cuts_of_a_track_snap_like_cuts_of_a_plan(spark):
    draw = random.Random(9)
    segments = [(p, s, a := round(draw.uniform(0, 50), 2), round(a + draw.uniform(0.8, 9), 2)) for p in range(30) for s in range(draw.randint(1, 9))]
    frame = spark.createDataFrame(segments, "plan_id long, seg_no long, src_start double, src_end double")
    cues = spark.createDataFrame([(p, p % 3, round(draw.uniform(0, 200), 3)) for p in range(28)], "plan_id long, track_id long, offset double")
    cuts = spark.createDataFrame([(t, round(x * draw.uniform(0.4, 0.6), 3)) for t in range(2) for x in range(700)], "track_id long, cut_t double").distinct()
    beats = cuts.limit(0).withColumnRenamed("cut_t", "beat_t")
    overlaps = spark.createDataFrame([(p, 0.4) for p in range(0, 30, 2)], "plan_id long, overlap double")
    order = lambda df: sorted(map(tuple, df.select("plan_id", "seg_no", "src_end", "beat_synced").collect()))
    got = order(P.snap_to_track(frame, cues, cuts, overlaps))
    assert got == order(P.snap_to_cuts(frame, M.shift_cuts(cues, cuts, beats), overlaps)) and {g[3] for g in got} == {True, False}


def test_sliding_windows_weigh_as_single_ones(spark):
    draw = random.Random(6)
    spans = [(v, float(lo), lo + draw.choice([0.5, 2.5, 9.0]), draw.choice([None, 0.25, 0.7, 1.0])) for v in range(3) for lo in range(0, 300, 12)]
    scenes = spark.createDataFrame(spans, "video_id long, start_s double, end_s double, interest double")
    slid = [(i, draw.randrange(4), [x := draw.uniform(0, 280), x + 0.5, x + 1.0][:draw.randint(1, 3)], draw.uniform(1, 15)) for i in range(80)]
    arrays = spark.createDataFrame([(i, v, a, [x + w for x in a]) for i, v, a, w in slid], "window_id long, video_id long, a array<double>, b array<double>")
    single = spark.createDataFrame([(f"{i}/{k}", v, x, x + w) for i, v, a, w in slid for k, x in enumerate(a)], "window_id string, video_id long, a double, b double")
    pauses = scenes.selectExpr("video_id", "start_s AS lo", "end_s AS hi")
    for name, many, one in (("mean", V.weighted_overlap(arrays, scenes.filter("interest IS NOT NULL"), "interest"), V.weighted_overlap(single, scenes.filter("interest IS NOT NULL"), "interest")),
                            ("mean", V.weighted_overlap(arrays, scenes, "interest"), None), ("overlap", V.overlap_len(arrays, pauses), V.overlap_len(single, pauses))):
        got = {f"{r.window_id}/{k}": x for r in many.collect() for k, x in enumerate(r[name])}
        want = {r.window_id: r[name] for r in one.collect()} if one is not None else {
            f"{i}/{k}": sum(part(x, x + w, s) * (s[3] or 0) for s in spans if s[0] == v) / (sum(part(x, x + w, s) for s in spans if s[0] == v) or 1)
            for i, v, a, w in slid for k, x in enumerate(a)}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got) and any(got.values())


def part(a, b, span):
    return max(0.0, min(b, span[2]) - max(a, span[1]))


def test_a_route_film_looks_its_scenes_up_once(spark, sf_dir, monkeypatch):
    """Scenes of moves and stops are found together, over scenes stored once with what a route asks of them."""
    looked, stored, scene_at, store = [], [], routes.scene_at, routes.tables.keep
    monkeypatch.setattr(routes, "scene_at", lambda *a: looked.append(1) or scene_at(*a))
    monkeypatch.setattr(routes.tables, "keep", lambda df, name: stored.append((name, "end_s" in df.columns and "quality_score" in df.columns)) or store(df, name))
    fx = Fixtures(spark, sf_dir).settle("scenes", "samples")
    zones = routes.tables.keep(W.route_zones(fx), "zones-given")
    del stored[:]
    segments, _ = routes.build_route_plans(zones, W.people(fx), W.clock4(fx), W.still(fx), W.settings(fx))
    assert segments.count() > 0 and len(looked) == 1
    assert [x for x in stored if x[0] == "scenes"] == [("scenes", False)]
