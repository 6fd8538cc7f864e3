"""Ordered work split into small chunks must equal the plain rule over a whole hot key."""

import collections
import random

from pyspark.sql import functions as F

from conftest import rows
from mediaplan.functions import ranges, sequences as Q
from mediaplan.functions.skew import join_hot
from mediaplan.operators import intervals as V, signals, spans as S
from mediaplan.plans import routes


def hot(n=400, keys=3, seed=1):
    """Most rows belong to key 0."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.7 else rnd.randrange(1, keys), i, round(rnd.random() * 300, 1), round(rnd.random() * 9, 2)) for i in range(n)]


def by_key(data, order):
    out = {}
    for r in sorted(data, key=order):
        out.setdefault(r[0], []).append(r)
    return out


def test_number_and_previous(spark):
    data = hot()
    df = spark.createDataFrame(data, "k long, id long, t double, v double")
    got = {(r.k, r.id): r.n for r in Q.number_rows(df, ["k"], Q.chunk_of("t", 7), ["t", "id"]).collect()}
    prev = {(r.k, r.id): r.p for r in Q.previous_row(df, ["k"], Q.chunk_of("t", 7), ["t", "id"], {"p": F.col("v")}).collect()}
    for k, seq in by_key(data, lambda r: (r[2], r[1])).items():
        for i, r in enumerate(seq):
            assert got[k, r[1]] == i
            assert prev[k, r[1]] == (seq[i - 1][3] if i else None)


def test_halo_windows(spark):
    data = [(k, i, random.Random(i + k).random()) for k in (0, 1) for i in range(200 if k == 0 else 13)]
    df = spark.createDataFrame(data, "video_id long, n long, x double")
    d = Q.with_halo(df, "n", before=2, after=1, size=5)
    w = Q.halo_window(["video_id"], "n").rowsBetween(-2, 1)
    got = {(r.video_id, r.n): r.s for r in Q.core_rows(d.withColumn("s", F.sum("x").over(w))).collect()}
    assert len(got) == len(data)
    for k in (0, 1):
        xs = [r[2] for r in data if r[0] == k]
        for i in range(len(xs)):
            assert abs(got[k, i] - sum(xs[max(i - 2, 0):i + 2])) < 1e-9


def test_merge_spans(spark):
    data = [(k, t, t + v) for k, _, t, v in hot()]
    df = spark.createDataFrame(data, "k long, lo double, hi double")
    want = []
    for k, seq in by_key(data, lambda r: (r[1], r[2])).items():
        out = []
        for _, lo, hi in seq:
            if out and lo - out[-1][1] <= 0.5:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        want += [(k, *o) for o in out]
    assert rows(V.merge_spans(df, ["k"], "lo", "hi", 0.5, chunk_s=11)) == sorted(want)


def test_spaced_points(spark):
    data = sorted({(k, t) for k, _, t, _ in hot(900)})
    df = spark.createDataFrame(data, "k long, t double")
    want = []
    for k in {d[0] for d in data}:
        last = -1e9
        for _, t in [d for d in data if d[0] == k]:
            if t - last >= 1.0:
                want.append((k, t))
                last = t
    for gaps in (1, 3, 64):
        assert rows(Q.spaced_points(df, ["k"], "t", 1.0, chunk_gaps=gaps)) == sorted(want)


def test_runs_and_freeze(spark):
    rnd = random.Random(3)
    data, level = [], 0
    for i in range(600):
        if rnd.random() < 0.05:
            level = 5 - level
        data.append((1, i, i / 8, float(level)))
    df = spark.createDataFrame(data, "video_id long, n long, t double, diff double")
    xs = [d[3] for d in data]
    smooth = [sum(xs[max(i - 2, 0):i + 2]) / 4 for i in range(len(xs))]
    want, start = [], None
    for i, s in enumerate(smooth):
        if s < 2 and start is None:
            start = i / 8
        elif s >= 2 and start is not None:
            want += [(1, start, i / 8)] if i / 8 - start >= 2.5 else []
            start = None
    if start is not None and data[-1][2] - start >= 2.5:
        want.append((1, start, data[-1][2]))
    assert rows(signals.freeze_spans(df, chunk_rows=10)) == want


def test_range_join_counts_each_pair_once(spark):
    data = [(k, i, t, t + v * 3) for k, i, t, v in hot(200)]
    a = spark.createDataFrame(data, "k long, ia long, a0 double, a1 double")
    b = spark.createDataFrame(data, "k long, ib long, b0 double, b1 double")
    want = sorted((x[1], y[1]) for x in data for y in data if x[0] == y[0] and y[3] > x[2] and y[2] < x[3])
    assert rows(ranges.range_join(a, b, ["k"], ("a0", "a1"), ("b0", "b1"), 4.0).select("ia", "ib")) == want


def test_join_hot(spark):
    big = spark.createDataFrame([(0, i) for i in range(100)] + [(1, 500)], "k long, id long")
    small = spark.createDataFrame([(0, "a"), (2, "b")], "k long, f string")
    assert join_hot(big, small, ["k"], "id").count() == 100
    assert join_hot(big, small, ["k"], "id", how="left").filter("f IS NULL").count() == 1


def test_rows_of_all_videos_are_not_broadcast(spark):
    """Stored rows look small to the optimizer, and copies of them smaller still."""
    df = routes.keep(spark.createDataFrame([(k, t, float(t)) for k in range(9) for t in range(9)], "video_id long, i long, t double"), "rows")
    ends = df.groupBy("video_id").agg(F.max("t").alias("end"))
    for out in (join_hot(df.select("video_id", "i"), ends, ["video_id"], "i"), Q.number_rows(df, ["video_id"], Q.chunk_of("t", 4), ["t"]),
                Q.previous_row(df, ["video_id"], Q.chunk_of("t", 4), ["t"], {"before": F.col("i")})):
        assert out.count() == 81
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_similar_looks_equals_all_pairs(spark):
    rnd = random.Random(5)
    words = [chr(97 + i) for i in range(7)]
    data = [(i, rnd.randrange(3), rnd.choice(["x", "y"]), sorted(rnd.sample(words, rnd.randrange(1, 6)))) for i in range(150)]
    scenes = spark.createDataFrame([d[:3] for d in data], "scene_id long, project_id long, scene_type string")
    tokens = spark.createDataFrame([(d[0], t) for d in data for t in d[3]], "scene_id long, token string")
    looks = S.scene_looks(scenes, tokens)
    got = rows(S.similar_looks(looks).select("project_id", "scene_type", "jaccard", "scene_pairs"))
    # a token that many looks share is dealt to parts
    assert rows(S.similar_looks(looks, hot=2)) == rows(S.similar_looks(looks))
    pairs = S.similar_looks(looks).collect()
    ends = collections.Counter(x for p in pairs for x in (p.look_a, p.look_b))
    assert {r.look_id: r.links for r in S.look_links(looks, hot=2).collect() if r.links} == ends
    looks = {}
    for _, p, ty, tok in data:
        looks[p, ty, tuple(tok)] = looks.get((p, ty, tuple(tok)), 0) + 1
    want, names = [], sorted(looks)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if a[:2] == b[:2]:
                j = len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2]))
                if j >= 0.65:
                    want.append((a[0], a[1], round(j, 6), looks[a] * looks[b]))
    assert got == sorted(want)
