"""What large tables cost: nothing is moved, stored or read that a query does not need, with the same rows."""

import collections
import random

from pyspark.sql import functions as F

import workload
from mediaplan.functions.sequences import number_ranged
from mediaplan.operators import intervals as V, spans as S
from mediaplan.plans import drafts as P, routes as Z
from mediaplan.sources import tables
from workload import fixtures, routes

from conftest import rows

QUERIES = workload.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_looks(spark):
    draw = random.Random(3)
    words = [chr(97 + i) for i in range(7)]
    data = [(i, 0 if draw.random() < 0.7 else draw.randrange(1, 9), "x", draw.sample(words, draw.randrange(1, 6))) for i in range(200)]
    scenes = spark.createDataFrame([d[:3] for d in data], "scene_id long, project_id long, scene_type string")
    return S.scene_looks(scenes, spark.createDataFrame([(d[0], t) for d in data for t in d[3]], "scene_id long, token string"))


def test_few_looks_meet_directly_and_many_by_rare_tokens(spark):
    looks = some_looks(spark)
    assert "Generate" not in plan_of(S.similar_looks(looks))  # nothing is copied for sizes and tokens
    want, links = rows(S.similar_looks(looks)), rows(S.look_links(looks))
    assert len({w[0] for w in want}) > 2
    for few in (0, 8):  # all by tokens, one project by tokens
        assert rows(S.similar_looks(looks, few=few)) == want and rows(S.look_links(looks, few=few)) == links


def test_plan_fps_sorts_no_rows_by_place(spark, sf_dir):
    assert "Window" not in plan_of(QUERIES["T6_plan_fps"](spark, sf_dir))


def test_a_full_ranking_stores_what_it_reads(spark, sf_dir):
    for name in ("R5_rank_all", "R6_variant_order"):
        stored = spark.read.parquet(*QUERIES[name](spark, sf_dir).inputFiles())
        assert "score" in stored.columns and not {"description", "tags", "scene_types"} & set(stored.columns)


def test_small_keys_are_numbered_where_they_meet_and_hot_ones_in_ranges(spark):
    draw = random.Random(8)
    data = [(None if draw.random() < 0.3 else "hot" if draw.random() < 0.7 else f"k{draw.randrange(40)}", 0.5, i) for i in range(3000)]
    frame = spark.createDataFrame(data, "k string, score double, id long").repartition(5)
    want = collections.Counter(d[0] for d in data)
    for many in (10_000, 100, 0):
        got = collections.defaultdict(list)
        for r in number_ranged(frame, ["k"], [F.col("score").desc(), "id"], many=many).collect():
            got[r.k].append((r.n, r.id))
        assert {k: len(v) for k, v in got.items()} == want
        for v in got.values():
            assert [n for n, _ in sorted(v)] == list(range(len(v))) and [i for _, i in sorted(v)] == sorted(i for _, i in v)


def test_snapped_segments_are_not_joined_back(spark):
    """Rows that repeat come once each, with all their columns, and numbers missing in a span move nothing."""
    data = [(1, 0, 0.0, 3.0, "a"), (1, 0, 0.0, 3.0, "a"), (1, 1, 2.0, 4.5, "b"), (2, 0, 1.0, None, "c"), (2, 1, 1.0, 4.0, "d"), (3, 0, 0.0, 2.0, "e")]
    segments = spark.createDataFrame(data, "plan_id long, seg_no long, src_start double, src_end double, slot string")
    cues = spark.createDataFrame([(1, 7, 0.0), (2, 7, 60.0), (3, 8, 0.0)], "plan_id long, track_id long, offset double")
    cuts = spark.createDataFrame([(7, c) for c in (2.9, 6.1, 8.6, 63.2, 66.0)], "track_id long, cut_t double")
    out = P.snap_to_track(segments, cues, cuts, spark.createDataFrame([(9, 0.0)], "plan_id long, overlap double"))
    want = [(1, 0, 0.0, "a", 2.9, True), (1, 0, 0.0, "a", 3.2, True), (1, 1, 2.0, "b", 4.5, True), (2, 0, 1.0, "c", None, False),
            (2, 1, 1.0, "d", 4.0, False), (3, 0, 0.0, "e", 2.0, False)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_windows_that_slide_overlap_like_single_ones(spark):
    draw = random.Random(2)
    spans = [(draw.randrange(2), lo := draw.uniform(0, 300), lo + draw.uniform(0, 40), draw.choice([None, draw.random()])) for _ in range(120)]
    scenes = spark.createDataFrame(spans, "video_id long, start_s double, end_s double, x double")
    blocks = [(i, i % 3, [i * 11.0 + k / 2 for k in range(9)], [i * 11.0 + k / 2 + 5 for k in range(9)]) for i in range(30)]
    sliding = spark.createDataFrame(blocks, "window_id long, video_id long, a array<double>, b array<double>")
    single = sliding.selectExpr("window_id", "video_id", "inline(arrays_zip(a, b))").selectExpr("struct(window_id, a) AS window_id", "video_id", "a", "b")
    cuts = scenes.selectExpr("video_id", "start_s AS lo", "end_s AS hi")
    for name, of in (("overlap", lambda w: V.overlap_len(w, cuts)), ("mean", lambda w: V.weighted_overlap(w, scenes, "x"))):
        got = sliding.join(of(sliding), "window_id").selectExpr("window_id", f"inline(arrays_zip(a, {name}))").collect()
        want = {(r[0].window_id, r[0].a): r[1] for r in of(single).collect()}
        assert len(got) == len(want) and all(abs(r[2] - want[r[0], r[1]]) < 1e-9 for r in got)


def test_zone_windows_move_a_row_a_block(spark, sf_dir, monkeypatch):
    stored = {}
    monkeypatch.setattr(Z, "keep", lambda df, name: stored.setdefault(name, tables.keep(df, name)))
    QUERIES["Z8_zone_windows"](spark, sf_dir)
    assert dict(stored["windows"].dtypes)["a"] == "array<double>"


def test_queries_of_pieces_store_no_samples(spark, sf_dir, monkeypatch):
    names = []
    for module in (fixtures, routes):
        monkeypatch.setattr(module, "keep", lambda df, name: names.append(name) or tables.keep(df, name))
    for name in ("Z9_gap_pieces", "Z10_route_segments"):
        QUERIES[name](spark, sf_dir)
    assert "people" in names and "samples" not in names
