"""Streams of several batches, run again, and drafts set to music."""

import shutil

import pytest
from pyspark.sql import functions as F

import workload
from mediaplan.plans import films
from mediaplan.sources import ingest as I, tables as T
from mediaplan.streaming import forms as W


def feed(spark, folder, data, shape):
    spark.createDataFrame(data, shape).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_arrivals_over_batches_and_again(spark, tmp_path):
    shape = "file_id long, path string, fingerprint string"
    source, sink = tmp_path / "in", str(tmp_path / "out")
    feed(spark, source, [(1, "a", "x"), (2, "b", "y"), (3, "c", "x")], shape)
    stream = feed(spark, source, [(4, "d", "y"), (5, "e", "z")], shape)
    want = ["x", "y", "z"]
    assert sorted(r.fingerprint for r in W.arrivals(stream, sink, str(tmp_path / "c1"), buckets=4).collect()) == want
    # a new checkpoint replays every batch against the same table
    assert sorted(r.fingerprint for r in W.arrivals(stream, sink, str(tmp_path / "c2"), buckets=4).collect()) == want
    more = feed(spark, source, [(6, "f", "w"), (7, "g", "x")], shape)
    out = W.arrivals(more, sink, str(tmp_path / "c1"), buckets=4)
    assert sorted(r.fingerprint for r in out.collect()) == ["w", *want] and out.columns == ["fingerprint", "file_id", "path"]


@pytest.mark.parametrize("files", [1, 3])
def test_a_stream_reads_a_table_of_one_file_or_many(spark, tmp_path, files):
    pages = spark.range(0, 60, 1, files).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', CAST(id % 4 AS INT)) AS html")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    if files == 1:
        part, = (tmp_path / "pages.parquet").glob("part-*")
        folder = tmp_path / "single"
        folder.mkdir()
        shutil.copyfile(part, folder / "pages.parquet")
        tmp_path = folder
    got = workload.queries()["W1_arrivals"](spark, str(tmp_path)).collect()
    # 40 remainders that fix the length, too
    assert sorted(r.file_id for r in got) == list(range(40))


def test_a_broken_sink_is_no_empty_sink(spark, tmp_path):
    like = spark.createDataFrame([], "a long")
    assert W._stored(spark, str(tmp_path / "none"), like).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        W._stored(spark, "nowhere://x/y", like).count()


@pytest.mark.parametrize("every", [1, 2, 50])
def test_latest_status_over_batches(spark, tmp_path, every):
    shape = "project_id long, status string, ts timestamp, event_id long"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    feed(spark, tmp_path / "in", [(1, "new", at(1), 1), (2, "new", at(1), 2)], shape)
    feed(spark, tmp_path / "in", [(1, "done", at(3), 3), (3, "new", at(1), 4)], shape)
    stream = feed(spark, tmp_path / "in", [(1, "late", at(2), 5), (2, "draft", at(2), 6)], shape)
    out = W.latest_status(stream, str(tmp_path / "out"), str(tmp_path / "c"), every=every)
    assert sorted(map(tuple, out.collect())) == [(1, "done"), (2, "draft"), (3, "new")]


def test_heads_of_files(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a.mp4").write_bytes(b"0123456789")
    (folder / "b.mp4").write_bytes(b"ab")
    listed = I.list_files(spark, f"file:{folder}")
    heads = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in I.with_heads(listed, 4).collect()}
    assert heads == {"a.mp4": b"0123", "b.mp4": b"ab"}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (4, "z", 1)], "k long, v string, at long")
    assert sorted(map(tuple, I.upsert(base, delta, ["k"], F.col("at")).collect())) == [(1, "a"), (2, "y"), (3, "c"), (4, "z")]


def test_saved_table_has_few_files(spark, tmp_path):
    df = spark.range(0, 20000, 1, 40).selectExpr("id % 3 AS project_id", "id AS scene_id", "map('a', id) AS m")
    T.save_table(df, str(tmp_path / "t"), buckets=4, salts=2)
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 4 * 2
    assert T.load_table(spark, str(tmp_path / "t")).count() == 20000


def test_films(spark):
    segments = spark.createDataFrame(
        [(p, i, 100 * i, 10.0 * i, 10.0 * i + 4.2) for p in (1, 2, 3) for i in range(4)],
        "project_id long, seg_no long, scene_id long, src_start double, src_end double")
    projects = spark.createDataFrame([(1, "generic", True), (2, "generic", False), (3, "generic", True)],
                                     "project_id long, used_preset string, sync_to_music boolean")
    music = spark.createDataFrame([(1, 5), (2, 5)], "project_id long, track_id long")  # project 3 has none
    curve = spark.createDataFrame([(5, s, s / 60.0) for s in range(60)], "track_id long, sec long, energy double")
    tracks = spark.createDataFrame([(5, 60.0)], "track_id long, duration double")
    beats = spark.createDataFrame([(5, i, i * 0.5) for i in range(120)], "track_id long, beat_no long, beat_t double")
    cuts = spark.createDataFrame([(5, i * 0.5) for i in range(120)], "track_id long, cut_t double")
    out, cues = films.set_to_music(segments, projects, music, curve, tracks, beats, cuts)
    rows = sorted(out.select("project_id", "seg_no", "src_end", "beat_synced").collect())
    assert [r.project_id for r in cues.collect()] == [1]
    assert [r[1] for r in rows] == [0, 1, 2, 3] * 3
    assert not any(r.beat_synced or round(r.src_end - 10 * r.seg_no, 3) != 4.2 for r in rows if r.project_id != 1)
    assert any(r.beat_synced for r in rows if r.project_id == 1)
    assert all(abs(r.src_end - 10 * r.seg_no - 4.2) <= 0.35 + 1e-9 for r in rows)
