"""Frame and motion signals: measures, motion classes, smoothness, frozen spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import clamp, rnd
from ..functions.sequences import core_rows, halo_window, runs, with_halo
from ..functions.skew import join_hot
from ..functions.windows import Windows, rounded, slide


def sample_times(scenes: DataFrame, n: int = 4) -> DataFrame:
    """``n`` evenly spaced moments strictly inside every scene."""
    return (scenes.select("scene_id", "start_s", "end_s",
                          F.explode(F.sequence(F.lit(1), F.lit(n))).alias("burst"))
            .select("scene_id", (F.col("burst") - 1).alias("burst"),
                    (F.col("start_s") + F.col("burst") * (F.col("end_s") - F.col("start_s"))
                     / (n + 1)).alias("t")))


def change_profile(frames: DataFrame, fps: float = 8.0, start: float = 0.0) -> DataFrame:
    """Mean absolute change between consecutive frames of a video.

    ``frames``: video_id, frame_no (dense), luma array. Videos of fewer than three
    frames give nothing. Frames move once, by block; which videos are long enough is counted without
    them and asked of the differences."""
    df = with_halo(frames.select("video_id", "frame_no", "luma"), "frame_no", before=1)
    prev = F.lag("luma").over(halo_window(["video_id"], "frame_no"))
    df = core_rows(df.withColumn("_prev", prev)).filter(F.col("_prev").isNotNull())
    total = F.aggregate(
        F.zip_with("luma", "_prev", lambda a, b: F.abs(a.cast("double") - b.cast("double"))),
        F.lit(0.0), lambda acc, x: acc + x)
    i = F.col("frame_no") - 1
    out = df.select("video_id", i.alias("sample_no"), (F.lit(start) + (i + 0.5) / fps).alias("t"),
                    (total / F.size("luma")).alias("diff"))
    long_enough = frames.groupBy("video_id").agg(F.count("*").alias("_n")).filter("_n >= 3").select("video_id")
    return join_hot(out, long_enough, ["video_id"], "sample_no")


def frame_measures(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Adds ``sharpness`` (variance of the 4-neighbour Laplacian, edges mirrored) and
    ``brightness`` (mean). Works on whole Arrow batches of equally sized frames."""

    @F.pandas_udf("sharpness double, brightness double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for luma in batches:
            if luma.empty:
                yield pd.DataFrame({"sharpness": [], "brightness": []}, dtype="float64")
                continue
            img = np.stack(luma.to_numpy()).astype(np.float64).reshape(len(luma), height, width)
            pad = np.pad(img, ((0, 0), (1, 1), (1, 1)), mode="reflect")
            lap = (pad[:, :-2, 1:-1] + pad[:, 2:, 1:-1] + pad[:, 1:-1, :-2] + pad[:, 1:-1, 2:]
                   - 4.0 * img)
            yield pd.DataFrame({"sharpness": lap.var(axis=(1, 2)),
                                "brightness": img.mean(axis=(1, 2))})

    return (frames.withColumn("_m", measure("luma"))
            .select(*[c for c in frames.columns if c != "luma"], "_m.sharpness", "_m.brightness"))


def scene_measures(samples: DataFrame) -> DataFrame:
    """Median sharpness and brightness of a scene (a few samples each)."""
    return samples.groupBy("scene_id").agg(
        F.percentile("sharpness", 0.5).alias("sharpness"),
        F.percentile("brightness", 0.5).alias("brightness"))


def flow_stats(scenes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Motion statistics per scene from vectors inside short bursts.

    ``vectors``: scene_id, burst, k, dx, dy, radial. Speed is the median length, accel the
    75th percentile of the change, flips the share of pairs that turn back."""
    w = Window.partitionBy("scene_id", "burst").orderBy("k")
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    v = vectors.withColumn("_norm", norm)
    v = (v.withColumn("_px", F.lag("dx").over(w)).withColumn("_py", F.lag("dy").over(w))
         .withColumn("_pn", F.lag("_norm").over(w)))
    ddx, ddy = F.col("dx") - F.col("_px"), F.col("dy") - F.col("_py")
    dot = F.col("dx") * F.col("_px") + F.col("dy") * F.col("_py")
    turned = (F.col("_norm") > 1.5) & (F.col("_pn") > 1.5) & (dot < 0)
    stats = v.groupBy("scene_id").agg(
        F.percentile("_norm", 0.5).alias("speed"),
        F.percentile(F.sqrt(ddx * ddx + ddy * ddy), 0.75).alias("accel"),
        F.count(F.when(turned, 1)).alias("_flips"), F.count("_px").alias("_pairs"),
        F.percentile("radial", 0.5).alias("radial"))
    zero = F.lit(0.0)
    return scenes.select("scene_id").join(stats, "scene_id", "left").select(
        "scene_id", "speed", F.coalesce("accel", zero).alias("accel"),
        F.when(F.col("_pairs") > 0, F.col("_flips") / F.col("_pairs")).otherwise(zero).alias("flip_ratio"),
        F.coalesce("radial", zero).alias("radial"))


def classify_motion(stats: DataFrame, fps: float = 30.0) -> DataFrame:
    """Adds jerkiness, stability, motion (static/slow/fast) and motion_type. Scenes
    without any vector are static and steady."""
    seen = F.col("speed").isNotNull()
    j = F.least(0.5 * F.least(F.col("accel") / 14.0, F.lit(2.0))
                + 0.3 * F.least(F.col("flip_ratio") / 0.4, F.lit(2.0))
                + 0.2 * F.least(F.col("speed") / 45.0, F.lit(2.0)), F.lit(2.0)) / 2.0
    pps = F.col("speed") * fps
    df = (stats.withColumn("jerkiness", F.when(seen, j).otherwise(0.0))
          .withColumn("motion", F.when(~seen | (pps < 8), "static").when(pps < 120, "slow").otherwise("fast")))
    zoom = (F.abs("radial") > 0.5 * F.col("speed")) & (F.col("speed") > 1.0)
    kind = (F.when(F.col("motion") == "static", "none").when(F.col("jerkiness") >= 0.5, "shake")
            .when(zoom & (F.col("radial") > 0), "zoom_in").when(zoom, "zoom_out").otherwise("pan"))
    return df.withColumn("motion_type", kind).withColumn(
        "stability", clamp(1.0 - F.col("jerkiness"), 0.0, 1.0))


def quality_score(df: DataFrame, dark: float = 35.0, bright: float = 225.0,
                  blurred: float = 40.0) -> DataFrame:
    """Adds ``quality_score`` from sharpness, brightness, stability and motion."""
    b = F.col("brightness")
    expo = (F.when(b < dark, F.greatest(b / dark, F.lit(0.1)))
            .when(b > bright, F.greatest((255.0 - b) / (255.0 - bright), F.lit(0.1))).otherwise(1.0))
    q = 0.45 * F.least(F.col("sharpness") / 150.0, F.lit(1.0)) + 0.25 * expo + 0.30 * F.col("stability")
    q = (F.when(F.col("motion_type") == "shake", q * 0.5)
         .when((F.col("motion") == "fast") & (F.col("sharpness") < blurred * 2.5), q * 0.7).otherwise(q))
    return df.withColumn("quality_score", rnd(q, 3))


def keyframes(samples: DataFrame) -> DataFrame:
    """The two sharpest samples of a scene in time order; equal sharpness prefers the
    later one. ``best_moment`` is the earlier of the two."""
    w = Window.partitionBy("scene_id").orderBy(F.col("sharpness").desc(), F.col("sample_no").desc())
    top = samples.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return top.groupBy("scene_id").agg(
        F.min("t").alias("best_moment"),
        F.max(F.when(F.col("_r") <= 2, F.col("t"))).alias("last_keyframe"), F.count("*").alias("keyframes"))


def reject_low_quality(scenes: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Drops scenes below the threshold and tags shaken ones ``jerky``."""
    return scenes.filter(F.col("quality_score") >= threshold).withColumn(
        "tags", F.when(F.col("motion_type") == "shake", F.array_append("tags", "jerky"))
        .otherwise(F.col("tags")))


def motion_pairs(samples: DataFrame) -> DataFrame:
    """Samples with what the pair (sample before, this one) shows: ``pt`` time of the
    one before, ``speed``, ``acc`` change of speed, ``flip`` turned back while moving.

    ``samples``: video_id, n (dense), t, dx, dy."""
    df = samples.select("video_id", "n", "t", "dx", "dy").withColumn(
        "speed", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    df = with_halo(df, "n", before=1)
    prev = F.lag(F.struct("t", "dx", "dy", "speed")).over(halo_window(["video_id"], "n"))
    df = core_rows(df.withColumn("_p", prev))
    dot = F.col("dx") * F.col("_p.dx") + F.col("dy") * F.col("_p.dy")
    return df.select(
        "video_id", "n", "t", "speed", F.col("_p.t").alias("pt"),
        F.abs(F.col("speed") - F.col("_p.speed")).alias("acc"),
        F.coalesce((dot < 0) & (F.col("speed") * F.col("_p.speed") > 9.0), F.lit(False)).alias("flip"))


def smoothness(w: Windows, fast: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is each window smooth (``fast``: is fast motion allowed), and how rough is it. Windows of fewer than four samples pass."""
    few = w.n < 4
    ok = (w.sp95 <= np.where(fast, 22.0, 10.0)) & (w.ac95 <= np.where(fast, 12.0, 6.0)) & (w.flips <= np.where(fast, 3, 1))
    return few | ok, np.where(few, 0.0, rounded(w.ac95 + 0.4 * w.sp95 + 2.0 * w.flips, 3))


def window_motion(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """Smoothness of windows (window_id, video_id, a, b, allow_fast)."""
    rows = windows.select("window_id", "allow_fast", "video_id", F.array("a").alias("starts"), (F.col("b") - F.col("a")).alias("length"),
                          F.col("b").alias("last_end"), F.col("b").alias("stop"))

    def judge(own, w):
        ok, rough = smoothness(w, own.column("allow_fast").to_numpy())
        return pa.table([own.column("window_id"), pa.array(ok), pa.array(rough, from_pandas=True)], ["window_id", "ok", "badness"])

    kind = windows.schema["window_id"].dataType.simpleString()
    return slide(rows, motion_pairs(samples), ["window_id", "allow_fast"], judge, f"window_id {kind}, ok boolean, badness double")


def smooth_same(samples: DataFrame, value: str, k: int = 4, name: str = "smooth") -> DataFrame:
    """Centred moving mean with a fixed divisor: places outside the series count as zero.
    ``samples``: video_id, n (dense) and the value."""
    back, ahead = k // 2, (k - 1) // 2
    df = with_halo(samples, "n", before=back, after=ahead)
    w = halo_window(["video_id"], "n").rowsBetween(-back, ahead)
    return core_rows(df.withColumn(name, F.sum(value).over(w) / F.lit(float(k))))


def freeze_spans(samples: DataFrame, rate: float = 8.0, max_diff: float = 2.0,
                 min_len: float = 2.5, chunk_rows: int = 8192) -> DataFrame:
    """Spans in which the picture stands still for at least ``min_len`` seconds.

    ``samples``: video_id, n (dense), t, diff at ``rate`` per second. The smoothing window
    is half a second; series shorter than that cannot hold a span."""
    smooth = smooth_same(samples.select("video_id", "n", "t", "diff"), "diff", max(int(0.5 * rate), 1))
    spans = runs(smooth, ["video_id"], "t", F.col("smooth") < max_diff,
                 F.floor(F.col("n") / chunk_rows), ["n"])
    return spans.filter(F.col("run_end") - F.col("run_start") >= min_len).select(
        "video_id", F.col("run_start").alias("f_start"), F.col("run_end").alias("f_end"))
