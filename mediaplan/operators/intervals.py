"""Interval algebra per key: merge, subtract, split, overlap, lookup, threshold runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import overlap
from ..functions.ranges import range_join
from ..functions.sequences import chunk_of, running, runs
from ..functions.skew import join_hot
from ..functions.sweep import sweep

CHUNK_S = 3600.0
BIN_S = 60.0
#: Copies of a row that every video has one of.
FACT_SALTS = 8


def merge_spans(spans: DataFrame, key: Sequence[str], lo: str, hi: str, gap: float = 0.5,
                chunk_s: float = CHUNK_S) -> DataFrame:
    """Unions of spans whose distance is at most ``gap``. Inverted spans are left out."""
    chunk, order = chunk_of(lo, chunk_s), [lo, hi]
    df = spans.select(*key, lo, hi).filter(F.col(hi) >= F.col(lo))
    df = running(df, key, chunk, order, {"_reach": ("max", F.col(hi), False)}, keep_chunk=True)
    opens = F.when(F.col("_reach").isNull() | (F.col(lo) - F.col("_reach") > gap), 1).otherwise(0)
    df = running(df.withColumn("_opens", opens), key, None, order,
                 {"_no": ("sum", F.col("_opens"), True)})
    return df.groupBy(*key, "_no").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_no")


def subject_spans(scenes: DataFrame, key: Sequence[str] = ("video_id",), gap: float = 2.0) -> DataFrame:
    """Merged spans of scenes in which somebody is seen (``has_person``)."""
    people = scenes.filter("has_person").select(*key, F.col("start_s").alias("s_start"), F.col("end_s").alias("s_end"))
    return merge_spans(people, key, "s_start", "s_end", gap)


def frozen_scene_spans(scenes: DataFrame, key: Sequence[str] = ("video_id",), gap: float = 0.5,
                       min_len: float = 2.5) -> DataFrame:
    """Merged spans of static scenes without people, long enough to count as a pause."""
    still = scenes.filter((F.col("motion") == "static") & ~F.col("has_person"))
    still = still.select(*key, F.col("start_s").alias("f_start"), F.col("end_s").alias("f_end"))
    return merge_spans(still, key, "f_start", "f_end", gap).filter(
        F.col("f_end") - F.col("f_start") >= min_len)


def subtract_spans(base: DataFrame, cut: DataFrame, key: Sequence[str], base_span: tuple[str, str],
                   span: tuple[str, str], min_len: float = 0.4) -> DataFrame:
    """Pieces (p_lo, p_hi) of every base interval outside all cut spans, at least
    ``min_len`` long. Base columns are kept."""
    return sweep(base, cut, key, base_span, span).filter(F.col("p_hi") - F.col("p_lo") >= min_len).drop("inside")


def split_by_spans(base: DataFrame, spans: DataFrame, key: Sequence[str], base_span: tuple[str, str],
                   span: tuple[str, str]) -> DataFrame:
    """Pieces (p_lo, p_hi, inside) that cover every base interval, split at the borders of
    disjoint spans."""
    return sweep(base, spans, key, base_span, span, inside=True)


def net_length(spans: DataFrame, routes: DataFrame, tech: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """Length of spans (span_id, video_id, lo, hi) inside the route (r_lo, r_hi) of their
    video, less every technical span (t_lo, t_hi) on its own; never below zero."""
    clip = join_hot(spans, routes.select("video_id", "r_lo", "r_hi"), ["video_id"], "lo", FACT_SALTS)
    clip = clip.select("span_id", "video_id", F.greatest("lo", "r_lo").alias("c_lo"), F.least("hi", "r_hi").alias("c_hi"))
    ok = clip.filter("c_lo < c_hi")
    hit = range_join(ok, tech.select("video_id", "t_lo", "t_hi"), ["video_id"], ("c_lo", "c_hi"), ("t_lo", "t_hi"), bin_s)
    off = hit.groupBy("span_id").agg(F.sum(overlap("c_lo", "c_hi", "t_lo", "t_hi")).alias("_off"))
    net = F.greatest(F.col("c_hi") - F.col("c_lo") - F.coalesce("_off", F.lit(0.0)), F.lit(0.0))
    return clip.join(off, "span_id", "left").select(
        "span_id", "video_id", F.when(F.col("c_lo") < F.col("c_hi"), net).otherwise(0.0).alias("net_len"))


def overlap_len(windows: DataFrame, spans: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """Total overlap of windows (window_id, video_id, a, b) with spans (lo, hi). Rows may hold windows that slide over a short
    stretch, as arrays a and b: their overlap is an array too."""
    if _slides(windows):
        return _summed(_with_met(windows, spans.select("video_id", "lo", "hi"), bin_s), "overlap", lambda total, weighted: total)
    hit = range_join(windows, spans.select("video_id", "lo", "hi"), ["video_id"], ("a", "b"), ("lo", "hi"), bin_s)
    total = hit.groupBy("window_id").agg(F.sum(overlap("a", "b", "lo", "hi")).alias("_len"))
    return windows.join(total, "window_id", "left").select(
        "window_id", F.coalesce("_len", F.lit(0.0)).alias("overlap"))


def weighted_overlap(windows: DataFrame, scenes: DataFrame, value: str, bin_s: float = BIN_S) -> DataFrame:
    """Mean of a scene column over windows, weighted by overlap; zero where none meets. Windows that slide: see ``overlap_len``."""
    s = scenes.select("video_id", F.col("start_s").alias("lo"), F.col("end_s").alias("hi"), F.col(value).alias("_x"))
    if _slides(windows):
        s = s.withColumn("_x", F.col("_x").cast("double"))
        return _summed(_with_met(windows, s, bin_s), "mean", lambda total, weighted: np.divide(weighted, total, out=np.zeros_like(total), where=total != 0))
    hit = range_join(windows, s, ["video_id"], ("a", "b"), ("lo", "hi"), bin_s)
    w = overlap("a", "b", "lo", "hi")
    mean = hit.groupBy("window_id").agg((F.sum(w * F.col("_x")) / F.sum(w)).alias("_mean"))
    return windows.join(mean, "window_id", "left").select(
        "window_id", F.coalesce("_mean", F.lit(0.0)).alias("mean"))


def _slides(windows: DataFrame) -> bool:
    return dict(windows.dtypes)["a"].startswith("array")


def _with_met(windows: DataFrame, spans: DataFrame, bin_s: float) -> DataFrame:
    """Rows of windows with the spans that their stretch meets, in order. Only the ends of a stretch move to find them."""
    ends = windows.select("window_id", "video_id", F.array_min("a").alias("_a"), F.array_max("b").alias("_b"))
    hit = range_join(ends, spans, ["video_id"], ("_a", "_b"), ("lo", "hi"), bin_s)
    own = [c for c in spans.columns if c != "video_id"]
    met = hit.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("_met"))
    return windows.join(met, "window_id", "left").withColumn("_met", F.coalesce("_met", F.array().cast(met.schema["_met"].dataType)))


def _summed(rows: DataFrame, name: str, result: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``result`` of the overlaps of every window with the spans ``_met`` and of the overlaps times ``_x`` (null: nothing), both summed
    up in the order of the spans: (window_id, ``name``), an array for each row."""

    def run(batches):
        for batch in batches:
            ends, *sums = _sums(batch)
            yield pa.RecordBatch.from_arrays([batch.column("window_id"), pa.ListArray.from_arrays(ends, pa.array(result(*sums)))], ["window_id", name])

    return rows.select("window_id", "a", "b", "_met").mapInArrow(run, f"window_id {rows.schema['window_id'].dataType.simpleString()}, {name} array<double>")


def _sums(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Where the windows of each row end, and the two sums of every window."""
    met = batch.column("_met")
    many, some = (pa.compute.list_value_length(x).fill_null(0).to_numpy() for x in (batch.column("a"), met))
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b"))
    span = met.flatten()
    lo, hi = (span.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))
    weighs = span.type.get_field_index("_x") >= 0
    x = span.field("_x") if weighs else pa.nulls(len(span), pa.float64())
    none, x = x.is_null().to_numpy(zero_copy_only=False), x.fill_null(0.0).to_numpy(zero_copy_only=False)
    row, first = np.repeat(np.arange(len(many)), many), np.cumsum(some) - some
    total, weighted = np.zeros(len(a)), np.zeros(len(a))
    for k in range(int(some.max(initial=0))):
        own = np.flatnonzero(some[row] > k)
        i = first[row[own]] + k
        part = np.maximum(np.minimum(b[own], hi[i]) - np.maximum(a[own], lo[i]), 0.0)
        total[own] += part
        if weighs:
            weighted[own] += np.where(none[i], 0.0, part * x[i])
    return pa.array(np.append(0, np.cumsum(many)), pa.int32()), total, weighted


def scene_at(points: DataFrame, scenes: DataFrame, bin_s: float = BIN_S) -> DataFrame:
    """Scene at a moment (point_id, video_id, t): the first with start <= t < end, else the
    last scene of the video."""
    s = scenes.select("video_id", "start_s", "end_s", "scene_id")
    hit = range_join(points, s, ["video_id"], ("t", "t"), ("start_s", "end_s"), bin_s, closed=True)
    first = hit.filter(F.col("t") < F.col("end_s")).groupBy("point_id").agg(
        F.min_by("scene_id", F.struct("start_s", "scene_id")).alias("_hit"))
    last = s.groupBy("video_id").agg(F.max_by("scene_id", F.struct("start_s", "scene_id")).alias("_last"))
    return (join_hot(points.join(first, "point_id", "left"), last, ["video_id"], "t", FACT_SALTS, "left")
            .select("point_id", F.coalesce("_hit", "_last").alias("scene_id")))


def threshold_ranges(series: DataFrame, key: Sequence[str], holds: Column, min_seconds: int = 2,
                     chunk_s: int = 3600) -> DataFrame:
    """Runs of whole seconds (``sec``, dense) of at least ``min_seconds`` where ``holds``:
    [first, first failing), or up to the end of the series."""
    r = runs(series, key, "sec", holds, F.floor(F.col("sec") / chunk_s), ["sec"])
    end = F.when(F.col("closed"), F.col("run_end")).otherwise(F.col("run_end") + 1)
    r = r.select(*key, F.col("run_start").cast("double").alias("r_start"), end.cast("double").alias("r_end"))
    return r.filter(F.col("r_end") - F.col("r_start") >= min_seconds)
