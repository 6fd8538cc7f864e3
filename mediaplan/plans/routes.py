"""Routes of one-take videos: zones, timing, windows and the film that follows the route.

Steps whose result several later ones read are written to the shared folder (``keep``):
the plan stays short, nothing is computed twice, and a lost executor costs one step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clamp, half_even, overlap, rnd
from ..functions.ranges import range_join
from ..functions.sequences import chunk_of, number_rows, previous_row, running
from ..functions.skew import by_merge, join_hot
from ..functions.windows import slide
from ..operators import music as M, presets
from ..operators.intervals import (FACT_SALTS, frozen_scene_spans, merge_spans, net_length, overlap_len, scene_at,
                                   split_by_spans, subject_spans, subtract_spans, weighted_overlap)
from ..operators.signals import motion_pairs, smoothness
from ..operators.spans import group_neighbours
from ..sources import tables

MIN_INTEREST = 0.15
MIN_GAP = 0.4
FREEZE_MIN = 2.5
SUBJECT_MAX = 3.0
CHUNK_S = 3600.0
BIN_S = 60.0

# --- fixed values: titles, reasons, warnings and problems
WARNING_SHORT = ("Тайминг %dс слишком короткий: %d обязательных зон + маршрут займут минимум ~%dс (кадры с людьми не перематываются быстрее ×%s — "
                 "танец должен остаться смотрибельным). Варианты: увеличить длительность ролика; снять отметку с части зон; выбрать стиль «динамичный» "
                 "(сильнее ускоряет); согласиться с %dс.")
PROBLEM_NO_ZONES = "Зоны не найдены — сначала выполните детекцию зон"
PROBLEM_TECHNICAL = "Все зоны помечены техническими"
TITLE_MOMENT = "момент %d"
LABEL_MOVE, LABEL_END = "переезд", "финал"
REASON_FROZEN = "статичная пауза %dс — сжата до %sс"
REASON_SUBJECT = "щадящая перемотка ×%s — в кадре люди"
REASON_EMPTY = "перемотка ×%s по маршруту"
REASON_ZONE = "обязательная зона «%s»"


def keep(df: DataFrame, name: str) -> DataFrame:
    """A stored step (``tables.keep``) of all videos: joined by merge, as a broadcast of it would pass the driver."""
    return by_merge(tables.keep(df, name))


def _general(c) -> Column:
    """A number with up to two decimals, without closing zeros."""
    return F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")


def _seconds(lo, hi) -> Column:
    return rnd(F.col(hi) - F.col(lo), 3)


def zones_from_ranges(scenes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Zones from ranges of scene numbers (video_id, no, first_index, last_index, title,
    technical). The score is the mean of aesthetics, or quality where that is missing."""
    s = number_rows(scenes.select("video_id", "scene_id", "start_s", "end_s", "quality_score", "aesthetic_score"),
                    ["video_id"], chunk_of("start_s", CHUNK_S), ["start_s", "scene_id"], "_i")
    s = keep(s, "numbered")
    worth = F.when(F.col("aesthetic_score") == 0, F.col("quality_score")).otherwise(
        F.coalesce("aesthetic_score", "quality_score"))
    hit = range_join(ranges, s, ["video_id"], ("first_index", "last_index"), ("_i", "_i"), 64, closed=True)
    z = hit.groupBy("video_id", "no", "title", "technical").agg(
        F.min("start_s").alias("z_start"), F.max_by("end_s", "_i").alias("z_end"), rnd(F.avg(worth), 3).alias("score"),
        (F.min("_i") + F.floor(F.count("*") / 2)).alias("_mid"))
    mid = s.select("video_id", F.col("_i").alias("_mid"), F.col("scene_id").alias("thumb_scene"))
    return z.join(mid, ["video_id", "_mid"], "left").withColumn("required", ~F.col("technical")).drop("_mid")


def lane_zones(scenes: DataFrame, routes: DataFrame) -> DataFrame:
    """The most interesting scene of each lane of a route.

    ``scenes`` carry interest and has_person. ``routes``: route_id, video_id, r_lo, r_hi,
    target_duration, lane_width (null: lanes follow from the target). A lane gives nothing
    where interest is low, where people appear on the route but not in it, or where it
    repeats the scene accepted last."""
    span = F.col("r_hi") - F.col("r_lo")
    k = F.when(F.col("lane_width").isNotNull(), F.greatest(half_even(span / F.col("lane_width")), F.lit(1.0))).otherwise(
        clamp(half_even(F.col("target_duration") / 10), 4.0, 10.0)).cast("int")
    lanes = routes.filter(span > 0).withColumn("_k", k).withColumn("_lane", span / F.col("_k"))
    lanes = lanes.select("route_id", "video_id", "r_lo", "_lane", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("lane"))
    lanes = lanes.select("route_id", "video_id", "lane", (F.col("r_lo") + F.col("lane") * F.col("_lane")).alias("_lo"),
                         (F.col("r_lo") + (F.col("lane") + 1) * F.col("_lane")).alias("_hi"))
    s = scenes.select("video_id", "scene_id", "start_s", "end_s", "interest", "has_person", "description")
    hit = range_join(lanes, s, ["video_id"], ("_lo", "_hi"), ("start_s", "end_s"), BIN_S)
    first_best = F.max_by(F.struct("scene_id", "start_s", "end_s", "interest", "has_person", "description"),
                          F.struct("interest", -F.col("start_s"), -F.col("scene_id")))
    best = hit.groupBy("route_id", "video_id", "lane").agg(first_best.alias("b"), F.max("has_person").alias("_people"))
    best = keep(best, "lanes")
    people = best.groupBy("route_id").agg(F.max("_people").alias("_any"))
    ok = join_hot(best, by_merge(people), ["route_id"], "lane").filter(
        (F.col("b.interest") >= MIN_INTEREST) & (~F.col("_any") | F.col("b.has_person")))
    ok = previous_row(ok.select("route_id", "video_id", "lane", "b"), ["route_id"], F.floor(F.col("lane") / 4096), ["lane"],
                      {"_last": F.col("b.scene_id")})
    ok = ok.filter(F.col("_last").isNull() | (F.col("_last") != F.col("b.scene_id")))
    moment = F.format_string(TITLE_MOMENT, F.col("lane") + 1)
    title = F.coalesce(F.nullif(F.trim(F.substring("b.description", 1, 32)), F.lit("")), moment)
    return ok.select("route_id", "video_id", "lane", "b.scene_id", F.col("b.start_s").alias("z_start"),
                     F.col("b.end_s").alias("z_end"), title.alias("title"), F.col("b.interest").alias("score"))


def expand_zones(zones: DataFrame, scenes: DataFrame) -> DataFrame:
    """Replaces zones longer than 1.8 x target_span by the moments inside them, if at least
    two are found. ``zones``: zone_key (text), video_id, z_start, z_end, title, target_span."""
    long = zones.filter(_seconds("z_start", "z_end") > F.col("target_span") * 1.8)
    subs = keep(lane_zones(scenes, long.select(
        F.col("zone_key").alias("route_id"), "video_id", F.col("z_start").alias("r_lo"), F.col("z_end").alias("r_hi"),
        F.lit(0.0).alias("target_duration"), F.col("target_span").alias("lane_width"))), "moments")
    split = subs.groupBy("route_id").agg(F.count("*").alias("_c")).filter("_c >= 2").select(F.col("route_id").alias("zone_key"))
    parts = subs.withColumnRenamed("route_id", "zone_key").join(split, "zone_key", "left_semi").join(
        long.select("zone_key", "target_span"), "zone_key").select(
        F.concat_ws("/", "zone_key", F.col("lane").cast("string")).alias("zone_key"), "video_id", "z_start", "z_end", "title", "target_span")
    kept = zones.join(split, "zone_key", "left_anti").select("zone_key", "video_id", "z_start", "z_end", "title", "target_span")
    return kept.unionByName(parts)


def decide_zones(scenes: DataFrame, model_zones: DataFrame, targets: DataFrame) -> DataFrame:
    """Zones of each video: the model's where they are fine enough, else its technical
    zones with the moments between them, else chains of like scenes. A video without scenes has none.

    ``scenes`` carry interest, has_person, tokens and hist; ``model_zones``: video_id,
    z_start, z_end, title, technical; ``targets``: video_id, target_duration."""
    scenes, model_zones = keep(scenes, "scenes"), keep(model_zones, "zones")
    ends = scenes.groupBy("video_id").agg(
        F.min("start_s").alias("_first"), F.max_by("end_s", F.struct("start_s", "scene_id")).alias("_last"))
    ends = ends.withColumn("_span", F.col("_last") - F.col("_first"))
    model_zones = model_zones.join(ends.select("video_id"), "video_id", "left_semi")
    z = model_zones.join(ends, "video_id")
    length = _seconds("z_start", "z_end")
    tech = F.col("technical")
    facts = z.groupBy("video_id").agg(
        F.count(F.when(~tech, 1)).alias("_plain"),
        F.max(F.when(~tech, length > F.col("_span") * 0.45)).alias("_huge"),
        F.max(F.when(tech & (F.col("z_start") <= F.col("_first") + F.col("_span") * 0.3), F.col("z_end"))).alias("_from"),
        F.min(F.when(tech & (F.col("z_end") >= F.col("_last") - F.col("_span") * 0.3), F.col("z_start"))).alias("_to"))
    v = ends.join(facts, "video_id", "left")
    coarse = ((F.coalesce("_plain", F.lit(0)) < 4) | F.coalesce("_huge", F.lit(False))) & (F.col("_span") > 15)
    routes = v.filter(coarse).join(targets.select("video_id", "target_duration"), "video_id").select(
        F.col("video_id").alias("route_id"), "video_id", F.coalesce("_from", "_first").alias("r_lo"),
        F.coalesce("_to", "_last").alias("r_hi"), "target_duration", F.lit(None).cast("double").alias("lane_width"))
    auto = keep(lane_zones(scenes, routes).select(
        "video_id", "z_start", "z_end", "title", F.lit(False).alias("technical"), F.lit("moment").alias("origin")), "moments")
    split = auto.select("video_id").distinct()
    model = model_zones.select("video_id", "z_start", "z_end", "title", "technical", F.lit("model").alias("origin"))
    model = model.join(split.withColumn("_auto", F.lit(True)), "video_id", "left").filter(
        F.col("_auto").isNull() | F.col("technical")).drop("_auto")
    named = model_zones.select("video_id").union(split).distinct()
    chains = group_neighbours(join_hot(scenes, named, ["video_id"], "scene_id", how="left_anti")).select(
        "video_id", "z_start", "z_end", "title", F.lit(False).alias("technical"), F.lit("chain").alias("origin"))
    return model.unionByName(auto).unionByName(chains)


def with_style(df: DataFrame, style: str = "fpv_style") -> DataFrame:
    """Adds the numbers of the chosen style; unknown names fall back."""
    known = [s[0] for s in presets.STYLES]
    used = F.when(F.col(style).isin(known), F.col(style)).otherwise(presets.DEFAULT_STYLE)
    return df.withColumn("_style", used).join(
        F.broadcast(presets.styles(df.sparkSession).withColumnRenamed("style", "_style")), "_style").drop("_style")


def solve_timing(routes: DataFrame, zones: DataFrame) -> DataFrame:
    """Window length and speeds that fit a route into its target.

    ``routes``: route_id, route_len, target_duration, fpv_style, subject_len, frozen_len,
    frozen_out. ``zones``: route_id, zone_len. Every window of the style is a row; the
    longest one that fits wins. Where none does, the shortest window and the highest
    speeds are given, with the least seconds the film would need."""
    r = with_style(routes.select("route_id", "fpv_style")).select("route_id", "w_min", "w_max")
    steps = F.floor((F.col("w_max") - F.col("w_min") + 0.01) / 0.5 + 1e-9).cast("int")
    grid = r.withColumn("w", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: F.col("w_max") - i * 0.5)))
    shown = grid.join(zones.select("route_id", "zone_len"), "route_id", "left").groupBy("route_id", "w").agg(
        F.coalesce(F.sum(F.when(F.col("zone_len").isNotNull(), F.least("w", "zone_len"))), F.lit(0.0)).alias("_shown"))
    df = with_style(routes).join(shown, "route_id")
    df = df.withColumn("_gap", F.greatest(F.col("route_len") - F.col("_shown"), F.lit(0.0)))
    df = df.withColumn("_subj", F.least(F.greatest(F.col("subject_len") - F.col("_shown"), F.lit(0.0)), F.col("_gap")))
    df = df.withColumn("_still", F.least("frozen_len", F.col("_gap") - F.col("_subj")))
    df = df.withColumn("_empty", F.col("_gap") - F.col("_subj") - F.col("_still")).withColumn("_zone", F.col("_shown") / F.col("zone_speed"))
    df = df.withColumn("_rest", F.col("target_duration") - F.col("_zone") - F.col("frozen_out"))
    t_subj = F.col("_rest") - F.col("_empty") / F.col("gap_max")
    has = F.col("_subj") > 0
    df = df.withColumn("_s", F.when(has, F.greatest(F.try_divide(F.col("_subj"), t_subj), F.lit(1.0))).otherwise(1.0))
    ok = (F.col("_rest") > 0) & (~has | ((t_subj > 0) & (F.col("_s") <= SUBJECT_MAX)))
    df = df.withColumn("_ts", F.try_divide(F.col("_subj"), F.col("_s")))
    empty = F.when(F.col("_empty") > 0, F.try_divide(F.col("_empty"), F.greatest(F.col("_rest") - F.col("_ts"), F.lit(1e-9)))).otherwise(1.0)
    df = df.withColumn("_e", F.least(F.greatest(empty, F.lit(1.0)), F.col("gap_max")))
    total = F.col("_zone") + F.col("frozen_out") + F.col("_ts") + F.col("_empty") / F.col("_e")
    df = df.withColumn("_fits", F.coalesce(ok & (total <= F.col("target_duration") + 1.0), F.lit(False)))
    least = F.col("_zone") + F.col("frozen_out") + F.col("_empty") / F.col("gap_max") + F.col("_subj") / SUBJECT_MAX
    pick = F.struct(rnd("w", 2).alias("w"), rnd("_e", 2).alias("e"), rnd("_s", 2).alias("s"))
    best = df.groupBy("route_id", "zone_speed", "gap_max", "w_min").agg(
        F.max_by(F.when(F.col("_fits"), pick), F.when(F.col("_fits"), F.col("w"))).alias("_b"),
        F.max(F.when(F.abs(F.col("w") - F.col("w_min")) < 1e-6, least)).alias("_least"))
    fits = F.col("_b").isNotNull()
    return best.select(
        "route_id", F.when(fits, F.col("_b.w")).otherwise(F.col("w_min")).alias("window_s"), "zone_speed",
        F.when(fits, F.col("_b.e")).otherwise(F.col("gap_max")).alias("gap_speed"), fits.alias("fits"),
        F.when(fits, F.col("_b.s")).otherwise(SUBJECT_MAX).alias("subject_speed"),
        F.when(~fits, rnd("_least", 3)).alias("least_s"))


def route_inputs(zones: DataFrame, scenes: DataFrame, still: DataFrame, settings: DataFrame) -> dict[str, DataFrame]:
    """Everything the timing and the film of a route need.

    ``zones``: video_id, zone_no, z_start, z_end, title, technical, required. ``scenes`` carry
    interest and has_person. ``still``: frozen spans measured on the picture (f_start, f_end).
    ``settings``: video_id, target_duration, fpv_style, pause_out. Gives the tables routes,
    required, technical, subject and frozen."""
    return _inputs(zones, keep(_seen(scenes), "scenes"), still, settings)


def _seen(scenes: DataFrame) -> DataFrame:
    """What a route asks of a scene."""
    return scenes.select("video_id", "scene_id", "start_s", "end_s", "interest", "has_person", "motion", "description")


def _inputs(zones: DataFrame, scenes: DataFrame, still: DataFrame, settings: DataFrame) -> dict[str, DataFrame]:
    """``route_inputs`` over stored scenes."""
    zones = keep(zones, "zones")
    settings = with_style(settings.select("video_id", "target_duration", "fpv_style", "pause_out"))
    plain = zones.filter(~F.col("technical"))
    at = F.struct("z_start", "zone_no")
    routes = plain.groupBy("video_id").agg(
        F.min("z_start").alias("r_lo"), F.max_by("z_end", at).alias("r_hi"), F.max("required").alias("_marked"))
    tech = zones.filter("technical").select("video_id", F.col("z_start").alias("t_lo"), F.col("z_end").alias("t_hi"))

    wanted = plain.join(routes.select("video_id", "_marked"), "video_id").filter(F.col("required") | ~F.col("_marked"))
    wanted = wanted.join(settings.select("video_id", (F.col("w_max") * 3.0).alias("target_span")), "video_id")
    wanted = expand_zones(wanted.select(
        F.concat_ws("/", F.col("video_id").cast("string"), F.col("zone_no").cast("string")).alias("zone_key"),
        "video_id", "z_start", "z_end", "title", "target_span"), scenes)

    raw = frozen_scene_spans(scenes).unionByName(still.select("video_id", "f_start", "f_end"))
    frozen = keep(merge_spans(raw, ["video_id"], "f_start", "f_end", 0.5), "pauses")
    frozen = keep(_with_net(frozen, "f_start", "f_end", routes, tech).filter(F.col("net_len") >= FREEZE_MIN), "pauses")
    f_sum = frozen.groupBy("video_id").agg(F.sum("net_len").alias("frozen_len"), F.count("*").alias("_pauses"))
    frozen = frozen.select("video_id", "f_start", "f_end")

    subject = keep(subject_spans(scenes), "people")
    s_net = _with_net(subject, "s_start", "s_end", routes, tech)
    on_pause = overlap_len(s_net.select(F.struct("video_id", "s_start").alias("window_id"), "video_id",
                                        F.col("s_start").alias("a"), F.col("s_end").alias("b")),
                           frozen.select("video_id", F.col("f_start").alias("lo"), F.col("f_end").alias("hi")))
    s_sum = (s_net.withColumn("window_id", F.struct("video_id", "s_start")).join(on_pause, "window_id")
             .groupBy("video_id").agg(F.sum(F.greatest(F.col("net_len") - F.col("overlap"), F.lit(0.0))).alias("subject_len")))

    on_zone = overlap_len(wanted.select(F.col("zone_key").alias("window_id"), "video_id", F.col("z_start").alias("a"), F.col("z_end").alias("b")),
                          frozen.select("video_id", F.col("f_start").alias("lo"), F.col("f_end").alias("hi")))
    wanted = wanted.join(on_zone.withColumnRenamed("window_id", "zone_key"), "zone_key").withColumn(
        "_awake", F.col("overlap") < 0.7 * _seconds("z_start", "z_end"))
    some = wanted.groupBy("video_id").agg(F.max("_awake").alias("_some"))
    required = keep(wanted.join(some, "video_id").filter(F.col("_awake") | ~F.col("_some")).select(
        "zone_key", "video_id", "z_start", "z_end", "title"), "required")

    cut = routes.join(tech, "video_id").groupBy("video_id").agg(F.sum(overlap("r_lo", "r_hi", "t_lo", "t_hi")).alias("_tech"))
    pause = F.greatest(F.when(F.coalesce("pause_out", F.lit(0.0)) == 0, 0.5).otherwise(F.col("pause_out")), F.lit(0.1), F.col("fade") + 0.1)
    zero = F.lit(0.0)
    routes = (routes.join(settings, "video_id").join(cut, "video_id", "left").join(f_sum, "video_id", "left").join(s_sum, "video_id", "left")
              .withColumn("pause_s", pause).select(
                  "video_id", "r_lo", "r_hi", (F.col("r_hi") - F.col("r_lo") - F.coalesce("_tech", zero)).alias("route_len"),
                  "target_duration", "fpv_style", F.coalesce("subject_len", zero).alias("subject_len"),
                  F.coalesce("frozen_len", zero).alias("frozen_len"), "pause_s", "fade",
                  (F.col("pause_s") * F.coalesce("_pauses", F.lit(0))).alias("frozen_out")))
    return {"routes": keep(routes, "routes"), "required": required, "technical": tech, "subject": subject, "frozen": frozen}


def _with_net(spans: DataFrame, lo: str, hi: str, routes: DataFrame, tech: DataFrame) -> DataFrame:
    """Disjoint spans with their length inside the route, technical zones taken off."""
    s = spans.withColumn("span_id", F.struct("video_id", lo))
    net = net_length(s.select("span_id", "video_id", F.col(lo).alias("lo"), F.col(hi).alias("hi")), routes, tech)
    return s.join(net.select("span_id", "net_len"), "span_id").drop("span_id")


def timing_of(inputs: dict[str, DataFrame]) -> DataFrame:
    """The timing of prepared routes, by video_id."""
    routes = inputs["routes"].withColumnRenamed("video_id", "route_id")
    zones = inputs["required"].select(F.col("video_id").alias("route_id"), _seconds("z_start", "z_end").alias("zone_len"))
    return solve_timing(routes, zones).withColumnRenamed("route_id", "video_id")


def zone_windows(zones: DataFrame, samples: DataFrame, scenes: DataFrame, frozen: DataFrame,
                 step: float = 0.5, block_s: float = 30.0) -> DataFrame:
    """Where in each zone (zone_key, video_id, z_start, z_end, window_s) the window shown
    lies: smooth, interesting and not standing still; the earliest of equals.

    Starts slide in blocks of a zone (``slide``), so a long zone spreads over many tasks."""
    z = zones.withColumn("_w", F.least(F.col("window_s"), _seconds("z_start", "z_end")))
    tight = _seconds("z_start", "z_end") <= F.col("_w") + 0.2
    middle = F.least(F.greatest(F.col("z_start") + _seconds("z_start", "z_end") / 2 - F.col("_w") / 2, F.col("z_start")),
                     F.col("z_end") - F.col("_w"))
    fixed = z.filter(tight).select("zone_key", "video_id", rnd(middle, 3).alias("w_start"), rnd(middle + F.col("_w"), 3).alias("w_end"))

    per = int(block_s / step)
    count = F.ceil((F.col("z_end") - F.col("_w") + 0.01 - F.col("z_start")) / step).cast("int")
    blocks = z.filter(~tight).withColumn("_n", count).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / per).cast("int"))))
    first = F.col("_b") * per
    blocks = blocks.withColumn("starts", F.transform(
        F.sequence(first, F.least(first + per, F.col("_n")) - 1), lambda i: F.col("z_start") + i * F.lit(step)))
    rows = blocks.select("zone_key", F.col("video_id").alias("_v"), "video_id", F.col("_w").alias("length"), "_w", "_b", "starts",
                         (F.element_at("starts", -1) + F.col("_w")).alias("last_end")).withColumn("stop", F.col("last_end"))

    def judge(own, w):
        ok, rough = smoothness(w, np.zeros(len(w.row), bool))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(w.row, minlength=len(own)))), pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(x, from_pandas=True)) for x in (w.start, w.end, np.where(ok, rough, rough + 50)))
        return pa.table([*(own.column(c) for c in ("zone_key", "_v", "_w", "_b")), *lists], ["zone_key", "video_id", "_w", "_b", "a", "b", "_bad"])

    kinds = ", ".join(f"`{c}` {zones.schema[c].dataType.simpleString()}" for c in ("zone_key", "video_id"))
    lists = ", ".join(f"{c} array<double>" for c in ("a", "b", "_bad"))
    wins = slide(rows, motion_pairs(samples), ["zone_key", "_v", "_w", "_b"], judge, f"{kinds}, _w double, _b int, {lists}")
    # a row for all windows of a block, never one for each
    wins = keep(wins.select(F.struct("zone_key", "_b").alias("window_id"), *wins.columns), "windows")
    interest = weighted_overlap(wins, scenes, "interest").withColumnRenamed("mean", "_int")
    still = overlap_len(wins, frozen.select("video_id", F.col("f_start").alias("lo"), F.col("f_end").alias("hi")))
    judged = wins.join(interest, "window_id").join(still, "window_id").withColumn("_tries", F.arrays_zip("a", "b", "_bad", "_int", "overlap"))
    tries = F.transform("_tries", lambda t: F.struct(F.round(
        t["_bad"] - 8.0 * t["_int"] + 40.0 * t["overlap"] / F.col("_w") + 1e-9, 6).alias("score"), t["a"].alias("a"), t["b"].alias("b")))
    best = judged.groupBy("zone_key", "video_id").agg(F.min(F.array_min(tries)).alias("_m"))
    return fixed.unionByName(best.select("zone_key", "video_id", rnd("_m.a", 3).alias("w_start"), rnd("_m.b", 3).alias("w_end")))


def gaps_between(routes: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows with tiny gaps closed, and the gaps (gap_id, g_lo, g_hi, label) before,
    between and after them. ``windows``: zone_key, video_id, z_start, w_start, w_end."""
    df = previous_row(windows, ["video_id"], chunk_of("z_start", CHUNK_S), ["z_start", "zone_key"],
                      {"_cursor": F.col("w_end")})
    df = join_hot(df, routes.select("video_id", "r_lo", "r_hi"), ["video_id"], "z_start", FACT_SALTS)
    df = df.withColumn("_cursor", F.coalesce("_cursor", "r_lo"))
    apart = F.col("w_start") - F.col("_cursor") >= MIN_GAP
    gaps = df.filter(apart).select("video_id", F.col("_cursor").alias("g_lo"), F.col("w_start").alias("g_hi"), F.lit(LABEL_MOVE).alias("label"))
    last = windows.groupBy("video_id").agg(F.max_by("w_end", F.struct("z_start", "zone_key")).alias("_end"))
    tail = routes.join(last, "video_id").filter(F.col("r_hi") - F.col("_end") >= MIN_GAP).select(
        "video_id", F.col("_end").alias("g_lo"), F.col("r_hi").alias("g_hi"), F.lit(LABEL_END).alias("label"))
    shown = df.withColumn("w_start", F.when(apart, F.col("w_start")).otherwise(F.col("_cursor"))).select(*windows.columns)
    gaps = gaps.unionByName(tail).withColumn("gap_id", F.struct("video_id", "g_lo", "g_hi"))
    return shown, gaps


def gap_pieces(gaps: DataFrame, technical: DataFrame, frozen: DataFrame, subject: DataFrame) -> DataFrame:
    """Pieces of gaps to fast-forward through, each frozen, subject or empty. Technical
    zones are cut out; pieces under 0.4 s join the one before (the first joins the next)."""
    base = gaps.select("gap_id", "video_id", "g_lo", "g_hi", "label")
    open_ = subtract_spans(base, technical, ["video_id"], ("g_lo", "g_hi"), ("t_lo", "t_hi"), MIN_GAP)
    open_ = keep(open_.select("video_id", "label", F.struct("gap_id", "p_lo").alias("part"), F.col("p_lo").alias("a"),
                              F.col("p_hi").alias("b")), "open")
    by_pause = keep(split_by_spans(open_, frozen, ["video_id"], ("a", "b"), ("f_start", "f_end")), "by_pause")
    still = by_pause.filter("inside").select("video_id", "label", "part", "p_lo", "p_hi", F.lit("frozen").alias("kind"))
    moving = by_pause.filter("NOT inside").select("video_id", "label", "part", F.col("p_lo").alias("c"), F.col("p_hi").alias("d"))
    by_person = split_by_spans(moving, subject, ["video_id"], ("c", "d"), ("s_start", "s_end"))
    rest = by_person.select("video_id", "label", "part", "p_lo", "p_hi",
                            F.when(F.col("inside"), "subject").otherwise("empty").alias("kind"))
    return glue_pieces(keep(still.unionByName(rest), "pieces"))


def glue_pieces(pieces: DataFrame) -> DataFrame:
    """Joins short pieces (part, p_lo, p_hi, kind) of one part to a neighbour."""
    chunk = chunk_of("p_lo", CHUNK_S)
    firsts = pieces.groupBy("part").agg(F.min("p_lo").alias("_start"))
    df = pieces.join(firsts, "part").withColumn(
        "_big", F.when((F.col("p_hi") - F.col("p_lo") >= MIN_GAP) | (F.col("p_lo") == F.col("_start")), 1).otherwise(0))
    df = running(df, ["part"], chunk, ["p_lo"], {"_g": ("sum", F.col("_big"), True)})
    merged = keep(df.groupBy("video_id", "label", "part", "_g").agg(
        F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi"), F.min_by("kind", "p_lo").alias("kind")), "merged")
    head = merged.groupBy("part").agg(F.min(F.struct("_g", "p_lo", "p_hi")).alias("h"), F.count("*").alias("_n"))
    tiny = (F.col("_n") > 1) & (F.col("h.p_hi") - F.col("h.p_lo") < MIN_GAP)
    out = merged.join(head, "part").filter(~(tiny & (F.col("_g") == 1)))
    lo = F.when(tiny & (F.col("_g") == 2), F.col("h.p_lo")).otherwise(F.col("p_lo"))
    return out.select("video_id", "label", "part", lo.alias("p_lo"), "p_hi", "kind")


def route_segments(pieces: DataFrame, timing: DataFrame, routes: DataFrame, scenes: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Segments for pieces: speed and reason by kind, and the scene each starts in.
    ``timing``: video_id, gap_speed, subject_speed; ``routes``: video_id, pause_s. ``stops``: further segments, at the
    moment ``at``, whose scenes are looked up with theirs."""
    facts = timing.select("video_id", "gap_speed", "subject_speed").join(routes.select("video_id", "pause_s"), "video_id")
    df = join_hot(pieces, facts, ["video_id"], "p_lo", FACT_SALTS)
    length = F.col("p_hi") - F.col("p_lo")
    speed = (F.when(F.col("kind") == "frozen", F.greatest(length / F.col("pause_s"), F.col("gap_speed")))
             .when(F.col("kind") == "subject", F.col("subject_speed")).otherwise(F.col("gap_speed")))
    reason = (F.when(F.col("kind") == "frozen", F.format_string(REASON_FROZEN, half_even(rnd(length, 6)).cast("int"), _general("pause_s")))
              .when(F.col("kind") == "subject", F.format_string(REASON_SUBJECT, _general("subject_speed")))
              .otherwise(F.format_string(REASON_EMPTY, _general("gap_speed"))))
    df = df.select("video_id", F.col("p_lo").alias("at"), rnd("p_lo", 3).alias("src_start"), rnd("p_hi", 3).alias("src_end"), F.col("label").alias("slot"),
                   rnd(speed, 2).alias("speed"), reason.alias("reason"))
    return _with_scene(df if stops is None else df.unionByName(stops), scenes)


def _with_scene(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """The scene a segment starts in, by its start ``at`` before rounding."""
    df = keep(df, "segments").withColumn("point_id", F.struct("video_id", "at"))
    found = scene_at(df.select("point_id", "video_id", F.col("at").alias("t")).distinct(), scenes)
    return df.join(found, "point_id").drop("point_id", "at")


def build_route_plans(zones: DataFrame, scenes: DataFrame, samples: DataFrame, still: DataFrame,
                      settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The film of every route: its zones at their speed and what lies between, in source
    order. Returns segments (video_id, seg_no, ...) and plans (video_id, transition,
    transition_s, fits, least_s, total_s, warnings). See ``route_problems`` for videos that have none."""
    scenes = keep(_seen(scenes), "scenes")
    inputs = _inputs(zones, scenes, still, settings)
    routes, timing = inputs["routes"], keep(timing_of(inputs), "timing")
    wanted = inputs["required"].join(timing.select("video_id", "window_s", "zone_speed"), "video_id")
    windows = zone_windows(wanted, samples, scenes, inputs["frozen"])
    windows = keep(wanted.select("zone_key", "video_id", "z_start", "title", "zone_speed").join(
        windows.select("zone_key", "w_start", "w_end"), "zone_key"), "windows")
    shown, gaps = gaps_between(routes, windows)
    gaps = keep(gaps, "gaps")
    pieces = gap_pieces(gaps, inputs["technical"], inputs["frozen"], inputs["subject"])
    reason = F.concat(F.format_string(REASON_ZONE, "title"), F.when(
        F.col("zone_speed") != 1, F.concat(F.lit(" ×"), _general("zone_speed"))).otherwise(""))
    stops = shown.select(
        "video_id", F.col("w_start").alias("at"), rnd("w_start", 3).alias("src_start"), rnd("w_end", 3).alias("src_end"),
        F.substring("title", 1, 24).alias("slot"), F.col("zone_speed").alias("speed"), reason.alias("reason"))
    segments = number_rows(keep(route_segments(pieces, timing, routes, scenes, stops), "segments"), ["video_id"], chunk_of("src_start", CHUNK_S),
                           ["src_start", "src_end"], "seg_no")
    out = rnd((F.col("src_end") - F.col("src_start")) / F.greatest("speed", F.lit(0.01)), 3)
    total = segments.groupBy("video_id").agg(rnd(F.sum(out), 3).alias("total_s"))
    count = inputs["required"].groupBy("video_id").agg(F.count("*").alias("_zones"))
    plans = (routes.select("video_id", F.lit("crossfade").alias("transition"), F.col("fade").alias("transition_s"), "target_duration")
             .join(timing.select("video_id", "fits", "least_s"), "video_id").join(total, "video_id").join(count, "video_id"))
    whole = lambda c: half_even(c).cast("long")
    short = F.format_string(WARNING_SHORT, whole("target_duration"), "_zones", whole("least_s"), F.lit(f"{SUBJECT_MAX:g}"), whole("least_s"))
    plans = plans.withColumn("warnings", F.when(F.col("fits"), F.array().cast("array<string>")).otherwise(F.array(short))).drop("_zones", "target_duration")
    return segments, plans


def route_problems(videos: DataFrame, zones: DataFrame) -> DataFrame:
    """Videos (video_id) that can have no route film, and why: (video_id, problem)."""
    seen = zones.groupBy("video_id").agg(F.max((~F.col("technical")).cast("int")).alias("_plain"))
    marked = videos.select("video_id").join(seen, "video_id", "left")
    return marked.filter("_plain IS NULL OR _plain = 0").select(
        "video_id", F.when(F.col("_plain").isNull(), PROBLEM_NO_ZONES).otherwise(PROBLEM_TECHNICAL).alias("problem"))


def build_route_films(zones: DataFrame, scenes: DataFrame, samples: DataFrame, still: DataFrame, settings: DataFrame,
                      tracks_of: DataFrame, curve: DataFrame, tracks: DataFrame, beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route films as their users get them: the segments of ``build_route_plans``, and its plans with the part of a track
    that fits (music_offset, music_fade_in, music_fade_out; null for videos without a track).

    ``tracks_of``: video_id, track_id. Segments keep their speeds: a route film is not cut to the beat."""
    segments, plans = build_route_plans(zones, scenes, samples, still, settings)
    plans = keep(plans, "plans")
    cues = M.finish_cue(M.music_cue(route_cues(plans, tracks_of), curve, tracks), M.downbeats(beats), beats)
    cues = cues.select(F.col("plan_id").alias("video_id"), F.col("offset").alias("music_offset"), F.col("fade_in").alias("music_fade_in"),
                       F.col("fade_out").alias("music_fade_out"))
    return segments, plans.join(cues, "video_id", "left")


def route_cues(plans: DataFrame, tracks_of: DataFrame) -> DataFrame:
    """Cue requests for route films (see ``music_cue``); ``tracks_of``: video_id, track_id."""
    return plans.join(tracks_of, "video_id").select(
        F.col("video_id").alias("plan_id"), "track_id", F.lit("drone_cinematic").alias("preset_id"),
        F.col("total_s").alias("target_duration"))


def apply_zone_edits(zones: DataFrame, edits: DataFrame, least: float = 0.01) -> DataFrame:
    """Takes over edits (video_id, zone_no, and the new_ values). Title and flags always;
    borders only when they are in order and something changed."""
    e = edits.select("video_id", "zone_no", F.col("new_title"), F.col("new_required"), F.col("new_technical"),
                     F.col("new_start"), F.col("new_end"), F.lit(True).alias("_edit"))
    df = zones.join(e, ["video_id", "zone_no"], "left")
    hit = F.coalesce("_edit", F.lit(False))
    moved = (F.abs(F.col("new_start") - F.col("z_start")) > least) | (F.abs(F.col("new_end") - F.col("z_end")) > least)
    other = ((F.col("new_title") != F.col("title")) | (F.col("new_required") != F.col("required"))
             | (F.col("new_technical") != F.col("technical")))
    borders = hit & (moved | other) & (F.col("new_end") > F.col("new_start"))
    df = df.withColumn("_lo", F.when(borders, F.col("new_start")).otherwise(F.col("z_start")))
    df = df.withColumn("z_end", F.when(borders, F.col("new_end")).otherwise(F.col("z_end"))).withColumn("z_start", F.col("_lo"))
    for name in ("title", "required", "technical"):
        df = df.withColumn(name, F.when(hit, F.col(f"new_{name}")).otherwise(F.col(name)))
    return df.select(*zones.columns)
