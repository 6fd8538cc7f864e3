"""Frame geometry and the timeline of finished segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import half_even, rnd
from ..functions.sequences import running

SEGMENT_CHUNK = 1024
CACHE_BYTES = 3 * 1024 ** 3


def crop_window(df: DataFrame) -> DataFrame:
    """Adds crop_w, crop_h, crop_x, crop_y for src_w, src_h, target_w, target_h and a focus
    (focus_x, focus_y; null is the centre). Sizes become even after the place is set."""
    ar_t, ar_s = F.col("target_w") / F.col("target_h"), F.col("src_w") / F.col("src_h")
    wide = ar_s > ar_t
    cw = F.when(wide, F.least(half_even(F.col("src_h") * ar_t).cast("long"), F.col("src_w"))).otherwise(F.col("src_w"))
    ch = F.when(wide, F.col("src_h")).otherwise(F.least(half_even(F.col("src_w") / ar_t).cast("long"), F.col("src_h")))
    df = df.withColumn("_cw", cw.cast("long")).withColumn("_ch", ch.cast("long"))

    def place(focus, size, part):
        at = half_even(F.coalesce(focus, F.lit(0.5)) * F.col(size) - F.col(part) / 2).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(at, F.col(size) - F.col(part)))
    both = F.col("focus_x").isNotNull() & F.col("focus_y").isNotNull()
    df = (df.withColumn("crop_x", place(F.when(both, F.col("focus_x")), "src_w", "_cw"))
          .withColumn("crop_y", place(F.when(both, F.col("focus_y")), "src_h", "_ch")))
    return (df.withColumn("crop_w", F.col("_cw") - F.col("_cw") % 2)
            .withColumn("crop_h", F.col("_ch") - F.col("_ch") % 2).drop("_cw", "_ch"))


def crop_rect_norm(df: DataFrame) -> DataFrame:
    """Adds the crop window as parts of the frame: x0, y0, x1, y1."""
    df = crop_window(df)
    return (df.withColumn("x0", rnd(F.col("crop_x") / F.col("src_w"), 4))
            .withColumn("y0", rnd(F.col("crop_y") / F.col("src_h"), 4))
            .withColumn("x1", rnd((F.col("crop_x") + F.col("crop_w")) / F.col("src_w"), 4))
            .withColumn("y1", rnd((F.col("crop_y") + F.col("crop_h")) / F.col("src_h"), 4)))


def focus_point(boxes: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Centre of attention per segment, weighted by area. Any face outranks all bodies.

    ``boxes``: segment_id, kind (face/body), x, y, w, h, frame_w, frame_h, confidence."""
    area = F.col("w") * F.col("h")
    face = F.col("kind") == "face"
    weight = F.when(face, area).otherwise(area * F.col("confidence"))
    cx, cy = (F.col("x") + F.col("w") / 2) / F.col("frame_w"), (F.col("y") + F.col("h") / 2) / F.col("frame_h")
    df = boxes.filter(face | (F.col("confidence") >= min_confidence)).select(
        "segment_id", face.alias("_face"), weight.alias("_w"), (cx * weight).alias("_x"), (cy * weight).alias("_y"))

    def mean(part, of):
        return F.try_divide(F.sum(F.when(of, F.col(part))), F.sum(F.when(of, F.col("_w"))))
    sums = df.groupBy("segment_id").agg(
        mean("_x", F.col("_face")).alias("_fx"), mean("_y", F.col("_face")).alias("_fy"),
        mean("_x", ~F.col("_face")).alias("_bx"), mean("_y", ~F.col("_face")).alias("_by"))
    return sums.select("segment_id", rnd(F.coalesce("_fx", "_bx"), 4).alias("focus_x"),
                       rnd(F.coalesce("_fy", "_by"), 4).alias("focus_y"))


def segment_focus(segments: DataFrame, focus: DataFrame) -> DataFrame:
    """Adds focus_x/focus_y to segments (segment_id, crop, subject_x, subject_y): what was
    detected, else where the annotation saw the subject, else nothing."""
    f = focus.select("segment_id", F.col("focus_x").alias("_fx"), F.col("focus_y").alias("_fy"))
    df = segments.join(f, "segment_id", "left")
    seen = F.col("_fx").isNotNull()
    told = (F.col("subject_x") != 0.5) | (F.col("subject_y") != 0.5)
    smart = F.col("crop") != "center"
    return (df.withColumn("focus_x", F.when(smart & seen, F.col("_fx")).when(smart & told, F.col("subject_x")))
            .withColumn("focus_y", F.when(smart & seen, F.col("_fy")).when(smart & told, F.col("subject_y")))
            .drop("_fx", "_fy"))


def display_dims(videos: DataFrame) -> DataFrame:
    """Adds src_w/src_h: the frame as it is shown, turned where the orientation says so."""
    w, h = F.col("width"), F.col("height")
    turn = (((F.col("orientation") == "vertical") & (w > h)) | ((F.col("orientation") == "horizontal") & (h > w)))
    return (videos.withColumn("src_w", F.when(turn, h).otherwise(w).cast("long"))
            .withColumn("src_h", F.when(turn, w).otherwise(h).cast("long")))


def plan_fps(segments: DataFrame, scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """25 for plans whose known sources all run close to a multiple of 25, else 30."""
    rest = F.col("fps") % 25
    even = (F.abs(rest) < 0.6) | (F.abs(rest - 25) < 0.6)
    known = videos.filter(F.coalesce("fps", F.lit(0.0)) != 0).select("video_id", even.alias("_even"))
    of_scene = scenes.select("scene_id", "video_id").join(known, "video_id").select("scene_id", "_even")
    # segments are read once: those without a known source say nothing
    hit = segments.select("plan_id", "scene_id").join(of_scene, "scene_id", "left").groupBy("plan_id").agg(F.every("_even").alias("_all"))
    return hit.select("plan_id", F.when(F.col("plan_id").isNotNull() & F.col("_all"), 25).otherwise(30).alias("fps"))


def out_duration():
    return rnd((F.col("src_end") - F.col("src_start")) / F.greatest("speed", F.lit(0.01)), 3)


def crossfade_timeline(segments: DataFrame, plans: DataFrame) -> DataFrame:
    """Start of every segment in the film. ``plans``: plan_id, transition, transition_s.
    Fades shrink to fit the shortest part; a film of one part or of cuts has none."""
    parts = segments.withColumn("out_s", out_duration())
    sums = parts.groupBy("plan_id").agg(F.count("*").alias("parts"), F.min("out_s").alias("_min"), F.sum("out_s").alias("_sum"))
    faded = (F.col("transition") == "crossfade") & (F.col("transition_s") > 0) & (F.col("parts") > 1)
    sums = sums.join(plans.select("plan_id", "transition", "transition_s"), "plan_id").withColumn(
        "fade_s", F.when(faded, F.least("transition_s", F.col("_min") * 0.45)).otherwise(0.0))
    sums = sums.withColumn("total_s", F.col("_sum") - (F.col("parts") - 1) * F.col("fade_s"))
    placed = running(parts.select("plan_id", "seg_no", "out_s"), ["plan_id"], F.floor(F.col("seg_no") / SEGMENT_CHUNK),
                     ["seg_no"], {"_before": ("sum", F.col("out_s"), False)})
    return placed.join(sums.select("plan_id", "fade_s", "total_s"), "plan_id").select(
        "plan_id", "seg_no", "out_s", rnd("fade_s", 6).alias("fade_s"),
        rnd(F.col("_before") - F.col("seg_no") * F.col("fade_s"), 3).alias("offset_s"), rnd("total_s", 3).alias("total_s"))


def render_key(segments: DataFrame) -> DataFrame:
    """Adds ``render_key``, equal for segments that would be encoded to the same file."""
    def t(c):
        return F.format_string("%.3f", rnd(c, 3))
    speed = F.when(F.col("speed") != 1.0, F.concat(F.lit(":x"), F.regexp_replace(
        F.format_string("%.2f", "speed"), r"\.?0+$", ""))).otherwise("")
    recipe = F.concat(
        F.col("scene_id").cast("string"), F.lit(":"), t("src_start"), F.lit(":"), t("src_end"),
        F.format_string(":%dx%d@%d:", F.col("out_w").cast("long"), F.col("out_h").cast("long"), F.col("fps").cast("long")),
        F.when(F.col("final"), "f").otherwise("p"),
        F.format_string(":%dx%d+%d+%d", "crop_w", "crop_h", "crop_x", "crop_y"),
        F.when(F.col("stabilise"), ":stab").otherwise(""), speed, F.lit(":"), F.col("codec"))
    return segments.withColumn("render_key", F.substring(F.md5(recipe), 1, 16))


def render_backlog(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Recipes still to be encoded, each once."""
    return (render_key(segments).join(cache.select("render_key").distinct(), "render_key", "left_anti")
            .groupBy("render_key").agg(F.count("*").alias("segments")))


def retain_newest(files: DataFrame, limit: int = CACHE_BYTES, chunk: float = 86400.0) -> DataFrame:
    """Files kept when the oldest go until the rest of a project fits the limit.
    ``files``: project_id, name, size_bytes, mtime."""
    order = [F.col("mtime").desc(), F.col("name").desc()]
    df = running(files, ["project_id"], F.floor(-F.col("mtime") / chunk), order,
                 {"kept_bytes": ("sum", F.col("size_bytes"), True)})
    return df.filter(F.col("kept_bytes") <= limit)


def audio_fades(plans: DataFrame) -> DataFrame:
    """Adds fade_in_s, fade_out_s and fade_out_at for plans (total_s, fade_in, fade_out)."""
    out = F.greatest("fade_out", F.lit(0.01))
    return (plans.withColumn("fade_in_s", F.greatest("fade_in", F.lit(0.01))).withColumn("fade_out_s", out)
            .withColumn("fade_out_at", F.greatest(rnd(F.col("total_s") - out, 3), F.lit(0.0))))


def timeline(segments: DataFrame) -> DataFrame:
    """Place and width (percent, at least 3) of every segment on the time line."""
    parts = segments.withColumn("out_s", out_duration()).select("plan_id", "seg_no", "out_s")
    total = parts.groupBy("plan_id").agg(F.greatest(rnd(F.sum("out_s"), 3), F.lit(0.1)).alias("_t"))
    df = running(parts, ["plan_id"], F.floor(F.col("seg_no") / SEGMENT_CHUNK), ["seg_no"],
                 {"_before": ("sum", F.col("out_s"), False)}).join(total, "plan_id")
    return df.select("plan_id", "seg_no", rnd("_before", 3).alias("out_start"), "out_s",
                     rnd(F.greatest(F.col("out_s") / F.col("_t") * 100, F.lit(3.0)), 1).alias("width_pct"))
