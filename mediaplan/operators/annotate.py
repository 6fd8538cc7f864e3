"""Model replies: lenient parsing, filling of scenes, backlogs, batches, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clamp, col, or_default, rnd
from ..functions.sequences import number_rows
from ..functions.skew import join_hot

SCORE_BATCH = 25


def parse_reply(df: DataFrame, content: str = "content", out: str = "reply") -> DataFrame:
    """Adds a VARIANT parsed from a model's text: as it is, without a code fence, the
    outermost braces, or with a cut-off tail closed. Null where nothing parses."""
    text = F.regexp_replace(F.col(content), r"^\s+|\s+$", "")
    bare = F.regexp_replace(text, r"^`+|`+$", "")
    line = F.instr(bare, "\n")
    fenced = F.when(line > 0, F.expr("substring(_bare, instr(_bare, chr(10)) + 1)")).otherwise(F.col("_bare"))
    df = df.withColumn("_text", text).withColumn("_bare", bare)
    df = df.withColumn("_text", F.when(F.startswith("_text", F.lit("```")), fenced).otherwise(F.col("_text")))
    frag = F.when(F.instr("_text", "{") > 0, F.regexp_replace(
        F.regexp_replace(F.expr("substring(_text, instr(_text, '{'))"), r"\s+$", ""), r",+$", ""))
    df = df.withColumn("_frag", frag)
    quotes = F.length("_frag") - F.length(F.replace("_frag", F.lit('"'), F.lit("")))
    df = df.withColumn("_frag", F.when(quotes % 2 == 1, F.regexp_replace("_frag", r"(?s),[^,]*$", "")).otherwise(F.col("_frag")))
    tries = [F.col("_text"), F.regexp_extract("_text", r"(?s)\{.*\}", 0),
             *[F.concat("_frag", F.lit(s)) for s in ("}", "]}", '"]}', "}}")]]
    return df.withColumn(out, F.coalesce(*[F.try_parse_json(t) for t in tries])).drop("_text", "_bare", "_frag")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("reply", f"$.{path}", kind)


def apply_annotations(scenes: DataFrame, replies: DataFrame) -> DataFrame:
    """Fills scenes from parsed replies (scene_id, reply). An empty or missing object
    marks the scene failed; scenes without a reply row stay as they are."""
    df = scenes.join(replies.select("scene_id", "reply", F.lit(True).alias("_asked")), "scene_id", "left")
    shape = F.schema_of_variant("reply")
    ok = F.coalesce(F.startswith(shape, F.lit("OBJECT")) & (shape != "OBJECT<>"), F.lit(False))
    df = df.withColumn("_asked", F.coalesce("_asked", F.lit(False))).withColumn("_ok", F.col("_asked") & ok)
    raw = F.coalesce(_get("aesthetic_score", "double"), F.lit(0.0))
    raw = F.when(raw > 1, raw / 10.0).otherwise(raw)
    unusable = (~F.coalesce(_get("usable_for_edit", "boolean"), F.lit(True))
                | F.coalesce(F.is_variant_null(_get("usable_for_edit", "variant")), F.lit(False)))
    none = F.array().cast("array<string>")
    tags = F.coalesce(_get("tags", "array<string>"), none)
    empty = F.lit("")
    filled = {
        "description": F.coalesce(_get("scene_description", "string"), empty),
        "objects": F.coalesce(_get("objects", "array<string>"), none),
        "people_count": F.coalesce(_get("people_count", "int"), F.lit(0)),
        "emotions": F.coalesce(_get("emotions", "array<string>"), none),
        "composition": F.coalesce(_get("composition", "string"), empty),
        "lighting": F.coalesce(_get("lighting", "string"), empty),
        "aesthetic_score": clamp(raw, 0.0, 1.0),
        "scene_type": F.coalesce(_get("scene_type", "string"), empty),
        "recommended_slot": F.coalesce(_get("recommended_slot", "string"), empty),
        "tags": F.when(unusable, F.array_append(tags, "not-usable")).otherwise(tags),
        "subject_x": clamp(or_default(_get("subject_x", "double"), 0.5), 0.0, 1.0),
        "subject_y": clamp(or_default(_get("subject_y", "double"), 0.5), 0.0, 1.0),
        "scenario_match_key": empty,
    }
    kinds = dict(scenes.dtypes)
    for name, value in filled.items():
        old = F.col(name) if name in kinds else F.lit(None)
        df = df.withColumn(f"_n_{name}", F.when(F.col("_ok"), value).otherwise(old))
    for name in filled:
        df = df.withColumn(name, F.col(f"_n_{name}")).drop(f"_n_{name}")
    status = F.when(F.col("_ok"), "done").when(F.col("_asked"), "failed").otherwise(F.col("llm_status"))
    return df.withColumn("llm_status", status).drop("reply", "_asked", "_ok")


def annotation_backlog(scenes: DataFrame) -> DataFrame:
    """Scenes waiting for a description: new ones first, then the failed ones, each in
    catalogue order. ``queue`` is 0 or 1."""
    queue = F.when(F.col("llm_status") == "pending", 0).when(F.col("llm_status") == "failed", 1)
    return scenes.withColumn("queue", queue).filter("queue IS NOT NULL").sort(
        "queue", "video_id", "start_s", "scene_id")


def fail_without_frame(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Waiting scenes for which no frame (scene_id) could be had become failed."""
    known = frames.select("scene_id").distinct().withColumn("_frame", F.lit(True))
    df = scenes.join(known, "scene_id", "left")
    lost = F.col("llm_status").isin("pending", "failed") & F.col("_frame").isNull()
    return df.withColumn("llm_status", F.when(lost, "failed").otherwise(F.col("llm_status"))).drop("_frame")


def scene_cards(scenes: DataFrame) -> DataFrame:
    """The ten fields a scorer sees of a scene, as JSON."""
    card = F.to_json(F.struct(
        F.col("scene_id").alias("id"), rnd(F.col("end_s") - F.col("start_s"), 3).alias("duration"),
        "description", "tags", "scene_type", rnd("quality_score", 2).alias("quality"),
        rnd("aesthetic_score", 2).alias("aesthetic"), "motion", "motion_type", "people_count"))
    return scenes.select("scene_id", card.alias("card"))


def scenario_key(text) -> Column:
    return F.substring(F.md5(col(text)), 1, 12)


def rank_backlog(scenes: DataFrame, projects: DataFrame) -> DataFrame:
    """Described scenes not yet scored for the scenario of their project."""
    keys = projects.select("project_id", scenario_key("scenario").alias("scenario_key"))
    return (join_hot(scenes.filter("llm_status = 'done'"), keys, ["project_id"], "scene_id")
            .filter(F.coalesce("scenario_match_key", F.lit("")) != F.col("scenario_key")))


def batch_rows(df: DataFrame, key: Sequence[str], chunk: Column, order: Sequence,
               size: int = SCORE_BATCH) -> DataFrame:
    """Adds ``batch_no``: rows of a key in order, ``size`` at a time."""
    out = number_rows(df, key, chunk, order, "_n")
    return out.withColumn("batch_no", F.floor(F.col("_n") / size).cast("long")).drop("_n")


def apply_match(scenes: DataFrame, scores: DataFrame) -> DataFrame:
    """Takes over scores (scene_id, match, seq, scenario_key): the last one of a scene,
    held to 0..1, with the key it was made for."""
    last = scores.groupBy("scene_id").agg(F.max_by(F.struct("match", "scenario_key"), "seq").alias("_s"))
    df = scenes.join(last, "scene_id", "left")
    has = F.col("_s").isNotNull()
    return (df.withColumn("scenario_match_score", F.when(has, clamp("_s.match", 0.0, 1.0)).otherwise(F.col("scenario_match_score")))
            .withColumn("scenario_match_key", F.when(has, F.col("_s.scenario_key")).otherwise(F.col("scenario_match_key")))
            .drop("_s"))


def score_with(cards: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], batch: int = SCORE_BATCH) -> DataFrame:
    """Runs a user's scorer over cards, at most ``batch`` at a time. ``fn`` gets a frame
    with scene_id and card and gives one number per row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i:i + batch]
                yield pd.DataFrame({"scene_id": part["scene_id"], "match": fn(part).astype("float64")})

    kind = dict(cards.dtypes)["scene_id"]
    return cards.select("scene_id", "card").mapInPandas(run, f"scene_id {kind}, match double")


_REPAIR = """
aggregate(ranges, named_struct('prev', -1L, 'kept', filter(ranges, r -> false)), (acc, r) ->
  transform(array(named_struct('no', r.no, 'a', greatest(r.a, acc.prev + 1), 'b', least(r.b, scene_count - 1))), c ->
    if(c.a > c.b, acc, named_struct('prev', c.b, 'kept', concat(acc.kept, array(c)))))[0]).kept"""


def repair_ranges(replies: DataFrame) -> DataFrame:
    """Makes index ranges of one reply ascend without overlap and stay inside the video.

    ``replies``: video_id, scene_count and ``ranges``, an array of (no, a, b) of one model
    reply. Output: one row per range that is left."""
    return (replies.select("video_id", F.explode(F.expr(_REPAIR)).alias("_r"))
            .select("video_id", "_r.no", F.col("_r.a").alias("first_index"), F.col("_r.b").alias("last_index")))
