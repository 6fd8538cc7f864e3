"""Catalogue queries: lists, lookups, summaries and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import half_even, rnd

POSITION = ["video_id", "start_s", "scene_id"]


def list_scenes(scenes: DataFrame, project_id=None, status: str | None = None) -> DataFrame:
    """Scenes in catalogue order, of one project and of one annotation state if given."""
    if project_id is not None:
        scenes = scenes.filter(F.col("project_id") == project_id)
    if status is not None:
        scenes = scenes.filter(F.col("llm_status") == status)
    return scenes.sort("project_id", *POSITION)


def browse_scenes(scenes: DataFrame, min_quality: float = 0.0, types: Sequence[str] = (),
                  order: str = "position") -> DataFrame:
    """Scenes of at least some quality and of some types (none given: all), by position,
    quality or aesthetics."""
    df = scenes.filter(F.col("quality_score") >= min_quality)
    if types:
        df = df.filter(F.col("scene_type").isin(list(types)))
    first = {"position": [], "quality": [F.col("quality_score").desc()],
             "aesthetic": [F.col("aesthetic_score").desc()]}[order]
    return df.sort("project_id", *first, *POSITION)


def latest_plan(plans: DataFrame) -> DataFrame:
    """The newest plan of every project."""
    return plans.groupBy("project_id").agg(
        F.max_by(F.struct(*[c for c in plans.columns if c != "project_id"]), F.struct("created_at", "plan_id")).alias("_p")
    ).select("project_id", "_p.*")


def mark_used(scenes: DataFrame, plans: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``used``: does the newest plan of the project show the scene."""
    now = latest_plan(plans.select("project_id", "plan_id", "created_at")).select("project_id", "plan_id")
    shown = segments.select("plan_id", "scene_id").join(now, "plan_id").select(
        "project_id", "scene_id").distinct().withColumn("_used", F.lit(True))
    return (scenes.join(shown, ["project_id", "scene_id"], "left")
            .withColumn("used", F.coalesce("_used", F.lit(False))).drop("_used"))


def project_summary(projects: DataFrame, scenes: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Projects, newest first, with their scene count and bytes. ``limit`` shows only the
    newest: the limit is taken before anything is joined."""
    newest = projects.select("project_id", "created_at").sort(F.col("created_at").desc(), F.col("project_id").desc())
    if limit is not None:
        newest = newest.limit(limit)
    counts = scenes.groupBy("project_id").agg(F.count("*").alias("_n"))
    sizes = files.groupBy("project_id").agg(F.sum("file_bytes").alias("_b"))
    zero = F.lit(0).cast("long")
    return (newest.join(counts, "project_id", "left").join(sizes, "project_id", "left")
            .select("project_id", "created_at", F.coalesce("_n", zero).alias("scenes"), F.coalesce("_b", zero).alias("bytes"))
            .sort(F.col("created_at").desc(), F.col("project_id").desc()))


def infer_step(projects: DataFrame, scenes: DataFrame, plans: DataFrame, sources: DataFrame) -> DataFrame:
    """How far a project has come: draft, scenes, settings or material."""
    def has(df, name):
        return df.select("project_id").distinct().withColumn(name, F.lit(True))
    df = projects.select("project_id")
    for part, name in ((plans, "_plan"), (scenes, "_scene"), (sources, "_source")):
        df = df.join(has(part, name), "project_id", "left")
    step = (F.when(F.col("_plan"), "draft").when(F.col("_scene"), "scenes")
            .when(F.col("_source"), "settings").otherwise("material"))
    return df.select("project_id", step.alias("step"))


def annotation_progress(scenes: DataFrame) -> DataFrame:
    """Scenes, described, waiting and the described share per project."""
    done = F.count(F.when(F.col("llm_status") == "done", 1))
    return scenes.groupBy("project_id").agg(
        F.count("*").alias("scenes"), done.alias("done"),
        F.count(F.when(F.col("llm_status").isin("pending", "failed"), 1)).alias("waiting"),
        rnd(done / F.count("*"), 4).alias("done_share"))


def zone_source(scenes: DataFrame, enough: float = 0.6) -> DataFrame:
    """Per video: are there enough descriptions to let a model name the zones."""
    told = (F.col("llm_status") == "done") & (F.coalesce("description", F.lit("")) != "")
    n = F.count(F.when(told, 1))
    return scenes.groupBy("video_id").agg(
        n.alias("described"), F.count("*").alias("scenes"),
        F.when(n < F.count("*") * enough, "fallback").otherwise("model").alias("source"))


def scene_types(scenes: DataFrame) -> DataFrame:
    """Types in use per project."""
    return scenes.filter("scene_type <> ''").select("project_id", "scene_type").distinct().sort("project_id", "scene_type")


def toggle_flags(scenes: DataFrame, clicks: DataFrame) -> DataFrame:
    """Applies clicks (scene_id, flag, click_no) in order: clicking the flag a scene has
    clears it, another one sets it. The end state follows from the closing run of equal
    clicks alone, so no scene's clicks are gathered."""
    last = clicks.groupBy("scene_id").agg(F.max_by("flag", "click_no").alias("_flag"))
    c = clicks.join(last, "scene_id")
    other = c.filter("flag <> _flag").groupBy("scene_id").agg(F.max("click_no").alias("_other"))
    run = c.join(other, "scene_id", "left").filter("_other IS NULL OR click_no > _other").groupBy("scene_id").agg(
        F.first("_flag").alias("_flag"), F.count("*").alias("_run"), F.first("_other").isNull().alias("_all"))
    df = scenes.join(run, "scene_id", "left")
    held = F.col("_all") & (F.col("user_flag") == F.col("_flag"))
    odd = (F.col("_run") + held.cast("int")) % 2 == 1
    return df.withColumn("user_flag", F.when(F.col("_flag").isNull(), F.col("user_flag"))
                         .when(odd, F.col("_flag")).otherwise("")).drop("_flag", "_run", "_all")


def list_zones(zones: DataFrame, videos: DataFrame) -> DataFrame:
    """Zones of one-take videos in time order, with marks: T technical, R required."""
    fpv = videos.filter("fpv_showroom").select("video_id")
    mark = F.when(F.col("technical"), "T").when(F.col("required"), "R").otherwise("")
    return zones.join(fpv, "video_id", "left_semi").withColumn("mark", mark).sort("video_id", "z_start", "zone_no")


def plan_listing(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Segments of plans with the type of their scene, in order; a scene that is gone
    shows as ``?``."""
    kinds = scenes.select("scene_id", F.col("scene_type").alias("_t"))
    return (segments.join(kinds, "scene_id", "left").withColumn("scene_type", F.coalesce("_t", F.lit("?"))).drop("_t")
            .sort("plan_id", "seg_no"))


def track_facts(tracks: DataFrame, beats: DataFrame, climaxes: DataFrame, ranges: DataFrame, show: int = 3) -> DataFrame:
    """Tempo, beats, climax and the first ranges of each kind, as text."""
    n = beats.groupBy("track_id").agg(F.count("*").alias("beats"))
    w = Window.partitionBy("track_id", "kind").orderBy("r_start")
    text = F.format_string("%d-%d", F.col("r_start").cast("long"), F.col("r_end").cast("long"))
    first = ranges.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= show)

    def joined(kind):
        own = F.when(F.col("kind") == kind, F.struct("r_start", text.alias("x")))
        return F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda s: s["x"]), " ").alias(kind)
    first = first.groupBy("track_id").agg(joined("calm"), joined("energetic"))
    empty = F.lit("")
    return (tracks.select("track_id", "bpm", "duration").join(n, "track_id", "left").join(climaxes, "track_id", "left")
            .join(first, "track_id", "left").select(
                "track_id", "bpm", "duration", F.coalesce("beats", F.lit(0).cast("long")).alias("beats"), "climax_t",
                F.coalesce("calm", empty).alias("calm"), F.coalesce("energetic", empty).alias("energetic")))


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a table whose key is wanted; the key is every column of ``keys``."""
    return table.join(keys.distinct(), keys.columns, "left_semi")


def default_project(projects: DataFrame) -> DataFrame:
    """The newest project."""
    return projects.agg(F.max_by("project_id", F.struct("created_at", "project_id")).alias("project_id"))
