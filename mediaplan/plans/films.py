"""The film of a project as its user gets it: a draft set to its music."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import music as M, presets
from ..sources.tables import keep
from .drafts import plan_durations, preset_transition, renumber, snap_to_track


def set_to_music(segments: DataFrame, projects: DataFrame, music: DataFrame, curve: DataFrame, tracks: DataFrame,
                 beats: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (project_id, seg_no, src_start, src_end, ...) with their ends moved to cut points of the music
    and numbered anew, and the cue of each.

    ``projects``: project_id, used_preset, sync_to_music; ``music``: project_id, track_id. A film is aligned where
    project and preset both ask for it and there is music; the others keep their ends and have no cue."""
    own = segments.withColumnRenamed("project_id", "plan_id")
    synced = presets.preset_heads(segments.sparkSession).filter("sync_to_music").select(F.col("preset_id").alias("used_preset"))
    wanted = projects.filter("sync_to_music").join(F.broadcast(synced), "used_preset").join(music, "project_id").select(
        F.col("project_id").alias("plan_id"), "track_id", F.col("used_preset").alias("preset_id"))
    lengths = plan_durations(own.withColumn("speed", F.lit(1.0))).withColumnRenamed("total_s", "target_duration")
    cues = keep(M.finish_cue(M.music_cue(wanted.join(lengths, "plan_id"), curve, tracks), M.downbeats(beats), beats), "cues")
    overlaps = preset_transition(projects).select(F.col("project_id").alias("plan_id"), F.col("transition_s").alias("overlap"))
    moved = keep(snap_to_track(own, cues, M.cut_moments(cuts, beats), overlaps), "aligned")
    return renumber(moved).withColumnRenamed("plan_id", "project_id"), cues.withColumnRenamed("plan_id", "project_id")
