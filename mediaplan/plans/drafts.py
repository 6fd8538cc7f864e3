"""Draft plans: beat alignment, lengths, replacement of segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import rnd
from ..functions.sequences import number_rows
from ..functions.skew import by_merge, join_hot
from ..functions.windows import rounded
from ..operators import presets
from ..operators.timeline import SEGMENT_CHUNK, out_duration
from ..sources.tables import keep

# --- fixed value: reason of a segment a user has exchanged
REASON_REPLACED = "заменено пользователем"

#: Seconds of a track whose cut points travel together.
CUT_BLOCK = 64.0
#: Requests of one group that meet a head in one task.
ASKED_ROWS = 4096
#: Parts of a group whose heads are taken on their own first.
HEAD_PARTS = 8


def _folded(segments: DataFrame) -> DataFrame:
    """(plan_id, segs, _reach, _n), stored: the segments of each plan in order, and how far its film reaches at most."""
    flag = F.coalesce("beat_synced", F.lit(False)) if "beat_synced" in segments.columns else F.lit(False)
    start, end = (F.col(c).cast("double") for c in ("src_start", "src_end"))
    own = [c for c in segments.columns if c not in ("plan_id", "src_end", "beat_synced")]
    seg = F.struct("seg_no", start.alias("_start"), end.alias("_end"), flag.alias("_synced"), F.struct(*own).alias("_own"))
    return keep(segments.filter("plan_id IS NOT NULL").groupBy("plan_id").agg(
        F.sort_array(F.collect_list(seg)).alias("segs"), F.sum(F.greatest(end - start, F.lit(0.0))).alias("_reach"), F.count("*").alias("_n")), "plans")


def _snapped(segments: DataFrame, plans: DataFrame, overlaps: DataFrame, reach: float, shortest: float) -> DataFrame:
    """Segments with their ends moved to the nearest cut (``cuts`` of each plan, sorted, in film time), one after the other.
    All plans of a batch take their first segments together, then their second ones, and so on."""
    df = plans.join(overlaps.select("plan_id", "overlap"), "plan_id", "left").select(
        "plan_id", "segs", "cuts", F.coalesce(F.col("overlap").cast("double"), F.lit(0.0)).alias("overlap"))
    own = [c for c in segments.columns if c not in ("plan_id", "src_end", "beat_synced")]
    names = ["plan_id", "seg_no", *(c for c in own if c != "seg_no")]
    kinds = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in names)

    def fold(batches):
        for batch in batches:
            segs = batch.column("segs")
            flat, many = segs.flatten(), pa.compute.list_value_length(segs).to_numpy()
            first = np.cumsum(many) - many
            begin, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_start", "_end"))
            end, synced = end.copy(), flat.field("_synced").to_numpy(zero_copy_only=False).astype(bool)
            lists = batch.column("cuts")
            some = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
            low, cuts = np.cumsum(some) - some, np.append(lists.flatten().to_numpy(), 0.0)
            overlap, at = batch.column("overlap").to_numpy(), np.zeros(len(many))
            order = np.argsort(-many, kind="stable")
            for k in range(int(many.max(initial=0))):
                p = order[:np.searchsorted(-many[order], -k, "left")]  # plans with such a segment
                i, inner = first[p] + k, k < many[p] - 1
                length = _r3(end[i] - begin[i])
                want = at[p] + length - np.where(inner, overlap[p] / 2, 0.0)
                place = _first_not_before(cuts, low[p], low[p] + some[p], want)
                left = np.where(place > low[p], cuts[place - 1], -np.inf)
                right = np.where(place < low[p] + some[p], cuts[place], np.inf)
                delta = np.where(np.abs(left - want) <= np.abs(right - want), left, right) - want
                hit = (np.abs(delta) <= reach) & (length + delta >= shortest)
                end[i[hit]] = _r3(end[i[hit]] + delta[hit])
                synced[i[hit]] = True
                at[p] = at[p] + _r3(end[i] - begin[i]) - np.where(inner, overlap[p], 0.0)
            held = dict(zip(own, flat.field("_own").flatten()))
            plan = batch.column("plan_id").take(pa.array(np.repeat(np.arange(len(many)), many)))
            yield pa.RecordBatch.from_arrays([plan, *(held[c] for c in names[1:]), pa.array(end, from_pandas=True), pa.array(synced)],
                                             [*names, "src_end", "beat_synced"])

    return df.mapInArrow(fold, f"{kinds}, src_end double, beat_synced boolean").filter("seg_no IS NOT NULL")


def _first_not_before(values: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The first place from ``low`` to ``high`` whose value is not below ``want``, for many sorted stretches of ``values``."""
    low, high = low.copy(), high.copy()
    while (todo := low < high).any():
        middle = (low + high) // 2
        before = todo & (values[middle] < want)
        low, high = np.where(before, middle + 1, low), np.where(todo & ~before, middle, high)
    return low


def _r3(x: np.ndarray) -> np.ndarray:
    return rounded(x, 3)


def snap_to_cuts(segments: DataFrame, cuts: DataFrame, overlaps: DataFrame, reach: float = 0.35,
                 shortest: float = 1.0) -> DataFrame:
    """Moves segment ends to cut points nearby, one after the other along each plan.

    ``cuts``: plan_id, cut_t in film time, for plans that have cut points of their own; see ``snap_to_track`` for those of
    a track. ``overlaps``: plan_id, overlap. Where a segment starts depends on every move before it, so a plan is
    folded as one row; it holds the segments of one film and the cuts of its length, nothing larger."""
    plans = _folded(segments)
    near = (cuts.join(plans.select("plan_id", "_reach", "_n"), "plan_id").filter(F.col("cut_t") <= F.col("_reach") + (F.col("_n") + 1) * reach)
            .groupBy("plan_id").agg(F.array_sort(F.collect_set(F.col("cut_t").cast("double"))).alias("cuts")))
    return _snapped(segments, plans.join(near, "plan_id", "left"), overlaps, reach, shortest)


def snap_to_track(segments: DataFrame, cues: DataFrame, cuts: DataFrame, overlaps: DataFrame, reach: float = 0.35,
                  shortest: float = 1.0) -> DataFrame:
    """``snap_to_cuts`` for films set to a track: ``cues`` are plan_id, track_id, offset; ``cuts`` track_id, cut_t.

    A track's cut points are sorted once in blocks of ``CUT_BLOCK`` seconds. A plan meets the few blocks that its film
    plays, never single cuts, and finds the nearest by binary search."""
    plans = _folded(segments)
    blocks = cuts.groupBy("track_id", F.floor(F.col("cut_t") / CUT_BLOCK).cast("long").alias("_block")).agg(
        F.array_sort(F.collect_set(F.col("cut_t").cast("double"))).alias("_cuts"))
    played = cues.select("plan_id", "track_id", F.col("offset").cast("double").alias("offset")).join(plans.select("plan_id", "_reach", "_n"), "plan_id")
    # no end gets farther than this, and no cut beyond is near enough
    played = played.withColumn("_end", F.col("offset") + F.col("_reach") + (F.col("_n") + 1) * (reach + 0.001))
    played = played.withColumn("_block", F.explode(F.sequence(F.floor(F.col("offset") / CUT_BLOCK).cast("long"), F.floor(F.col("_end") / CUT_BLOCK).cast("long"))))
    met = join_hot(played.select("plan_id", "track_id", "offset", "_end", "_block"), blocks, ["track_id", "_block"], "plan_id", salts=8)
    met = met.select("plan_id", "offset", "_block", F.filter("_cuts", lambda c: (c >= F.col("offset")) & (c <= F.col("_end"))).alias("_cuts"))
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_cuts"))), lambda b: b["_cuts"]))
    near = met.repartition("plan_id").groupBy("plan_id", "offset").agg(lists.alias("_all"))
    film = F.transform("_all", lambda c: rnd(c - F.col("offset"), 3))
    return _snapped(segments, plans.join(near.select("plan_id", film.alias("cuts")), "plan_id", "left"), overlaps, reach, shortest)


def renumber(segments: DataFrame) -> DataFrame:
    """Dense segment numbers from zero, in the present order."""
    df = number_rows(segments, ["plan_id"], F.floor(F.col("seg_no") / SEGMENT_CHUNK), ["seg_no"], "_n")
    return df.withColumn("seg_no", F.col("_n")).drop("_n")


def segment_durations(segments: DataFrame) -> DataFrame:
    """Adds source_s (in the source) and out_s (in the film)."""
    return segments.withColumn("source_s", rnd(F.col("src_end") - F.col("src_start"), 3)).withColumn("out_s", out_duration())


def plan_durations(segments: DataFrame) -> DataFrame:
    """Length of every plan in the film: the sum of its parts at their speed."""
    return segments.groupBy("plan_id").agg(rnd(F.sum(out_duration()), 3).alias("total_s"))


def replace_segments(segments: DataFrame, requests: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puts other scenes into segments. ``requests``: plan_id, seg_no, new_scene_id,
    replaced_at. Returns the segments of all plans and the history rows. A request for an
    unknown segment or scene does nothing. Plans touched go back to draft (see the history)
    and may be aligned again with ``snap_to_cuts``."""
    new = requests.join(scenes.select(F.col("scene_id").alias("new_scene_id"), F.col("start_s").alias("_s"),
                                      F.col("end_s").alias("_e")), "new_scene_id")
    df = segments.join(new, ["plan_id", "seg_no"], "left")
    hit = F.col("new_scene_id").isNotNull()
    scene_s = rnd(F.col("_e") - F.col("_s"), 3)
    length = F.least(rnd(F.col("src_end") - F.col("src_start"), 3), scene_s)
    df = df.withColumn("_len", length).withColumn(
        "_from", rnd(F.col("_s") + F.greatest((scene_s - F.col("_len")) / 2, F.lit(0.0)), 3))
    history = df.filter(hit).select("plan_id", "seg_no", F.col("scene_id").alias("old_scene_id"), "new_scene_id", "replaced_at")
    df = (df.withColumn("scene_id", F.when(hit, F.col("new_scene_id")).otherwise(F.col("scene_id")))
          .withColumn("src_start", F.when(hit, F.col("_from")).otherwise(F.col("src_start")))
          .withColumn("src_end", F.when(hit, rnd(F.col("_from") + F.col("_len"), 3)).otherwise(F.col("src_end")))
          .withColumn("reason", F.when(hit, REASON_REPLACED).otherwise(F.col("reason")))
          .withColumn("beat_synced", F.col("beat_synced") & ~hit))
    return df.select(*segments.columns), history


def replacement_candidates(requests: DataFrame, segments: DataFrame, alternatives: DataFrame, plans: DataFrame,
                           scenes: DataFrame, k: int = 4) -> DataFrame:
    """Up to ``k`` scenes to put in place of a segment (plan_id, seg_no): the stored
    alternatives of its slot, then scenes of the project wanted for the slot or of the same
    type; nothing banned or already shown. Alternatives that no longer exist take a place
    and are then left out.

    A plan excludes only its own segments and alternatives, so the first k + that many scenes of a project and slot (and
    of a project and type) are enough for it. Of every group that is asked for, the deepest such head is kept: first in
    parts of the group, then of what those leave. A plan is one row with all its requests; it meets the heads they ask for
    once, as one row. Heads and what a film shows are tens of scenes. A project of more than ``ASKED_ROWS`` requests is dealt to
    several such rows, each with the heads that its own plans ask for."""
    types = scenes.select("scene_id", F.col("scene_type").alias("_type"))
    own = segments.select("plan_id", "seg_no", "slot", "scene_id").join(types, "scene_id", "left")
    films = own.filter("plan_id IS NOT NULL").groupBy("plan_id").agg(
        F.collect_set("scene_id").alias("_shown"), F.collect_list(F.struct("seg_no", "slot", "_type")).alias("_segs"))
    wanted = requests.groupBy("plan_id").agg(F.collect_list("seg_no").alias("_wanted"))
    known = alternatives.join(scenes.select("scene_id").distinct().withColumn("_known", F.lit(True)), "scene_id", "left")
    choice = F.struct("scene_id", F.coalesce("_known", F.lit(False)).alias("known"))
    listed = known.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("slot", "pos", choice.alias("c")))).alias("_listed"))
    kind = f"array<struct<scene_id: {dict(scenes.dtypes)['scene_id']}, known: boolean>>"
    asked = films.join(wanted, "plan_id").join(plans.select("plan_id", "project_id"), "plan_id").join(listed, "plan_id", "left")
    mine = F.flatten(F.transform("_wanted", lambda n: F.filter("_segs", lambda g: g["seg_no"] == n)))

    def request(g):
        alts = F.coalesce(F.transform(F.filter("_listed", lambda x: x["slot"] == g["slot"]), lambda x: x["c"]).cast(kind), F.array().cast(kind))
        first = F.slice(F.filter(alts, lambda x: ~F.array_contains("_shown", x["scene_id"])), 1, k)
        spare = F.array_except(F.transform(alts, lambda x: x["scene_id"]), "_shown")
        return F.struct(g["seg_no"].alias("seg_no"), g["slot"].alias("slot"), g["_type"].alias("_type"), first.alias("_first"), spare.alias("_spare"))

    asked = asked.select("plan_id", "project_id", "_shown", F.transform(mine, request).alias("_asked")).filter(F.size("_asked") > 0)
    asked = keep(asked, "asked")
    parts = asked.groupBy("project_id").agg(F.ceil(F.sum(F.size("_asked")) / ASKED_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.broadcast(keep(parts, "parts"))  # a row for ASKED_ROWS requests at most
    asked = asked.join(parts, "project_id", "left").withColumn(
        "_part", F.pmod(F.xxhash64("plan_id"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")

    def names(slot, kind_):
        return F.array(F.struct(F.lit("slot").alias("_of"), slot.alias("_name")), F.struct(F.lit("type").alias("_of"), kind_.alias("_name")))

    of = ["project_id", "_of", "_name"]
    deep = asked.select("project_id", "_part", F.size("_shown").alias("_n"), F.explode("_asked").alias("q")).select(
        "project_id", "_part", (F.col("_n") + F.size("q._spare") + k).alias("_d"), F.explode(names(F.col("q.slot"), F.col("q._type"))).alias("g"))
    groups = keep(deep.select("project_id", "_part", "_d", "g.*").filter("_name IS NOT NULL").groupBy(*of, "_part").agg(F.max("_d").alias("_d")), "groups")
    place = ["video_id", "start_s", "scene_id"]
    pool = scenes.filter("user_flag <> 'banned'").select("project_id", *place, "recommended_slot", F.explode(names(
        F.col("recommended_slot"), F.col("scene_type"))).alias("g")).select("project_id", *place, "recommended_slot", "g.*")
    part = F.pmod(F.xxhash64("scene_id"), F.lit(HEAD_PARTS))
    w = Window.partitionBy(*of, part).orderBy(*place)
    deepest = by_merge(groups.groupBy(*of).agg(F.max("_d").alias("_d")))
    found = join_hot(pool, deepest, of, "scene_id", salts=HEAD_PARTS).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_d"))
    found = found.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct(*place, "recommended_slot"))).alias("_all"), F.max("_d").alias("_d"))
    heads = found.select(*of, F.slice("_all", F.lit(1), F.col("_d")).alias("_head"))
    entry = F.struct("_name", "_head")
    heads = by_merge(groups.select(*of, "_part")).join(by_merge(heads), of).groupBy("project_id", "_part").agg(
        *(F.map_from_entries(F.collect_list(F.when(F.col("_of") == x, entry))).alias(f"_by_{x}") for x in ("slot", "type")))

    def choices(q):
        """The first k scenes that a request may show: of its alternatives, then of the heads of its groups."""
        def new(x):
            return ~F.array_contains("_shown", x["scene_id"]) & ~F.array_contains(q["_spare"], x["scene_id"])

        by_slot = F.filter(F.try_element_at("_by_slot", q["slot"]), new)
        by_type = F.filter(F.try_element_at("_by_type", q["_type"]), lambda x: (x["recommended_slot"] != q["slot"]) & new(x))
        both = F.sort_array(F.flatten(F.array_compact(F.array(F.slice(by_slot, 1, k), F.slice(by_type, 1, k)))))
        more = F.transform(both, lambda x: F.struct(x["scene_id"].alias("scene_id"), F.lit(True).alias("known")))
        return F.struct(q["seg_no"].alias("seg_no"), F.slice(F.concat(q["_first"], more), 1, k).alias("top"))

    met = asked.join(by_merge(heads), ["project_id", "_part"], "left").select("plan_id", F.explode(F.transform("_asked", choices)).alias("q"))
    top = met.select("plan_id", "q.seg_no", F.posexplode("q.top").alias("_at", "c"))
    return top.filter("c.known").select("plan_id", "seg_no", (F.col("_at") + 1).cast("long").alias("choice"), "c.scene_id")


def preset_transition(projects: DataFrame) -> DataFrame:
    """Transition of a project's films (project_id, used_preset); cuts have no length."""
    heads = presets.preset_heads(projects.sparkSession).select(
        F.col("preset_id").alias("used_preset"), "transition",
        F.when(F.col("transition") == "cut", 0.0).otherwise(F.col("transition_s")).alias("transition_s"))
    return projects.join(F.broadcast(heads), "used_preset").select("project_id", "transition", "transition_s")
