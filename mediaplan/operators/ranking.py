"""Pool, gate, scores and order of scenes for the slots of a film."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import clamp, or_default, rnd
from ..functions.ranges import range_join
from ..functions.sequences import number_ranged
from ..functions.skew import join_hot
from ..functions.windows import BLOCK_S, Windows, film_windows, rounded, slide
from .signals import motion_pairs, smoothness

CATALOGUE_ORDER = ["video_id", "start_s", "scene_id"]
#: Seconds behind a scene that a fragment of rounded length may reach.
FILM_EDGE = 0.01

# --- fixed values: reason texts, in the order they are tried
REASON_TYPE = "тип «%s» подходит слоту"
REASON_RECOMMENDED = "LLM рекомендовала это место в ролике"
REASON_MOTION = "движение «%s» соответствует динамике"
REASON_AESTHETIC = "высокая эстетика кадра"
REASON_MATCH = "высокое соответствие сценарию"
REASON_PINNED = "закреплена пользователем"
REASON_BEST = "лучший доступный кандидат (q=%.2f)"
PROBLEM_EMPTY = "Нет пригодных сцен для монтажа"


def duration() -> Column:
    return rnd(F.col("end_s") - F.col("start_s"), 3)


def usable_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes that may be shown: not banned, not marked unusable."""
    return scenes.filter((F.col("user_flag") != "banned")
                         & ~F.array_contains("tags", "not-usable"))


def stability_gate(scenes: DataFrame, projects: DataFrame, min_stability: float = 0.55,
                   enough: int = 3) -> DataFrame:
    """Steady or pinned scenes of a project; where fewer than ``enough`` qualify, the
    least jerky half instead. Projects that stabilise keep everything.

    Counts are pre-aggregated per project; ranks are only taken for the projects that
    need the fallback, over ranges that also split scenes of equal jerkiness."""
    steady = ((F.col("user_flag") == "pinned")
              | ((F.col("motion_type") != "shake") & (F.col("stability_score") >= min_stability)))
    marked = scenes.withColumn("_steady", steady)
    counts = marked.groupBy("project_id").agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("_steady"), 1)).alias("_ok"))
    options = projects.select("project_id", F.col("stabilize_shaky").alias("_keep"))
    marked = join_hot(marked, counts.join(options, "project_id"), ["project_id"], "scene_id")
    direct = marked.filter(F.col("_keep") | ((F.col("_ok") >= enough) & F.col("_steady")))
    short = marked.filter(~F.col("_keep") & (F.col("_ok") < enough))
    ranked = number_ranged(short, ["project_id"], ["jerkiness", *CATALOGUE_ORDER], "_rank")
    fallback = ranked.filter(F.col("_rank") < F.greatest(F.floor(F.col("_n") / 2), F.lit(3)))
    own = ["_steady", "_n", "_ok", "_keep"]
    return direct.drop(*own).unionByName(fallback.drop(*own, "_rank"))


def pool_report(scenes: DataFrame, projects: DataFrame, min_stability: float = 0.55, enough: int = 3) -> DataFrame:
    """What each project has to choose from: usable scenes (``scenes`` before ``usable_scenes``), steady ones, whether the
    stability gate falls back to the least jerky, and the problem of a project without a scene to show."""
    ok = usable_scenes(scenes).withColumn("_steady", (F.col("user_flag") == "pinned") | (
        (F.col("motion_type") != "shake") & (F.col("stability_score") >= min_stability)))
    counts = ok.groupBy("project_id").agg(F.count("*").alias("usable"), F.count(F.when(F.col("_steady"), 1)).alias("steady"))
    df = projects.select("project_id", "stabilize_shaky").join(counts, "project_id", "left")
    usable, steady = (F.coalesce(c, F.lit(0).cast("long")) for c in ("usable", "steady"))
    return df.select("project_id", usable.alias("usable"), steady.alias("steady"),
                     (~F.col("stabilize_shaky") & (usable > 0) & (steady < enough)).alias("fallback"), F.when(usable == 0, PROBLEM_EMPTY).alias("problem"))


def with_slots(scenes: DataFrame, projects: DataFrame, slots: DataFrame) -> DataFrame:
    """Every scene next to the slots of its project's preset. ``projects`` holds
    project_id and used_preset; the 65 slot rows are broadcast."""
    chosen = projects.select("project_id", F.col("used_preset").alias("preset_id"))
    return join_hot(scenes, chosen, ["project_id"], "scene_id").join(F.broadcast(slots), "preset_id")


def _type_place() -> Column:
    return F.array_position("scene_types", F.col("scene_type"))


def _motion_fits() -> Column:
    return F.array_contains("prefer_motion", F.col("motion"))


def slot_scores(pairs: DataFrame) -> DataFrame:
    """Adds ``score``: how well a scene serves a slot (see ``with_slots``)."""
    place = _type_place()
    type_score = (F.when(place > 0, 1.0 - 0.15 * (place - 1))
                  .when(F.col("recommended_slot") == F.col("slot"), 0.7).otherwise(0.3))
    motion_score = (F.when((F.size("prefer_motion") == 0) | _motion_fits(), 1.0)
                    .when((F.col("motion") == "fast") & F.col("slot").isin("intro", "ending"), 0.1)
                    .otherwise(0.3))
    quality = 0.6 * F.col("quality_score") + 0.4 * or_default("aesthetic_score", F.col("quality_score"))
    match = or_default("scenario_match_score", 0.5)
    bonus = (F.when(F.col("user_flag") == "pinned", 0.5).when(F.col("user_flag") == "good", 0.2)
             .when(F.col("user_flag") == "bad", -0.4).otherwise(0.0))
    total = 0.35 * type_score + 0.15 * motion_score + 0.25 * quality + 0.25 * match + bonus
    return pairs.withColumn("score", rnd(total, 4))


def slot_reasons(pairs: DataFrame) -> DataFrame:
    """Adds ``reason``: the first three grounds that apply."""
    grounds = F.array_compact(F.array(
        F.when(_type_place() > 0, F.format_string(REASON_TYPE, "scene_type"))
        .when(F.col("recommended_slot") == F.col("slot"), F.lit(REASON_RECOMMENDED)),
        F.when((F.size("prefer_motion") > 0) & _motion_fits(),
               F.format_string(REASON_MOTION, "motion")),
        F.when(F.col("aesthetic_score") >= 0.7, F.lit(REASON_AESTHETIC)),
        F.when(F.col("scenario_match_score") >= 0.7, F.lit(REASON_MATCH)),
        F.when(F.col("user_flag") == "pinned", F.lit(REASON_PINNED))))
    best = F.format_string(REASON_BEST, rnd("quality_score", 2))
    return pairs.withColumn("reason", F.when(F.size(grounds) == 0, best).otherwise(
        F.concat_ws("; ", F.slice(grounds, 1, 3))))


def rank_for_slot(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` (1 is best) per project, preset and slot among scenes long enough.

    With ``k`` a group limit runs before the shuffle. Without, ranks come from ranges of score and
    place, so a project of any size spreads over many tasks, even if all its scores are equal."""
    fit = scores.filter(duration() >= F.col("min_fragment"))
    key = ["project_id", "preset_id", "slot"]
    order = [F.col("score").desc(), *CATALOGUE_ORDER]
    if k is not None:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
        return fit.withColumn("rank", rank).filter(F.col("rank") <= k)
    return number_ranged(fit, key, order, "rank").withColumn("rank", F.col("rank") + 1)


def variant_order(ranked: DataFrame, variant: int, head: int = 6) -> DataFrame:
    """Adds ``position``: the best ``head`` of a slot in an order drawn from the
    variant number, pinned ones in front; the others stay. Variant 0 changes nothing."""
    if not variant:
        return ranked.withColumn("position", F.col("rank"))
    draw = F.md5(F.concat(F.lit(f"{variant}:"), "slot", F.lit(":"), F.col("scene_id").cast("string")))
    w = Window.partitionBy("project_id", "preset_id", "slot").orderBy(
        F.col("user_flag") != "pinned", draw)
    top = ranked.filter(F.col("rank") <= head).withColumn(
        "position", F.row_number().over(w).cast("long"))
    return top.unionByName(
        ranked.filter(F.col("rank") > head).withColumn("position", F.col("rank")))


def _centred_start(length: Column) -> Column:
    inside = (F.col("best_moment") > F.col("start_s")) & (F.col("best_moment") < F.col("end_s"))
    centre = F.when(inside, F.col("best_moment")).otherwise(F.col("start_s") + duration() / 2)
    return F.least(F.greatest(centre - length / 2, F.col("start_s")), F.col("end_s") - length)


def center_fragment(scenes: DataFrame, length) -> DataFrame:
    """Adds ``src_start``/``src_end``: a fragment around the best moment, inside the scene."""
    n = F.col(length) if isinstance(length, str) else F.lit(float(length))
    whole = duration() <= n
    return (scenes.withColumn("_at", _centred_start(n))
            .withColumn("src_start", F.when(whole, F.col("start_s")).otherwise(rnd("_at", 3)))
            .withColumn("src_end", F.when(whole, F.col("end_s")).otherwise(rnd(F.col("_at") + n, 3)))
            .drop("_at"))


def _smoothest(w: Windows, fast: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The start of the smoothest window of each row, of equal ones the nearest to its centre; nan where all are jerky."""
    ok, rough = smoothness(w, fast[w.row])
    cost = np.where(ok, rounded(rough + 0.05 * np.abs(w.start - centre[w.row]), 6), np.inf)
    best = np.full(len(fast), np.nan)
    order = np.lexsort([w.start, cost, w.row])
    order = order[np.append(True, w.row[order][1:] != w.row[order][:-1])]
    order = order[np.isfinite(cost[order])]
    best[w.row[order]] = w.start[order]
    return best


def best_window(frags: DataFrame, samples: DataFrame, step: float = 0.5, key: Sequence[str] = ("frag_id",)) -> DataFrame:
    """The smoothest place of a fragment inside its scene.

    ``frags``: ``key``, video_id, start_s, end_s, best_moment, frag_len, allow_fast.
    Output per fragment: ``key``, src_start, src_end; null where every place is jerky. All places of a fragment slide in
    one task over samples that its scene shares with others (``slide``)."""
    n, at = F.col("frag_len"), F.col("start_s")
    last = F.col("end_s") - n
    count = F.ceil((last - at + 0.01) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: at + i * F.lit(step))
    full = F.when(F.element_at(grid, -1) < last - 0.05, F.concat(grid, F.array(last))).otherwise(grid)
    starts = F.when(duration() <= n + 0.2, F.array("start_s")).otherwise(full)
    centre = F.when(duration() <= n, F.col("start_s")).otherwise(rnd(_centred_start(n), 3))
    rows = frags.select(*key, "video_id", "allow_fast", centre.alias("_centre"), starts.alias("starts"), n.alias("length"),
                        F.col("end_s").alias("stop")).withColumn("last_end", F.element_at("starts", -1) + F.col("length"))

    def judge(own, w):
        best = _smoothest(w, own.column("allow_fast").to_numpy(), own.column("_centre").to_numpy())
        return pa.table([*(own.column(k) for k in key), pa.array(w.seen), pa.array(best, from_pandas=True)], [*key, "_seen", "_st"])

    kinds = ", ".join(f"`{k}` {frags.schema[k].dataType.simpleString()}" for k in key)
    best = slide(rows, motion_pairs(samples), [*key, "allow_fast", "_centre"], judge, f"{kinds}, _seen boolean, _st double")
    alone = center_fragment(frags, "frag_len").join(best, [*key])
    return alone.select(*key, F.when(F.col("_seen"), rnd("_st", 3)).otherwise(F.col("src_start")).alias("src_start"),
                        F.when(F.col("_seen"), rnd(F.col("_st") + n, 3)).otherwise(F.col("src_end")).alias("src_end"))


def scene_films(scenes: DataFrame, pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """What ``best_place`` reads: ``key``, and t, pt, speed, acc, flip of the samples of each scene (``key``, video_id, start_s, end_s) in order.
    ``pairs``: see ``motion_pairs``. Scenes without samples have no row."""
    spans = scenes.select(*key, "video_id", "start_s", (F.col("end_s") + FILM_EDGE).alias("_stop"))
    met = range_join(spans, pairs.drop("n").withColumn("_t", F.col("t")), ["video_id"], ("start_s", "_stop"), ("t", "_t"), BLOCK_S, closed=True)
    names = ["t", "pt", "speed", "acc", "flip"]
    film = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_film"))
    return film.select(*key, *(F.col("_film")[n].alias(n) for n in names))


def best_place(film: dict[str, np.ndarray] | None, start: float, end: float, moment: float | None, length: float, fast: bool,
               step: float = 0.5) -> tuple[float, float] | None:
    """``best_window`` of one scene, for a length that only a task knows: (src_start, src_end), or None where every place is jerky.
    ``film``: the samples of the scene (``scene_films``); without any, a fragment around the best moment (``center_fragment``)."""
    whole = float(rounded(end - start, 3))
    middle = moment if moment is not None and start < moment < end else start + whole / 2
    at = min(max(middle - length / 2, start), end - length)
    if film is not None:
        last = end - length
        starts = start + np.arange(max(math.ceil((last - start + 0.01) / step), 1)) * step
        if starts[-1] < last - 0.05:
            starts = np.append(starts, last)
        starts = np.array([start]) if whole <= length + 0.2 else starts
        w = film_windows(film, starts, starts + length, end)
        if w.seen[0]:
            best = _smoothest(w, np.array([fast]), np.array([start if whole <= length else rounded(at, 3)]))[0]
            return None if np.isnan(best) else (float(rounded(best, 3)), float(rounded(best + length, 3)))
    return (start, end) if whole <= length else (float(rounded(at, 3)), float(rounded(at + length, 3)))


def interest(scenes: DataFrame, detected: DataFrame | None = None) -> DataFrame:
    """Adds ``has_person`` and ``interest``. ``detected`` (scene_id) lists scenes in which
    a detector found somebody."""
    if detected is not None:
        seen = detected.select("scene_id").distinct().withColumn("_seen", F.lit(True))
        scenes = scenes.join(seen, "scene_id", "left")
        person = (F.col("people_count") > 0) | F.coalesce("_seen", F.lit(False))
    else:
        person = F.col("people_count") > 0
    raw = (F.when(F.col("has_person"), 0.55).otherwise(0.0)
           + 0.35 * F.coalesce("aesthetic_score", F.lit(0.0)) + 0.10 * F.col("quality_score"))
    dull = (F.col("motion") == "static") & ~F.col("has_person")
    return (scenes.withColumn("has_person", person)
            .withColumn("interest", rnd(F.when(dull, raw * 0.25).otherwise(raw), 4)).drop("_seen"))
