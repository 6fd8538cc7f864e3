"""Scene spans, speech inside them, and scenes that look alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import rnd
from ..functions.ranges import range_join
from ..sources.tables import keep
from ..functions.sequences import (BLOCK_ROWS, core_rows, halo_window, number_rows, running, with_halo)
from ..functions.skew import by_merge


def adaptive_cuts(scores: DataFrame, ratio: float = 3.0, min_score: float = 15.0,
                  reach: int = 2) -> DataFrame:
    """Spans between cuts. A frame is a cut when its change score is at least ``ratio``
    times the mean of its ``reach`` neighbours on each side, and at least ``min_score``.

    ``scores``: video_id, n (dense), t, score. A span runs to the next cut, the last one
    to the last frame."""
    df = with_halo(scores.select("video_id", "n", "t", "score"), "n", before=reach, after=reach)
    w = halo_window(["video_id"], "n").rowsBetween(-reach, reach)
    around = (F.sum("score").over(w) - F.col("score")) / (F.count("score").over(w) - 1)
    df = core_rows(df.withColumn("_mean", F.when(F.count("score").over(w) > 1, around)))
    cut = (F.col("score") >= min_score) & (F.col("score") >= ratio * F.col("_mean")) & (F.col("n") > 0)
    df = df.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    df = running(df, ["video_id"], F.floor(F.col("n") / BLOCK_ROWS), ["n"],
                 {"_no": ("sum", F.when(F.col("_cut"), 1).otherwise(0), True)})
    # a cut opens its own span and closes the one before
    both = F.when(F.col("_cut"), F.array(F.col("_no"), F.col("_no") - 1)).otherwise(F.array("_no"))
    df = df.withColumn("_own", F.col("_no")).withColumn("_span", F.explode(both))
    own = F.col("_span") == F.col("_own")
    out = df.groupBy("video_id", "_span").agg(
        F.min(F.when(own, F.col("t"))).alias("start_s"),
        F.coalesce(F.min(F.when(~own, F.col("t"))), F.max("t")).alias("end_s"))
    return out.filter("end_s > start_s").select("video_id", "start_s", "end_s")


def cover_uncut(videos: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans, plus one over the whole file for videos without any."""
    whole = (videos.filter("duration > 0").join(spans.select("video_id").distinct(), "video_id", "left_anti")
             .select("video_id", F.lit(0.0).alias("start_s"), F.col("duration").cast("double").alias("end_s")))
    return spans.select("video_id", "start_s", "end_s").unionByName(whole)


def normalize_spans(spans: DataFrame, min_len: float = 1.5, max_len: float = 10.0) -> DataFrame:
    """Drops short spans and cuts long ones into equal parts of at most ``max_len``."""
    length = F.col("end_s") - F.col("start_s")
    parts = F.when(length <= max_len, F.lit(1)).otherwise(F.floor(length / max_len).cast("int") + 1)
    df = spans.filter(length >= min_len).withColumn("_n", parts)
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_part", length / F.col("_n"))
    lo = F.col("start_s") + F.col("_i") * F.col("_part")
    hi = F.when(F.col("_n") == 1, F.col("end_s")).otherwise(
        F.least(F.col("start_s") + (F.col("_i") + 1) * F.col("_part"), F.col("end_s")))
    rest = [c for c in spans.columns if c not in ("start_s", "end_s")]
    return (df.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_hi") - F.col("_lo") >= min_len)
            .select(*rest, rnd("_lo", 3).alias("start_s"), rnd("_hi", 3).alias("end_s")))


def clean_phrases(phrases: DataFrame, max_no_speech: float = 0.6, min_chars: int = 2) -> DataFrame:
    """Phrases with real text: trimmed, not noise, times rounded."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return (phrases.withColumn("text", text)
            .filter((F.length("text") >= min_chars) & (F.coalesce("no_speech_prob", F.lit(0.0)) <= max_no_speech))
            .withColumn("p_start", rnd("p_start", 3)).withColumn("p_end", rnd("p_end", 3)))


def phrases_in_scene(scenes: DataFrame, phrases: DataFrame, bin_s: float = 60.0) -> DataFrame:
    """Phrases that reach into a scene (ends do not count)."""
    return range_join(scenes.select("scene_id", "video_id", "start_s", "end_s"),
                      phrases.select("video_id", "p_start", "p_end", "text"), ["video_id"],
                      ("start_s", "end_s"), ("p_start", "p_end"), bin_s)


_SAFE = """
aggregate(phrases, named_struct('a', src_start, 'b', src_end), (acc, p) ->
  transform(array(
    CASE WHEN p.p_start < acc.a AND acc.a < p.p_end THEN
      if(acc.a - p.p_start <= 1.5D AND p.p_start >= start_s, p.p_start, least(p.p_end, acc.b))
    ELSE acc.a END),
    a -> named_struct('a', a, 'b',
      CASE WHEN p.p_start < acc.b AND acc.b < p.p_end THEN
        if(p.p_end - a <= max_len AND p.p_end <= end_s, p.p_end, greatest(p.p_start, a))
      ELSE acc.b END))[0])"""


def speech_safe(frags: DataFrame) -> DataFrame:
    """Moves fragment ends off the middle of phrases.

    ``frags``: src_start, src_end, start_s, end_s (of the scene), max_len and ``phrases``,
    an array of (p_start, p_end) in time order: only the phrases of one scene."""
    df = frags.withColumn("_f", F.expr(_SAFE))
    keep = F.col("_f.b") - F.col("_f.a") < 1.0
    has = F.size("phrases") > 0
    return (df.withColumn("_a", F.when(keep | ~has, F.col("src_start")).otherwise(rnd("_f.a", 3)))
            .withColumn("src_end", F.when(keep | ~has, F.col("src_end")).otherwise(rnd("_f.b", 3)))
            .withColumn("src_start", F.col("_a")).drop("_a", "_f"))


def with_phrases(frags: DataFrame, scenes: DataFrame, phrases: DataFrame) -> DataFrame:
    """Adds the phrase array of the fragment's scene."""
    arr = phrases_in_scene(scenes, phrases).groupBy("scene_id").agg(
        F.sort_array(F.collect_list(F.struct("p_start", "p_end"))).alias("phrases"))
    empty = F.array().cast("array<struct<p_start:double,p_end:double>>")
    return frags.join(arr, "scene_id", "left").withColumn("phrases", F.coalesce("phrases", empty))


def hist_corr_sql(a: str, b: str) -> str:
    def mean(x):
        return f"(aggregate({x}, 0D, (s, v) -> s + v) / size({x}))"

    cross = (f"aggregate(zip_with({a}, {b}, (p, q) -> named_struct('p', p - m.a, 'q', q - m.b)),"
             " 0D, (s, v) -> s + v.p * v.q)")
    aa = f"aggregate({a}, 0D, (s, v) -> s + (v - m.a) * (v - m.a))"
    bb = f"aggregate({b}, 0D, (s, v) -> s + (v - m.b) * (v - m.b))"
    return (f"transform(array(named_struct('a', {mean(a)}, 'b', {mean(b)})), m ->"
            f" if({aa} * {bb} <= 2.220446049250313e-16D, 1D, {cross} / sqrt({aa} * {bb})))[0]")


def hist_corr(a: str, b: str) -> Column:
    """Correlation of two histograms of equal size; flat ones count as equal."""
    return F.expr(hist_corr_sql(a, b))


#: Looks that share a token and a size and are compared in one task.
HOT_LOOKS = 4096
#: Looks of a project and type that are compared with each other.
FEW_LOOKS = 128


def scene_looks(scenes: DataFrame, tokens: DataFrame) -> DataFrame:
    """What a scene shows: its type and its set of tokens, for scenes that have both.
    Scenes of a project with the same look share a ``look_id``."""
    sets = tokens.groupBy("scene_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    df = scenes.filter(F.col("scene_type") != "").select("scene_id", "project_id", "scene_type").join(sets, "scene_id")
    text = F.concat_ws("\u0001", F.col("project_id").cast("string"), "scene_type", "tokens")
    return df.withColumn("look_id", F.md5(text))


def near_scenes(scenes: DataFrame, within: float = 20.0) -> DataFrame:
    """Pairs of scenes of one video that start less than ``within`` seconds apart. Scenes
    do not overlap, so a scene has a handful of partners at most."""
    bin_no = F.floor(F.col("start_s") / within).cast("long")
    s = scenes.select("video_id", "scene_id", "start_s")
    a = s.select("video_id", F.col("scene_id").alias("scene_a"), F.col("start_s").alias("_sa"),
                 F.explode(F.array(bin_no, bin_no + 1)).alias("_bin"))
    b = s.select("video_id", F.col("scene_id").alias("scene_b"), F.col("start_s").alias("_sb"), bin_no.alias("_bin"))
    first = (F.col("_sa") < F.col("_sb")) | ((F.col("_sa") == F.col("_sb")) & (F.col("scene_a") < F.col("scene_b")))
    return (a.join(b, ["video_id", "_bin"]).filter(first & (F.col("_sb") - F.col("_sa") < within))
            .select("video_id", "scene_a", "scene_b"))


def similar_looks(looks: DataFrame, min_jaccard: float = 0.65, hot: int = HOT_LOOKS, few: int = FEW_LOOKS) -> DataFrame:
    """Pairs of different looks of a project and type whose token sets are alike.

    Copies collapse first: scenes of equal look are one row with a count, so a large
    group of copies is one look and never a square of pairs. Where a project has at most ``few`` looks of a type, each
    meets each. Elsewhere the join is an exact prefix join: two sets that are alike enough must share one of their rarest
    tokens, so only those are joined on, together with the size of the partner. Where more than ``hot`` looks
    share such a token they are dealt to parts, which look for partners one by one."""
    return _like_looks(looks, min_jaccard, hot, few)[1].select(
        "project_id", "scene_type", F.least("look_a", "look_b").alias("look_a"), F.greatest("look_a", "look_b").alias("look_b"),
        rnd("jaccard", 6).alias("jaccard"), (F.col("scenes_a") * F.col("scenes_b")).alias("scene_pairs"))


def _like_looks(looks: DataFrame, min_jaccard: float, hot: int, few: int) -> tuple[DataFrame, DataFrame]:
    """The looks with their number of scenes, stored, and the pairs of those that are alike, each once."""
    t, group = float(min_jaccard), ["project_id", "scene_type"]
    sets = keep(looks.groupBy(*group, "look_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("scenes")), "looks")
    # a row for more than ``few`` looks
    large = keep(sets.groupBy(*group).agg(F.count("*").alias("_looks")).filter(F.col("_looks") > few).select(*group), "groups")
    alone = large.isEmpty()
    small = sets if alone else sets.join(large, group, "left_anti")
    side = lambda x: small.select(*group, F.col("look_id").alias(f"look_{x}"), F.col("tokens").alias(f"_t{x}"), F.col("scenes").alias(f"scenes_{x}"))
    met = side("a").join(by_merge(side("b")), group).filter(F.col("look_a") < F.col("look_b"))
    common = F.size(F.array_intersect("_ta", "_tb"))
    met = met.withColumn("jaccard", common / (F.size("_ta") + F.size("_tb") - common))
    out = [*group, "look_a", "look_b", "scenes_a", "scenes_b", "jaccard"]
    pairs = met.filter(F.col("jaccard") >= t).select(*out)
    return sets, pairs if alone else pairs.unionByName(_prefix_pairs(sets.join(large, group, "left_semi"), t, hot).select(*out))


def _prefix_pairs(sets: DataFrame, t: float, hot: int) -> DataFrame:
    """Pairs of looks that share a rare token and are alike."""
    group = ["project_id", "scene_type"]
    flat = sets.select(*group, "look_id", F.explode("tokens").alias("token"))
    freq = flat.groupBy(*group, "token").agg(F.count("*").alias("_f"))
    rare = (flat.join(freq, [*group, "token"]).groupBy(*group, "look_id")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("_f", "token"))),
                             lambda x: x["token"]).alias("_by_rarity")))
    need = F.ceil(F.size("tokens") * t - 1e-9).cast("int")
    sets = sets.join(rare, [*group, "look_id"]).withColumn("_n", F.size("tokens")).withColumn(
        "_prefix", F.slice("_by_rarity", F.lit(1), F.col("_n") - need + 1))
    sets = keep(sets.select(*group, "look_id", "tokens", "scenes", "_prefix", "_n"), "looks")
    a = sets.select(*group, F.col("look_id").alias("look_a"), F.col("tokens").alias("_ta"),
                    F.col("scenes").alias("scenes_a"), F.col("_prefix").alias("_pa"), F.col("_n").alias("_na"))
    # the smaller set looks for partners of its own size and above
    a = a.withColumn("_size", F.explode(F.sequence(F.col("_na"), F.floor(F.col("_na") / t + 1e-9).cast("int"))))
    a = a.withColumn("token", F.explode("_pa"))
    b = sets.select(*group, F.col("look_id").alias("look_b"), F.col("tokens").alias("_tb"),
                    F.col("scenes").alias("scenes_b"), F.col("_prefix").alias("_pb"), F.col("_n").alias("_size"))
    b = b.withColumn("token", F.explode("_pb"))
    on = [*group, "_size", "token"]
    parts = b.groupBy(*on).agg(F.ceil(F.count("*") / hot).cast("int").alias("_parts")).filter("_parts > 1")
    a = a.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    b = b.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64("look_b"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    pairs = a.join(b, [*on, "_part"])
    pairs = pairs.filter((F.col("_na") < F.col("_size")) | (F.col("look_a") < F.col("look_b")))
    # several shared rare tokens would give the pair several times: keep the first
    pairs = pairs.filter(F.get(F.array_intersect("_pa", "_pb"), F.lit(0)) == F.col("token"))
    common = F.size(F.array_intersect("_ta", "_tb"))
    jac = common / (F.col("_na") + F.col("_size") - common)
    return pairs.withColumn("jaccard", jac).filter(F.col("jaccard") >= t)


def look_links(looks: DataFrame, min_jaccard: float = 0.65, hot: int = HOT_LOOKS, few: int = FEW_LOOKS) -> DataFrame:
    """How many other looks and scenes each look (look_id) is like (``similar_looks``): a row a look, zeros included. Scenes of one
    look are alike too and not counted."""
    own, pairs = _like_looks(looks, min_jaccard, hot, few)
    ends = F.array(F.struct(F.col("look_a").alias("look_id"), F.col("scenes_b").alias("s")), F.struct(F.col("look_b").alias("look_id"), F.col("scenes_a").alias("s")))
    links = pairs.select(F.explode(ends).alias("e")).groupBy("e.look_id").agg(F.count("*").alias("links"), F.sum("e.s").alias("linked_scenes"))
    zero = F.lit(0).cast("long")
    return own.join(links, "look_id", "left").select("project_id", "scene_type", "look_id", "scenes", F.coalesce("links", zero).alias("links"),
                                                     F.coalesce("linked_scenes", zero).alias("linked_scenes"))


def similar_sql(a: str, b: str, within: float = 20.0, min_jaccard: float = 0.65, min_corr: float = 0.88) -> str:
    common, union = f"size(array_intersect({a}.tokens, {b}.tokens))", f"size(array_union({a}.tokens, {b}.tokens))"
    return (f"coalesce(({a}.video_id = {b}.video_id AND abs({a}.start_s - {b}.start_s) < {within!r}D)"
            f" OR ({a}.scene_type <> '' AND {a}.scene_type = {b}.scene_type AND size({a}.tokens) > 0 AND size({b}.tokens) > 0"
            f" AND {common} / greatest({union}, 1) >= {min_jaccard!r}D AND ({a}.hist IS NULL OR {b}.hist IS NULL"
            f" OR {hist_corr_sql(f'{a}.hist', f'{b}.hist')} > {min_corr!r}D)), false)")


def similar(a: str, b: str) -> Column:
    """Would two scenes (struct columns ``a`` and ``b`` with video_id, start_s, scene_type,
    tokens, hist) repeat each other in one film."""
    return F.expr(similar_sql(a, b))


def scene_views(scenes: DataFrame, tokens: DataFrame, hists: DataFrame | None = None) -> DataFrame:
    """Scenes with their token set and, where known, their histogram."""
    sets = tokens.groupBy("scene_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    df = scenes.join(sets, "scene_id", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    if hists is None:
        return df.withColumn("hist", F.lit(None).cast("array<double>"))
    return df.join(hists.select("scene_id", "hist"), "scene_id", "left")


def similar_pairs(pairs: DataFrame, views: DataFrame) -> DataFrame:
    """Adds ``similar`` to given pairs (scene_a, scene_b)."""
    view = F.struct("video_id", "start_s", "scene_type", "tokens", "hist")
    a = views.select(F.col("scene_id").alias("scene_a"), view.alias("_a"))
    b = views.select(F.col("scene_id").alias("scene_b"), view.alias("_b"))
    return (pairs.join(a, "scene_a").join(b, "scene_b").withColumn("similar", similar("_a", "_b")).drop("_a", "_b"))


def group_neighbours(views: DataFrame, chunk_s: float = 3600.0) -> DataFrame:
    """Chains of consecutive scenes of a video that are alike; each chain becomes one
    zone titled by its first scene."""
    df = number_rows(views, ["video_id"], F.floor(F.col("start_s") / chunk_s), ["start_s", "scene_id"])
    df = with_halo(df, "n", before=1).withColumn(
        "_cur", F.struct("video_id", "start_s", "scene_type", "tokens", "hist"))
    df = core_rows(df.withColumn("_prev", F.lag("_cur").over(halo_window(["video_id"], "n"))))
    df = df.withColumn("_opens", F.when(F.col("_prev").isNotNull() & similar("_prev", "_cur"), 0).otherwise(1))
    df = keep(df.select("video_id", "n", "start_s", "end_s", "description", "_opens"), "chains")
    df = running(df, ["video_id"], F.floor(F.col("n") / BLOCK_ROWS), ["n"],
                 {"group_no": ("sum", F.col("_opens"), True)})
    first = F.min_by(F.substring("description", 1, 40), F.col("n"))
    ordinal = F.format_string("зона %d", F.min("n") + 1)
    out = df.groupBy("video_id", "group_no").agg(
        F.min("n").alias("first_index"), F.max("n").alias("last_index"),
        F.min("start_s").alias("z_start"), F.max_by("end_s", "n").alias("z_end"),
        F.trim(F.coalesce(F.nullif(first, F.lit("")), ordinal)).alias("title"))
    return out.withColumn("group_no", F.col("group_no").cast("long"))
