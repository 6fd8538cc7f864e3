"""Preset, style and aspect dimensions: small fixed tables, always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# --- fixed values -------------------------------------------------------------------
# id, title, dynamics, transition, transition seconds, music sync, idea, intro rule
# (an empty intro rule means the common one)
PRESET_HEADS = [
    ("fpv_location", "FPV обзор локации", "high", "cut", 0.4, True,
     "Динамичный FPV-облёт локации: непрерывное движение, пролёты сквозь пространства, эффект присутствия.", ""),
    ("restaurant", "Реклама ресторана/кафе", "medium", "crossfade", 0.4, True,
     "Аппетитная реклама заведения: атмосфера, интерьер, блюда крупным планом, довольные гости.", ""),
    ("coworking", "Реклама коворкинга", "medium", "crossfade", 0.4, True,
     "Современное рабочее пространство: свет, зоны, атмосфера продуктивности, люди за работой.", ""),
    ("travel", "Туристический ролик", "medium", "crossfade", 0.4, True,
     "Путешествие: пейзажи, достопримечательности, атмосфера места, ощущение открытия.", ""),
    ("family", "Семейное видео", "low", "crossfade", 0.5, True,
     "Тёплое семейное видео: эмоции, лица, совместные моменты, естественность.", ""),
    ("birthday", "День рождения", "medium", "crossfade", 0.3, True,
     "Праздник: торт, свечи, поздравления, эмоции именинника и гостей, веселье.", ""),
    ("drone_cinematic", "Дроновое cinematic video", "medium", "crossfade", 0.4, True,
     "Кинематографичные дроновые кадры: масштаб, плавные пролёты, величие пейзажа.", ""),
    ("reels_fast", "Быстрый Reels для Instagram", "high", "cut", 0.4, True,
     "Цепляющий вертикальный ролик: быстрые склейки, самое яркое в первые 2 секунды, высокий темп.",
     "сразу самый цепляющий кадр — хук в первые 2 секунды"),
    ("tiktok_clip", "Вертикальный TikTok клип", "high", "cut", 0.4, True,
     "Ритмичный вертикальный клип под музыку: склейки строго по битам, энергия, движение.",
     "мгновенный хук: движение или самый яркий кадр"),
    ("real_estate", "Презентация недвижимости", "low", "crossfade", 0.5, True,
     "Презентация объекта: фасад, входная группа, ключевые помещения, детали отделки, вид из окон.", ""),
    ("slow_cinematic", "Атмосферный slow cinematic", "low", "crossfade", 0.6, False,
     "Медитативный атмосферный ролик: длинные планы, настроение, свет, фактуры, неторопливость.", ""),
    ("action_montage", "Динамичный action монтаж", "high", "cut", 0.4, True,
     "Энергичный экшн: скорость, движение, адреналин, резкая смена планов, монтаж в ритм.", ""),
    ("generic", "Универсальный ролик", "medium", "crossfade", 0.3, True,
     "Сбалансированный ролик: понятное начало, содержательная середина, яркая кульминация, завершённый финал.", ""),
]
INTRO_RULE = "спокойный или общий кадр, задающий место действия"
ENDING_RULE = "завершённый кадр: общий вид или спокойный фрагмент, без обрыва"
SLOTS = ("intro", "development", "main", "climax", "ending")
# preset, slot, share, scene types (best first), shortest and longest fragment, wanted motion
PRESET_SLOTS = [
    ("fpv_location", "intro", 0.15, ["establishing", "location"], 1.5, 4.0, ["slow"]),
    ("fpv_location", "development", 0.30, ["action", "location", "detail"], 1.5, 4.0, ["fast", "slow"]),
    ("fpv_location", "main", 0.25, ["action", "location"], 1.5, 4.0, ["fast"]),
    ("fpv_location", "climax", 0.20, ["climax", "action"], 2.0, 5.0, ["fast"]),
    ("fpv_location", "ending", 0.10, ["ending", "establishing"], 2.0, 5.0, ["slow", "static"]),
    ("restaurant", "intro", 0.15, ["establishing", "location"], 2.0, 5.0, ["slow", "static"]),
    ("restaurant", "development", 0.30, ["detail", "food", "location"], 1.5, 4.0, ["slow"]),
    ("restaurant", "main", 0.30, ["food", "people", "detail"], 1.5, 4.0, ["slow", "static"]),
    ("restaurant", "climax", 0.15, ["food", "climax", "people"], 2.0, 4.0, ["slow"]),
    ("restaurant", "ending", 0.10, ["ending", "establishing"], 2.0, 5.0, ["static", "slow"]),
    ("coworking", "intro", 0.15, ["establishing", "location"], 2.0, 5.0, ["slow"]),
    ("coworking", "development", 0.35, ["location", "detail", "people"], 1.5, 4.0, ["slow"]),
    ("coworking", "main", 0.25, ["people", "detail"], 1.5, 4.0, ["slow", "static"]),
    ("coworking", "climax", 0.15, ["climax", "location"], 2.0, 4.0, ["slow"]),
    ("coworking", "ending", 0.10, ["ending", "establishing"], 2.0, 5.0, ["static"]),
    ("travel", "intro", 0.15, ["establishing", "location"], 2.0, 5.0, ["slow"]),
    ("travel", "development", 0.30, ["location", "detail", "people"], 1.5, 4.5, ["slow"]),
    ("travel", "main", 0.25, ["location", "action", "people"], 1.5, 4.5, ["slow", "fast"]),
    ("travel", "climax", 0.20, ["climax", "location"], 2.0, 5.0, ["slow", "fast"]),
    ("travel", "ending", 0.10, ["ending", "establishing"], 2.0, 5.0, ["slow", "static"]),
    ("family", "intro", 0.15, ["establishing", "people"], 2.0, 5.0, ["static", "slow"]),
    ("family", "development", 0.35, ["people", "detail"], 2.0, 5.0, ["static", "slow"]),
    ("family", "main", 0.25, ["people", "action"], 2.0, 5.0, ["slow"]),
    ("family", "climax", 0.15, ["people", "climax"], 2.0, 5.0, ["slow"]),
    ("family", "ending", 0.10, ["ending", "people"], 2.5, 6.0, ["static", "slow"]),
    ("birthday", "intro", 0.15, ["establishing", "detail"], 2.0, 4.0, ["slow", "static"]),
    ("birthday", "development", 0.30, ["people", "detail", "action"], 1.5, 4.0, ["slow"]),
    ("birthday", "main", 0.25, ["people", "action"], 1.5, 4.0, ["slow", "fast"]),
    ("birthday", "climax", 0.20, ["climax", "people"], 2.0, 5.0, ["slow"]),
    ("birthday", "ending", 0.10, ["ending", "people"], 2.0, 5.0, ["static", "slow"]),
    ("drone_cinematic", "intro", 0.15, ["establishing"], 2.5, 6.0, ["slow"]),
    ("drone_cinematic", "development", 0.30, ["location", "establishing"], 2.0, 6.0, ["slow"]),
    ("drone_cinematic", "main", 0.25, ["location", "action"], 2.0, 6.0, ["slow"]),
    ("drone_cinematic", "climax", 0.20, ["climax", "establishing"], 2.5, 6.0, ["slow", "fast"]),
    ("drone_cinematic", "ending", 0.10, ["ending", "establishing"], 3.0, 6.0, ["slow", "static"]),
    ("reels_fast", "intro", 0.10, ["climax", "action", "detail"], 1.0, 2.5, ["fast", "slow"]),
    ("reels_fast", "development", 0.30, ["action", "detail"], 1.0, 2.5, ["fast"]),
    ("reels_fast", "main", 0.30, ["action", "people", "detail"], 1.0, 2.5, ["fast"]),
    ("reels_fast", "climax", 0.20, ["climax", "action"], 1.5, 3.0, ["fast"]),
    ("reels_fast", "ending", 0.10, ["ending", "establishing"], 1.5, 3.0, ["slow"]),
    ("tiktok_clip", "intro", 0.10, ["action", "climax"], 1.0, 2.0, ["fast"]),
    ("tiktok_clip", "development", 0.30, ["action", "detail", "people"], 1.0, 2.5, ["fast"]),
    ("tiktok_clip", "main", 0.30, ["action", "people"], 1.0, 2.5, ["fast"]),
    ("tiktok_clip", "climax", 0.20, ["climax", "action"], 1.5, 3.0, ["fast"]),
    ("tiktok_clip", "ending", 0.10, ["ending"], 1.5, 3.0, ["slow", "static"]),
    ("real_estate", "intro", 0.15, ["establishing"], 2.5, 6.0, ["slow", "static"]),
    ("real_estate", "development", 0.35, ["location", "detail"], 2.0, 5.0, ["slow"]),
    ("real_estate", "main", 0.25, ["location", "detail"], 2.0, 5.0, ["slow", "static"]),
    ("real_estate", "climax", 0.15, ["climax", "location"], 2.5, 5.0, ["slow"]),
    ("real_estate", "ending", 0.10, ["ending", "establishing"], 2.5, 6.0, ["static", "slow"]),
    ("slow_cinematic", "intro", 0.15, ["establishing"], 3.0, 7.0, ["static", "slow"]),
    ("slow_cinematic", "development", 0.35, ["detail", "location"], 2.5, 6.0, ["static", "slow"]),
    ("slow_cinematic", "main", 0.25, ["detail", "location"], 2.5, 6.0, ["slow"]),
    ("slow_cinematic", "climax", 0.15, ["climax", "establishing"], 3.0, 6.0, ["slow"]),
    ("slow_cinematic", "ending", 0.10, ["ending"], 3.0, 7.0, ["static"]),
    ("action_montage", "intro", 0.10, ["action", "establishing"], 1.0, 2.5, ["fast", "slow"]),
    ("action_montage", "development", 0.30, ["action"], 1.0, 2.5, ["fast"]),
    ("action_montage", "main", 0.30, ["action", "detail"], 1.0, 2.5, ["fast"]),
    ("action_montage", "climax", 0.20, ["climax", "action"], 1.5, 3.5, ["fast"]),
    ("action_montage", "ending", 0.10, ["ending", "establishing"], 2.0, 4.0, ["slow"]),
    ("generic", "intro", 0.15, ["establishing", "intro", "location"], 1.5, 5.0, ["slow", "static"]),
    ("generic", "development", 0.30, ["location", "detail", "people"], 1.5, 4.5, []),
    ("generic", "main", 0.25, ["action", "people", "detail"], 1.5, 4.5, []),
    ("generic", "climax", 0.20, ["climax", "action"], 2.0, 5.0, []),
    ("generic", "ending", 0.10, ["ending", "establishing"], 2.0, 5.0, ["slow", "static"]),
]
# style: zone speed, fastest gap, fade, shortest and longest window
STYLES = [
    ("smooth", 1.0, 8.0, 0.5, 3.0, 6.0),
    ("dynamic", 1.2, 12.0, 0.25, 2.5, 5.0),
    ("premium", 1.0, 6.0, 0.6, 3.5, 7.0),
]
ASPECTS = [("9:16", 1080, 1920), ("16:9", 1920, 1080), ("1:1", 1080, 1080)]
# wanted loudness per slot, and the same for presets of high dynamics
SLOT_ENERGY = {"intro": 0.35, "development": 0.6, "main": 0.75, "climax": 1.0, "ending": 0.3}
SLOT_ENERGY_HIGH = {"intro": 0.8, "development": 0.75, "main": 0.85, "climax": 1.0, "ending": 0.4}
# -------------------------------------------------------------------------------------

DEFAULT_PRESET, DEFAULT_STYLE = "generic", "smooth"
PRESET_IDS = [h[0] for h in PRESET_HEADS]


def slot_rows() -> list[tuple]:
    """(preset_id, slot_no, slot, share, types, min, max, motions), lists as text."""
    return [(preset_id, SLOTS.index(slot), slot, share, ",".join(types), lo, hi, ",".join(motions))
            for preset_id, slot, share, types, lo, hi, motions in PRESET_SLOTS]


def preset_slots(spark: SparkSession) -> DataFrame:
    """The 65 preset slots."""
    schema = ("preset_id string, slot_no int, slot string, share double, types string,"
              " min_fragment double, max_fragment double, motions string")
    df = spark.createDataFrame(slot_rows(), schema)
    return df.select(
        "preset_id", "slot_no", "slot", "share", F.split("types", ",").alias("scene_types"),
        "min_fragment", "max_fragment",
        F.when(F.col("motions") == "", F.array().cast("array<string>"))
        .otherwise(F.split("motions", ",")).alias("prefer_motion"))


def preset_heads(spark: SparkSession) -> DataFrame:
    rows = [(*h[:7], h[7] or INTRO_RULE, ENDING_RULE) for h in PRESET_HEADS]
    return spark.createDataFrame(
        rows, "preset_id string, title string, dynamics string, transition string,"
        " transition_s double, sync_to_music boolean, idea string, intro_rule string,"
        " ending_rule string")


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STYLES, "style string, zone_speed double, gap_max double, fade double,"
        " w_min double, w_max double")


def aspects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASPECTS, "aspect string, target_w int, target_h int")


def slot_energy(spark: SparkSession) -> DataFrame:
    rows = [(s, SLOT_ENERGY[s], SLOT_ENERGY_HIGH[s]) for s in SLOTS]
    return spark.createDataFrame(rows, "slot string, energy double, energy_high double")


def list_presets(spark: SparkSession) -> DataFrame:
    """Id, title and dynamics of every preset."""
    return preset_heads(spark).select("preset_id", "title", "dynamics")


def resolve_presets(projects: DataFrame) -> DataFrame:
    """Adds the preset a project really uses (unknown ids fall back) and its scenario
    text: the project's own if it has one, else the preset's."""
    spark = projects.sparkSession
    known = F.broadcast(scenario_text(spark).withColumnRenamed("preset_id", "used_preset"))
    wanted = F.when(F.col("preset_id").isin(PRESET_IDS), F.col("preset_id")).otherwise(DEFAULT_PRESET)
    return (projects.withColumn("used_preset", wanted).join(known, "used_preset")
            .withColumn("scenario", F.coalesce(F.nullif("scenario_text", F.lit("")), "preset_text"))
            .drop("preset_text"))


def scenario_text(spark: SparkSession) -> DataFrame:
    """One text per preset: idea, dynamics, a line per slot, intro and ending rules."""
    percent = F.floor(F.col("share") * 100).cast("int").cast("string")
    line = F.concat(F.lit("- "), "slot", F.lit(" (~"), percent, F.lit("%): типы сцен "),
                    F.concat_ws(", ", "scene_types"))
    lines = (preset_slots(spark).groupBy("preset_id")
             .agg(F.sort_array(F.collect_list(F.struct("slot_no", line.alias("line")))).alias("l")))
    return preset_heads(spark).join(F.broadcast(lines), "preset_id").select(
        "preset_id", F.concat_ws(
            "\n", F.concat(F.lit("Идея ролика: "), "idea"),
            F.concat(F.lit("Динамика: "), "dynamics", F.lit(".")), F.lit("Структура:"),
            F.concat_ws("\n", F.col("l.line")),
            F.concat(F.lit("Вступление: "), "intro_rule"),
            F.concat(F.lit("Финал: "), "ending_rule")).alias("preset_text"))


def _values(rows, names) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else (
            str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


def as_values_sql() -> str:
    return _values(slot_rows(), ["preset_id", "slot_no", "slot", "share", "types",
                                 "min_fragment", "max_fragment", "motions"])


def heads_as_values_sql() -> str:
    rows = [(*h[:7], h[7] or INTRO_RULE, ENDING_RULE) for h in PRESET_HEADS]
    return _values(rows, ["preset_id", "title", "dynamics", "transition", "transition_s",
                          "sync_to_music", "idea", "intro_rule", "ending_rule"])
