"""Files in, records kept up to date: selection, fingerprints, probes, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.expr import rnd
from ..functions.skew import join_hot

VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv")
AUDIO_EXTENSIONS = ("mp3", "wav", "m4a", "aac", "flac")
HEAD_BYTES = 65536


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path, size_bytes, modified. Nothing of the files themselves is read; empty files
    are not listed."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(F.col("path"), F.lit(root.rstrip("/")).alias("root"), F.col("length").alias("size_bytes"),
                    F.col("modificationTime").alias("modified"), F.lit(False).alias("explicit")))


def with_heads(files: DataFrame, size: int = HEAD_BYTES) -> DataFrame:
    """Adds ``content``, the first ``size`` bytes of each file (path), read in tasks; the rest of a file, of
    whatever length, is not touched. Put few files into a partition: a row holds ``size`` bytes."""

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                heads = [_head(p, size) for p in part.column("path").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], [*part.schema.names, "content"])

    return files.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def _head(path: str, size: int) -> bytes:
    if path.startswith("file:"):
        store, place = pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        store, place = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    with store.open_input_file(place) as source:
        return source.read(size)


def select_media(files: DataFrame, exts: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Media paths of a listing (path, root, explicit), each once. Anything hidden below
    the root is left out, unless the file itself was named."""
    kind = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    below = F.expr("substring(path, instr(path, root) + length(root))")
    hidden = F.contains(below, F.lit("/."))
    return files.filter(kind.isin(list(exts)) & (F.col("explicit") | ~hidden)).select("path").distinct().sort("path")


def fingerprint(files: DataFrame) -> DataFrame:
    """Adds ``fingerprint``: md5 of size and time followed by the first bytes of the file
    (size_bytes, mtime, content)."""
    head = F.encode(F.concat(F.col("size_bytes").cast("string"), F.lit(":"), F.col("mtime").cast("string")), "utf-8")
    return files.withColumn("fingerprint", F.md5(F.concat(head, F.substring("content", 1, HEAD_BYTES))))


def plan_increment(files: DataFrame, videos: DataFrame, scenes: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``action``: ``cached`` for files whose fingerprint belongs to a video that has
    scenes, else ``analyse``. ``force`` analyses everything."""
    if force:
        return files.withColumn("action", F.lit("analyse"))
    with_scenes = scenes.select("video_id").distinct()
    known = (videos.filter(F.coalesce("fingerprint", F.lit("")) != "").groupBy("project_id", "fingerprint")
             .agg(F.max("video_id").alias("video_id")).join(with_scenes, "video_id", "left_semi")
             .select("project_id", "fingerprint", F.lit(True).alias("_known")))
    return (files.join(known, ["project_id", "fingerprint"], "left")
            .withColumn("action", F.when(F.col("_known"), "cached").otherwise("analyse")).drop("_known"))


def supersede(videos: DataFrame, scenes: DataFrame, zones: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """Removes the videos of paths (project_id, path) that are analysed again, with their
    scenes and zones."""
    gone = videos.join(paths.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi").select("video_id")
    return {name: join_hot(df, gone.distinct(), ["video_id"], spread, how="left_anti").select(*df.columns)
            for name, df, spread in (("videos", videos, "path"), ("scenes", scenes, "scene_id"), ("zones", zones, "zone_no"))}


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Rows of ``base`` (one a key) replaced or joined by those of ``delta``; the last by ``order``
    wins. The delta is reduced first, combined before its shuffle, so a key written very often is cheap; of the
    base only rows that no delta row replaces go on, and a small delta does not make it move."""
    rest = [c for c in base.columns if c not in key]
    last = delta.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    new = last.select(*key, *[F.col("_row")[c].alias(c) for c in rest]).select(*base.columns)
    return base.join(new.select(*key), [*key], "left_anti").select(*base.columns).unionByName(new)


def delete_projects(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given projects. Replacements know only their plan, so they go
    by way of the plans."""
    ids = ids.select("project_id").distinct()
    plans = tables["plans"].join(ids, "project_id", "left_semi").select("plan_id")
    out = {name: df.join(ids, "project_id", "left_anti") for name, df in tables.items() if name != "replacements"}
    if "replacements" in tables:
        out["replacements"] = tables["replacements"].join(plans, "plan_id", "left_anti")
    return out


def load_documents(raw: DataFrame, schema: str, defaults: Mapping[str, object], data: str = "data") -> DataFrame:
    """Reads JSON documents: unknown fields are dropped, missing ones take the default."""
    df = raw.withColumn("_d", F.from_json(data, schema))
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col("_d")[name], F.lit(value)))
    return df.drop("_d", data)


def load_segments(raw: DataFrame, data: str = "data") -> DataFrame:
    """Segments of plan documents (plan_id, data), one row each in their order."""
    schema = ("segments ARRAY<STRUCT<scene_id: STRING, `order`: INT, src_start: DOUBLE, src_end: DOUBLE,"
              " slot: STRING, reason: STRING, crop: STRING, beat_synced: BOOLEAN, speed: DOUBLE>>")
    df = raw.select("plan_id", F.posexplode(F.from_json(data, schema)["segments"]).alias("seg_no", "s"))
    return df.select("plan_id", F.col("seg_no").cast("long").alias("seg_no"), "s.scene_id", "s.src_start", "s.src_end",
                     "s.slot", F.coalesce("s.reason", F.lit("")).alias("reason"),
                     F.coalesce("s.crop", F.lit("center")).alias("crop"),
                     F.coalesce("s.beat_synced", F.lit(False)).alias("beat_synced"),
                     F.coalesce("s.speed", F.lit(1.0)).alias("speed"))


_PROBE = ("format STRUCT<duration: STRING, bit_rate: STRING>, streams ARRAY<STRUCT<codec_type: STRING,"
          " codec_name: STRING, width: STRING, height: STRING, avg_frame_rate: STRING, r_frame_rate: STRING,"
          " side_data_list: ARRAY<STRUCT<rotation: STRING>>>>")


def flatten_probe(probe: DataFrame) -> DataFrame:
    """One row of facts per probe record (video_id, probe_json)."""
    df = probe.withColumn("_p", F.from_json("probe_json", _PROBE))
    streams = F.coalesce("_p.streams", F.array())
    pictures = F.filter(streams, lambda s: s["codec_type"] == "video")
    sized = F.filter(pictures, lambda s: F.coalesce(s["width"].try_cast("int"), F.lit(0)) != 0)
    df = df.withColumn("_v", F.coalesce(F.get(sized, F.lit(0)), F.element_at(F.when(F.size(pictures) > 0, pictures), -1)))
    rate = F.coalesce(F.nullif("_v.avg_frame_rate", F.lit("")), F.nullif("_v.r_frame_rate", F.lit("")), F.lit("0/1"))
    parts = F.split(rate, "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ratio = rnd(F.try_divide(num, den), 3)
    turned = F.array_compact(F.transform(F.coalesce("_v.side_data_list", F.array()), lambda s: s["rotation"].try_cast("int")))
    turn = F.abs(F.coalesce(F.try_element_at(turned, F.lit(-1)), F.lit(0)))
    df = (df.withColumn("duration", F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0)))
          .withColumn("bitrate", F.coalesce(F.col("_p.format.bit_rate").try_cast("long"), F.lit(0).cast("long")))
          .withColumn("width", F.coalesce(F.col("_v.width").try_cast("int"), F.lit(0)))
          .withColumn("height", F.coalesce(F.col("_v.height").try_cast("int"), F.lit(0)))
          .withColumn("codec", F.coalesce("_v.codec_name", F.lit("")))
          .withColumn("fps", F.when(F.col("_v").isNull() | (F.size(parts) != 2), 0.0).otherwise(F.coalesce(ratio, F.lit(0.0))))
          .withColumn("has_audio", F.exists(streams, lambda s: s["codec_type"] == "audio"))
          .withColumn("_turn", turn))
    side = F.col("_turn").isin(90, 270)
    w = F.when(side, F.col("height")).otherwise(F.col("width"))
    h = F.when(side, F.col("width")).otherwise(F.col("height"))
    shape = F.when(F.col("_v").isNull(), "").when(w > h, "horizontal").when(h > w, "vertical").otherwise("square")
    return (df.withColumn("orientation", shape).withColumn("valid", (F.col("duration") > 0) & (F.col("width") != 0))
            .drop("_p", "_v", "_turn", "probe_json"))


def replace_zones(zones: DataFrame, new: DataFrame, videos: DataFrame) -> DataFrame:
    """The zones of the given videos are exchanged for the new set."""
    rest = join_hot(zones, videos.select("video_id").distinct(), ["video_id"], "zone_no", how="left_anti")
    return rest.select(*zones.columns).unionByName(new.select(*zones.columns))


def delete_zones(zones: DataFrame, keys: DataFrame) -> DataFrame:
    """Zones without the given (video_id, zone_no)."""
    return zones.join(keys.select("video_id", "zone_no"), ["video_id", "zone_no"], "left_anti")
