"""The driver's tables in the shapes the operators take.

Each shape is given once as column expressions that mean the same in Spark and in the
oracle engine. Row numbers are the exception: Spark takes them from ``number_rows``,
which never sorts one whole key in one task; the oracle text uses ROW_NUMBER."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaplan.functions.sequences import number_rows
from mediaplan.operators import presets
from mediaplan.sources.tables import keep

SCENE_COLS = """o_orderkey AS scene_id, o_custkey AS video_id,
 CAST(floor(o_custkey / 1e1) AS BIGINT) AS project_id, 1e1 * n AS start_s,
 2e0 + (o_orderkey % 17) * 5e-1 AS dur,
 (o_orderkey * 7919 % 1000) / 1e3 AS quality_score,
 CASE WHEN o_orderkey % 7 = 0 THEN 0e0 ELSE (o_orderkey * 10473 % 1000) / 1e3 END AS aesthetic_score,
 (o_orderkey * 31 % 100) / 1e2 AS jerkiness,
 1e0 - (o_orderkey * 31 % 100) / 1e2 AS stability_score,
 split_part('static,slow,fast', ',', CAST(o_orderkey % 3 + 1 AS INT)) AS motion,
 CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey * 31 % 100 >= 50 THEN 'shake' ELSE 'pan' END AS motion_type,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE split_part('intro,establishing,detail,action,people,location,food,product,transition,climax,ending', ',', CAST(o_orderkey * 5 % 11 + 1 AS INT)) END AS scene_type,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE split_part('intro,development,main,climax,ending', ',', CAST(o_orderkey * 3 % 5 + 1 AS INT)) END AS recommended_slot,
 CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_orderkey % 3 ELSE 0 END AS people_count,
 CASE o_orderkey % 41 WHEN 0 THEN 'pinned' WHEN 1 THEN 'banned' WHEN 2 THEN 'good' WHEN 3 THEN 'bad' ELSE '' END AS user_flag,
 CASE WHEN o_orderkey % 7 = 0 THEN 'pending' WHEN o_orderkey % 29 = 0 THEN 'failed' ELSE 'done' END AS llm_status,
 CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE (o_orderkey * 613 % 1000) / 1e3 END AS scenario_match_score,
 CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 29 = 0 THEN '' ELSE 'Shot of ' || lower(o_orderpriority) || ' at ' || lower(o_orderstatus) END AS description,
 CASE WHEN o_orderkey % 43 = 5 THEN 'not-usable' WHEN o_orderkey % 3 <> 0 AND o_orderkey * 31 % 100 >= 50 THEN 'jerky' ELSE 'plain' END AS tag"""

SCENE_MORE = "s.*, start_s + dur AS end_s, start_s + dur * 5e-1 AS best_moment"

SAMPLE_COLS = """user_id AS video_id, n, n / 2e1 AS t20, n / 8e0 AS t8,
 ((event_id * 37) % 41 - 20) / 2e0 AS dx, ((event_id * 53) % 23 - 11) / 2e0 AS dy,
 value AS diff, value AS rms, event_type, event_id"""

PHRASE_COLS = """conv_id AS video_id, turn, turn * 4e0 AS p_start,
 turn * 4e0 + 1e0 + (length(text) % 40) / 1e1 AS p_end, text, (length(text) % 10) / 1e1 AS no_speech_prob"""

REPLY_COLS = """event_id AS scene_id, props AS clean, CASE event_id % 6 WHEN 0 THEN props
 WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Answer: ' || props || ' done'
 WHEN 3 THEN props || chr(10) || chr(10) || '   ' WHEN 4 THEN replace(props, '}', ', "re') ELSE 'no json here' END AS content"""

PROBE_COLS = """c_custkey AS video_id, '{"format":{"duration":"' || CAST(c_custkey % 300 AS VARCHAR(20)) || '.5","bit_rate":"' || CAST(1000 + c_custkey AS VARCHAR(20)) ||
 '"},"streams":[{"codec_type":"video","codec_name":"h264","width":' || CASE c_custkey % 3 WHEN 0 THEN '1920,"height":1080' WHEN 1 THEN '1080,"height":1920' ELSE '1080,"height":1080' END ||
 ',"avg_frame_rate":"' || CASE c_custkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '50/1' ELSE '0/0' END || '"' ||
 CASE WHEN c_custkey % 5 = 0 THEN ',"side_data_list":[{"rotation":-90}]' ELSE '' END || '}' ||
 CASE WHEN c_custkey % 2 = 0 THEN ',{"codec_type":"audio","codec_name":"aac"}' ELSE '' END || ']}' AS probe_json"""

SEGMENT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber",
                 "l_extendedprice", "l_discount", "l_tax"]

SEGMENT_COLS = """l_orderkey AS plan_id, n AS seg_no,
 l_partkey % 200 * 1e0 AS src_start, l_partkey % 200 * 1e0 + 1e0 + l_quantity / 1e1 AS src_end,
 CASE WHEN l_linenumber % 3 = 0 THEN 3e0 ELSE 1e0 END AS speed, l_partkey AS scene_id,
 split_part('intro,development,main,climax,ending', ',', CAST(l_partkey % 5 + 1 AS INT)) AS slot"""

FILE_COLS = """page_id AS file_id, url AS path, length(html) AS size_bytes, page_id * 1000 AS mtime_ms,
 md5(CAST(length(html) AS VARCHAR(20)) || ':' || CAST(page_id % 40 AS VARCHAR(20))) AS fingerprint,
 page_id % 10 AS project_id"""

# projects: ten customers each; settings spread over all presets, styles and lengths
PROJECT_COLS = """project_id, split_part('{ids},unknown', ',', CAST(project_id % 14 + 1 AS INT)) AS preset_id,
 2e1 + project_id % 5 * 1e1 AS target_duration, project_id % 10 = 3 AS stabilize_shaky,
 split_part('smooth,dynamic,premium,other', ',', CAST(project_id % 4 + 1 AS INT)) AS fpv_style,
 CASE WHEN project_id % 3 = 0 THEN 0e0 ELSE project_id % 4 * 4e-1 END AS pause_out,
 CASE WHEN project_id % 6 = 0 THEN 'Own story ' || CAST(project_id AS VARCHAR(20)) ELSE '' END AS scenario_text,
 split_part('9:16,16:9,1:1', ',', CAST(project_id % 3 + 1 AS INT)) AS aspect,
 project_id * 7919 % 1000 * 1e0 AS created_at""".format(ids=",".join(presets.PRESET_IDS))

VIDEO_COLS = """c_custkey AS video_id, CAST(floor(c_custkey / 1e1) AS BIGINT) AS project_id,
 '/media/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR(20)) || '.mp4' AS path,
 CASE c_custkey % 6 WHEN 0 THEN 25e0 WHEN 1 THEN 50e0 WHEN 2 THEN 2997e-2 WHEN 3 THEN 0e0 WHEN 4 THEN 60e0 ELSE 2498e-2 END AS fps,
 CASE c_custkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1080 WHEN 2 THEN 3840 ELSE 1279 END AS width,
 CASE c_custkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 2160 ELSE 1279 END AS height,
 split_part('horizontal,vertical,square', ',', CAST(c_custkey % 3 + 1 AS INT)) AS orientation,
 c_custkey % 4 = 0 AS fpv_showroom, 1000 + c_custkey AS file_bytes"""

ZONE_AGG = """MIN(start_s) AS z_start, MAX(end_s) AS z_end"""
ZONE_COLS = """video_id, g AS zone_no, z_start, z_end,
 (video_id % 5 = 0 AND g = 0) AS technical, NOT (video_id % 5 = 0 AND g = 0) AS required,
 'zone ' || CAST(g + 1 AS VARCHAR(20)) AS title"""

# one cue request per project: which track, which preset, how long the film is
CUE_COLS = """project_id AS plan_id, preset_id, target_duration,
 project_id AS track_id"""


def exprs(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "([":
            depth += 1
        elif not quoted and ch in ")]":
            depth -= 1
        elif ch == "," and not quoted and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


class shape:
    """A derived table; the stored copy where ``settle`` has made one."""

    def __init__(self, fn):
        self.fn, self.name = fn, fn.__name__

    def __get__(self, fx, owner=None) -> DataFrame:
        return fx.kept[self.name] if self.name in fx.kept else self.fn(fx)


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.kept = spark, sf_dir, {}

    def settle(self, *names: str) -> Fixtures:
        """Write derived tables once, for queries that read them many times."""
        for name in names:
            if name not in self.kept:
                self.kept[name] = keep(getattr(self, name), name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @shape
    def scenes(self) -> DataFrame:
        orders = number_rows(
            self.table("orders"), ["o_custkey"],
            F.year("o_orderdate") * 12 + F.month("o_orderdate"),
            ["o_orderdate", "o_orderkey"])
        return (orders.selectExpr(*exprs(SCENE_COLS)).alias("s")
                .selectExpr(*exprs(SCENE_MORE)))

    @shape
    def tokens(self) -> DataFrame:
        line, part = self.table("lineitem"), self.table("part")
        return (line.join(part, line.l_partkey == part.p_partkey)
                .select(F.col("l_orderkey").alias("scene_id"), F.col("p_type").alias("token"))
                .distinct())

    @shape
    def samples(self) -> DataFrame:
        events = self.table("events")
        hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
        return number_rows(events, ["user_id"], hour, ["ts", "event_id"]).selectExpr(
            *exprs(SAMPLE_COLS))

    @shape
    def frames(self) -> DataFrame:
        vecs = number_rows(self.table("embeddings"), ["label"], F.floor(F.col("vec_id") / 256),
                           ["vec_id"])
        return vecs.selectExpr("label AS video_id", "vec_id", "embedding", "n AS frame_no")

    @shape
    def phrases(self) -> DataFrame:
        return self.table("conversations").selectExpr(*exprs(PHRASE_COLS))

    @shape
    def replies(self) -> DataFrame:
        return self.table("events").selectExpr(*exprs(REPLY_COLS))

    @shape
    def probe(self) -> DataFrame:
        return self.table("customer").selectExpr(*exprs(PROBE_COLS))

    @shape
    def zones(self) -> DataFrame:
        g = F.floor(F.col("start_s") / 30).cast("long").alias("g")
        return (self.scenes.groupBy("video_id", g)
                .agg(*[F.expr(e) for e in exprs(ZONE_AGG)]).selectExpr(*exprs(ZONE_COLS)))

    @shape
    def segments(self) -> DataFrame:
        line = number_rows(self.table("lineitem"), ["l_orderkey"],
                           F.year("l_shipdate") * 12 + F.month("l_shipdate"), SEGMENT_ORDER)
        return line.selectExpr(*exprs(SEGMENT_COLS))

    @shape
    def shown(self) -> DataFrame:
        """The scene of every segment, for queries that do not ask for its place or span: nothing is sorted."""
        line = self.table("lineitem").filter("l_orderkey IS NOT NULL AND l_shipdate IS NOT NULL")  # those that have a place
        return line.selectExpr("l_orderkey AS plan_id", "l_partkey AS scene_id")

    @shape
    def shot(self) -> DataFrame:
        """The video of every scene, for queries that do not ask when it plays: nothing is sorted."""
        orders = self.table("orders").filter("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")  # those that have a place
        return orders.selectExpr("o_orderkey AS scene_id", "o_custkey AS video_id")

    @shape
    def cuts(self) -> DataFrame:
        return self.samples.filter("event_type <> 'view'").selectExpr(
            "video_id AS track_id", "n * 75e-2 AS cut_t")

    @shape
    def files(self) -> DataFrame:
        return self.table("pages").selectExpr(*exprs(FILE_COLS))

    @shape
    def projects(self) -> DataFrame:
        return (self.table("customer")
                .selectExpr("CAST(floor(c_custkey / 1e1) AS BIGINT) AS project_id").distinct()
                .selectExpr(*exprs(PROJECT_COLS)))

    @shape
    def videos(self) -> DataFrame:
        return self.table("customer").selectExpr(*exprs(VIDEO_COLS))

    @shape
    def rms(self) -> DataFrame:
        """Loudness frames of a track, 1.1 s apart so that some seconds stay empty."""
        return self.samples.selectExpr("video_id AS track_id", "n * 11e-1 AS t", "rms")

    @shape
    def tracks(self) -> DataFrame:
        return self.samples.groupBy("video_id").agg(F.max("n").alias("n")).selectExpr(
            "video_id AS track_id", "n * 11e-1 + 1e0 AS duration",
            "'/music/' || CAST(video_id AS VARCHAR(20)) || '.mp3' AS path",
            "n * 100 AS size_bytes", "n * 7 AS mtime_ms", "60 + n % 90 AS bpm")

    @shape
    def beats(self) -> DataFrame:
        return self.samples.selectExpr("video_id AS track_id", "n AS beat_no", "n * 5e-1 AS beat_t")

    @shape
    def cues(self) -> DataFrame:
        return self.projects.selectExpr(*exprs(CUE_COLS))


_CTE = {
    "fx_scenes": f"""SELECT {SCENE_MORE} FROM (SELECT {SCENE_COLS} FROM (
 SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders o) q) s""",
    "fx_tokens": "SELECT DISTINCT l_orderkey AS scene_id, p_type AS token FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fx_samples": f"""SELECT {SAMPLE_COLS} FROM (
 SELECT e.*, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events e) q""",
    "fx_frames": "SELECT label AS video_id, vec_id, embedding, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no FROM embeddings",
    "fx_phrases": f"SELECT {PHRASE_COLS} FROM conversations",
    "fx_replies": f"SELECT {REPLY_COLS} FROM events",
    "fx_probe": f"SELECT {PROBE_COLS} FROM customer",
    "fx_zones": f"""SELECT {ZONE_COLS} FROM (SELECT video_id, CAST(floor(start_s / 3e1) AS BIGINT) AS g, {ZONE_AGG}
 FROM fx_scenes GROUP BY 1, 2) q""",
    "fx_segments": f"""SELECT {SEGMENT_COLS} FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY
 {", ".join(SEGMENT_ORDER)}) - 1 AS n FROM lineitem l) q""",
    "fx_cuts": "SELECT video_id AS track_id, n * 75e-2 AS cut_t FROM fx_samples WHERE event_type <> 'view'",
    "fx_files": f"SELECT {FILE_COLS} FROM pages",
    "fx_projects": f"SELECT {PROJECT_COLS} FROM (SELECT DISTINCT CAST(floor(c_custkey / 1e1) AS BIGINT) AS project_id FROM customer) q",
    "fx_videos": f"SELECT {VIDEO_COLS} FROM customer",
    "fx_rms": "SELECT video_id AS track_id, n * 11e-1 AS t, rms FROM fx_samples",
    "fx_tracks": """SELECT video_id AS track_id, n * 11e-1 + 1e0 AS duration,
 '/music/' || CAST(video_id AS VARCHAR(20)) || '.mp3' AS path, n * 100 AS size_bytes, n * 7 AS mtime_ms, 60 + n % 90 AS bpm
 FROM (SELECT video_id, MAX(n) AS n FROM fx_samples GROUP BY video_id) q""",
    "fx_beats": "SELECT video_id AS track_id, n AS beat_no, n * 5e-1 AS beat_t FROM fx_samples",
    "fx_cues": f"SELECT {CUE_COLS} FROM fx_projects",
    "fx_presets": presets.as_values_sql(),
    "fx_preset_heads": presets.heads_as_values_sql(),
}


def oracle(body: str) -> str:
    """Put the fixture views a query names in front of it."""
    needed: list[str] = []

    def need(text: str):
        for name in _CTE:
            if name not in needed and _names(name, text):
                need(_CTE[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    body = body.strip()
    parts = [f"{n} AS ({_CTE[n]})" for n in needed]
    if body.upper().startswith("WITH "):
        body = body[5:].lstrip()
        if body.upper().startswith("RECURSIVE "):
            body = body[10:].lstrip()
        return "WITH RECURSIVE " + ",\n".join([*parts, body])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _names(name: str, text: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", text) is not None
