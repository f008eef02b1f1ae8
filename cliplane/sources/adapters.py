"""Logical inputs as views over stored tables, in Spark and in SQL.

A deployment reads videos, the work queue, timelines and chunks from its own
tables; here they are mapped from general ones by plain arithmetic, stated twice
so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOT = 600  # seconds of a scene
DAY = 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, d: str) -> DataFrame:
    """One row for each video, flat: identity, status, analysis fields, times."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "analyzed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("video_id"),
        F.substring("text", 1, 60).alias("title"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.substring("text", 61, 40)).alias("analysis_title"),
        F.col("source").alias("category"),
        F.col("text").alias("key_message"),
        (F.col("n_chars") % 11).cast("int").alias("score"),
        status.alias("status"),
        F.timestamp_seconds(F.col("doc_id") * 60).alias("created_at"),
        F.when(status == "analyzed", F.timestamp_seconds("doc_id")).alias("analyzed_at"),
        F.when(status == "failed", F.concat(F.lit("error "), F.col("doc_id").cast("string"))).alias("error"),
        F.concat(F.lit("https://www.tiktok.com/@"), F.col("source"), F.lit("/video/"), F.col("doc_id").cast("string")).alias("url"),
    )


VIDEOS = """videos AS (
  SELECT d.doc_id AS video_id, substring(text, 1, 60) AS title,
         CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE substring(text, 61, 40) END AS analysis_title,
         source AS category, text AS key_message, CAST(n_chars % 11 AS INTEGER) AS score,
         CASE WHEN quality = 1 THEN 'analyzed' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status,
         make_timestamp(d.doc_id * 60000000) AS created_at,
         CASE WHEN quality = 1 THEN make_timestamp(d.doc_id * 1000000) END AS analyzed_at,
         CASE WHEN quality = 0 THEN 'error ' || d.doc_id END AS error,
         'https://www.tiktok.com/@' || source || '/video/' || d.doc_id AS url
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def objects(spark: SparkSession, d: str) -> DataFrame:
    """The work queue."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("error")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_custkey") % 2 == 0, "user").otherwise("content").alias("type"),
        at.alias("added_at"),
        F.when(status == "completed", at + 2 * DAY).alias("completed_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
        F.when(status == "error", "HTTP 403").alias("last_error"),
        F.when(status == "error", at + DAY).alias("last_attempt"),
        F.when(status == "completed", F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"))).alias("file_path"),
    )


OBJECTS = """objects AS (
  SELECT *, CASE WHEN status = 'completed' THEN added_at + 172800 END AS completed_at,
         CASE WHEN status = 'error' THEN 'HTTP 403' END AS last_error,
         CASE WHEN status = 'error' THEN added_at + 86400 END AS last_attempt,
         CASE WHEN status = 'completed' THEN 'out/' || id END AS file_path
  FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'error' END AS status,
               o_orderpriority AS title, CASE WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'content' END AS type,
               CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS added_at, CAST(o_orderkey % 4 AS INTEGER) AS attempts
        FROM orders)
)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Speech segments: (video_id, seg, start, end, text), seconds from the start of the day."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp")) % DAY
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("seg"), start.cast("double").alias("start"), (start + F.col("value")).alias("end"), F.col("event_type").alias("text")
    )


SEGMENTS = """segments AS (
  SELECT user_id AS video_id, event_id AS seg, CAST(s AS DOUBLE) AS "start", s + value AS "end", event_type AS text
  FROM (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 AS s FROM events)
)"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Slots of ten minutes for each video, every fifth one missing; ids count the slots that exist."""
    ids = table(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct()
    slots = ids.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(DAY // SLOT - 1))).alias("slot")).filter("slot % 5 <> 4")
    return slots.select(
        "video_id",
        (F.col("slot") - F.floor(F.col("slot") / 5)).cast("int").alias("scene_id"),
        (F.col("slot") * SLOT).cast("double").alias("start_time"),
        ((F.col("slot") + 1) * SLOT).cast("double").alias("end_time"),
        F.lit(float(SLOT)).alias("duration"),
    )


SCENES = """scenes AS (
  SELECT video_id, CAST(slot - slot // 5 AS INTEGER) AS scene_id, CAST(slot * 600 AS DOUBLE) AS start_time,
         CAST((slot + 1) * 600 AS DOUBLE) AS end_time, CAST(600 AS DOUBLE) AS duration
  FROM (SELECT DISTINCT user_id AS video_id FROM events), (SELECT unnest(range(0, 144)) AS slot) WHERE slot % 5 <> 4
)"""


def ocr_items(spark: SparkSession, d: str) -> DataFrame:
    """On-screen texts: (video_id, scene_id, frame, text); some texts are empty, some scenes don't exist."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) % DAY / SLOT)
    text = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")))
    scene = F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(slot)
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), scene.cast("int").alias("scene_id"), F.col("event_id").alias("frame"), text.alias("text"))


OCR_ITEMS = """ocr_items AS (
  SELECT user_id AS video_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 // 600 AS INTEGER) END AS scene_id,
         event_id AS frame, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || ' ' || event_id END AS text
  FROM events
)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Aligned chunks: (video_id, pos, start, end, stt, ocr); a user's turn is speech, the answer to it on-screen text."""
    c = table(spark, d, "conversations")
    ask = c.filter("role = 'user'").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("pos"), F.col("text").alias("stt"))
    answer = c.filter("role = 'assistant'").select(F.col("conv_id").alias("video_id"), (F.col("turn") - 1).alias("pos"), F.col("text").alias("ocr"))
    start = (F.col("pos") * 5).cast("double")
    return ask.join(answer, ["video_id", "pos"], "left").select(
        "video_id", "pos", start.alias("start"), (start + 4 + F.col("video_id") % 5).alias("end"),
        F.when(F.col("pos") % 6 == 4, F.lit("")).otherwise(F.coalesce("stt", F.lit(""))).alias("stt"), F.coalesce("ocr", F.lit("")).alias("ocr"),
    )


CHUNKS = """chunks AS (
  SELECT u.conv_id AS video_id, u.turn AS pos, CAST(u.turn * 5 AS DOUBLE) AS "start", CAST(u.turn * 5 + 4 + u.conv_id % 5 AS DOUBLE) AS "end",
         CASE WHEN u.turn % 6 = 4 THEN '' ELSE coalesce(u.text, '') END AS stt, coalesce(a.text, '') AS ocr
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """OCR lines: (video_id, pos, line), the lines of a document in order."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = """lines AS (
  SELECT doc_id AS video_id, CAST(p - 1 AS INTEGER) AS pos, l[p] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents)
)"""

_SQL = {"videos": VIDEOS, "objects": OBJECTS, "segments": SEGMENTS, "scenes": SCENES, "ocr_items": OCR_ITEMS, "chunks": CHUNKS, "lines": LINES}


def sql(inputs: str, body: str) -> str:
    """``body`` after the common table expressions of the named inputs; it may begin with more of them (``, name AS (...)``)."""
    return "WITH " + ",\n".join(_SQL[n] for n in inputs.split()) + "\n" + body
