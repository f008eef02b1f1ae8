"""Queries over timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.operators import gaps, ranges, timeline
from cliplane.plans.registry import query
from cliplane.sources.adapters import chunks, lines, ocr_items, scenes, segments, sql, table

ALIGNED = """aligned AS (SELECT s.video_id, seg, "start", "end", text, ("start" + "end") / 2 AS mid, scene_id FROM segments s JOIN scenes c
  ON s.video_id = c.video_id AND ("start" + "end") / 2 >= start_time AND ("start" + "end") / 2 < end_time)"""
MERGED = f"""{ALIGNED}, speech AS (SELECT video_id, scene_id, string_agg(text, ' ' ORDER BY "start", seg) FILTER (text <> '') AS stt FROM aligned GROUP BY ALL),
shown AS (SELECT video_id, coalesce(scene_id, 0) AS scene_id, string_agg(text, chr(10) ORDER BY frame) FILTER (text <> '') AS ocr FROM ocr_items GROUP BY ALL),
merged AS (SELECT video_id, scene_id, start_time, end_time, coalesce(stt, '') AS stt_text, coalesce(ocr, '') AS ocr_text, concat_ws(chr(10), '[SPOKEN] ' || stt, '[ON-SCREEN] ' || ocr) AS combined_text,
  stt IS NOT NULL AS has_speech, ocr IS NOT NULL AS has_text FROM scenes LEFT JOIN speech USING (video_id, scene_id) LEFT JOIN shown USING (video_id, scene_id))"""
LABELLED = """labelled AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS chunk_id, "end" - "start" AS duration,
  CASE WHEN trim(stt) <> '' AND trim(ocr) <> '' THEN 'both' WHEN trim(stt) <> '' THEN 'stt' WHEN trim(ocr) <> '' THEN 'ocr' ELSE 'none' END AS source FROM chunks)"""
TIMES = """times AS (SELECT user_id AS video_id, list_sort(list_distinct(list(t))) AS ts, CAST(max(t) + 5 AS DOUBLE) AS duration FROM (SELECT user_id, CAST(event_id % 997 AS DOUBLE) / 4 AS t FROM events) GROUP BY user_id),
folded AS (SELECT video_id, duration, CASE WHEN len(ts) = 0 THEN ts ELSE list_reduce(list_transform(ts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 1.0 THEN list_concat(a, x) ELSE a END) END AS kept FROM times)"""
CHANGES = f"""{TIMES}, points AS (SELECT video_id, duration, list_concat(list_concat([CAST(0 AS DOUBLE)], kept), [duration]) AS p FROM folded),
pairs AS (SELECT video_id, i, p[i] AS s, p[i + 1] AS e FROM (SELECT *, unnest(range(1, len(p))) AS i FROM points)),
found AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS scene_id, round_even(s, 2) AS start_time, round_even(e, 2) AS end_time, round_even(e - s, 2) AS duration FROM pairs WHERE e - s >= 0.5)"""


def _time_rows(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("video_id"), ((F.col("event_id") % 997).cast("double") / 4).alias("t"))


def _times(spark, d) -> DataFrame:
    # Distinct before they are collected: at most 997 times of a video meet in a row.
    return _time_rows(spark, d).distinct().groupBy("video_id").agg(F.collect_list("t").alias("ts"), (F.max("t") + 5).alias("duration"))


def _changes(spark, d) -> DataFrame:
    times = _time_rows(spark, d)
    return timeline.scenes_between(gaps.kept_times(times, timeline.MIN_GAP), times.groupBy("video_id").agg((F.max("t") + 5).alias("duration")))


@query("j_1_midpoint_join", sql("segments scenes", f", {ALIGNED} SELECT * FROM aligned"))
def j_1(spark, d) -> DataFrame:
    return timeline.align_segments(segments(spark, d), scenes(spark, d)).select("video_id", "seg", "start", "end", "text", "mid", "scene_id")


@query("j_2_merge", sql("segments scenes ocr_items", f", {MERGED} SELECT * FROM merged"))
def j_2(spark, d) -> DataFrame:
    return timeline.merge(scenes(spark, d), segments(spark, d), ocr_items(spark, d))


@query("a_6_scene_counts", sql("segments scenes ocr_items", f""", {MERGED} SELECT video_id, count(*) AS scenes, count(*) FILTER (has_speech) AS scenes_with_speech, count(*) FILTER (has_text) AS scenes_with_text FROM merged GROUP BY video_id"""))
def a_6(spark, d) -> DataFrame:
    return timeline.scene_counts(timeline.merge(scenes(spark, d), segments(spark, d), ocr_items(spark, d)))


@query("p_16_source_label", sql("chunks", f", {LABELLED} SELECT video_id, chunk_id, source, duration FROM labelled"))
def p_16(spark, d) -> DataFrame:
    return timeline.label_sources(chunks(spark, d)).select("video_id", "chunk_id", "source", "duration")


@query("a_5_timeline_stats", sql("chunks", f""", {LABELLED} SELECT video_id, count(*) AS total, count(*) FILTER (source IN ('stt', 'both')) AS with_stt, count(*) FILTER (source IN ('ocr', 'both')) AS with_ocr,
count(*) FILTER (source = 'both') AS with_both, count(*) FILTER (source = 'none') AS empty, sum(duration) AS duration,
CASE WHEN sum(duration) > 0 THEN round_even(coalesce(sum(duration) FILTER (source IN ('stt', 'both')), 0) / sum(duration), 2) ELSE 0 END AS stt_coverage,
CASE WHEN sum(duration) > 0 THEN round_even(coalesce(sum(duration) FILTER (source IN ('ocr', 'both')), 0) / sum(duration), 2) ELSE 0 END AS ocr_coverage FROM labelled GROUP BY video_id"""))
def a_5(spark, d) -> DataFrame:
    return timeline.stats(timeline.label_sources(chunks(spark, d)))


@query("w_4_sliding_windows", sql("chunks", """, b AS (SELECT video_id, min("start") AS lo, max("end") AS hi FROM chunks GROUP BY video_id),
w AS (SELECT video_id, round_even(lo + k * CAST(8 AS DOUBLE), 6) AS w_start, least(round_even(lo + k * CAST(8 AS DOUBLE), 6) + 10, hi) AS w_end
  FROM (SELECT *, unnest(range(0, CASE WHEN hi - lo <= 10 THEN 1 ELSE CAST(ceil((hi - lo) / 8) AS BIGINT) END)) AS k FROM b))
SELECT w.video_id, w_start, w_end, count(*) AS n_chunks, coalesce(string_agg(stt, ' ' ORDER BY pos) FILTER (stt <> ''), '') AS stt_text, coalesce(string_agg(ocr, ' ' ORDER BY pos) FILTER (ocr <> ''), '') AS ocr_text,
row_number() OVER (PARTITION BY w.video_id ORDER BY w_start) - 1 AS window_id
FROM w JOIN chunks c ON c.video_id = w.video_id AND c."start" < w_end AND c."end" > w_start GROUP BY w.video_id, w_start, w_end"""))
def w_4(spark, d) -> DataFrame:
    """J-3 (overlap join) inside W-4 (sliding windows), texts by A-7."""
    return timeline.windows(chunks(spark, d))


@query("a_14_time_bounds", sql("chunks", 'SELECT video_id, min("start") AS lo, max("end") AS hi FROM chunks GROUP BY video_id'))
def a_14(spark, d) -> DataFrame:
    return chunks(spark, d).groupBy("video_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))


@query("a_7_ordered_concat", "SELECT conv_id AS video_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS script FROM conversations WHERE text <> '' GROUP BY conv_id")
def a_7(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.filter("text <> ''").groupBy(F.col("conv_id").alias("video_id")).agg(timeline.joined_text((F.col("turn"),), F.col("text"), "\n\n").alias("script"))


@query("a_7_script_parts", """WITH x AS (SELECT conv_id, turn, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM conversations WHERE text <> '')
SELECT conv_id AS video_id, o // 300 AS part, greatest(min(o) - 2, 0) AS "offset", CASE WHEN min(o) > 0 THEN chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM x GROUP BY conv_id, o // 300""")
def a_7_parts(spark, d) -> DataFrame:
    """Scripts in parts of 300 characters, so that no row holds a video's script."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), "turn", "text")
    return ranges.texts_in_parts(rows, "video_id", ("turn", "text"), "text", "\n\n", 300)


@query("a_15_ocr_by_scene", sql("ocr_items", "SELECT video_id, coalesce(scene_id, 0) AS scene_id, list(frame ORDER BY frame) AS frames FROM ocr_items GROUP BY ALL"))
def a_15(spark, d) -> DataFrame:
    return ocr_items(spark, d).groupBy("video_id", F.coalesce("scene_id", F.lit(0)).alias("scene_id")).agg(F.array_sort(F.collect_list("frame")).alias("frames"))


@query("w_3_min_gap", sql("chunks", f", {TIMES} SELECT video_id, kept FROM folded"))
def w_3(spark, d) -> DataFrame:
    """The times are kept as rows; only the answer has a list for each video."""
    return gaps.kept_times(_time_rows(spark, d), timeline.MIN_GAP).groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("kept"))


@query("w_3_min_gap_in_row", sql("chunks", f", {TIMES} SELECT video_id, kept FROM folded"))
def w_3b(spark, d) -> DataFrame:
    """The fold within a row, for videos whose times are a short array already."""
    return _times(spark, d).select("video_id", timeline.kept_gaps(F.col("ts")).alias("kept"))


@query("w_2_scenes_from_changes", sql("chunks", f", {CHANGES} SELECT * FROM found"))
def w_2(spark, d) -> DataFrame:
    return _changes(spark, d)


@query("w_5_keyframes", sql("chunks", f""", {CHANGES}, n AS (SELECT *, least(2, greatest(1, 10 // count(*) OVER (PARTITION BY video_id))) AS n, least(0.2::DOUBLE, 0.1::DOUBLE * duration) AS m FROM found),
f AS (SELECT *, CASE WHEN duration - 2 * m <= 0 OR n = 1 THEN (start_time + end_time) / 2 ELSE start_time + m + (i + 0.5::DOUBLE) * (duration - 2 * m) / n END AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id, i) - 1 AS frame_id FROM f)
SELECT video_id, scene_id, frame_id, round_even(t, 2) AS "timestamp" FROM r WHERE frame_id < 10"""))
def w_5(spark, d) -> DataFrame:
    """W-5 frame times, J-9 expansion, W-8 cap."""
    return timeline.keyframes(_changes(spark, d))


@query("w_8_successful_frames", sql("chunks", f""", {CHANGES}, n AS (SELECT *, least(2, greatest(1, 10 // count(*) OVER (PARTITION BY video_id))) AS n, least(0.2::DOUBLE, 0.1::DOUBLE * duration) AS m FROM found),
f AS (SELECT *, CASE WHEN duration - 2 * m <= 0 OR n = 1 THEN (start_time + end_time) / 2 ELSE start_time + m + (i + 0.5::DOUBLE) * (duration - 2 * m) / n END AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id, i) - 1 AS frame_id FROM f WHERE (video_id + scene_id * 3 + i) % 4 <> 0)
SELECT video_id, scene_id, frame_id, round_even(t, 2) AS "timestamp" FROM r WHERE frame_id < 10"""))
def w_8(spark, d) -> DataFrame:
    """Of the planned frames every fourth can't be read; those don't count toward the cap."""
    found = _changes(spark, d)
    read = timeline.planned_frames(found).filter((F.col("video_id") + F.col("scene_id") * 3 + F.col("i")) % 4 != 0)
    return timeline.keyframes(found, read)


@query("w_6_audio_plan", """SELECT doc_id AS video_id, chunk_id, chunk_id * 120::DOUBLE AS "start", CASE WHEN dur <= 130 THEN dur ELSE least((chunk_id + 1) * 120::DOUBLE, dur) END AS "end"
FROM (SELECT doc_id, dur, unnest(range(0, CASE WHEN dur <= 130 THEN 1 ELSE CAST(floor(dur / 120) AS BIGINT) + 1 END)) AS chunk_id FROM (SELECT doc_id, CAST(n_chars % 1441 AS DOUBLE) AS dur FROM documents))
WHERE chunk_id = 0 OR least((chunk_id + 1) * 120::DOUBLE, dur) > chunk_id * 120::DOUBLE""")
def w_6(spark, d) -> DataFrame:
    return timeline.audio_plan(table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), (F.col("n_chars") % 1441).cast("double").alias("duration")))


@query("w_10_segment_offset", """WITH p AS (SELECT doc_id, chunk_id, chunk_id * 120::DOUBLE AS s, CASE WHEN dur <= 130 THEN dur ELSE least((chunk_id + 1) * 120::DOUBLE, dur) END AS e
FROM (SELECT doc_id, dur, unnest(range(0, CASE WHEN dur <= 130 THEN 1 ELSE CAST(floor(dur / 120) AS BIGINT) + 1 END)) AS chunk_id FROM (SELECT doc_id, CAST(n_chars % 1441 AS DOUBLE) AS dur FROM documents)))
SELECT doc_id AS video_id, chunk_id, n, s + CASE WHEN (doc_id + chunk_id) % 3 = 0 THEN 0 ELSE n * 2::DOUBLE END AS "start", s + CASE WHEN (doc_id + chunk_id) % 3 = 0 THEN e - s ELSE n * 2 + 1.5::DOUBLE END AS "end",
CASE WHEN (doc_id + chunk_id) % 3 = 0 THEN 'part ' || chunk_id ELSE 's' || n END AS text
FROM (SELECT *, unnest(range(0, CASE WHEN (doc_id + chunk_id) % 3 = 0 THEN 1 ELSE (doc_id + chunk_id) % 3 END)) AS n FROM p WHERE (chunk_id = 0 OR e > s) AND (doc_id + chunk_id) % 7 <> 0 AND (doc_id + chunk_id) % 5 <> 0)""")
def w_10(spark, d) -> DataFrame:
    plan = timeline.audio_plan(table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), (F.col("n_chars") % 1441).cast("double").alias("duration")))
    mix = F.col("video_id") + F.col("chunk_id")
    one = lambda i: F.struct((i * F.lit(2.0)).alias("start"), (i * 2 + F.lit(1.5)).alias("end"), F.concat(F.lit("s"), i.cast("string")).alias("text"))
    said = F.when(mix % 3 == 0, F.array().cast("array<struct<start:double,end:double,text:string>>")).otherwise(F.transform(F.sequence(F.lit(0), (mix % 3).cast("int") - 1), one))
    heard = plan.select("video_id", "chunk_id", (mix % 7 != 0).alias("success"), F.when(mix % 5 == 0, "").otherwise(F.concat(F.lit("part "), F.col("chunk_id").cast("string"))).alias("text"), said.alias("segments"))
    return timeline.shift_segments(plan, heard)


@query("w_7_first_lines", sql("lines", "SELECT video_id, min(pos) AS pos, arg_min(line, pos) AS line FROM lines GROUP BY video_id, lower(line)"))
def w_7(spark, d) -> DataFrame:
    return timeline.first_lines(lines(spark, d))


@query("w_1_position_ids", sql("scenes", "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_time) - 1 AS scene_id, start_time FROM scenes"))
def w_1(spark, d) -> DataFrame:
    return timeline.numbered(scenes(spark, d).drop("scene_id"), "scene_id", "start_time").select("video_id", "scene_id", "start_time")


@query("t_7_event_windows", """SELECT epoch(date_trunc('second', ts))::BIGINT // 480 * 480 - 480 * k AS start_s, event_type, count(*) AS n
FROM (SELECT *, unnest(range(0, 2)) AS k FROM events) WHERE epoch(date_trunc('second', ts))::BIGINT < epoch(date_trunc('second', ts))::BIGINT // 480 * 480 - 480 * k + 600 GROUP BY ALL""")
def t_7(spark, d) -> DataFrame:
    """Windows over event time, aligned to the epoch (an extension; the timeline's own windows start with the video)."""
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.groupBy(F.window("ts", "600 seconds", "480 seconds").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n")
