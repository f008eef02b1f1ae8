import pytest
from pyspark.sql import functions as F

from cliplane.operators import timeline


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


CHUNKS = [(1, 0, 0.0, 5.0, "Xin chào các bạn.", "Bước 1: Chuẩn bị"), (1, 1, 5.0, 12.0, "Hôm nay mình sẽ hướng dẫn.", ""), (1, 2, 12.0, 20.0, "", "Bước 2: Thực hiện")]
COLUMNS = "video_id long, pos int, start double, end double, stt string, ocr string"


def test_sources_and_stats(spark):
    chunks = spark.createDataFrame(CHUNKS, COLUMNS)
    labelled = timeline.label_sources(chunks)
    assert [r.source for r in labelled.orderBy("chunk_id").collect()] == ["both", "stt", "ocr"]
    got = timeline.stats(labelled).first()
    assert (got.total, got.with_stt, got.with_ocr, got.with_both, got.empty, got.duration, got.stt_coverage, got.ocr_coverage) == (3, 2, 2, 1, 0, 20.0, 0.6, 0.65)


def test_windows(spark):
    got = rows(timeline.windows(spark.createDataFrame(CHUNKS, COLUMNS)).select("window_id", "w_start", "w_end", "n_chunks"), "window_id")
    assert got == [(0, 0.0, 10.0, 2), (1, 8.0, 18.0, 2), (2, 16.0, 20.0, 1)]
    with pytest.raises(ValueError):
        timeline.windows(spark.createDataFrame(CHUNKS, COLUMNS), 2.0, 2.0)


def test_merge(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 5.0, 5.0), (1, 1, 5.0, 12.0, 7.0)], "video_id long, scene_id int, start_time double, end_time double, duration double")
    segments = spark.createDataFrame([(1, 0, 0.5, 2.0, "Xin chào các bạn."), (1, 1, 5.5, 8.0, "x"), (1, 2, 4.0, 6.0, "on the edge"), (1, 3, 11.0, 13.0, "at the end")], "video_id long, seg long, start double, end double, text string")
    ocr = spark.createDataFrame([(1, 0, 0, "Bước 1: Chuẩn bị"), (1, 1, 1, "b"), (1, 9, 2, "nowhere"), (1, None, 3, "")], "video_id long, scene_id int, frame long, text string")
    aligned = {r.seg: r.scene_id for r in timeline.align_segments(segments, scenes).collect()}
    assert aligned == {0: 0, 1: 1, 2: 1}
    got = timeline.merge(scenes, segments, ocr).orderBy("scene_id").collect()
    assert got[0].combined_text == "[SPOKEN] Xin chào các bạn.\n[ON-SCREEN] Bước 1: Chuẩn bị"
    assert (got[1].stt_text, got[1].ocr_text) == ("on the edge x", "b")


def test_folds(spark):
    one = spark.createDataFrame([(1, [0.3, 5.0], 12.0), (2, [], 12.0), (3, [], 0.0)], "video_id long, changes array<double>, duration double")
    got = rows(timeline.scenes_from_changes(one).select("video_id", "scene_id", "start_time", "end_time"), "video_id", "scene_id")
    assert got == [(1, 0, 0.3, 5.0), (1, 1, 5.0, 12.0), (2, 0, 0.0, 12.0)]
    times = spark.createDataFrame([([0.2, 0.9, 1.3, 2.2, 2.5],), ([],), ([3.0],)], "t array<double>")
    assert [r.k for r in times.select(timeline.kept_gaps(F.col("t")).alias("k")).collect()] == [[0.2, 1.3, 2.5], [], [3.0]]


def test_keyframes_and_audio(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 5.0, 5.0)], "video_id long, scene_id int, start_time double, end_time double, duration double")
    assert [r.timestamp for r in timeline.keyframes(scenes).orderBy("frame_id").collect()] == [1.35, 3.65]
    videos = spark.createDataFrame([(130, 130.0), (240, 240.0), (300, 300.0), (0, 0.0)], "video_id long, duration double")
    got = rows(timeline.audio_plan(videos).select("video_id", "start", "end"), "video_id", "start")
    assert got == [(0, 0.0, 0.0), (130, 0.0, 130.0), (240, 0.0, 120.0), (240, 120.0, 240.0), (300, 0.0, 120.0), (300, 120.0, 240.0), (300, 240.0, 300.0)]


def test_first_lines_twice(spark):
    lines = spark.createDataFrame([(1, 0, "Abc"), (1, 1, "ABC"), (1, 2, "x"), (2, 0, "abc")], "video_id long, pos int, line string")
    once = timeline.first_lines(lines)
    assert rows(once, "video_id", "pos") == [(1, 0, "Abc"), (1, 2, "x"), (2, 0, "abc")]
    assert rows(timeline.first_lines(once), "video_id", "pos") == rows(once, "video_id", "pos")


def test_speech_is_counted_without_a_transcript(spark):
    from cliplane.functions import rules

    texts = {1: ["  ", " one Two", None, "", " two\tone ", "   ", "x ", " "], 2: [" ", "  "], 3: [None, ""], 4: ["a b", "c"], 5: ["é É z"], 6: ["   ", "q"], 7: ["\t", "q", "\n"]}
    rows = [(v, i, float(9 - i % 3), 10.0, t) for v, ts in texts.items() for i, t in enumerate(ts)]
    said = spark.createDataFrame(rows, "video_id long, seg long, start double, end double, text string")
    got = timeline.speech_counts(said)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan
    whole = said.groupBy("video_id").agg(timeline.joined_text((F.col("start"), F.col("seg")), F.col("text"), " ").alias("transcript"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.count("*").alias("n_segments"))
    shown = ["video_id", "word_count", "char_count", "words_per_second", "silence_ratio", "repetition_ratio", "avg_word_length", "issues", "quality"]
    one, two = (f(r.withColumn("duration", F.lit(60.0))).select(shown).orderBy("video_id").collect() for f, r in ((rules.stt_judged, got), (rules.stt_quality, whole)))
    assert one == two and len(one) == len(texts)


def test_phase_2_and_times_gather_no_repeats(spark):
    from cliplane.plans import rule_queries, timeline_queries

    d = "/root/testdata/sf0.001"
    assert "joined_text" not in rule_queries.phase_2.__code__.co_names
    ts = timeline_queries._times(spark, d)
    assert ts.filter(F.size("ts") != F.size(F.array_distinct("ts"))).count() == 0
