"""Properties that hold for any input."""

import difflib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliplane.functions import compare, text
from cliplane.operators import timeline, tracker

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@few
@given(data=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=30))
def test_segments_have_one_scene_at_most(spark, data):
    segments = spark.createDataFrame([(v, i, t / 10, t / 10 + 1, "x") for i, (v, t) in enumerate(data)], "video_id long, seg long, start double, end double, text string")
    scenes = spark.createDataFrame([(v, s, s * 7.0, s * 7.0 + 9.0, 9.0) for v in range(3) for s in range(4)], "video_id long, scene_id int, start_time double, end_time double, duration double")
    got = {r.seg: r.scene_id for r in timeline.align_segments(segments, scenes).collect()}
    for i, (_, t) in enumerate(data):
        mid = (t / 10 + t / 10 + 1) / 2
        want = next((s for s in range(4) if s * 7.0 <= mid < s * 7.0 + 9.0), None)
        assert got.get(i) == want


@few
@given(times=st.lists(st.integers(0, 80), max_size=20))
def test_gaps_are_kept(spark, times):
    kept = spark.createDataFrame([([t / 4 for t in times],)], "t array<double>").select(timeline.kept_gaps(F.col("t")).alias("k")).first().k
    want = []
    for t in sorted({t / 4 for t in times}):
        if not want or t - want[-1] >= 1.0:
            want.append(t)
    assert kept == want


@few
@given(data=st.lists(st.tuples(st.text(alphabet="abc dé.", max_size=30), st.text(alphabet="abc dé.", max_size=30)), min_size=1, max_size=20))
def test_similarity_is_the_matcher(spark, data):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    rows = df.select("i", text.for_comparison(F.col("a")).alias("x"), text.for_comparison(F.col("b")).alias("y"), compare.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r.s == (round(difflib.SequenceMatcher(None, r.x, r.y).ratio(), 3) if r.x and r.y else 0.0)


@few
@given(spans=st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=15))
def test_windows_cover_all_chunks(spark, spans):
    rows = [(1, i, float(a), float(a + n), "s", "") for i, (a, n) in enumerate(spans)]
    got = timeline.windows(spark.createDataFrame(rows, "video_id long, pos int, start double, end double, stt string, ocr string")).collect()
    for _, _, a, b, *_ in rows:
        assert any(a < w.w_end and b > w.w_start for w in got)
    assert sorted(w.window_id for w in got) == list(range(len(got)))


@few
@given(statuses=st.lists(st.sampled_from(["completed", "error", "pending", "retry"]), max_size=20))
def test_counts_add_up(spark, statuses):
    rows = spark.createDataFrame([(str(i), s, "user") for i, s in enumerate(statuses)], "id string, status string, type string")
    assert sum(tracker.stats(rows).first()) == len(statuses)
