import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliplane.operators import gaps, ranges, timeline


def greedy(times, least):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= least:
            kept.append(t)
    return kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 80), min_size=1, max_size=60), st.integers(0, 59), st.integers(1, 9))
def test_chains_know_every_entry(times, cut, least):
    """Cut sorted times anywhere: from each entry, the rows marked for it are those of the rule."""
    times = sorted(set(times))
    own = times[min(cut, len(times) - 1) :]
    chains = gaps.Chains(1, least)
    marks = [(t, chains.take(t)) for t in own]
    exits = {key: (entry, end) for entry, key, end in chains.exits()}
    for before in range(own[0] - 2 * least, own[0]):
        want, last = [], before
        for t in own:
            if t - last >= least:
                want.append(t)
                last = t
        entered = [t for t in own if t - before >= least]
        if not entered:
            continue
        key = entered[0] if entered[0] - own[0] < least else gaps.BEFORE_ALL
        inside = lambda m, key=key: m is not None and (m[0] <= key <= m[1] if m[0] <= m[1] else key >= m[0] or key <= m[1])
        assert [t for t, m in marks if inside(m)] == want
        assert exits[key] == (entered[0], want[-1])


def test_kept_times(spark):
    rng = random.Random(1)
    rows = [(v, rng.choice([round(rng.uniform(0, 40), 2), rng.randrange(40) / 4, 0.1 * rng.randrange(400)])) for v in (1, 2, 3, 4) for _ in range(900)]
    rows += [(5, 7.0), (5, 7.0), (6, None), (7, float("nan")), (None, 1.0), (8, -3.0), (8, -2.0), (9, 1e9), (9, 0.0)]
    df = spark.createDataFrame(rows, "video_id long, t double").repartition(3)
    for partitions, least in (("1", 0.1), ("9", 1.0), ("9", 0.1)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {}
        for r in gaps.kept_times(df, least).collect():
            got.setdefault(r.video_id, []).append(r.t)
        clean = [(v, t) for v, t in rows if v is not None and t is not None and t == t]
        assert {v: sorted(ts) for v, ts in got.items()} == {v: greedy([t for w, t in clean if w == v], least) for v in {v for v, _ in clean}}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert gaps.kept_times(df.limit(0)).count() == 0


def test_one_video_of_a_million_times(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    times = spark.range(1_000_000).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 0.37 + F.col("id") % 7 * 0.01).alias("t"))
    got = np.sort([r.t for r in gaps.kept_times(times).collect()])
    ordered = np.sort(np.arange(1_000_000) * 0.37 + np.arange(1_000_000) % 7 * 0.01)
    want, last = [], -10.0
    for t in ordered.tolist():
        if t - last >= 1.0:
            want.append(t)
            last = t
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.tolist() == want


def test_numbers_and_followers_of_a_hot_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(1, i) for i in range(3000)] + [(g, i) for g in (0, 2, 3) for i in range(4)] + [(None, i) for i in range(5)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g long, x long")
    placed = ranges.place(df, "g", "x")
    assert placed.filter("g = 1").select("_range").distinct().count() > 1
    got = sorted(((r.g, r.x, r.n) for r in ranges.numbered(df, "n", "x", by="g").collect()), key=str)
    assert got == sorted(((g, x, x) for g, x in rows), key=str)
    after = {(r.g, r.x): r.nxt for r in ranges.following(placed, "nxt", F.when(F.col("x") % 5 != 0, F.col("x")), "g", "x").collect()}
    sizes = {1: 3000, None: 5}
    assert after == {(g, x): None if x + 1 == sizes.get(g, 4) or (x + 1) % 5 == 0 else x + 1 for g, x in rows}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_concatenate_to_the_whole(spark):
    """A hot group over many ranges and parts; one text is longer than several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(4)
    rows = [(1, i, "x" * rng.randrange(1, 40) + str(i)) for i in range(4000)] + [(1, 4000, "y" * 900), (1, 4001, "end"), (2, 0, ""), (2, 1, "only"), (3, 0, None), (None, 0, "a"), (None, 1, "b")]
    random.Random(5).shuffle(rows)
    parts = ranges.texts_in_parts(spark.createDataFrame(rows, "g long, n long, t string"), "g", ("n",), "t", "--", 200).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (1, 2, None):
        own = sorted((r for r in parts if r.g == g), key=lambda r: r.part)
        whole = "--".join(t for _, t in sorted((n, t) for h, n, t in rows if h == g and t))
        assert "".join(r.text for r in own) == whole
        assert all(whole[r.offset :].startswith(r.text) for r in own)
        assert all(len(r.text) <= 200 + 900 + 2 for r in own) and (g != 1 or len(own) > 300)
    assert {r.g for r in parts} == {1, 2, None}


def test_counted_numbers(spark):
    df = spark.createDataFrame([(1, 0, 9999), (2, 5, 5), (3, 3, 2), (4, -3, 1)], "g long, a long, b long")
    got = [tuple(r) for r in ranges.counted(df, "k", F.col("a"), F.col("b")).groupBy("g").agg(F.count("*"), F.min("k"), F.max("k"), F.countDistinct("k")).orderBy("g").collect()]
    assert got == [(1, 10000, 0, 9999, 10000), (2, 1, 5, 5, 1), (4, 5, -3, 1, 5)]
    far = spark.createDataFrame([(0, 50_000_000)], "a long, b long")
    assert ranges.counted(far, "k", F.col("a"), F.col("b")).count() == 50_000_001


def test_a_scene_of_any_length_is_one_row(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 1e9), (1, 1, 5.0, 6.0), (1, 2, 40.0, 400.0), (2, 0, -1e9, 1e9), (2, 1, 3.0, 3.0), (3, 0, float("-1e308"), float("1e308"))], "video_id long, scene_id int, start_time double, end_time double")
    rng = random.Random(3)
    segments = [(v, i, s, s + rng.random() * 4, "x") for v in (1, 2, 3) for i, s in enumerate([5.0, 5.9, 29.9, 39.0, 300.0, 1e9 - 3, 1e9 + 5, -7.0])]
    segments += [(1, 90, None, 4.0, "x"), (1, 91, 7.0, None, "x"), (1, 92, None, None, "x")]
    got = {(r.video_id, r.seg): (r.scene_id, r.mid) for r in timeline.align_segments(spark.createDataFrame(segments, "video_id long, seg long, start double, end double, text string"), scenes).collect()}
    want = {}
    for v, i, s, e, _ in segments:
        mid = ((s or 0.0) + (e if e is not None else s or 0.0)) / 2
        held = [r.scene_id for r in scenes.collect() if r.video_id == v and r.start_time <= mid < r.end_time]
        if held:
            want[v, i] = (min(held), mid)
    assert got == want
    none = spark.createDataFrame([], scenes.schema)
    assert timeline.align_segments(spark.createDataFrame(segments, "video_id long, seg long, start double, end double, text string"), none).count() == 0


def test_frames_that_fail_do_not_count(spark):
    scenes = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 5, 5.0) for i in range(30)], "video_id long, scene_id int, start_time double, end_time double, duration double")
    read = spark.createDataFrame([(1, s, 0) for s in range(30) if s % 2], "video_id long, scene_id int, i int")
    got = [(r.scene_id, r.frame_id) for r in timeline.keyframes(scenes, read).orderBy("frame_id").collect()]
    assert got == [(2 * i + 1, i) for i in range(10)]
