"""Timelines: scenes, speech and on-screen text of videos, joined and folded per video.

Rows carry ``video_id`` and seconds from the start of the video. Every join and
window is keyed by it, so all of them can share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.functions import text
from cliplane.operators import ranges
from cliplane.session import written

MIN_SCENE = 0.5
MIN_GAP = 1.0
MAX_FRAMES = 10
CHUNK = 120.0
LAST_CHUNK = 130.0


def numbered(rows: DataFrame, name: str, *order: str, by: str = "video_id") -> DataFrame:
    """Positions from 0 within each video, in two passes over ranges of its rows."""
    return ranges.numbered(rows, name, *order, by=by)


def joined_text(order: tuple, text: Column, separator: str) -> Column:
    """The texts of a group in order, one separator apart; empty ones are left out."""
    items = F.array_sort(F.collect_list(F.when((text != "") & text.isNotNull(), F.struct(*order, text.alias("t")))))
    return F.array_join(F.transform(items, lambda x: x["t"]), separator)


SLOT = 30.0  # seconds
CLASSES = 1019  # the last one is longer than any range of doubles that matters


def align_segments(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each segment with the first scene that holds its middle (start included, end not); others are dropped.

    Scenes are looked up by classes of length, each twice as long as the one before. A scene is one
    row, in the slot of its start; slots of its class are no shorter than it is, so what
    holds a segment's middle starts in the middle's slot or the one before. A segment asks
    these two of every class that there is. So a scene of any length costs one
    row, and a segment meets only scenes about as near as they are long.
    """
    length = F.col("end_time") - F.col("start_time")
    of = F.least(F.greatest(F.ceil(F.log2(length / SLOT)), F.lit(0)), F.lit(CLASSES)).cast("int")
    slot = lambda at, c: F.floor(at / (F.lit(SLOT) * F.pow(F.lit(2.0), c)))
    placed = scenes.filter("start_time < end_time").select(F.col("video_id").alias("v"), "scene_id", "start_time", "end_time", of.alias("class"))
    placed = placed.withColumn("slot", slot(F.col("start_time"), F.col("class")))
    there = sorted(r["class"] for r in placed.select("class").distinct().collect())  # at most CLASSES + 1
    mid = (F.coalesce("start", F.lit(0.0)) + F.coalesce("end", "start", F.lit(0.0))) / 2
    asked = segments.withColumn("start", F.coalesce("start", F.lit(0.0))).withColumn("mid", mid)
    probes = F.array(*(F.struct(F.lit(c).alias("class"), (slot(F.col("mid"), F.lit(c)) - back).alias("slot")) for c in there for back in (0, 1))) if there else F.array().cast("array<struct<class:int,slot:bigint>>")
    asked = asked.withColumn("_p", F.explode(probes))
    hit = (asked["video_id"] == placed["v"]) & (asked["_p.class"] == placed["class"]) & (asked["_p.slot"] == placed["slot"]) & (asked["mid"] >= placed["start_time"]) & (asked["mid"] < placed["end_time"])
    rest = [c for c in segments.columns if c not in ("video_id", "seg")] + ["mid"]
    first = asked.join(placed, hit).groupBy("video_id", "seg").agg(F.min(F.struct("scene_id", *rest)).alias("_f"))
    return first.select(*(c if c in ("video_id", "seg") else F.col(f"_f.{c}").alias(c) for c in [*segments.columns, "mid", "scene_id"]))


def merge(scenes: DataFrame, segments: DataFrame, ocr: DataFrame) -> DataFrame:
    """Every scene with its speech, its on-screen text and both labelled; items of no scene go, items without a scene are scene 0's."""
    speech = align_segments(segments, scenes).groupBy("video_id", "scene_id").agg(joined_text((F.col("start"), F.col("seg")), F.col("text"), " ").alias("stt_text"))
    shown = ocr.withColumn("scene_id", F.coalesce("scene_id", F.lit(0))).groupBy("video_id", "scene_id").agg(joined_text((F.col("frame"),), F.col("text"), "\n").alias("ocr_text"))
    both = scenes.join(speech, ["video_id", "scene_id"], "left").join(shown, ["video_id", "scene_id"], "left")
    stt, ocr_text = F.coalesce("stt_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    labelled = F.concat_ws("\n", F.when(stt != "", F.concat(F.lit("[SPOKEN] "), stt)), F.when(ocr_text != "", F.concat(F.lit("[ON-SCREEN] "), ocr_text)))
    return both.select("video_id", "scene_id", "start_time", "end_time", stt.alias("stt_text"), ocr_text.alias("ocr_text"), labelled.alias("combined_text"), (stt != "").alias("has_speech"), (ocr_text != "").alias("has_text"))


def scene_flags(scenes: DataFrame, segments: DataFrame, ocr: DataFrame) -> DataFrame:
    """``merge`` without its texts: every scene, and whether it has speech and on-screen text."""
    some = F.coalesce(F.max(F.col("text") != ""), F.lit(False))
    speech = align_segments(segments, scenes).groupBy("video_id", "scene_id").agg(some.alias("speech"))
    shown = ocr.withColumn("scene_id", F.coalesce("scene_id", F.lit(0))).groupBy("video_id", "scene_id").agg(some.alias("shown"))
    both = scenes.select("video_id", "scene_id").join(speech, ["video_id", "scene_id"], "left").join(shown, ["video_id", "scene_id"], "left")
    return both.select("video_id", "scene_id", F.coalesce("speech", F.lit(False)).alias("has_speech"), F.coalesce("shown", F.lit(False)).alias("has_text"))


def speech_counts(segments: DataFrame) -> DataFrame:
    """Each video's transcript counted, not built: word_count, char_count, _distinct, spoken, n_segments.

    The counts are those of the segments' texts in order, a space apart, trimmed;
    all are sums that tasks begin on their own, so no row holds a video's speech.
    """
    t = F.col("text")
    order = ("start", "seg", "text")
    blank = F.trim(t) == ""
    word = segments.select("video_id", F.explode(text.words(t)).alias("w")).groupBy("video_id", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    words = word.groupBy("video_id").agg(F.sum("n").alias("word_count"), F.count("*").alias("_distinct"))
    first = F.min(F.when(~blank, F.struct(*order, (F.length(t) - F.length(F.ltrim(t))).alias("n"))))
    last = F.max(F.when(~blank, F.struct(*order, (F.length(t) - F.length(F.rtrim(t))).alias("n"))))
    sums = segments.groupBy("video_id").agg(
        F.sum(F.when(t != "", F.length(t) + 1)).alias("chars"), first.alias("first"), last.alias("last"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.count("*").alias("n_segments")
    )
    # Trimming also takes the segments of spaces alone before the first word and after the last.
    key = lambda c: F.struct(*(F.col(f"{c}.{k}") for k in order))
    own = F.struct(*(F.col(k) for k in order))
    edges = segments.filter((t != "") & blank).join(sums.select("video_id", "first", "last"), "video_id").filter((own < key("first")) | (own > key("last")))
    gone = edges.groupBy("video_id").agg(F.sum(F.length(t) + 1).alias("gone"))
    chars = F.when(F.col("first").isNull(), 0).otherwise(F.col("chars") - 1 - F.col("first.n") - F.col("last.n") - F.coalesce("gone", F.lit(0)))
    counted = sums.join(words, "video_id", "left").join(gone, "video_id", "left").fillna(0, ["word_count", "_distinct"])
    return counted.select("video_id", "word_count", chars.alias("char_count"), "_distinct", "spoken", "n_segments")


def scene_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("video_id").agg(F.count("*").alias("scenes"), F.count_if("has_speech").alias("scenes_with_speech"), F.count_if("has_text").alias("scenes_with_text"))


def label_sources(chunks: DataFrame) -> DataFrame:
    """Chunks with their position and whether they hold speech, text, both or none."""
    stt, ocr = F.trim("stt") != "", F.trim("ocr") != ""
    source = F.when(stt & ocr, "both").when(stt, "stt").when(ocr, "ocr").otherwise("none")
    return numbered(chunks, "chunk_id", "pos").withColumns({"source": source, "duration": F.col("end") - F.col("start")})


def stats(labelled: DataFrame) -> DataFrame:
    """Counts and coverage per video; a video without duration has coverage 0."""
    is_ = lambda *s: F.col("source").isin(*s)
    total = F.sum("duration")
    cover = lambda *s: F.when(total > 0, F.bround(F.sum(F.when(is_(*s), F.col("duration")).otherwise(0.0)) / total, 2)).otherwise(0.0)
    return labelled.groupBy("video_id").agg(
        F.count("*").alias("total"), F.count_if(is_("stt", "both")).alias("with_stt"), F.count_if(is_("ocr", "both")).alias("with_ocr"), F.count_if(is_("both")).alias("with_both"),
        F.count_if(is_("none")).alias("empty"), total.alias("duration"), cover("stt", "both").alias("stt_coverage"), cover("ocr", "both").alias("ocr_coverage"),
    )


def windows(chunks: DataFrame, size: float = 10.0, overlap: float = 2.0) -> DataFrame:
    """Sliding windows of each video with the texts of the chunks that they overlap; windows without chunks are skipped.

    A video no longer than ``size`` has one window.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    # Written, so that Spark knows its size and can split a long video's chunks in the join.
    bounds = written(chunks.groupBy(F.col("video_id").alias("v")).agg(F.min("start").alias("lo"), F.max("end").alias("hi")), "window-bounds")
    last = F.when(F.col("hi") - F.col("lo") <= size, 0).otherwise(F.ceil((F.col("hi") - F.col("lo")) / step) - 1)
    # Which windows a chunk overlaps follows from its times; one more on either side for rounding.
    k = lambda at: F.floor((at - F.col("lo")) / step)
    placed = chunks.join(bounds, F.col("video_id") == F.col("v"))
    made = ranges.counted(placed, "k", F.greatest(k(F.col("start") - size) - 1, F.lit(0)), F.least(k(F.col("end")) + 1, last))
    begin = F.bround(F.col("lo") + F.col("k") * step, 6)
    pairs = made.withColumn("w_start", begin).withColumn("w_end", F.least(F.col("w_start") + size, F.col("hi"))).filter("start < w_end and end > w_start")
    texts = pairs.groupBy("video_id", "w_start", "w_end").agg(
        F.count("*").alias("n_chunks"), joined_text((F.col("pos"),), F.col("stt"), " ").alias("stt_text"), joined_text((F.col("pos"),), F.col("ocr"), " ").alias("ocr_text")
    )
    return numbered(texts, "window_id", "w_start")


def kept_gaps(times: Column, least: float = MIN_GAP) -> Column:
    """Sorted distinct times, each at least ``least`` after the last one kept."""
    ordered = F.array_sort(F.array_distinct(times))
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    keep = lambda kept, t: F.when(t - F.element_at(kept, -1) >= least, F.concat(kept, F.array(t))).otherwise(kept)
    # The fold starts with the first time, so that there always is a last one.
    return F.when(F.size(ordered) == 0, ordered).otherwise(F.aggregate(rest, F.slice(ordered, 1, 1), keep))


def scenes_from_changes(videos: DataFrame) -> DataFrame:
    """Scenes between the change times of (video_id, changes, duration): short ones are dropped, ids count what is left.

    Without any scene there is one over the whole video; a video without duration has none.
    """
    points = F.concat(F.array(F.lit(0.0)), "changes", F.array(F.col("duration")))
    pairs = F.transform(F.slice(points, 1, F.size(points) - 1), lambda t, i: F.struct(t.alias("start"), F.get(points, i + 1).alias("end")))
    long = F.filter(pairs, lambda p: p["end"] - p["start"] >= MIN_SCENE)
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").alias("end")))
    found = videos.filter("duration > 0").select("video_id", F.posexplode(F.when(F.size(long) > 0, long).otherwise(whole)).alias("scene_id", "s"))
    two = lambda c: F.bround(c, 2)
    return found.select("video_id", "scene_id", two(F.col("s.start")).alias("start_time"), two(F.col("s.end")).alias("end_time"), two(F.col("s.end") - F.col("s.start")).alias("duration"))


def scenes_between(changes: DataFrame, videos: DataFrame) -> DataFrame:
    """``scenes_from_changes`` of rows: changes (video_id, t) and videos (video_id, duration); no row holds a video's times."""
    long = videos.filter("duration > 0")
    ends = lambda at, k: long.select("video_id", at.alias("t"), F.lit(k).alias("k"))
    inner = changes.join(long.select("video_id"), "video_id", "left_semi").select("video_id", "t", F.lit(1).alias("k"))
    points = ranges.place(ends(F.lit(0.0), 0).unionByName(inner).unionByName(ends(F.col("duration"), 2)), "video_id", "k", "t")
    pairs = ranges.following(points, "end", F.col("t"), "video_id", "k", "t").filter("k < 2")
    found = written(pairs.filter(F.col("end") - F.col("t") >= MIN_SCENE), "scenes-found")
    two = lambda c: F.bround(c, 2)
    made = ranges.number(found, "scene_id", "video_id", "k", "t").select("video_id", "scene_id", F.col("t").alias("start"), "end")
    whole = long.join(found.select("video_id"), "video_id", "left_anti").select("video_id", F.lit(0).alias("scene_id"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return made.unionByName(whole).select("video_id", "scene_id", two(F.col("start")).alias("start_time"), two(F.col("end")).alias("end_time"), two(F.col("end") - F.col("start")).alias("duration"))


def planned_frames(scenes: DataFrame) -> DataFrame:
    """Frame times of each scene, (video_id, scene_id, i, t): two at most, one where a video has many scenes."""
    counts = written(scenes.groupBy(F.col("video_id").alias("v")).agg(F.count("*").alias("_scenes")), "scene-counts")
    many = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.lit(MAX_FRAMES) / F.col("_scenes"))))
    margin = F.least(F.lit(0.2), F.lit(0.1) * F.col("duration"))
    usable = F.col("duration") - 2 * margin
    mid = (F.col("start_time") + F.col("end_time")) / 2
    at = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.when((usable <= 0) | (F.col("n") == 1), mid).otherwise(F.col("start_time") + margin + (i + 0.5) * usable / F.col("n")))
    return scenes.join(counts, F.col("video_id") == F.col("v")).withColumn("n", many).select("video_id", "scene_id", F.posexplode(at).alias("i", "t"))


def capped(frames: DataFrame) -> DataFrame:
    """The first MAX_FRAMES of each video's frames in scene order, with their number."""
    return numbered(frames, "frame_id", "scene_id", "i").filter(F.col("frame_id") < MAX_FRAMES)


def keyframes(scenes: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Frame times of each scene, MAX_FRAMES in a video at most, in scene order.

    With ``read`` (video_id, scene_id, i), the planned frames that could be read, those that
    couldn't don't count toward the cap and have no number.
    """
    planned = planned_frames(scenes)
    if read is not None:
        planned = planned.join(read.select("video_id", "scene_id", "i").distinct(), ["video_id", "scene_id", "i"], "left_semi")
    return capped(planned).select("video_id", "scene_id", "frame_id", F.bround("t", 2).alias("timestamp"))


def audio_plan(videos: DataFrame) -> DataFrame:
    """Parts of the sound track of (video_id, duration): of CHUNK seconds, the last one shorter; up to LAST_CHUNK seconds stay whole."""
    dur = F.greatest(F.col("duration"), F.lit(0.0))
    last = F.when(dur <= LAST_CHUNK, 0).otherwise(F.floor(dur / CHUNK))
    parts = ranges.counted(videos.select("video_id", dur.alias("dur"), last.alias("last")), "chunk_id", F.lit(0), F.col("last")).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    end = F.when(F.col("dur") <= LAST_CHUNK, F.col("dur")).otherwise(F.least((F.col("chunk_id") + 1) * CHUNK, F.col("dur")))
    out = parts.select("video_id", "chunk_id", (F.col("chunk_id") * CHUNK).alias("start"), end.alias("end"))
    return out.filter((F.col("end") > F.col("start")) | (F.col("chunk_id") == 0))


def shift_segments(plan: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Segments of parts in the video's time. A part without segments is one segment; failed and empty parts go."""
    heard = transcripts.filter(F.col("success") & (F.coalesce("text", F.lit("")) != ""))
    own = plan.join(heard, ["video_id", "chunk_id"])
    whole = F.array(F.struct(F.lit(0.0).alias("start"), (F.col("end") - F.col("start")).alias("end"), F.col("text").alias("text")))
    parts = own.select("video_id", "chunk_id", F.col("start").alias("at"), F.posexplode(F.when(F.size("segments") > 0, F.col("segments")).otherwise(whole)).alias("n", "s"))
    return parts.select("video_id", "chunk_id", "n", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"))


def first_lines(lines: DataFrame) -> DataFrame:
    """Each different line of a video once, whatever its case, in its first spelling and order."""
    first = F.row_number().over(Window.partitionBy("video_id", F.lower("line")).orderBy("pos"))
    return lines.withColumn("_n", first).filter("_n = 1").drop("_n")
