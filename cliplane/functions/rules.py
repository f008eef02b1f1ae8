"""Quality, richness and readiness rules. Decisions use unrounded values; what is shown is rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.functions import text

MIN_WORDS = 5
MIN_CHUNKS = 1
MIN_DENSITY = 0.3


def issues(*named: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, n) for c, n in named)), lambda n: n.isNotNull())


def at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))


def stt_quality(rows: DataFrame) -> DataFrame:
    """Speech quality of (transcript, spoken, n_segments, duration); adds the measures, issues and quality."""
    t = F.trim(text.filled(F.col("transcript")))
    w = rows.withColumn("_w", text.words(t)).withColumns({"word_count": F.size("_w"), "char_count": F.length(t)})
    return stt_judged(w.withColumn("_distinct", F.size(F.array_distinct(F.transform("_w", F.lower)))).drop("_w")).drop("_distinct")


def stt_judged(w: DataFrame) -> DataFrame:
    """``stt_quality`` of counted speech: (word_count, char_count, _distinct, spoken, n_segments, duration)."""
    n, distinct = F.col("word_count"), F.col("_distinct")
    heard = (F.col("n_segments") > 0) & (F.col("duration") > 0)
    silence = F.when(heard, 1 - F.col("spoken") / F.nullif(F.col("duration"), F.lit(0.0))).when(n == 0, 1.0).otherwise(0.0)
    measured = w.withColumns({
        "_wps": n / F.greatest(F.col("duration"), F.lit(1.0)), "_silence": silence,
        "_repeat": F.when(n > 5, 1 - distinct / F.nullif(n, F.lit(0))).otherwise(0.0), "_len": F.col("char_count") / at_least_one(n),
    })
    s = F.col("_silence")
    found = issues(
        (n < 5, "very_few_words"), ((n >= 5) & (n < 10), "few_words"), (s > 0.7, "mostly_silence"), ((s > 0.5) & (s <= 0.7), "high_silence"),
        (F.col("_repeat") > 0.4, "high_repetition"), (F.col("_wps") > 5, "possibly_fast_or_noise"), (F.col("_len") < 2, "fragmented_words"),
    )
    out = measured.withColumn("issues", found)
    low = (n < 5) | (s > 0.7) | (F.size("issues") >= 3)
    shown = {"words_per_second": F.bround("_wps", 2), "silence_ratio": F.bround("_silence", 2), "repetition_ratio": F.bround("_repeat", 2), "avg_word_length": F.bround("_len", 1)}
    return out.withColumns({**shown, "quality": F.when(low, "low").otherwise("good")}).drop("_wps", "_silence", "_repeat", "_len")


def ocr_quality(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """Quality per video of frames (video_id, char_count, n_clean, n_raw), and (video_id, total_frames) attempted."""
    readable = (F.col("char_count") > 5) & (F.col("n_clean") > 0)
    sums = frames.groupBy("video_id").agg(F.sum("char_count").alias("total_chars"), F.sum("n_clean").alias("total_lines"), F.sum("n_raw").alias("raw_lines"), F.count_if(readable).alias("readable_frames"))
    joined = totals.join(sums, "video_id", "left").fillna(0, ["total_chars", "total_lines", "raw_lines", "readable_frames"])
    many = at_least_one(F.col("total_frames"))
    m = joined.withColumns({"_r": F.col("readable_frames") / many, "_a": F.col("total_chars") / many, "_n": (F.col("raw_lines") - F.col("total_lines")) / at_least_one(F.col("raw_lines"))})
    c = F.col("total_chars")
    found = issues((c < 5, "almost_no_text"), ((c >= 5) & (c < 20), "very_little_text"), (F.col("_r") < 0.1, "few_readable_frames"), (F.col("_n") > 0.6, "high_noise"), (F.col("_a") < 2, "low_text_density"))
    low = (c < 5) | (F.col("_r") < 0.1) | (F.size("issues") >= 3)
    out = m.withColumn("issues", found).withColumns({"readable_ratio": F.bround("_r", 2), "noise_ratio": F.bround("_n", 2), "avg_chars": F.bround("_a", 1), "quality": F.when(low, "low").otherwise("good")})
    return out.drop("_r", "_a", "_n")


def steps(value: Column, *bounds: int) -> Column:
    """50 points over the first bound, ten fewer over each next one."""
    out = F.lit(0)
    for points, bound in reversed(list(zip((50, 40, 30, 20, 10), bounds, strict=True))):
        out = F.when(value > bound, points).otherwise(out)
    return out


def richness(word_count: Column, char_count: Column) -> Column:
    score = steps(word_count, 100, 50, 20, 10, 5) + steps(char_count, 200, 100, 50, 20, 10)
    return F.struct(score.alias("score"), F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low").alias("level"))


def global_quality(stt: Column, ocr: Column) -> Column:
    """Which sources are usable: weak only if both are exactly ``low``."""
    s, o = stt == "good", ocr == "good"
    usable = F.when(s & o, F.array(F.lit("stt"), F.lit("ocr"))).when(s, F.array(F.lit("stt"))).when(o, F.array(F.lit("ocr"))).otherwise(F.array(F.lit("metadata_only")))
    primary = F.when(s & o, "both").when(s, "stt").when(o, "ocr").otherwise("none")
    weak = (stt == "low") & (ocr == "low")
    # The advice for each case
    advice = (
        F.when(weak, "Limited analysis - use metadata, scene structure, and any available text")
        .when(primary == "both", "Full multimodal analysis with STT and OCR")
        .when(primary == "stt", "Focus on audio/speech analysis, supplement with OCR where available")
        .when(primary == "ocr", "Focus on visual/text analysis, supplement with STT where available")
        .otherwise("Metadata-only analysis")
    )
    return F.struct(F.when(weak, "weak").otherwise("valid").alias("data_status"), usable.alias("usable_sources"), primary.alias("primary_source"), advice.alias("recommendation"))


def readiness(chunks: DataFrame, quality: DataFrame) -> DataFrame:
    """Whether a video's chunks (final_text, cleaned_text, content_confidence) carry enough to reason on.

    ``quality`` (video_id, data_status) lists the videos; one without chunks has the issue ``no_chunks``.
    """
    used = F.coalesce(F.nullif(F.col("final_text"), F.lit("")), F.col("cleaned_text"), F.lit(""))
    words, final = text.word_count(used), text.word_count(F.col("final_text"))
    conf = F.coalesce("content_confidence", F.lit("low"))
    has = lambda level: F.count_if(conf == level).alias(level)
    sums = chunks.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(words).alias("words"), F.count_if(words >= 3).alias("full"), F.count_if(final >= 5).alias("context"), has("high"), has("medium"), has("low"))
    rows = quality.join(sums, "video_id", "left").fillna(0, ["n", "words", "full", "context", "high", "medium", "low"])
    n, some = F.col("n"), F.col("n") > 0
    density, low_share = F.col("full") / F.nullif(n, F.lit(0)), F.col("low") / F.nullif(n, F.lit(0))
    structure = (n > 1) & (F.col("high") + F.col("medium") > 0)
    complete = issues((~some, "no_chunks"), (some & (F.col("words") < MIN_WORDS), "too_few_words"), (some & (F.col("full") < MIN_CHUNKS), "no_chunks_with_content"), (some & (density < MIN_DENSITY), "low_content_density"))
    coherent = issues((~some, "no_chunks"), (some & (low_share > 0.8), "mostly_low_confidence"), (some & ~structure, "no_clear_structure"))
    reason = issues((~some, "no_content"), (some & (F.col("words") < 5), "topic_unclear"), (some & (F.col("context") < 1), "no_context"))
    w, c = F.col("words"), F.col("context")
    rows = rows.withColumns({
        "complete": F.size(complete) == 0, "issues": F.concat(complete, coherent, reason), "content_density": F.coalesce(F.bround(density, 2), F.lit(0.0)),
        "topic_clarity": F.when(w >= 20, "clear").when(w >= 10, "partial").when(w >= 5, "vague").otherwise("none"),
        "context_level": F.when(c >= 3, "rich").when(c >= 2, "adequate").when(c >= 1, "minimal").otherwise("none"),
        "has_structure": structure, "coherent": F.size(coherent) == 0,
    }).withColumn("can_reason", F.col("topic_clarity").isin("clear", "partial") & (F.col("context_level") != "none"))
    ready = F.col("complete") & F.col("can_reason")
    count = F.size("issues")
    # The messages that callers show
    why = issues((~F.col("complete"), "Content không đủ đầy đủ"), (~F.col("can_reason"), "Không đủ context để suy luận"), ((F.col("data_status") == "weak") & ~F.col("complete"), "Dữ liệu yếu từ Phase 2"))
    said = lambda name: F.array_contains("issues", name) & ~ready
    acts = issues((said("too_few_words"), "Giữ nguyên nội dung, không ép phân loại"), (said("topic_unclear"), "Chỉ sử dụng metadata để phân loại"), (said("mostly_low_confidence"), "Đánh dấu low-confidence, hạn chế suy luận"))
    default = F.when(ready, "Tiếp tục Phase tiếp theo (classification, scripting)").otherwise("Giữ metadata và scene structure, bỏ qua deep analysis")
    return rows.withColumns({
        "reasoning_ready": ready,
        "content_quality": F.when(count == 0, "high").when(count <= 2, "medium").otherwise("low"),
        "reason": F.when(ready, "Nội dung đủ rõ ràng và có cấu trúc để AI suy luận").otherwise(F.array_join(why, "; ")),
        "recommended_actions": F.when(F.size(acts) == 0, F.array(default)).otherwise(acts),
    })
