"""The video library: search, lists, details, counts and changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 20
MAX_PAGE = 100


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def filled(text: Column) -> Column:
    """Empty counts as missing."""
    return F.nullif(text, F.lit(""))


def pattern(q: str) -> str:
    """A case-insensitive Unicode pattern; an invalid one is an error here, not on the executors."""
    re.compile(q)
    return f"(?iu){q}"


def matches(q: str, *columns: str) -> Column:
    """Any of the columns holds the pattern; null never matches. The empty pattern is no filter."""
    if q == "":
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).rlike(pattern(q)), F.lit(False))
    return found


def found_by(videos: DataFrame, q: str, category: str | None = None, min_score: int | None = None) -> DataFrame:
    """Analysed videos whose title, analysis title, category or key message holds ``q``."""
    out = videos.filter(F.col("status") == "analyzed").filter(matches(q, "title", "analysis_title", "category", "key_message"))
    if category:
        out = out.filter(matches(category, "category"))
    if min_score is not None:
        if not 1 <= min_score <= 10:
            raise ValueError("min_score is from 1 to 10")
        out = out.filter(F.col("score") >= min_score)
    return out


def search(videos: DataFrame, q: str, category: str | None = None, min_score: int | None = None, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the search, newest analysis first; ties by id."""
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"skip is 0 or more, limit from 1 to {MAX_PAGE}")
    rows = found_by(videos, q, category, min_score).orderBy(F.desc_nulls_last("analyzed_at"), "video_id").offset(skip).limit(limit)
    return rows.select("video_id", F.coalesce(filled(F.col("analysis_title")), F.col("title")).alias("title"), "category", "score", iso(F.col("analyzed_at")).alias("analyzed_at"))


def listed(videos: DataFrame, skip: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of all videos, newest first, with the total on each row."""
    total = videos.agg(F.count("*").alias("n")).scalar()
    page = videos.orderBy(F.desc_nulls_last("created_at"), "video_id").offset(skip).limit(limit)
    return page.select("video_id", "title", "status", iso(F.col("created_at")).alias("created_at"), "url").withColumn("total", total)


def detail(videos: DataFrame, video_id: int) -> DataFrame:
    """The whole row of a video, its id and dates as text; no row if there is none."""
    dates = {c: iso(F.col(c)) for c in ("created_at", "analyzed_at")}
    return videos.filter(F.col("video_id") == video_id).limit(1).withColumns({"video_id": F.col("video_id").cast("string"), **dates})


def analysis_view(videos: DataFrame) -> DataFrame:
    """Whether a video has an analysis (a title or a score that isn't empty or zero), and its fields if so."""
    has = F.coalesce(filled(F.col("analysis_title")).isNotNull(), F.lit(False)) | F.coalesce(F.col("score") != 0, F.lit(False))
    return videos.select(
        "video_id",
        F.coalesce("status", F.lit("pending")).alias("status"),
        has.alias("has_analysis"),
        F.when(has, F.col("analysis_title")).alias("analysis_title"),
        F.when(has, F.col("score")).alias("score"),
        F.when(F.col("status") == "failed", F.col("error")).alias("error"),
    )


def library_stats(videos: DataFrame) -> DataFrame:
    """All counts in one scan. Nothing writes the status ``completed``; ``analyzed`` is what it means."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return videos.agg(F.count("*").alias("total"), n("pending"), n("processing"), n("completed"), n("analyzed"), n("failed"))


def insert(videos: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Append rows; ``duplicate`` marks those whose key exists, which a writer must refuse."""
    known = videos.select(F.col(key).alias("_k"), F.lit(True).alias("_known")).distinct()
    return new.join(known, new[key] == known["_k"], "left").withColumn("duplicate", F.coalesce("_known", F.lit(False))).drop("_k", "_known")


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set the named fields of the rows that ``changes`` has a key for; a null in a change is set, too."""
    named = [c for c in changes.columns if c != key]
    marked = changes.select(F.col(key).alias("_k"), F.struct(*named).alias("_new"))
    joined = rows.join(marked, rows[key] == marked["_k"], "left")
    return joined.select(*(F.when(F.col("_k").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, key, "left_anti")
