"""Queries of the video library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.operators import search
from cliplane.operators.postings import SearchIndex
from cliplane.plans.registry import ORACLES, query
from cliplane.session import shared_dir
from cliplane.sources.adapters import sql, table, videos

FOUND = """status = 'analyzed' AND (regexp_matches(title, 'th', 'i') OR regexp_matches(analysis_title, 'th', 'i')
  OR regexp_matches(category, 'th', 'i') OR regexp_matches(key_message, 'th', 'i'))
  AND regexp_matches(category, 'src[0-4]', 'i') AND score >= 3"""
ISO = "'%Y-%m-%dT%H:%M:%S'"


@query("p_2_search", sql("videos", f"""SELECT video_id, coalesce(nullif(analysis_title, ''), title) AS title, category, score, strftime(analyzed_at, {ISO}) AS analyzed_at
FROM videos WHERE {FOUND} ORDER BY videos.analyzed_at DESC NULLS LAST, video_id LIMIT 20 OFFSET 5"""))
def p_2(spark, d) -> DataFrame:
    return search.search(videos(spark, d), "th", "src[0-4]", 3, skip=5, limit=20)


@query("o_9_search_total", sql("videos", f"SELECT count(*) AS total FROM videos WHERE {FOUND}"))
def o_9(spark, d) -> DataFrame:
    return search.found_by(videos(spark, d), "th", "src[0-4]", 3).agg(F.count("*").alias("total"))


@query("p_1_list", sql("videos", f"""SELECT video_id, title, status, strftime(created_at, {ISO}) AS created_at, url, (SELECT count(*) FROM videos) AS total
FROM videos ORDER BY videos.created_at DESC NULLS LAST, video_id LIMIT 20 OFFSET 10"""))
def p_1(spark, d) -> DataFrame:
    return search.listed(videos(spark, d), 10, 20)


@query("p_3_detail", sql("videos", f"""SELECT CAST(video_id AS VARCHAR) AS video_id, title, analysis_title, category, key_message, score, status,
strftime(created_at, {ISO}) AS created_at, strftime(analyzed_at, {ISO}) AS analyzed_at, error, url FROM videos WHERE video_id = 7"""))
def p_3(spark, d) -> DataFrame:
    return search.detail(videos(spark, d), 7)


@query("p_4_analysis_view", sql("videos", """SELECT video_id, status, h AS has_analysis, CASE WHEN h THEN analysis_title END AS analysis_title, CASE WHEN h THEN score END AS score,
CASE WHEN status = 'failed' THEN error END AS error FROM (SELECT *, coalesce(analysis_title, '') <> '' OR coalesce(score, 0) <> 0 AS h FROM videos)"""))
def p_4(spark, d) -> DataFrame:
    return search.analysis_view(videos(spark, d))


@query("s_1_scan", sql("videos", "SELECT video_id, title, status FROM videos"))
def s_1(spark, d) -> DataFrame:
    return videos(spark, d).select("video_id", "title", "status")


@query("s_2_point_lookup", sql("videos", "SELECT video_id, status, url FROM videos WHERE video_id = 42"))
def s_2(spark, d) -> DataFrame:
    return videos(spark, d).filter("video_id = 42").limit(1).select("video_id", "status", "url")


@query("a_1_library_stats", sql("videos", """SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'analyzed') AS analyzed, count(*) FILTER (status = 'failed') AS failed FROM videos"""))
def a_1(spark, d) -> DataFrame:
    return search.library_stats(videos(spark, d))


@query("p_7_status_filter", sql("videos", "SELECT video_id, title FROM videos WHERE status = 'failed'"))
def p_7(spark, d) -> DataFrame:
    return videos(spark, d).filter("status = 'failed'").select("video_id", "title")


@query("p_9_regex_any_of_four", sql("videos", """SELECT video_id FROM videos WHERE regexp_matches(title, 'an|que', 'i') OR regexp_matches(analysis_title, 'an|que', 'i')
OR regexp_matches(category, 'an|que', 'i') OR regexp_matches(key_message, 'an|que', 'i')"""))
def p_9(spark, d) -> DataFrame:
    return videos(spark, d).filter(search.matches("an|que", "title", "analysis_title", "category", "key_message")).select("video_id")


@query("p_10_category_regex", sql("videos", "SELECT video_id, category FROM videos WHERE regexp_matches(category, 'SRC1', 'i')"))
def p_10(spark, d) -> DataFrame:
    return videos(spark, d).filter(search.matches("SRC1", "category")).select("video_id", "category")


@query("p_11_score_at_least", sql("videos", "SELECT video_id, score FROM videos WHERE score >= 8"))
def p_11(spark, d) -> DataFrame:
    return videos(spark, d).filter("score >= 8").select("video_id", "score")


@query("p_12_empty_query", sql("videos", "SELECT video_id FROM videos WHERE status = 'analyzed'"))
def p_12(spark, d) -> DataFrame:
    return search.found_by(videos(spark, d), "").select("video_id")


@query("o_1_newest_created", sql("videos", "SELECT video_id FROM videos ORDER BY created_at DESC, video_id LIMIT 15 OFFSET 5"))
def o_1(spark, d) -> DataFrame:
    return videos(spark, d).orderBy(F.desc("created_at"), "video_id").offset(5).limit(15).select("video_id")


@query("o_2_newest_analyzed", sql("videos", f"SELECT video_id, strftime(analyzed_at, {ISO}) AS analyzed_at FROM videos ORDER BY videos.analyzed_at DESC NULLS LAST, video_id LIMIT 15 OFFSET 5"))
def o_2(spark, d) -> DataFrame:
    return videos(spark, d).orderBy(F.desc_nulls_last("analyzed_at"), "video_id").offset(5).limit(15).select("video_id", search.iso(F.col("analyzed_at")).alias("analyzed_at"))


@query("k_1_insert", "SELECT doc_id AS video_id, doc_id IN (SELECT doc_id FROM labels) AS duplicate FROM documents")
def k_1(spark, d) -> DataFrame:
    known = table(spark, d, "labels").select(F.col("doc_id").alias("video_id"))
    return search.insert(known, table(spark, d, "documents").select(F.col("doc_id").alias("video_id")))


@query("k_2_update", sql("videos", """SELECT v.video_id, CASE WHEN l.doc_id IS NULL THEN v.status ELSE 'processing' END AS status, CASE WHEN l.doc_id IS NULL THEN v.score ELSE l.toxic END AS score, title
FROM videos v LEFT JOIN labels l ON v.video_id = l.doc_id"""))
def k_2(spark, d) -> DataFrame:
    changes = table(spark, d, "labels").select(F.col("doc_id").alias("video_id"), F.lit("processing").alias("status"), F.col("toxic").alias("score"))
    return search.update(videos(spark, d).select("video_id", "status", "score", "title"), changes, "video_id")


@query("k_3_delete", sql("videos", "SELECT video_id, title FROM videos WHERE video_id NOT IN (SELECT doc_id FROM labels)"))
def k_3(spark, d) -> DataFrame:
    return search.delete(videos(spark, d).select("video_id", "title"), table(spark, d, "labels").select(F.col("doc_id").alias("video_id")), "video_id")


@query("s_23_file_location", sql("videos", """SELECT video_id, coalesce(CASE WHEN video_id % 3 = 0 THEN 'local/' || video_id END, CASE WHEN video_id % 2 = 0 THEN 'uploads/' || video_id || '.mp4' END,
CASE WHEN video_id % 5 = 0 THEN 'scraped/' || video_id || '.mp4' END) AS path FROM videos"""))
def s_23(spark, d) -> DataFrame:
    ident = F.col("video_id").cast("string")
    place = lambda n, head, tail: F.when(F.col("video_id") % n == 0, F.concat(F.lit(head), ident, F.lit(tail)))
    return videos(spark, d).select("video_id", F.coalesce(place(3, "local/", ""), place(2, "uploads/", ".mp4"), place(5, "scraped/", ".mp4")).alias("path"))


@query("t_4_latest_state", """SELECT user_id AS video_id, arg_max(event_type, event_id) AS state, max(event_id) AS at FROM events GROUP BY user_id""")
def t_4(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("at"))


def _indexed(spark, d) -> SearchIndex:
    """The library behind a trigram index, inserted in two parts."""
    index = SearchIndex(spark, f"{shared_dir(spark)}/cliplane-index-{uuid.uuid4().hex}")
    return index.insert(videos(spark, d).filter("video_id % 2 = 0")).insert(videos(spark, d).filter("video_id % 2 = 1"))


@query("p_2_index_search", sql("videos", f"""SELECT video_id, coalesce(nullif(analysis_title, ''), title) AS title, category, score, strftime(analyzed_at, {ISO}) AS analyzed_at
FROM videos WHERE status = 'analyzed' AND (regexp_matches(title, 'licen[cs]e|reserved', 'i') OR regexp_matches(analysis_title, 'licen[cs]e|reserved', 'i') OR regexp_matches(category, 'licen[cs]e|reserved', 'i') OR regexp_matches(key_message, 'licen[cs]e|reserved', 'i'))
AND regexp_matches(category, 'src[0-4]', 'i') AND score >= 3 ORDER BY videos.analyzed_at DESC NULLS LAST, video_id LIMIT 20 OFFSET 5"""))
def p_2_index(spark, d) -> DataFrame:
    q = "licen[cs]e|reserved"
    return search.search(_indexed(spark, d).candidates(q), q, "src[0-4]", 3, skip=5, limit=20)


@query("p_9_index_any_of_four", sql("videos", """SELECT video_id FROM videos WHERE regexp_matches(title, 'gnu general|apache +license', 'i') OR regexp_matches(analysis_title, 'gnu general|apache +license', 'i')
OR regexp_matches(category, 'gnu general|apache +license', 'i') OR regexp_matches(key_message, 'gnu general|apache +license', 'i')"""))
def p_9_index(spark, d) -> DataFrame:
    q = "gnu general|apache +license"
    return _indexed(spark, d).candidates(q).filter(search.matches(q, "title", "analysis_title", "category", "key_message")).select("video_id")


@query("p_9_index_scan", ORACLES["p_9_regex_any_of_four"])
def p_9_scan(spark, d) -> DataFrame:
    """A pattern from which no trigram follows falls back to the scan."""
    q = "an|que"
    return _indexed(spark, d).candidates(q).filter(search.matches(q, "title", "analysis_title", "category", "key_message")).select("video_id")
