"""Queries that parse addresses, pages, JSON and probe output, and flatten raw items.

Raw items are built from ``part`` by plain arithmetic, as JSON text, and read
back with the schema of the platform; the SQL states the result directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.functions import answer, parse
from cliplane.operators import flatten
from cliplane.plans.registry import query
from cliplane.sources.adapters import sql, table, videos


def raw_text(spark, d) -> DataFrame:
    """One JSON text for each part."""
    k = F.col("p_partkey")
    ident = k.cast("string")
    tag = lambda name, i, user: F.struct(F.lit(name).alias("hashtagName"), i.alias("hashtagId"), user.alias("userId"), F.lit(1).alias("type"), F.lit(False).alias("isCommerce"))
    none = F.lit(None).cast("string")
    counts = lambda n: F.struct(*((k * n).cast("string").alias(f"{c}Count") for c in ("digg", "share", "comment", "play", "collect")), F.lit("12.5").alias("repostCount"))
    pick = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    item = F.struct(
        ident.alias("id"), (k + 1_000_000_000).cast("string").alias("createTime"), F.col("p_name").alias("desc"), F.when(k % 5 == 0, "FAKE-AD").when(k % 5 == 1, "USA").when(k % 5 == 2, "VN").alias("locationCreated"),
        F.when(k % 2 == 0, k % 4 == 0).alias("isAd"), pick(3, F.array().cast("array<string>"), F.array(F.col("p_type"))).alias("effectStickers"), F.when(k % 7 != 0, F.array(F.lit("x"))).alias("comments"),
        F.struct((k * 7).cast("string").alias("id"), F.concat(F.lit("u"), ident).alias("uniqueId"), F.col("p_brand").alias("nickname"), (k % 3 == 0).alias("verified"), (k % 4).alias("relation")).alias("author"),
        F.struct(pick(6, F.lit("none"), (k * 3).cast("string")).alias("id"), F.col("p_type").alias("title"), F.col("p_brand").alias("authorName"), (k % 2 == 1).alias("original"), F.concat(F.lit("m/"), ident).alias("playUrl")).alias("music"),
        F.struct(F.col("p_size").cast("long").alias("duration"), (k % 1000).alias("height"), (k % 800).alias("width"), F.when(k % 4 == 0, "540p").when(k % 4 == 1, "").when(k % 4 == 2, "720p").alias("ratio"),
                 F.when(k % 9 == 0, "").when(k % 9 < 8, F.concat(F.lit("p/"), ident)).alias("playAddr"), F.concat(F.lit("d/"), ident).alias("downloadAddr"), F.struct((k % 2 == 0).alias("hasOriginalAudio"), F.when(k % 3 == 0, False).alias("enableAutoCaption")).alias("claInfo")).alias("video"),
        F.when(k % 2 == 0, counts(2)).alias("statsV2"), counts(1).alias("stats"), F.when(k % 11 == 0, "{}").otherwise("w").alias("warnInfo"),
        F.when(k % 4 == 0, F.array(F.lit("Education"))).when(k % 4 == 1, F.array(F.lit("COMEDY"), F.lit("x"))).when(k % 4 == 2, F.array().cast("array<string>")).alias("diversificationLabels"),
        F.array(tag("a", ident, none), tag("b", pick(2, F.lit("x1"), (k + 1).cast("string")), none), tag("c", none, pick(3, F.lit("9"), none))).alias("textExtra"),
        F.array(F.struct(ident.alias("id"), F.col("p_brand").alias("desc")), F.struct(ident.alias("id"), F.lit("second").alias("desc")), F.struct(F.lit("bad").alias("id"), F.lit("null id").alias("desc"))).alias("challenges"),
    )
    # Parts are few bytes, their items are much work: rows of a few row groups are dealt to all cores.
    return table(spark, d, "part").repartition(2 * spark.sparkContext.defaultParallelism).select(F.to_json(item).alias("raw"))


def raw(spark, d) -> DataFrame:
    return flatten.parsed(raw_text(spark, d))


COUNT = "CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 2 ELSE p_partkey END"


@query("p_5_video_metadata", f"""SELECT p_partkey AS id, strftime(make_timestamp((p_partkey + 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%S') AS time_created, p_partkey * 7 AS author_id, p_name AS description,
CASE WHEN p_partkey % 3 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS hashtags, CASE WHEN p_partkey % 3 = 0 THEN ['9'] END AS mentions, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey * 3 END AS music_id,
CASE p_partkey % 5 WHEN 0 THEN 'XX' WHEN 2 THEN 'VN' END AS location_created, p_partkey % 4 = 0 AND p_partkey % 2 = 0 AS is_ad, {COUNT} AS diggcount, {COUNT} AS playcount, CAST(NULL AS BIGINT) AS repostcount, CASE WHEN p_partkey % 11 <> 0 THEN 'w' END AS warn_info,
CASE WHEN p_partkey % 3 <> 0 THEN [p_type] END AS effect_stickers, CASE WHEN p_partkey % 7 <> 0 THEN ['x'] END AS comments, CASE p_partkey % 4 WHEN 0 THEN ['Education'] WHEN 1 THEN ['COMEDY', 'x'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS diversification_labels, false AS duet_enabled FROM part""")
def p_5(spark, d) -> DataFrame:
    v = flatten.video_metadata(raw(spark, d))
    return v.select("id", "time_created", "author_id", "description", "hashtags", "mentions", "music_id", "location_created", "is_ad", "diggcount", "playcount", "repostcount", "warn_info", "effect_stickers", "comments", "diversification_labels", "duet_enabled")


RATIO = "CASE p_partkey % 4 WHEN 0 THEN 540 WHEN 2 THEN 720 END"


@query("p_5_file_metadata", f"""SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS duration, p_partkey % 1000 AS height, p_partkey % 800 AS width, CAST({RATIO} AS BIGINT) AS ratio, p_partkey % 2 = 0 AS has_original_audio,
CASE WHEN p_partkey % 3 = 0 THEN false END AS enable_audio_caption, false AS is_slide FROM part""")
def p_5_file(spark, d) -> DataFrame:
    return flatten.file_metadata(raw(spark, d)).select("id", "duration", "height", "width", "ratio", "has_original_audio", "enable_audio_caption", "is_slide")


@query("p_5_music_metadata", "SELECT CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey * 3 END AS id, p_type AS title, p_brand AS author_name, p_partkey % 2 = 1 AS original FROM part")
def p_5_music(spark, d) -> DataFrame:
    return flatten.music_metadata(raw(spark, d)).select("id", "title", "author_name", "original")


@query("p_5_author_metadata", "SELECT p_partkey * 7 AS id, 'u' || p_partkey AS username, p_brand AS name, p_partkey % 3 = 0 AS verified, p_partkey % 4 AS relation FROM part")
def p_5_author(spark, d) -> DataFrame:
    return flatten.author_metadata(raw(spark, d)).select("id", "username", "name", "verified", "relation")


@query("j_4_hashtag_lookup", """SELECT p_partkey AS video_id, pos, name, id, CASE WHEN id IS NULL THEN 'null id' WHEN id = p_partkey THEN p_brand END AS description FROM (
SELECT *, 0 AS pos, 'a' AS name, p_partkey AS id FROM part UNION ALL SELECT *, 1, 'b', CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_partkey + 1 END FROM part UNION ALL SELECT *, 2, 'c', NULL FROM part WHERE p_partkey % 3 <> 0)""")
def j_4(spark, d) -> DataFrame:
    return flatten.hashtags_metadata(raw(spark, d)).select("video_id", "pos", "name", "id", "description")


@query("s_8_media_links", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'd/' || p_partkey WHEN p_partkey % 9 < 8 THEN 'p/' || p_partkey END AS mp4, 'm/' || p_partkey AS mp3 FROM part")
def s_8(spark, d) -> DataFrame:
    return flatten.links(raw(spark, d)).select("id", "mp4", "mp3")


@query("p_6_display_metadata", f"""SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(nullif(p_name, ''), 'No Title') AS title, {COUNT} AS views, {COUNT} AS saves, CAST(p_size AS BIGINT) AS video_duration,
p_partkey % 2 = 0 OR p_partkey % 3 <> 0 AS has_audio, CASE p_partkey % 4 WHEN 0 THEN 'EDUCATE' WHEN 1 THEN 'ENTERTAIN' ELSE 'VIDEO' END AS video_type FROM part""")
def p_6(spark, d) -> DataFrame:
    """P-6 with F-28 (video type) and F-24 (statsV2 before stats)."""
    return flatten.displayed(raw(spark, d)).select("id", "title", "views", "saves", "video_duration", "has_audio", "video_type")


@query("j_5_overlay", """SELECT p.p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_partkey + 0.5::DOUBLE END AS duration, CASE WHEN p_partkey % 3 = 0 THEN true ELSE p_partkey % 2 = 0 END AS has_audio,
CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 640 ELSE 100 END AS width, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN p_partkey % 5 ELSE 200 END AS height,
CASE WHEN p_partkey % 3 = 0 THEN 'ffprobe_failed_using_scraper_metadata' END AS warning FROM part p""")
def j_5(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    scraped = p.select(k.alias("id"), F.col("p_size").cast("double").alias("duration"), F.lit(True).alias("has_audio"), F.lit(100).alias("width"), F.lit(200).cast("long").alias("height"))
    probed = p.filter(k % 3 != 0).select(k.alias("id"), (k + 0.5).alias("duration"), (k % 2 == 0).alias("has_audio"), F.lit(640).alias("width"), (k % 5).alias("height"))
    return flatten.overlay(scraped, probed)


@query("s_6_script_json", """SELECT page_id, nullif(regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1), '') AS script, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages""")
def s_6(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", parse.first_script(F.col("html")).alias("script"), parse.extracted(F.col("html"), "(?s)<title>(.*?)</title>").alias("title"))


@query("s_6_item_from_page", "SELECT p_partkey AS id, p_name AS description FROM part")
def s_6b(spark, d) -> DataFrame:
    """A page around the raw item, its script found by id, the item by its path."""
    head, tail = '<html><script id="other">1</script><script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":', "}}}}</script></html>"
    pages = raw_text(spark, d).select(F.concat(F.lit(head), "raw", F.lit(tail)).alias("html"))
    item = F.get_json_object(parse.script_json(F.col("html"), "__UNIVERSAL_DATA_FOR_REHYDRATION__"), "$.__DEFAULT_SCOPE__['webapp.video-detail'].itemInfo.itemStruct")
    return flatten.video_metadata(flatten.parsed(pages.select(item.alias("raw")))).select("id", "description")


@query("s_7_user_page", "SELECT c_custkey AS id, replace(c_name, '@', '') AS name, c_custkey * 10 AS followers FROM customer")
def s_7(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    page = F.concat(F.lit('<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__">{"__DEFAULT_SCOPE__":{"webapp.user-detail":{"userInfo":{"stats":{"followerCount":'), (F.col("c_custkey") * 10).cast("string"), F.lit("}}}}}</script>"))
    followers = F.get_json_object(parse.script_json(page, "__UNIVERSAL_DATA_FOR_REHYDRATION__"), "$.__DEFAULT_SCOPE__['webapp.user-detail'].userInfo.stats.followerCount")
    return c.select(F.col("c_custkey").alias("id"), parse.user_name(F.concat(F.lit("@"), "c_name")).alias("name"), followers.cast("long").alias("followers"))


@query("s_4_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s_4(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("s_5_id_list", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0")
def s_5(spark, d) -> DataFrame:
    """Trimmed lines that aren't blank."""
    lines = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("value"))
    return lines.select(F.trim("value").alias("v")).filter("v <> ''").select(F.col("v").cast("long").alias("id")).distinct()


PROBED = """SELECT p_partkey AS id, p_size::DOUBLE AS duration, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN round_even(30000 / 1001::DOUBLE, 2) ELSE 25 END::DOUBLE AS fps,
CASE p_partkey % 3 WHEN 0 THEN 'h264' WHEN 1 THEN 'wmv3' ELSE 'vp9' END AS codec, p_partkey % 2 = 0 AS has_audio, CAST(p_partkey % 7 AS INTEGER) AS width, 480 AS height FROM part"""


def _probed(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    rate = F.when(k % 4 == 0, "30/0").when(k % 4 == 1, "30000/1001").otherwise("25/1")
    video = F.struct(F.lit("video").alias("codec_type"), F.when(k % 3 == 0, "h264").when(k % 3 == 1, "wmv3").otherwise("vp9").alias("codec_name"), (k % 7).cast("int").alias("width"), F.lit(480).alias("height"), rate.alias("r_frame_rate"))
    sound = video.withField("codec_type", F.lit("audio"))
    json = F.to_json(F.struct(F.when(k % 2 == 0, F.array(sound, video)).otherwise(F.array(video)).alias("streams"), F.struct(F.col("p_size").cast("string").alias("duration")).alias("format")))
    return table(spark, d, "part").select(k.alias("id"), parse.probe(json).alias("m"))


@query("s_13_probe", PROBED)
def s_13(spark, d) -> DataFrame:
    """S-13 with F-36 (frame rate)."""
    return _probed(spark, d).select("id", "m.duration", "m.fps", "m.codec", "m.has_audio", "m.width", "m.height")


@query("f_33_validate", f"""SELECT id, CASE WHEN id % 10 = 0 OR id % 10 = 3 THEN false ELSE true END AS is_valid, CASE WHEN id % 10 IN (0, 3) OR duration < 3 OR width = 0 THEN 'low' WHEN duration > 600 OR NOT has_audio OR codec = 'wmv3' THEN 'medium' ELSE 'high' END AS confidence,
CASE WHEN id % 10 = 0 THEN ['file_not_found'] WHEN id % 10 = 3 THEN ['cannot_read_metadata'] ELSE list_filter([CASE WHEN duration < 3 THEN 'video_too_short' END, CASE WHEN duration > 600 THEN 'video_too_long' END, CASE WHEN NOT has_audio THEN 'no_audio' END, CASE WHEN codec = 'wmv3' THEN 'unusual_codec' END, CASE WHEN width = 0 THEN 'invalid_resolution' END], lambda x: x IS NOT NULL) END AS warnings,
CASE WHEN id % 10 = 0 THEN false WHEN id % 10 = 3 THEN true ELSE codec = 'wmv3' END AS normalize FROM ({PROBED})""")
def f_33(spark, d) -> DataFrame:
    """F-33 with F-34 (re-encode or not)."""
    rows = _probed(spark, d)
    gone = F.lit(None).cast(rows.schema["m"].dataType)
    v = parse.validated(F.col("id") % 10 != 0, F.when(F.col("id") % 10 != 3, F.col("m")), gone)
    return rows.select("id", v.alias("v")).select("id", "v.is_valid", "v.confidence", "v.warnings", parse.should_normalize(F.col("v.warnings")).alias("normalize"))


@query("s_15_change_times", """SELECT user_id AS video_id, list_sort(list_distinct(list(CAST(value AS DOUBLE)))) AS times FROM events GROUP BY user_id""")
def s_15(spark, d) -> DataFrame:
    line = F.concat(F.lit("[showinfo] n:1 pts_time:"), F.col("value").cast("string"), F.lit(" pos:7"))
    logs = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.array_join(F.collect_list(line), "\n").alias("log"))
    return logs.select("video_id", parse.change_times(F.col("log")).alias("times"))


@query("p_13_upload_checks", """SELECT p_partkey AS id, e IN ('.mp4', '.mkv') AS ok_name, s <= 524288000 AS ok_size, CASE e WHEN '.mp4' THEN 'video/mp4' WHEN '.mkv' THEN 'video/x-matroska' WHEN '.flv' THEN 'video/x-flv' ELSE 'video/mp4' END AS mime,
s > 0 AND s <= 2147483648 AND e <> '.mkv' AS ok_remote, round_even(s / 1048576::DOUBLE, 2) AS size_mb
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.flv' ELSE '.txt' END AS e, p_partkey % 5 * 524288000 AS s FROM part)""")
def p_13(spark, d) -> DataFrame:
    """P-13 extension, P-14 size, F-35 remote upload, F-36 megabytes."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("v.x"), k.cast("string"), F.when(k % 4 == 0, ".MP4").when(k % 4 == 1, ".mkv").when(k % 4 == 2, ".Flv").otherwise(".txt"))
    size = k % 5 * 524288000
    return table(spark, d, "part").select(k.alias("id"), parse.is_upload(name).alias("ok_name"), parse.fits_upload(size).alias("ok_size"), parse.mime_type(name).alias("mime"), parse.is_remote_upload(name, size).alias("ok_remote"), parse.megabytes(size).alias("size_mb"))


@query("p_15_platform_url", sql("videos", "SELECT video_id, contains(lower(url), 'tiktok.com') AS ok FROM videos UNION ALL SELECT page_id, contains(lower(url), 'tiktok.com') FROM pages"))
def p_15(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("video_id"), "url")
    return videos(spark, d).select("video_id", "url").unionByName(pages).select("video_id", parse.is_platform_url(F.col("url")).alias("ok"))


@query("f_20_video_id", sql("videos", """SELECT video_id, CASE video_id % 4 WHEN 0 THEN CAST(video_id AS VARCHAR) WHEN 1 THEN CAST(video_id AS VARCHAR) WHEN 2 THEN '700000000000000' || video_id END AS found, CASE WHEN video_id % 4 = 0 THEN CAST(video_id AS VARCHAR) END AS in_path FROM videos"""))
def f_20(spark, d) -> DataFrame:
    """F-20 and F-21 over four shapes of address."""
    v = F.col("video_id")
    shape = F.when(v % 4 == 0, F.col("url")).when(v % 4 == 1, v.cast("string")).when(v % 4 == 2, F.concat(F.lit("x/700000000000000"), v.cast("string"), F.lit("?y"))).otherwise(F.lit("https://vm.tiktok.com/abc/"))
    return videos(spark, d).select("video_id", parse.video_id(shape).alias("found"), parse.video_id_in_path(shape).alias("in_path"))


@query("f_22_to_int", """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 11 = 4 THEN NULL WHEN event_id % 7 = 1 THEN event_id * 1000 + 7 ELSE event_id END AS n FROM events""")
def f_22(spark, d) -> DataFrame:
    e = F.col("event_id")
    text = e.cast("string")
    shape = F.when(e % 3 == 0, F.concat(text, F.lit(".5"))).when(e % 11 == 4, F.concat(text, F.lit("__1"))).when(e % 7 == 1, F.concat(text, F.lit("_007"))).when(e % 3 == 1, F.concat(F.lit(" "), e.cast("string"), F.lit(" "))).otherwise(e.cast("string"))
    return table(spark, d, "events").select("event_id", flatten.to_int(shape).alias("n"))


@query("f_30_answer_json", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def f_30(spark, d) -> DataFrame:
    e = F.col("event_id")
    said = (
        F.when(e % 5 == 0, F.col("props"))
        .when(e % 5 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(e % 5 == 2, F.concat(F.lit("```\n"), "props", F.lit("\n```")))
        .when(e % 5 == 3, F.concat(F.lit("It is "), "props", F.lit(" I think.")))
        .otherwise(F.lit("no answer {"))
    )
    return table(spark, d, "events").select("event_id", F.get_json_object(parse.answer_json(said), "$.k").cast("long").alias("k"))


@query("f_31_time_range", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 60 * 60 + 15 END::DOUBLE AS start_seconds, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 3 THEN 5 ELSE event_id % 60 * 60 + 30 END::DOUBLE AS end_seconds FROM events""")
def f_31(spark, d) -> DataFrame:
    e = F.col("event_id")
    minute = (e % 60).cast("string")
    said = F.when(e % 4 == 3, F.concat(minute, F.lit(":15-"), minute, F.lit(":30"))).otherwise(F.concat(minute, F.lit(":15 - "), minute, F.lit(":30")))
    start, end = F.when(e % 4 == 0, 1.0), F.when(e % 4 == 0, 2.0).when(e % 4 == 3, 5.0)
    return table(spark, d, "events").select("event_id", parse.time_range(said, start, end).alias("t")).select("event_id", "t.*")


@query("f_32_schema_check", "SELECT doc_id, CASE WHEN source IS NULL THEN 'missing field' WHEN n_chars % 13 < 1 OR n_chars % 13 > 10 THEN 'score out of range' END AS error FROM documents")
def f_32(spark, d) -> DataFrame:
    score = F.col("n_chars") % 13
    return table(spark, d, "documents").select("doc_id", F.when(F.col("source").isNull(), "missing field").when(~score.between(1, 10), "score out of range").alias("error"))


# An answer for each document, in which up to three fields are broken by its number.
GOOD = {name: {f: ("8" if kind == "score" else '"x"') for f, optional, kind in answer._fields(fields) if not optional} for name, fields in answer.SECTIONS.items()}
PARTS = {name: "{" + ", ".join(f'"{f}": {v}' for f, v in fields.items()) + "}" for name, fields in GOOD.items()}
ONE_SEGMENT = "{" + ", ".join(f'"{f}": {"1" if kind == "whole" else chr(34) + "x" + chr(34)}' for f, optional, kind in answer._fields(answer.SEGMENT) if not optional) + "}"
WHOLE_ANSWER = "{" + ", ".join(f'"{n}": {p}' for n, p in PARTS.items()) + f', "script_breakdown": [{ONE_SEGMENT}, {ONE_SEGMENT}]' + "}"
BROKEN = (
    # (every how many documents, what is replaced, by what, the breach)
    (7, '"title": "x"', '"name": "x"', "general_info.title: missing"),
    (11, '"key_message": "x"', '"key_message": 5', "content_analysis.key_message: not a text"),
    (3, '"pacing": "x"}]', '"pacing": null}]', "script_breakdown[1].pacing: null"),
    (6, '"cta_analysis": "x"', '"cta_analysis": []', "technical_audit.cta_analysis: not a text"),
)


@query("f_32_answer_breaches", f"""SELECT doc_id, list_filter([{", ".join(f"CASE WHEN doc_id % {n} = 1 THEN '{breach}' END" for n, _, _, breach in BROKEN)},
CASE WHEN n_chars % 13 < 1 OR n_chars % 13 > 10 THEN 'virality_factors.score: not from 1 to 10' END], lambda x: x IS NOT NULL) AS breaches FROM documents""")
def f_32_answer(spark, d) -> DataFrame:
    text = F.replace(F.lit(WHOLE_ANSWER), F.lit('"score": 8'), F.concat(F.lit('"score": '), (F.col("n_chars") % 13).cast("string")))
    for n, old, new, _ in BROKEN:
        text = F.when(F.col("doc_id") % n == 1, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", text.alias("t")).select("doc_id", answer.breaches(F.col("t")).alias("breaches"))


@query("f_37_database_name", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'fallback' END AS db FROM nation")
def f_37(spark, d) -> DataFrame:
    uri = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("mongodb+srv://u:p@host.example/"), "n_name", F.lit("?retryWrites=true"))).otherwise(F.lit("mongodb://host.example/"))
    return table(spark, d, "nation").select("n_nationkey", parse.database_name(uri, "fallback").alias("db"))


@query("f_38_new_id")
def f_38(spark, d) -> DataFrame:
    """Ids are random; only their form can be checked."""
    return table(spark, d, "region").select("r_regionkey", parse.new_video_id().rlike(r"^vid_\d{8}_\d{6}_[0-9a-f]{8}$").alias("well_formed"))


@query("f_40_display_maps", sql("videos", """SELECT video_id, CASE status WHEN 'analyzed' THEN '✅ Đã phân tích' WHEN 'failed' THEN '❌ Thất bại' ELSE '⏳ Đang chờ' END AS label, CASE video_id % 2 WHEN 0 THEN 'red' ELSE 'gray' END AS color, score * 10 AS percent FROM videos"""))
def f_40(spark, d) -> DataFrame:
    pacing = F.when(F.col("video_id") % 2 == 0, "Nhanh").otherwise("?")
    return videos(spark, d).select("video_id", parse.status_label(F.col("status")).alias("label"), parse.pacing_color(pacing).alias("color"), (F.col("score") * 10).alias("percent"))
