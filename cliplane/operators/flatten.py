"""Raw platform items into flat entities: video, file, music, author and hashtags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = """id string, createTime string, desc string, scheduleTime bigint, locationCreated string, isAd boolean, suggestedWords array<string>,
author struct<id: string, uniqueId: string, nickname: string, signature: string, createTime: bigint, verified: boolean, ftc: boolean, relation: bigint, openFavorite: boolean, commentSetting: bigint,
duetSetting: bigint, stitchSetting: bigint, privateAccount: boolean, secret: boolean, isADVirtual: boolean, downloadSetting: bigint, recommendReason: string, suggestAccountBind: boolean>,
music struct<id: string, title: string, authorName: string, original: boolean, scheduleSearchTime: bigint, collected: boolean, preciseDuration: string, playUrl: string>,
video struct<duration: bigint, height: bigint, width: bigint, ratio: string, playAddr: string, downloadAddr: string, volumeInfo: struct<Loudness: double, Peak: double>,
claInfo: struct<hasOriginalAudio: boolean, enableAutoCaption: boolean, noCaptionReason: bigint>>,
imagePost struct<images: array<string>>,
stats struct<diggCount: string, shareCount: string, commentCount: string, playCount: string, collectCount: string, repostCount: string>,
statsV2 struct<diggCount: string, shareCount: string, commentCount: string, playCount: string, collectCount: string, repostCount: string>,
warnInfo string, originalItem boolean, officalItem boolean, secret boolean, forFriend boolean, digged boolean, itemCommentStatus bigint, takeDown bigint, effectStickers array<string>, privateItem boolean,
duetEnabled boolean, stitchEnabled boolean, stickersOnItem array<string>, shareEnabled boolean, comments array<string>, duetDisplay bigint, stitchDisplay bigint, indexEnabled boolean,
diversificationLabels array<string>, diversificationId bigint, channelTags string, keywordTags string, IsAigc boolean, aigcLabelType bigint, AIGCDescription string,
textExtra array<struct<hashtagName: string, hashtagId: string, userId: string, type: bigint, subType: bigint, isCommerce: boolean>>,
challenges array<struct<id: string, desc: string>>"""


def to_int(value: Column) -> Column:
    """A whole number, single underscores between its digits allowed, or null where the text isn't one (``12.5`` isn't)."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text, F.lit("_"), F.lit(""))).try_cast("bigint")


def unless_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def unless(value: Column, *empty: str) -> Column:
    return F.when(~value.isin(*empty), value)


def country(code: Column) -> Column:
    return F.when(F.length(code) <= 2, code).when(code == "FAKE-AD", "XX")


def lines_of_resolution(ratio: Column) -> Column:
    """``540p`` is 540."""
    return to_int(F.nullif(F.substring(ratio, 1, F.length(ratio) - 1), F.lit("")))


def hashtags(extra: Column, challenges: Column) -> Column:
    """Tags of a text, described by the first challenge with their id (a null id meets a null id)."""
    tags = F.filter(extra, lambda e: e["userId"].isNull())

    def described(e: Column) -> Column:
        same = F.filter(challenges, lambda c: to_int(c["id"]).eqNullSafe(to_int(e["hashtagId"])))
        return F.struct(e["hashtagName"].alias("name"), to_int(e["hashtagId"]).alias("id"), e["type"].alias("type"), e["subType"].alias("sub_type"), e["isCommerce"].alias("is_commerce"), F.get(same, F.lit(0))["desc"].alias("description"))

    return F.transform(tags, described)


def mentions(extra: Column) -> Column:
    return unless_empty(F.transform(F.filter(extra, lambda e: e["userId"].isNotNull()), lambda e: e["userId"]))


def parsed(texts: DataFrame, column: str = "raw") -> DataFrame:
    return texts.select(F.from_json(column, RAW).alias("r")).select("r.*")


def _video_columns() -> list[Column]:
    c = F.col
    stats = F.coalesce("statsV2", "stats")
    counts = {f"{n}count": to_int(stats[f"{n}Count"]) for n in ("digg", "share", "comment", "play", "collect", "repost")}
    plain = {
        "original_item": "originalItem", "offical_item": "officalItem", "secret": "secret", "for_friend": "forFriend", "digged": "digged", "item_comment_status": "itemCommentStatus",
        "take_down": "takeDown", "private_item": "privateItem", "share_enabled": "shareEnabled", "duet_display": "duetDisplay", "stitch_display": "stitchDisplay",
        "diversification_labels": "diversificationLabels", "diversification_id": "diversificationId", "keyword_tags": "keywordTags", "is_ai_gc": "IsAigc", "aigc_label_type": "aigcLabelType",
        "suggested_words": "suggestedWords", "schedule_time": "scheduleTime",
    }
    # Missing means false for these four only.
    flags = {"is_ad": "isAd", "duet_enabled": "duetEnabled", "stitch_enabled": "stitchEnabled", "index_enabled": "indexEnabled"}
    listed = {"effect_stickers": "effectStickers", "stickers_on_item": "stickersOnItem", "comments": "comments"}
    columns = {
        "id": to_int(c("id")), "time_created": F.date_format(F.timestamp_seconds(to_int(c("createTime"))), "yyyy-MM-dd'T'HH:mm:ss"), "author_id": to_int(c("author.id")), "description": c("desc"),
        "hashtags": F.transform(hashtags(c("textExtra"), c("challenges")), lambda h: h["name"]), "mentions": mentions(c("textExtra")), "music_id": to_int(c("music.id")),
        "location_created": country(c("locationCreated")), **counts, "warn_info": unless(c("warnInfo"), "{}"), "channel_tags": unless(c("channelTags"), "{}"), "ai_gc_description": unless(c("AIGCDescription"), ""),
        **{n: c(p) for n, p in plain.items()}, **{n: F.coalesce(c(p), F.lit(False)) for n, p in flags.items()}, **{n: unless_empty(c(p)) for n, p in listed.items()},
    }
    return [v.alias(n) for n, v in columns.items()]


def video_metadata(raw: DataFrame) -> DataFrame:
    return raw.select(*_video_columns())


def _file_columns() -> list[Column]:
    v = F.col("video")
    cla, volume = v["claInfo"], v["volumeInfo"]
    return [
        to_int(F.col("id")).alias("id"), F.lit(None).cast("string").alias("filepath"), v["duration"].alias("duration"), v["height"].alias("height"), v["width"].alias("width"), lines_of_resolution(v["ratio"]).alias("ratio"),
        volume["Loudness"].alias("volume_loudness"), volume["Peak"].alias("volume_peak"), cla["hasOriginalAudio"].alias("has_original_audio"), cla["enableAutoCaption"].alias("enable_audio_caption"), cla["noCaptionReason"].alias("no_caption_reason"),
        F.col("imagePost").isNotNull().alias("is_slide"),
    ]


def file_metadata(raw: DataFrame) -> DataFrame:
    return raw.select(*_file_columns())


def music_metadata(raw: DataFrame) -> DataFrame:
    m = F.col("music")
    return raw.select(to_int(m["id"]).alias("id"), m["title"].alias("title"), m["authorName"].alias("author_name"), m["original"].alias("original"), m["scheduleSearchTime"].alias("schedule_search_time"), m["collected"].alias("collected"), m["preciseDuration"].alias("precise_duration"))


def author_metadata(raw: DataFrame) -> DataFrame:
    a = F.col("author")
    names = {
        "username": "uniqueId", "name": "nickname", "signature": "signature", "create_time": "createTime", "verified": "verified", "ftc": "ftc", "relation": "relation", "open_favorite": "openFavorite",
        "comment_setting": "commentSetting", "duet_setting": "duetSetting", "stitch_setting": "stitchSetting", "private_account": "privateAccount", "secret": "secret", "is_ad_virtual": "isADVirtual",
        "download_setting": "downloadSetting", "recommend_reason": "recommendReason", "suggest_account_bind": "suggestAccountBind",
    }
    return raw.select(to_int(a["id"]).alias("id"), *(a[p].alias(n) for n, p in names.items()))


def hashtags_metadata(raw: DataFrame) -> DataFrame:
    return raw.select(to_int(F.col("id")).alias("video_id"), F.posexplode(hashtags(F.col("textExtra"), F.col("challenges"))).alias("pos", "h")).select("video_id", "pos", "h.*")


def links(raw: DataFrame) -> DataFrame:
    """Media addresses; an empty play address falls back to the download address, a null one doesn't."""
    play = F.col("video.playAddr")
    return raw.select(to_int(F.col("id")).alias("id"), F.when(play == "", F.col("video.downloadAddr")).otherwise(play).alias("mp4"), F.col("music.playUrl").alias("mp3"), F.col("imagePost.images").alias("jpegs"))


def video_type(labels: Column) -> Column:
    low = F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    has = lambda *names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    return F.when(has("education", "learnontiktok"), "EDUCATE").when(has("entertainment", "comedy"), "ENTERTAIN").otherwise("VIDEO")


def _shown() -> list[Column]:
    title = F.coalesce(F.nullif(F.col("v.description"), F.lit("")), F.lit("No Title"))
    count = lambda c, n: F.coalesce(F.col(f"v.{c}"), F.lit(0)).alias(n)
    audio = F.coalesce("f.has_original_audio", F.lit(True)) | F.coalesce("f.enable_audio_caption", F.lit(True))
    return [
        F.col("v.id").cast("string").alias("id"), title.alias("title"), F.coalesce("v.hashtags", F.array().cast("array<string>")).alias("hashtags"),
        count("playcount", "views"), count("diggcount", "likes"), count("commentcount", "comments"), count("sharecount", "shares"), count("collectcount", "saves"),
        F.coalesce("f.duration", F.lit(0)).alias("video_duration"), audio.alias("has_audio"), video_type(F.col("v.diversification_labels")).alias("video_type"),
    ]


def display_metadata(videos: DataFrame, files: DataFrame) -> DataFrame:
    """What a library shows of a flattened item, with defaults; a null takes the default as a missing key does."""
    return videos.alias("v").join(files.alias("f"), F.col("v.id") == F.col("f.id"), "left").select(*_shown())


def displayed(raw: DataFrame) -> DataFrame:
    """``display_metadata`` of raw items: video and file are of one row, so each item is read once and nothing is joined."""
    return raw.select(F.struct(*_video_columns()).alias("v"), F.struct(*_file_columns()).alias("f")).select(*_shown())


def overlay(scraped: DataFrame, probed: DataFrame) -> DataFrame:
    """Probed (id, duration, has_audio, width, height) over scraped values: duration and sound always, the size only if both sides are known."""
    p = probed.select("id", *(F.col(c).alias(f"p_{c}") for c in ("duration", "has_audio", "width", "height")), F.lit(True).alias("probed"))
    sized = F.coalesce((F.col("p_width") > 0) & (F.col("p_height") > 0), F.lit(False))
    probed_ = F.coalesce("probed", F.lit(False))
    joined = scraped.join(p, "id", "left")
    new = {c: F.when(probed_, F.col(f"p_{c}")).otherwise(F.col(c)) for c in ("duration", "has_audio")} | {c: F.when(sized, F.col(f"p_{c}")).otherwise(F.col(c)) for c in ("width", "height")}
    return joined.select("id", *(v.alias(c) for c, v in new.items()), F.when(~probed_, "ffprobe_failed_using_scraper_metadata").alias("warning"))
