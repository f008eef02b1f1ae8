"""Parsing of addresses, pages, probe output, model answers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and names that uploads are held against
UPLOAD_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm")
MAX_UPLOAD_BYTES = 500 * 1024 * 1024
MAX_REMOTE_BYTES = 2 * 1024**3
MIN_DURATION, MAX_DURATION = 3, 600
CODECS = ("h264", "hevc", "h265", "vp9", "av1", "mpeg4")
REMOTE_MIMES = ("video/mp4", "video/mpeg", "video/mov", "video/avi", "video/x-flv", "video/mpg", "video/webm", "video/wmv", "video/3gpp", "video/quicktime")
MIMES = {
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".webm": "video/webm",
    ".mkv": "video/x-matroska", ".flv": "video/x-flv", ".wmv": "video/x-ms-wmv", ".3gp": "video/3gpp",
}
STATUS_LABELS = {"analyzed": "✅ Đã phân tích", "processing": "⏳ Đang xử lý", "uploaded": "📤 Đã upload", "pending": "⏳ Đang chờ", "failed": "❌ Thất bại"}
PACING_COLORS = {"Nhanh": "red", "Chậm": "blue", "Dồn dập": "orange", "Vừa phải": "green", "Tĩnh lặng": "gray"}

PROBE = "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, duration: string, r_frame_rate: string>>, format struct<duration: string, bit_rate: string, size: string>"


def extracted(t: Column, pattern: str, group: int = 1) -> Column:
    """The first hit, null without one."""
    return F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))


def lookup(names: dict[str, str], key: Column, default: str | None) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def script_json(html: Column, script_id: str) -> Column:
    """What the script with this id holds."""
    return extracted(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>')


def first_script(html: Column) -> Column:
    return extracted(html, "(?s)<script[^>]*>(.*?)</script>")


def user_name(name: Column) -> Column:
    return F.replace(name, F.lit("@"), F.lit(""))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_upload(name: Column) -> Column:
    return extension(name).isin(*UPLOAD_EXTENSIONS)


def fits_upload(size: Column) -> Column:
    return size <= MAX_UPLOAD_BYTES


def is_platform_url(url: Column) -> Column:
    return F.lower(url).contains("tiktok.com")


def video_id(url: Column) -> Column:
    """From the path, else the text itself if it is digits, else a long run of digits in it."""
    return F.coalesce(extracted(url, r"/(video|photo)/(\d+)", 2), F.when(url.rlike(r"^\d+$"), url), extracted(url, r"(\d{15,})"))


def video_id_in_path(url: Column) -> Column:
    return extracted(url, r"/video/(\d+)")


def change_times(log: Column) -> Column:
    """Sorted distinct times of scene changes in a filter's log."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:(\d+\.?\d*)"), F.lit(1)), lambda t: t.cast("double"))))


def frame_rate(text: Column) -> Column:
    """``30000/1001`` is 29.97; 0 without a denominator."""
    parts = F.split(text, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(bottom != 0, F.bround(top / F.nullif(bottom, F.lit(0.0)), 2)).otherwise(0.0)


def megabytes(size: Column) -> Column:
    return F.bround(size / F.lit(1024.0 * 1024.0), 2)


def probe(json: Column) -> Column:
    """Measures of a media file from a prober's JSON: of the first video and the first sound stream."""
    p = F.from_json(json, PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    sound = F.exists(p["streams"], lambda s: s["codec_type"] == "audio")
    duration = F.coalesce(p["format"]["duration"].try_cast("double"), video["duration"].try_cast("double"), F.lit(0.0))
    return F.struct(
        duration.alias("duration"), frame_rate(video["r_frame_rate"]).alias("fps"), F.coalesce(video["codec_name"], F.lit("unknown")).alias("codec"), sound.alias("has_audio"),
        F.coalesce(video["width"], F.lit(0)).alias("width"), F.coalesce(video["height"], F.lit(0)).alias("height"), F.coalesce(p["format"]["size"].try_cast("bigint"), F.lit(0)).alias("file_size"),
    )


def validated(exists: Column, probed: Column, scraped: Column) -> Column:
    """(is_valid, confidence, warnings) of a file; ``scraped`` stands in where the probe is null."""
    meta = F.coalesce(probed, scraped)
    none = meta.isNull()
    codec = F.lower(F.coalesce(meta["codec"], F.lit("unknown")))
    short, long, mute = meta["duration"] < MIN_DURATION, meta["duration"] > MAX_DURATION, ~meta["has_audio"]
    odd = ~codec.isin(*CODECS, "unknown")
    unsized = (meta["width"] == 0) | (meta["height"] == 0)
    named = ((probed.isNull() & ~none, "ffprobe_failed_using_scraper_metadata"), (none, "cannot_read_metadata"), (short, "video_too_short"), (long, "video_too_long"), (mute, "no_audio"), (odd, "unusual_codec"), (unsized, "invalid_resolution"))
    warnings = F.filter(F.array(*(F.when(c, n) for c, n in named)), lambda n: n.isNotNull())
    yes = lambda c: F.coalesce(c, F.lit(False))
    sure = F.when(none | yes(short) | yes(unsized), "low").when(yes(long) | yes(mute) | yes(odd), "medium").otherwise("high")
    return F.struct(
        (exists & ~none).alias("is_valid"), F.when(~exists, "low").otherwise(sure).alias("confidence"), F.when(~exists, F.array(F.lit("file_not_found"))).otherwise(warnings).alias("warnings")
    )


def should_normalize(warnings: Column) -> Column:
    return F.arrays_overlap(warnings, F.array(F.lit("unusual_codec"), F.lit("cannot_read_metadata")))


def mime_type(name: Column) -> Column:
    return lookup(MIMES, extension(name), "video/mp4")


def is_remote_upload(name: Column, size: Column) -> Column:
    return (size > 0) & (size <= MAX_REMOTE_BYTES) & mime_type(name).isin(*REMOTE_MIMES)


def answer_json(answer: Column) -> Column:
    """The JSON object in a model's answer: all of it, a fenced block, or from the first to the last brace; null if none parses."""
    tries = [answer, extracted(answer, r"(?s)```json\s*(.*?)\s*```"), extracted(answer, r"(?s)```\s*(.*?)\s*```"), extracted(answer, r"(?s)(\{.*\})")]
    whole = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(*map(whole, tries))


def time_range(text: Column, start: Column, end: Column) -> Column:
    """(start_seconds, end_seconds): both from ``MM:SS - MM:SS`` if one is missing and it can be read."""
    sides = F.split(text, " - ")
    two = lambda i: F.split(F.trim(F.get(sides, F.lit(i))), ":")
    seconds = lambda i: F.get(two(i), F.lit(0)).try_cast("int") * 60 + F.get(two(i), F.lit(1)).try_cast("int")
    readable = (F.size(sides) == 2) & seconds(0).isNotNull() & seconds(1).isNotNull() & (start.isNull() | end.isNull())
    pick = lambda i, old: F.when(readable, seconds(i).cast("double")).otherwise(old)
    return F.struct(pick(0, start).alias("start_seconds"), pick(1, end).alias("end_seconds"))


def database_name(uri: Column, default: str) -> Column:
    return F.coalesce(extracted(uri, r"^[^:]+://[^/]+/([^?]+)"), F.lit(default))


def new_video_id() -> Column:
    return F.concat(F.lit("vid_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss_"), F.substring(F.uuid(), 1, 8))


def status_label(status: Column) -> Column:
    return lookup(STATUS_LABELS, F.coalesce(status, F.lit("pending")), None)


def pacing_color(pacing: Column) -> Column:
    return lookup(PACING_COLORS, pacing, "gray")
