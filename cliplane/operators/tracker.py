"""The work queue ``objects``: idempotent adds, state changes, probes and statistics.

Each mutator takes the queue and returns the changed queue with its columns.
``now`` is a timestamp in seconds, so that a rerun gives the same rows. A queue with
the column ``updated_at`` has the time of the change there in every row that a
mutator changes or adds. Where one batch names an id more than once, rows count in
the order of ``pos``; without that column the greatest value counts as the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("completed", "error", "pending", "retry")
OPEN = ("pending", "retry")


def _set(objects: DataFrame, where: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    if "updated_at" in objects.columns:
        values |= {"updated_at": F.current_timestamp()}
    return objects.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def add_objects(objects: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Add (id, title, type) rows whose id is new; the first of rows with one id counts (by ``pos``), known ids stay as they are."""
    first = new.groupBy("id").agg(F.min(F.struct("pos", "title", "type")).alias("f")).select("id", "f.title", "f.type")
    fresh = first.join(objects.select("id"), "id", "left_anti")
    filled = {"status": F.lit("pending"), "added_at": F.lit(now).cast("long"), "attempts": F.lit(0), "updated_at": F.current_timestamp()}
    kinds = dict(objects.dtypes)
    rows = fresh.select(*(filled[c].alias(c) if c in filled else F.col(c) if c in fresh.columns else F.lit(None).cast(kinds[c]).alias(c) for c in objects.columns))
    return objects.unionByName(rows)


def _last(rows: DataFrame, value: str) -> DataFrame:
    """(_id, _value, _n): the last value of each id, and how often it occurs."""
    order = [c for c in ("pos", value) if c in rows.columns]
    return rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(value), F.struct(*order))[value].alias("_value"), F.count("*").cast("int").alias("_n"))


def mark_completed(objects: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """Complete the ids of ``done`` (id, file_path, pos); the last path of an id wins, unknown ids change nothing."""
    paths = _last(done, "file_path")
    joined = objects.join(paths, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return _set(joined, hit, status=F.lit("completed"), completed_at=F.lit(now).cast("long"), file_path=F.col("_value")).select(*objects.columns)


def zipped(ids: Column, paths: Column) -> Column:
    """Positional pairs of ids and paths, with their position."""
    numbered = F.transform(F.arrays_zip(ids.alias("id"), paths.alias("file_path")), lambda x, i: F.struct(x["id"].alias("id"), x["file_path"].alias("file_path"), i.alias("pos")))
    return F.explode(numbered)


def mark_error(objects: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """Record errors (id, message, pos; the message may be null): every one counts as an attempt, the last message stays."""
    said = _last(failed, "message")
    joined = objects.join(said, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return _set(joined, hit, status=F.lit("error"), attempts=F.col("attempts") + F.col("_n"), last_error=F.col("_value"), last_attempt=F.lit(now).cast("long")).select(*objects.columns)


def reset_errors(objects: DataFrame) -> DataFrame:
    """Errors become pending and lose their message and time; attempts stay."""
    return _set(objects, F.col("status") == "error", status=F.lit("pending"), last_error=F.lit(None).cast("string"), last_attempt=F.lit(None).cast("long"))


def reset_all(objects: DataFrame) -> DataFrame:
    """All become pending without message and time; attempts and completion times stay."""
    return _set(objects, F.lit(True), status=F.lit("pending"), last_error=F.lit(None).cast("string"), last_attempt=F.lit(None).cast("long"))


def clear(objects: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Without ids all rows go."""
    return objects.limit(0) if ids is None else objects.join(ids.select("id"), "id", "left_anti")


def put_metadata(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace (key, value) rows; the last by ``pos`` wins."""
    last = new.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    return stored.join(last.select("key"), "key", "left_anti").unionByName(last)


def pending(objects: DataFrame, kind: str = "all", limit: int | None = None) -> DataFrame:
    """Open work, oldest first (ties by id)."""
    rows = objects.filter(F.col("status").isin(*OPEN))
    rows = rows if kind == "all" else rows.filter(F.col("type") == kind)
    if limit is not None:
        rows = rows.orderBy("added_at", "id").limit(limit)
    return rows.select("id", "title", "type")


def status_of(objects: DataFrame, object_id: int) -> DataFrame:
    return objects.filter(F.col("id") == object_id).limit(1)


def is_completed(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked ids that exist as completed."""
    return ids.join(objects.filter(F.col("status") == "completed"), "id", "left_semi")


def errors(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("status") == "error").select("id", "title", "type", "last_error", "last_attempt", "attempts", F.lit(None).cast("long").alias("completed_at"))


def completed(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("status") == "completed").select("id", "title", "type", "completed_at", "file_path", F.lit(None).cast("string").alias("last_error"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias({"error": "errors"}.get(s, s)) for s in STATUSES]


def stats(objects: DataFrame, kind: str = "all") -> DataFrame:
    """Counts by status, zero-filled; other statuses aren't counted."""
    return (objects if kind == "all" else objects.filter(F.col("type") == kind)).agg(*_counts())


def stats_summary(objects: DataFrame) -> DataFrame:
    """Counts by type and over all rows, in one pass of grouping sets."""
    grouped = objects.rollup("type").agg(*_counts(), F.grouping("type").alias("every"))
    return grouped.filter((F.col("every") == 1) | F.col("type").isin("content", "user")).select(F.when(F.col("every") == 1, "all").otherwise(F.col("type")).alias("scope"), "completed", "errors", "pending", "retry")


def rates(objects: DataFrame) -> DataFrame:
    """Share of completed and failed work in per cent; null without work."""
    total = F.count("*")
    share = lambda s: F.bround(F.lit(100.0) * F.count_if(F.col("status") == s) / F.nullif(total, F.lit(0)), 1)
    return objects.agg(total.alias("total"), share("completed").alias("progress_percent"), share("error").alias("error_percent"))
