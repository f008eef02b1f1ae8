"""Queries of the work queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.operators import tracker
from cliplane.operators.changelog import ChangeLog
from cliplane.plans.registry import ORACLES, query
from cliplane.session import shared_dir
from cliplane.sources.adapters import objects, sql, table

NOW = 1_000_000_000
ALL = "id, status, title, type, added_at, attempts, completed_at, last_error, last_attempt, file_path"
COUNTS = "count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'retry') AS retry"


def _parts(spark, d) -> DataFrame:
    """Ids to change: those of lineitem's orders whose first line was returned."""
    return table(spark, d, "lineitem").filter("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()


PARTS = "parts AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R')"


@query("k_6_add_objects", sql("objects", f"""SELECT {ALL} FROM objects UNION ALL
SELECT id, 'pending', title, type, {NOW}, 0, NULL, NULL, NULL, NULL FROM (SELECT l_orderkey * 2 AS id, min({{'pos': l_linenumber, 'title': l_linestatus}}).title AS title, 'content' AS type FROM lineitem GROUP BY l_orderkey)
WHERE id NOT IN (SELECT id FROM objects)"""))
def k_6(spark, d) -> DataFrame:
    new = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"), F.col("l_linestatus").alias("title"), F.lit("content").alias("type"), F.col("l_linenumber").alias("pos"))
    return tracker.add_objects(objects(spark, d), new, NOW)


@query("k_7_put_metadata", "SELECT r_name AS key, 'v' || r_regionkey AS value FROM region WHERE r_name NOT IN (SELECT r_name FROM region WHERE r_regionkey > 1) UNION ALL SELECT r_name, 'new' FROM region WHERE r_regionkey > 1")
def k_7(spark, d) -> DataFrame:
    regions = table(spark, d, "region")
    stored = regions.select(F.col("r_name").alias("key"), F.concat(F.lit("v"), F.col("r_regionkey").cast("string")).alias("value"))
    new = regions.filter("r_regionkey > 1").select(F.col("r_name").alias("key"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("old").alias("value")), F.struct(F.lit(1).alias("pos"), F.lit("new").alias("value")))).alias("x"))
    return tracker.put_metadata(stored, new.select("key", "x.value", "x.pos"))


@query("k_8_mark_completed", sql("objects", f""", {PARTS} SELECT o.id, CASE WHEN p.id IS NULL THEN status ELSE 'completed' END AS status, title, type, added_at, attempts,
CASE WHEN p.id IS NULL THEN completed_at ELSE {NOW} END AS completed_at, last_error, last_attempt, CASE WHEN p.id IS NULL THEN file_path ELSE 'done/' || p.id END AS file_path FROM objects o LEFT JOIN parts p ON o.id = p.id"""))
def k_8(spark, d) -> DataFrame:
    path = lambda folder: F.concat(F.lit(folder), F.col("id").cast("string"))
    # The id comes twice, and one that isn't in the queue between: the last path wins.
    done = _parts(spark, d).select(F.array("id", -F.col("id") - 1, "id").alias("ids"), F.array(path("zzz/"), path("none/"), path("done/")).alias("paths"))
    pairs = done.select(tracker.zipped(F.col("ids"), F.col("paths")).alias("p")).select("p.*")
    return tracker.mark_completed(objects(spark, d), pairs, NOW)


@query("k_9_mark_error", sql("objects", f""", {PARTS} SELECT o.id, CASE WHEN p.id IS NULL THEN status ELSE 'error' END AS status, title, type, added_at, CASE WHEN p.id IS NULL THEN attempts ELSE attempts + CASE WHEN p.id % 3 = 0 THEN 2 ELSE 1 END END AS attempts,
completed_at, CASE WHEN p.id IS NULL THEN last_error WHEN p.id % 2 = 0 THEN 'timeout' END AS last_error, CASE WHEN p.id IS NULL THEN last_attempt ELSE {NOW} END AS last_attempt, file_path FROM objects o LEFT JOIN parts p ON o.id = p.id"""))
def k_9(spark, d) -> DataFrame:
    first = _parts(spark, d).filter("id % 3 = 0").select("id", F.lit("zzz").alias("message"), F.lit(0).alias("pos"))
    failed = _parts(spark, d).select("id", F.when(F.col("id") % 2 == 0, "timeout").alias("message"), F.lit(1).alias("pos"))
    return tracker.mark_error(objects(spark, d), first.unionByName(failed), NOW)


@query("k_10_reset_errors", sql("objects", """SELECT id, CASE status WHEN 'error' THEN 'pending' ELSE status END AS status, title, type, added_at, attempts, completed_at, CASE WHEN status <> 'error' THEN last_error END AS last_error,
CASE WHEN status <> 'error' THEN last_attempt END AS last_attempt, file_path FROM objects"""))
def k_10(spark, d) -> DataFrame:
    return tracker.reset_errors(objects(spark, d))


@query("k_11_reset_all", sql("objects", "SELECT id, 'pending' AS status, title, type, added_at, attempts, completed_at, CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS BIGINT) AS last_attempt, file_path FROM objects"))
def k_11(spark, d) -> DataFrame:
    return tracker.reset_all(objects(spark, d))


@query("k_12_clear_ids", sql("objects", f", {PARTS} SELECT {ALL} FROM objects WHERE id NOT IN (SELECT id FROM parts)"))
def k_12(spark, d) -> DataFrame:
    return tracker.clear(objects(spark, d), _parts(spark, d))


@query("k_13_updated_at", sql("objects", """, fixed AS (SELECT id, CASE status WHEN 'error' THEN 'pending' ELSE status END AS status, status = 'error' AS touched FROM objects) SELECT * FROM fixed"""))
def k_13(spark, d) -> DataFrame:
    queue = objects(spark, d).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return tracker.reset_errors(queue).select("id", "status", F.col("updated_at").isNotNull().alias("touched"))


@query("p_8_pending", sql("objects", "SELECT id, title, type FROM objects WHERE status IN ('pending', 'retry') AND type = 'user' ORDER BY added_at, id LIMIT 100"))
def p_8(spark, d) -> DataFrame:
    return tracker.pending(objects(spark, d), "user", 100)


@query("o_4_pending_all", sql("objects", "SELECT id, title, type FROM objects WHERE status IN ('pending', 'retry')"))
def o_4(spark, d) -> DataFrame:
    return tracker.pending(objects(spark, d))


@query("p_17_object_status", sql("objects", f"SELECT {ALL} FROM objects WHERE id = 77"))
def p_17(spark, d) -> DataFrame:
    return tracker.status_of(objects(spark, d), 77)


@query("j_7_is_completed", sql("objects", f", {PARTS} SELECT id FROM parts WHERE EXISTS (SELECT 1 FROM objects WHERE objects.id = parts.id AND status = 'completed')"))
def j_7(spark, d) -> DataFrame:
    return tracker.is_completed(objects(spark, d), _parts(spark, d))


@query("j_8_insert_ignore", "SELECT DISTINCT l_orderkey * 3 AS id FROM lineitem WHERE l_orderkey * 3 NOT IN (SELECT o_orderkey FROM orders)")
def j_8(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 3).alias("id")).distinct().join(objects(spark, d).select("id"), "id", "left_anti")


@query("p_18_errors", sql("objects", "SELECT id, title, type, last_error, last_attempt, attempts, CAST(NULL AS BIGINT) AS completed_at FROM objects WHERE status = 'error'"))
def p_18(spark, d) -> DataFrame:
    return tracker.errors(objects(spark, d))


@query("p_18_completed", sql("objects", "SELECT id, title, type, completed_at, file_path, CAST(NULL AS VARCHAR) AS last_error FROM objects WHERE status = 'completed'"))
def p_18b(spark, d) -> DataFrame:
    return tracker.completed(objects(spark, d))


@query("o_3_latest_errors", sql("objects", "SELECT id, last_attempt FROM objects WHERE status = 'error' ORDER BY last_attempt DESC, id LIMIT 50"))
def o_3(spark, d) -> DataFrame:
    return tracker.errors(objects(spark, d)).orderBy(F.desc("last_attempt"), "id").limit(50).select("id", "last_attempt")


@query("o_5_first_errors", sql("objects", "SELECT id FROM objects WHERE status = 'error' ORDER BY id LIMIT 10"))
def o_5(spark, d) -> DataFrame:
    return tracker.errors(objects(spark, d)).orderBy("id").limit(10).select("id")


@query("a_2_stats", sql("objects", f"SELECT {COUNTS} FROM objects"))
def a_2(spark, d) -> DataFrame:
    return tracker.stats(objects(spark, d))


@query("a_3_stats_summary", sql("objects", f"SELECT type AS scope, {COUNTS} FROM objects GROUP BY type UNION ALL SELECT 'all', {COUNTS} FROM objects"))
def a_3(spark, d) -> DataFrame:
    return tracker.stats_summary(objects(spark, d))


@query("a_4_rates", sql("objects", """SELECT count(*) AS total, round_even(100.0::DOUBLE * count(*) FILTER (status = 'completed') / nullif(count(*), 0), 1) AS progress_percent,
round_even(100.0::DOUBLE * count(*) FILTER (status = 'error') / nullif(count(*), 0), 1) AS error_percent FROM objects"""))
def a_4(spark, d) -> DataFrame:
    return tracker.rates(objects(spark, d))


@query("a_16_eta", """SELECT event_id, sum(c) OVER w / (CAST(100 AS DOUBLE) * count(*) OVER w) AS mean_seconds FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def a_16(spark, d) -> DataFrame:
    """The mean of the last 100 iteration times of a worker (what the frozen list of the original meant to hold), from whole hundredths."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)
    hundredths = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").select("event_id", (F.sum(hundredths).over(w) / (F.lit(100.0) * F.count("*").over(w))).alias("mean_seconds"))


@query("f_39_eta_text", sql("objects", """SELECT type, printf('%d:%02d:%02d', n * 2 // 3600, n * 2 % 3600 // 60, n * 2 % 60) AS eta, format('{:,}', n) AS n_text
FROM (SELECT type, count(*) AS n FROM objects WHERE status = 'pending' GROUP BY type)"""))
def f_39(spark, d) -> DataFrame:
    n = F.col("n") * 2
    waiting = objects(spark, d).filter("status = 'pending'").groupBy("type").agg(F.count("*").alias("n"))
    return waiting.select("type", F.format_string("%d:%02d:%02d", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60).alias("eta"), F.format_number("n", 0).alias("n_text"))


def _logged(spark, d, change, compact: bool = False) -> DataFrame:
    """The queue after ``change`` of a change log over it, read from the log or after a compaction."""
    log = ChangeLog.create(spark, f"{shared_dir(spark)}/cliplane-log-{uuid.uuid4().hex}", objects(spark, d), 16)
    change(log)
    if compact:
        log.compact()
    return log.objects()


@query("k_6_log_add", ORACLES["k_6_add_objects"])
def k_6_log(spark, d) -> DataFrame:
    """K-6 by the log: the new rows are appended, not the queue written."""
    new = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"), F.col("l_linestatus").alias("title"), F.lit("content").alias("type"), F.col("l_linenumber").alias("pos"))
    return _logged(spark, d, lambda log: log.add(new, NOW))


@query("k_8_log_completed", ORACLES["k_8_mark_completed"])
def k_8_log(spark, d) -> DataFrame:
    """K-8 by the log, read after a compaction."""
    path = lambda folder: F.concat(F.lit(folder), F.col("id").cast("string"))
    done = _parts(spark, d).select(F.array("id", -F.col("id") - 1, "id").alias("ids"), F.array(path("zzz/"), path("none/"), path("done/")).alias("paths"))
    return _logged(spark, d, lambda log: log.complete(done.select(tracker.zipped(F.col("ids"), F.col("paths")).alias("p")).select("p.*"), NOW), compact=True)


@query("k_9_log_error", ORACLES["k_9_mark_error"])
def k_9_log(spark, d) -> DataFrame:
    """K-9 by the log, in two batches."""
    first = _parts(spark, d).filter("id % 3 = 0").select("id", F.lit("zzz").alias("message"), F.lit(0).alias("pos"))
    failed = _parts(spark, d).select("id", F.when(F.col("id") % 2 == 0, "timeout").alias("message"), F.lit(1).alias("pos"))

    def both(log: ChangeLog) -> None:
        log.error(first, NOW - 1)
        log.error(failed, NOW)

    return _logged(spark, d, both)


@query("k_10_log_reset_errors", ORACLES["k_10_reset_errors"])
def k_10_log(spark, d) -> DataFrame:
    return _logged(spark, d, lambda log: log.reset_errors())


@query("k_11_log_reset_all", ORACLES["k_11_reset_all"])
def k_11_log(spark, d) -> DataFrame:
    return _logged(spark, d, lambda log: log.reset_all(), compact=True)


@query("k_12_log_clear", ORACLES["k_12_clear_ids"])
def k_12_log(spark, d) -> DataFrame:
    return _logged(spark, d, lambda log: log.clear(_parts(spark, d)))


@query("k_13_log_updated", sql("objects", f""", {PARTS}, fresh AS (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT id FROM objects))
SELECT o.id, CASE WHEN p.id IS NOT NULL THEN 3 WHEN status = 'error' THEN 2 END AS updated_seq FROM objects o LEFT JOIN parts p ON o.id = p.id
UNION ALL SELECT id, 1 FROM fresh WHERE id NOT IN (SELECT id FROM parts) UNION ALL SELECT id, 3 FROM fresh WHERE id IN (SELECT id FROM parts)"""))
def k_13_log(spark, d) -> DataFrame:
    """K-13 in every mutator: which change touched each row last, of an add, a reset of errors and completions."""
    new = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"), F.col("l_linestatus").alias("title"), F.lit("content").alias("type"), F.col("l_linenumber").alias("pos"))
    log = ChangeLog.create(spark, f"{shared_dir(spark)}/cliplane-log-{uuid.uuid4().hex}", objects(spark, d), 16)
    log.add(new, NOW)
    log.reset_errors()
    log.complete(_parts(spark, d).withColumn("file_path", F.lit("p")), NOW)
    return log.state().select("id", "updated_seq")
