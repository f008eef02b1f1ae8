"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.plans.registry import query
from cliplane.session import shared_dir
from cliplane.sources import files
from cliplane.sources.adapters import table
from cliplane.streaming import queue, states


@query("t_1_queue_stream", "SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'content' END AS type, 'pending' AS status, 0 AS attempts FROM orders")
def t_1(spark, d) -> DataFrame:
    """T-1 micro-batches and T-2 idempotent adds: every order is work, and each is seen twice."""
    orders = queue.work_stream(spark, f"{d}/orders.parque[t]", "o_orderkey long, o_custkey long, o_orderpriority string")
    kind = F.when(F.col("o_custkey") % 2 == 0, "user").otherwise("content")
    work = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), kind.alias("type"))
    place = f"{shared_dir(spark)}/cliplane-queue-{uuid.uuid4().hex}"
    for n in range(2):
        queue.ingest(work, f"{place}/queue", f"{place}/checkpoint-{n}", f"run{n}")
    return queue.read_queue(spark, f"{place}/queue")


@query("k_4_json_files", "SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer")
def k_4(spark, d) -> DataFrame:
    """JSON lines, written and read again; null fields are there, too."""
    place = f"{shared_dir(spark)}/cliplane-json-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    files.write_json(rows, place)
    return spark.read.schema("id long, title string, segment string").json(place)


@query("s_4_documents", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation")
def s_4(spark, d) -> DataFrame:
    """One JSON document a file, over several lines."""
    place = f"{shared_dir(spark)}/cliplane-documents-{uuid.uuid4().hex}"
    text = F.concat(F.lit("{\n  \"id\": "), F.col("n_nationkey").cast("string"), F.lit(",\n  \"title\": \""), F.col("n_name"), F.lit("\"\n}"))
    table(spark, d, "nation").select(text.alias("value"), F.col("n_nationkey").alias("key")).repartition("key").write.partitionBy("key").text(place)
    return files.read_metadata(spark, f"{place}/*", "id long, title string")


@query("s_22_file_info", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(length(n_name) + 1 AS BIGINT) AS size, '.txt' AS suffix FROM nation")
def s_22(spark, d) -> DataFrame:
    """Size and suffix of files of a known text."""
    place = f"{shared_dir(spark)}/cliplane-files-{uuid.uuid4().hex}"
    table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("id")).repartition("id").write.partitionBy("id").text(place)
    found = files.file_info(spark, f"{place}/*/*.txt")
    return found.select(F.regexp_extract("path", r"/id=(\d+)/", 1).cast("long").alias("id"), "size", "suffix")


@query("s_22_missing_files", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 3 <> 0 THEN 1 END AS there FROM nation")
def s_22b(spark, d) -> DataFrame:
    """Files that are asked for, every third of which isn't there: null, no error."""
    place = f"{shared_dir(spark)}/cliplane-asked-{uuid.uuid4().hex}"
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    nations.filter("id % 3 <> 0").select("n_name", "id").repartition("id").write.partitionBy("id").text(place)
    there = files.file_info(spark, f"{place}/*/*.txt").withColumn("path", F.concat(F.regexp_extract("path", r"/id=(\d+)/", 1), F.lit(".txt")))
    asked = nations.select("id", F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"))
    return files.asked_files(asked, there).select("id", F.when(F.col("size").isNotNull(), 1).alias("there"))


@query("t_4_state_stream", "SELECT user_id AS video_id, max_by(event_type, struct_pack(ts := ts, id := event_id)) AS state FROM events GROUP BY user_id")
def t_4(spark, d) -> DataFrame:
    """The latest state of each video, kept by a stream over the events."""
    events = queue.work_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
    changes = events.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("state"), F.struct("ts", "event_id").alias("at"))
    place, name = f"{shared_dir(spark)}/cliplane-states-{uuid.uuid4().hex}", f"states_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.select("video_id", "state").write.mode("overwrite").parquet(f"{place}/{name}/epoch={epoch:010}")

    run = queue.states(changes).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{place}/{name}").agg(F.max("epoch")).first()[0]
    return spark.read.parquet(f"{place}/{name}").filter(F.col("epoch") == last).drop("epoch")


@query("t_2_watermark_ingest", """SELECT event_id AS id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS day FROM events
UNION ALL SELECT event_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 + 15 FROM events""")
def t_2(spark, d) -> DataFrame:
    """Work that comes again half a day later is known, 15 days later it is new; what comes 20 days late is left out."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("title"), F.lit("content").alias("type"))
    at = lambda hours: e.withColumn("ts", F.col("ts") + F.expr(f"interval {hours} hours"))
    period = lambda rows: rows.withColumn("part", F.floor(F.unix_timestamp("ts") / (5 * 86400)))
    first = e.agg(F.min("ts").alias("t")).first()["t"]
    late = period(e.filter((F.col("id") % 7 == 0) & (F.datediff("ts", F.lit(first)) > 15))).withColumn("ts", F.col("ts") - F.expr("interval 20 days")).withColumn("id", -F.col("id") - 1)
    place = f"{shared_dir(spark)}/cliplane-once-{uuid.uuid4().hex}"
    every = period(e.unionByName(at(12)).unionByName(at(15 * 24))).unionByName(late)
    # One batch for each five days, in order of time.
    parts = [r["part"] for r in every.select("part").distinct().orderBy("part").collect()]
    every.repartition("part").write.partitionBy("part").parquet(f"{place}/all")
    for n in parts:
        spark.read.parquet(f"{place}/all/part={n}").coalesce(1).write.mode("append").parquet(f"{place}/in")
    work = spark.readStream.schema("id long, ts timestamp, title string, type string").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    queue.ingest_once(work, f"{place}/queue", f"{place}/checkpoint")
    return queue.read_bucketed(spark, f"{place}/queue").select("id", F.floor(F.unix_timestamp("ts") / 86400).alias("day"))


@query("t_4_state_machine", """WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS us,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'analyzed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS go FROM events
), r AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, '' AS state, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS timeouts FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n + 1, CASE WHEN ok THEN go ELSE s END, CASE WHEN ok THEN us WHEN late THEN since + 21600000000 ELSE since END, refused + CASE WHEN ok THEN 0 ELSE 1 END, timeouts + CASE WHEN late THEN 1 ELSE 0 END
  FROM (SELECT *, CASE s WHEN '' THEN go IN ('pending', 'processing') WHEN 'pending' THEN go = 'processing' WHEN 'processing' THEN go IN ('analyzed', 'failed') WHEN 'analyzed' THEN go = 'processing' ELSE go IN ('processing', 'pending') END AS ok
        FROM (SELECT r.*, e.us, e.go, state = 'processing' AND e.us - since >= 21600000000 AS late, CASE WHEN state = 'processing' AND e.us - since >= 21600000000 THEN 'failed' ELSE state END AS s FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
)
SELECT user_id AS video_id, CASE state WHEN 'processing' THEN 'failed' ELSE state END AS state, CASE state WHEN 'processing' THEN since + 21600000000 ELSE since END AS since_us, refused,
       timeouts + CASE state WHEN 'processing' THEN 1 ELSE 0 END AS timeouts FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def t_4_machine(spark, d) -> DataFrame:
    """The status machine over the events in three batches that are out of order, then a row that moves the clock, so that timers fire."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    go = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "analyzed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    rows = e.select(F.col("user_id").alias("video_id"), "ts", F.col("event_id").alias("pos"), go.alias("state"))
    place = f"{shared_dir(spark)}/cliplane-machine-{uuid.uuid4().hex}"
    for n in range(3):
        rows.filter(F.col("pos") % 3 == n).coalesce(1).write.mode("append").parquet(f"{place}/in")
    clock = rows.agg((F.max("ts") + F.expr("interval 70 days")).alias("ts")).select(F.lit(-1).cast("long").alias("video_id"), "ts", F.lit(0).cast("long").alias("pos"), F.lit("pending").alias("state"))
    clock.coalesce(1).write.mode("append").parquet(f"{place}/in")
    changes = spark.readStream.schema("video_id long, ts timestamp, pos long, state string").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    states.run(changes, place, delay="60 days")
    return states.statuses(spark, place).filter("video_id >= 0")
