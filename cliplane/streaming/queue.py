"""The work queue as a stream: batches of new work, added once, whatever is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_FILES = 100
QUEUE = "id long, title string, type string, status string, attempts int"


def _existing(spark: SparkSession, queue: str, source: str, epoch: int) -> DataFrame | None:
    """What earlier batches have added; a batch that runs again doesn't see itself."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(queue)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return None
    return spark.read.schema(f"{QUEUE}, source string, epoch long").option("basePath", queue).parquet(queue).filter((F.col("epoch") != epoch) | (F.col("source") != source))


def add_batch(spark: SparkSession, queue: str, source: str):
    """foreachBatch: ids that the queue doesn't know are added as pending.

    A batch of a source has a folder of its own, so a rerun replaces it.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        first = batch.groupBy("id").agg(F.min(F.struct("title", "type")).alias("f")).select("id", "f.title", "f.type")
        known = _existing(spark, queue, source, epoch)
        fresh = first if known is None else first.join(known.select("id"), "id", "left_anti")
        fresh.select("id", "title", "type", F.lit("pending").alias("status"), F.lit(0).alias("attempts")).write.mode("overwrite").parquet(f"{queue}/source={source}/epoch={epoch}")

    return add


def ingest(work: DataFrame, queue: str, checkpoint: str, source: str) -> None:
    """Read all work that is there, batch by batch, and stop. ``work`` is a stream of (id, title, type); ``source`` names it."""
    run = work.writeStream.foreachBatch(add_batch(work.sparkSession, queue, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def work_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", BATCH_FILES).parquet(path)


def read_queue(spark: SparkSession, queue: str) -> DataFrame:
    return spark.read.schema(f"{QUEUE}, source string, epoch long").parquet(queue).drop("source", "epoch")


def ingest_once(work: DataFrame, queue: str, checkpoint: str, delay: str = "1 day", buckets: int = 16) -> int:
    """Add all work that is there of a stream of (id, ts, title, type) to a queue in buckets of ids; the number of rows that came too late.

    An id is added once, with the earliest of its rows that a batch holds. Its repeats within ``delay`` of that are known from
    a table of ids that the watermark bounds, so the queue is never read; a repeat after that is new work. The watermark of a batch is
    ``delay`` before the latest time of the batches before it; rows up to it are counted and left out. (Spark's own
    ``dropDuplicatesWithinWatermark`` keeps any row of those that a batch holds.) A batch that runs again replaces what it wrote:
    it reads what the batch before has left, and the tables of two batches take turns.
    """
    late = []

    def add(batch: DataFrame, epoch: int) -> None:
        spark, span = batch.sparkSession, F.expr(f"interval {delay}")
        place = lambda name, n: f"{checkpoint}/{name}/turn={n % 2}"
        newest = spark.read.schema("newest timestamp").parquet(place("clock", epoch - 1)).first()[0] if epoch else None
        line = F.lit(newest).cast("timestamp") - span
        old = F.coalesce(F.col("ts") <= line, F.lit(False))
        found = batch.agg(F.max("ts").alias("newest"), F.count_if(old).alias("late")).first()
        order = F.struct(F.col("ts").isNull(), "ts", "title", "type")
        fresh = batch.filter(~old).groupBy("id").agg(F.min_by(F.struct("ts", "title", "type"), order).alias("f")).select("id", "f.*")
        if epoch:
            known = spark.read.schema("id long, until timestamp").parquet(place("known", epoch - 1))
            fresh = fresh.join(known.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti")
        rows = fresh.select("id", "ts", "title", "type", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{queue}/epoch={epoch}")
        latest = max((t for t in (newest, found["newest"]) if t is not None), default=None)
        added = spark.read.schema("id long, ts timestamp").parquet(f"{queue}/epoch={epoch}").select("id", (F.col("ts") + span).alias("until"))
        every = known.unionByName(added) if epoch else added
        every.filter(F.col("until") > F.lit(latest).cast("timestamp") - span).write.mode("overwrite").parquet(place("known", epoch))
        spark.createDataFrame([(latest,)], "newest timestamp").coalesce(1).write.mode("overwrite").parquet(place("clock", epoch))
        late.append(found["late"])

    run = work.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(late)


def read_bucketed(spark: SparkSession, queue: str) -> DataFrame:
    """The queue that ``ingest_once`` keeps; a filter by ``bucket`` reads that bucket only."""
    return spark.read.schema("id long, ts timestamp, title string, type string, status string, attempts int, epoch long, bucket int").parquet(queue).drop("epoch")


def states(changes: DataFrame) -> DataFrame:
    """The latest state of each video of (video_id, state, at), as a stream or a table."""
    return changes.groupBy("video_id").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))
