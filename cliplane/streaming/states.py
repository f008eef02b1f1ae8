"""The status of each video as a state machine over a stream of changes.

A change is refused unless the status that the video has allows it, and a video that
stays in processing longer than a time limit fails by a timer. Changes may come out of order
within the watermark's delay: each waits in the video's state until the watermark has
passed it, so that they are taken in the order of their times, whatever the batches. Only videos
whose status has changed are written.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Workers get what this module defines with their task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The statuses of a video and what may follow each; a new one has none
ALLOWED = {"": ("pending", "processing"), "pending": ("processing",), "processing": ("analyzed", "failed"), "analyzed": ("processing",), "failed": ("processing", "pending")}
TIMED, EXPIRED = "processing", "failed"
LIMIT = 6 * 3600  # seconds in processing
DELAY = "1 day"
OUT = "video_id long, state string, since_us long, refused long, timeouts long, version long"


def _schema(ddl: str) -> StructType:
    """A schema of texts and whole numbers; unlike Spark's own reading of one it needs no session."""
    return StructType([StructField(n, StringType() if kind == "string" else LongType()) for n, kind in (f.split() for f in ddl.split(", "))])


KEPT = _schema("state string, since_us long, refused long, timeouts long, version long")
WAITING = _schema("events string")  # a batch's changes of a video: JSON of (at_us, pos, state)
DUE = _schema("at_us long")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """One video: its status with the time since when, what was refused and timed out, and the changes that wait."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)
        self.waiting = handle.getListState("waiting", WAITING)
        self.due = handle.getValueState("due", DUE)

    def _remind(self, due_us: int, now_us: int) -> None:
        self.due.update((due_us,))
        # Timers are in milliseconds; one too early would find nothing to do.
        self.handle.registerTimer(max(-(-due_us // 1000), now_us // 1000 + 1))

    def _advanced(self, video_id: int, new: list[tuple], now_us: int) -> Iterator[Row]:
        """Take all changes up to ``now_us`` in order and set the next timer."""
        state, since, refused, timeouts, version = self.kept.get() or ("", 0, 0, 0, 0)
        before = version
        events = sorted([*new, *(tuple(e) for (texts,) in self.waiting.get() for e in json.loads(texts))])
        ready = [e for e in events if e[0] <= now_us]
        for at, _, to in [*ready, (now_us, 0, None)]:
            if state == TIMED and at - since >= self.limit_us:
                state, since, timeouts, version = EXPIRED, since + self.limit_us, timeouts + 1, version + 1
            if to is None:
                continue
            version += 1
            if to in ALLOWED.get(state, ()):
                state, since = to, at
            else:
                refused += 1
        rest = events[len(ready) :]
        self.waiting.clear()
        if rest:
            self.waiting.put([(json.dumps(rest),)])
        if version != before:
            self.kept.update((state, since, refused, timeouts, version))
        due = [rest[0][0]] if rest else []
        due += [since + self.limit_us] if state == TIMED else []
        if due:
            self._remind(min(due), now_us)
        else:
            self.due.clear()
        if version != before:
            yield Row(video_id=video_id, state=state, since_us=since, refused=refused, timeouts=timeouts, version=version)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, now_us = sorted((r[2], r[3], r[4]) for r in rows), timerValues.getCurrentWatermarkInMs() * 1000
        if new[0][0] <= now_us:
            yield from self._advanced(key[0], new, now_us)
            return
        # All of them wait: those that wait already are neither read nor written again. What is due by now comes by its timer.
        self.waiting.appendValue((json.dumps(new),))
        due = self.due.get()
        if due is None or new[0][0] < due[0]:
            self._remind(new[0][0], now_us)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advanced(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def machine(changes: DataFrame, limit: int = LIMIT, delay: str = DELAY) -> DataFrame:
    """The stream of statuses of a stream of changes (video_id, ts, pos, state): a row each time a video's status has changed or a change was refused.

    ``pos`` orders changes of one time. Changes later than ``delay`` are dropped. ``version`` counts
    the changes of a video; the row with the greatest is its status.
    """
    rows = changes.select("video_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("pos").cast("long").alias("pos"), "state")
    timed = rows.withWatermark("ts", delay).groupBy("video_id")
    return timed.transformWithState(statefulProcessor=Machine(limit * 1_000_000), outputStructType=_schema(OUT), outputMode="Update", timeMode="EventTime")


def run(changes: DataFrame, path: str, limit: int = LIMIT, delay: str = DELAY) -> None:
    """Take all changes that are there into the statuses at ``path``, and stop. A batch that runs again replaces what it wrote."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/statuses/epoch={epoch}")

    started = machine(changes, limit, delay).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each video: video_id, state, since_us, refused, timeouts."""
    rows = spark.read.schema(OUT).parquet(f"{path}/statuses")
    return rows.groupBy("video_id").agg(F.max_by(F.struct("state", "since_us", "refused", "timeouts"), "version").alias("s")).select("video_id", "s.*")
