"""The work queue as a log of changes over a bucketed base.

A change is appended as a batch with the next sequence number, and costs its own rows
only; a change to the whole queue costs one row. Each batch has at most one row for an id:
repeats within it are put together before it is written. The queue is what the base holds,
with the later changes of each id folded in order of their numbers. Compaction writes
anew those buckets only in which an id has changed (after a change to the whole queue: all), and then a manifest
that names the version of every bucket; readers take the last manifest, so a broken
compaction is never seen. Between compactions an id has as many changes at most as
batches were appended.

One writer at a time; readers may read at any time. Batches and manifests count
once their folder is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "status string, title string, type string, added_at long, attempts int, completed_at long, last_error string, last_attempt long, file_path string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
CHANGE = "seq long, op string, n int, title string, type string, value string, now long"
STATE = "struct<there:boolean," + ",".join(f.replace(" ", ":") for f in FIELDS.split(", ")).replace(":long", ":bigint") + ",updated_seq:bigint>"
BUCKETS = 64


def _struct(kind: str) -> str:
    return "struct<" + ",".join(f.replace(" ", ":") for f in kind.split(", ")).replace(":long", ":bigint") + ">"


def step(state: Column, change: Column) -> Column:
    """The state of a row after one change; a row that isn't there changes by an ``add`` only."""
    op, there = change["op"], state["there"]
    is_ = lambda *ops: op.isin(*ops)
    new, done, error = ~there & is_("add"), there & is_("complete"), there & is_("error")
    reset = there & (is_("reset_all") | (is_("reset_errors") & (state["status"] == "error")))
    none = F.lit(None)
    values = {
        "there": F.when(is_("add"), True).when(is_("clear"), False).otherwise(there),
        "status": F.when(new | reset, "pending").when(done, "completed").when(error, "error"),
        "title": F.when(new, change["title"]),
        "type": F.when(new, change["type"]),
        "added_at": F.when(new, change["now"]),
        "attempts": F.when(new, 0).when(error, state["attempts"] + change["n"]),
        "completed_at": F.when(new, none).when(done, change["now"]),
        "last_error": F.when(new | reset, none).when(error, change["value"]),
        "last_attempt": F.when(new | reset, none).when(error, change["now"]),
        "file_path": F.when(new, none).when(done, change["value"]),
        "updated_seq": F.when(new | reset | done | error, change["seq"]),
    }
    touched = {"status": new | reset | done | error, "title": new, "type": new, "added_at": new, "attempts": new | error, "completed_at": new | done, "last_error": new | reset | error, "last_attempt": new | reset | error, "file_path": new | done, "updated_seq": new | reset | done | error}
    return F.struct(*(v.alias(k) if k == "there" else F.when(touched[k], v).otherwise(state[k]).alias(k) for k, v in values.items())).cast(STATE)


class ChangeLog:
    """A queue at a path: ``create`` it, append changes, read ``state()``, ``compact()`` now and then.

    ``id`` may be of any type; null ids in a change are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = spark.read.parquet(f"{self.path}/about").first()["buckets"]
        self.id_type = spark.read.parquet(f"{self.path}/about").schema["id"].dataType.simpleString()

    @classmethod
    def create(cls, spark: SparkSession, path: str, objects: DataFrame, buckets: int = BUCKETS) -> ChangeLog:
        """A log whose base is ``objects``."""
        kind = objects.schema["id"].dataType.simpleString()
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(None).cast(kind).alias("id")).write.parquet(f"{path}/about")
        log = cls(spark, path)
        rows = objects.select("id", *(F.col(f.split()[0]).cast(f.split()[1]) for f in FIELDS.split(", ")), F.lit(None).cast("long").alias("updated_seq"))
        log._write_base(rows, 0, {})
        return log

    # Folders

    def _complete(self, folder: str) -> list[int]:
        """Numbers of the complete folders ``folder/seq=N``, rising."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()]
        done = [p.getName() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("seq="))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> tuple[int, dict[int, int]]:
        """The last number in the base, and the version of each bucket that has rows."""
        seq = self._complete("manifest")[-1]
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/seq={seq}").collect()
        return seq, {r["bucket"]: r["version"] for r in rows}

    def _write_base(self, rows: DataFrame, seq: int, kept: dict[int, int]) -> list[int]:
        """Write buckets of version ``seq``; ``kept`` are those that stay. The buckets that have rows."""
        place = f"{self.path}/base/seq={seq}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        top = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        names = [s.getPath().getName() for s in top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top)]
        made = sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))
        versions = [(b, seq) for b in made] + [(b, v) for b, v in kept.items() if b not in made]
        self.spark.createDataFrame(versions, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/seq={seq}")
        return made

    def base(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the last compaction, of the buckets ``only`` if given."""
        _, versions = self._manifest()
        paths = [f"{self.path}/base/seq={v}/bucket={b}" for b, v in versions.items() if only is None or b in only]
        schema = f"id {self.id_type}, {FIELDS}, updated_seq long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self) -> DataFrame | None:
        """Changes after the last compaction, or None."""
        since = self._manifest()[0]
        paths = [f"{self.path}/log/seq={n}" for n in self._complete("log") if n > since]
        return self.spark.read.schema(f"id {self.id_type}, {CHANGE}, bucket int").parquet(*paths) if paths else None

    # Changes

    def _append(self, op: str, rows: DataFrame | None = None, now: int | None = None) -> int:
        seq = max([*self._complete("log"), self._manifest()[0]]) + 1
        values = {"seq": F.lit(seq), "op": F.lit(op), "now": F.lit(now)}
        if rows is None:
            rows = self.spark.range(1).select(F.lit(None).cast(self.id_type).alias("id"))
            bucket = F.lit(None)
        else:
            rows, bucket = rows.withColumn("id", F.col("id").cast(self.id_type)).filter("id is not null"), self._bucket()
        columns = [(values.get(n) if n in values else F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in (f.split() for f in CHANGE.split(", "))]
        rows.select("id", *columns, bucket.cast("int").alias("bucket")).write.mode("overwrite").parquet(f"{self.path}/log/seq={seq}")
        return seq

    def add(self, new: DataFrame, now: int) -> int:
        """(id, title, type, pos): ids that the queue doesn't know are added; of repeated ones the first counts."""
        first = new.groupBy("id").agg(F.min(F.struct("pos", "title", "type")).alias("f"))
        return self._append("add", first.select("id", "f.title", "f.type"), now)

    def _last(self, rows: DataFrame, value: str) -> DataFrame:
        order = [c for c in ("pos", value) if c in rows.columns]
        return rows.groupBy("id").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))["v"].alias("value"), F.count("*").cast("int").alias("n"))

    def complete(self, done: DataFrame, now: int) -> int:
        """(id, file_path, pos): the last path of an id wins; unknown ids change nothing."""
        return self._append("complete", self._last(done, "file_path"), now)

    def error(self, failed: DataFrame, now: int) -> int:
        """(id, message, pos): every error is an attempt, the last message stays."""
        return self._append("error", self._last(failed, "message"), now)

    def reset_errors(self) -> int:
        return self._append("reset_errors")

    def reset_all(self) -> int:
        return self._append("reset_all")

    def clear(self, ids: DataFrame | None = None) -> int:
        """Without ids all rows go."""
        return self._append("clear", None if ids is None else ids.select("id").distinct())

    # Reading

    def _folded(self, base: DataFrame, log: DataFrame) -> DataFrame:
        """``base`` with the changes of ``log``, that of whole-queue changes included."""
        whole = log.filter("id is null").select(*NAMES_OF_CHANGE).orderBy("seq").collect()  # one a batch at most
        kind = f"array<{_struct(CHANGE)}>"
        every = F.array(*(F.struct(*(F.lit(r[n]).cast(k).alias(n) for n, k in (f.split() for f in CHANGE.split(", ")))) for r in whole)).cast(kind)
        own = log.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct(*NAMES_OF_CHANGE)).alias("_own"))
        changes = F.array_sort(F.concat(F.coalesce(F.col("_own"), F.array().cast(kind)), every))
        fields = [*NAMES, "updated_seq"]
        # An outer join of both sides shuffles; two joins could broadcast all ids of the base.
        both = base.withColumn("_there", F.lit(True)).join(own, F.col("id") == F.col("_id"), "full_outer")
        start = F.struct(F.coalesce("_there", F.lit(False)).alias("there"), *(F.col(n) for n in fields)).cast(STATE)
        state = F.aggregate(changes, start, step)
        return both.select(F.coalesce("id", "_id").alias("id"), state.alias("_s")).filter("_s.there").select("id", *(F.col(f"_s.{n}").alias(n) for n in fields))

    def state(self) -> DataFrame:
        """The queue after all changes: id, the queue's fields, and updated_seq, the number of the change that touched the row last."""
        log = self._log()
        return self.base() if log is None else self._folded(self.base(), log)

    def objects(self) -> DataFrame:
        """The queue with the columns of the tracker's functions."""
        return self.state().select("id", *NAMES)

    def changed_buckets(self) -> list[int]:
        """Buckets that a compaction would write."""
        log = self._log()
        if log is None:
            return []
        found = [r["bucket"] for r in log.select("bucket").distinct().collect()]
        return sorted(set(found) if None not in found else set(range(self.buckets)))

    def compact(self) -> list[int]:
        """Fold all changes into the base; the buckets that were written."""
        log, buckets = self._log(), self.changed_buckets()
        if log is None:
            return []
        _, versions = self._manifest()
        kept = {b: v for b, v in versions.items() if b not in buckets}
        return self._write_base(self._folded(self.base(buckets), log), self._complete("log")[-1], kept)


NAMES_OF_CHANGE = [f.split()[0] for f in CHANGE.split(", ")]
