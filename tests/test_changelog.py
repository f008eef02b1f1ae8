import random

import pytest
from pyspark.sql import functions as F

from cliplane.operators import tracker
from cliplane.operators.changelog import NAMES, ChangeLog
from tests.test_tracker_and_search import COLUMNS

ADD, DONE, FAILED, IDS = "id string, title string, type string, pos int", "id string, file_path string, pos int", "id string, message string, pos int", "id string"


def same(log, queue):
    rows = lambda df: sorted((tuple(r) for r in df.select("id", *NAMES).collect()), key=str)
    return rows(log.state()) == rows(queue)


@pytest.mark.parametrize("seed", [1])
def test_log_equals_the_trackers_functions(spark, tmp_path, seed):
    """Any order of changes, repeats and unknown ids included, with compactions between."""
    rng = random.Random(seed)
    queue = spark.createDataFrame([(f"q{i}", rng.choice(["pending", "error", "completed"]), "t", "user", 5, i, None, "e", 6, None) for i in range(8)], COLUMNS)
    log = ChangeLog.create(spark, str(tmp_path / "log"), queue, 4)
    for now in range(9):
        op = rng.choice(["add", "complete", "error", "error", "complete", "reset_errors", "reset_all", "clear", "compact", "add"])
        ids = [rng.choice([f"q{rng.randrange(10)}", f"n{rng.randrange(6)}"]) for _ in range(5)]
        if op == "add":
            new = spark.createDataFrame([(i, f"t{n}", "user", n) for n, i in enumerate(ids)], ADD)
            queue = tracker.add_objects(queue, new, now)
            log.add(new, now)
        elif op == "complete":
            done = spark.createDataFrame([(i, rng.choice([f"p{n}", None]), n) for n, i in enumerate(ids)], DONE)
            queue = tracker.mark_completed(queue, done, now)
            log.complete(done, now)
        elif op == "error":
            failed = spark.createDataFrame([(i, rng.choice([f"m{n}", None]), n) for n, i in enumerate(ids)], FAILED)
            queue = tracker.mark_error(queue, failed, now)
            log.error(failed, now)
        elif op == "clear":
            gone = spark.createDataFrame([(i,) for i in ids[:2]], IDS)
            queue = tracker.clear(queue, gone)
            log.clear(gone)
        elif op == "compact":
            log.compact()
        else:
            queue = getattr(tracker, op)(queue)
            getattr(log, op)()
        queue = spark.createDataFrame([tuple(r) for r in queue.collect()], queue.schema)
    assert same(log, queue)
    log.compact()
    assert same(log, queue) and log.compact() == []
    log.clear()
    assert log.state().count() == 0
    log.compact()
    assert log.state().count() == 0
    log.add(spark.createDataFrame([("again", "t", "user", 0), (None, "t", "user", 1)], ADD), 99)
    assert [r.id for r in log.state().collect()] == ["again"]


def test_what_is_written_follows_the_changes(spark, tmp_path):
    queue = spark.range(20000).select("id", *(F.lit(None).cast("string").alias(n) for n in NAMES)).withColumn("status", F.lit("error"))
    log = ChangeLog.create(spark, str(tmp_path / "log"), queue, 16)
    size = lambda top: sum(p.stat().st_size for p in (tmp_path / "log" / top).rglob("*.parquet"))
    whole = size("base")
    one = spark.createDataFrame([(7, "x", 0)], "id long, file_path string, pos int")
    seq = log.complete(one, 5)
    assert size("log") < whole / 20
    (bucket,) = log.changed_buckets()
    assert log.compact() == [bucket]
    assert size(f"base/seq={seq}") < whole / 8
    assert log.state().filter("status = 'completed'").select("id", "file_path", "updated_seq").collect() == [(7, "x", seq)]
    assert log.state().count() == 20000
    # A change to the whole queue is one row until the next compaction writes all buckets.
    before = size("log")
    log.reset_errors()
    assert size("log") - before < 5000
    assert log.state().filter("status = 'pending'").count() == 19999
    assert len(log.compact()) == 16


def test_a_broken_batch_or_compaction_is_not_seen(spark, tmp_path):
    log = ChangeLog.create(spark, str(tmp_path / "log"), spark.createDataFrame([("a", "pending", "t", "user", 5, 0, None, None, None, None)], COLUMNS), 2)
    seq = log.reset_all()
    log.compact()
    (tmp_path / "log" / "manifest" / f"seq={seq + 5}").mkdir()
    (tmp_path / "log" / "log" / f"seq={seq + 1}").mkdir()
    assert log.state().count() == 1 and log.reset_errors() == seq + 1
    assert log.state().count() == 1


def test_no_side_of_the_fold_is_broadcast(spark, tmp_path):
    """However small Spark takes the base for: its ids may be far more than their file's size tells."""
    queue = spark.range(100).select("id", *(F.lit(None).cast("string").alias(n) for n in NAMES)).withColumn("status", F.lit("error"))
    log = ChangeLog.create(spark, str(tmp_path / "log"), queue, 4)
    log.complete(spark.createDataFrame([(7, "x", 0), (100, "y", 0)], "id long, file_path string, pos int"), 5)
    log.add(spark.createDataFrame([(100, "t", "user", 0)], "id long, title string, type string, pos int"), 6)
    state = log.state()
    assert state.count() == 101 and state.filter("status = 'pending'").count() == 1
    assert "Broadcast" not in state._jdf.queryExecution().executedPlan().toString()
