"""The queue's watermark and the status machine, batch by batch."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from cliplane.streaming import queue, states

START = datetime(2024, 1, 1)
WORK = "id long, ts timestamp, title string, type string"
CHANGE = "video_id long, ts timestamp, pos long, state string"


def fed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_repeats_within_and_beyond_the_delay(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    batches = [
        [(1, at(0), "a", "user"), (2, at(1), "b", "user"), (1, at(2), "a again", "user")],
        [(1, at(20), "within the delay", "user"), (3, at(60), "c", "user")],
        [(4, at(61), "d", "user")],
        # A row is too late by the watermark that held when the batch before was taken.
        [(1, at(120), "beyond the delay", "user"), (3, at(62), "within", "user"), (9, at(5), "too late", "user"), (9, at(6), "too late", "user")],
    ]
    late = queue.ingest_once(fed(spark, tmp_path / "in", batches, WORK), str(tmp_path / "queue"), str(tmp_path / "check"), "1 day", 4)
    got = sorted((r.id, r.ts) for r in queue.read_bucketed(spark, str(tmp_path / "queue")).collect())
    assert [i for i, _ in got] == [1, 1, 2, 3, 4] and got[1][1] == at(120) and late == 2
    # The queue is read by bucket, and a second run with the same checkpoint adds nothing.
    one = queue.read_bucketed(spark, str(tmp_path / "queue")).filter("bucket = 2")
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    again = spark.readStream.schema(WORK).parquet(str(tmp_path / "in"))
    assert queue.ingest_once(again, str(tmp_path / "queue"), str(tmp_path / "check"), "1 day", 4) == 0
    assert queue.read_bucketed(spark, str(tmp_path / "queue")).count() == 5


def test_the_earliest_row_of_a_batch_is_added(spark, tmp_path):
    """Whatever the order of a batch's rows, and when its earliest row is too late."""
    at = lambda hours: START + timedelta(hours=hours)
    batches = [
        [(i, at(h), "first" if h == 0 else "again", "user") for h in (12, 5, 0, 20) for i in range(200)],
        [(i, at(30 if i % 2 else 23), "third", "user") for i in range(200)] + [(500, at(100), "clock", "user")],
        [(900, at(10), "too late", "user"), (900, at(90), "later", "user"), (900, at(80), "in time", "user"), (1, at(99), "new", "user")],
    ]
    late = queue.ingest_once(fed(spark, tmp_path / "in", batches, WORK), str(tmp_path / "queue"), str(tmp_path / "check"), "1 day", 4)
    got = sorted((r.id, r.ts, r.title) for r in queue.read_bucketed(spark, str(tmp_path / "queue")).collect())
    want = [(i, at(0), "first") for i in range(200)] + [(1, at(99), "new"), (500, at(100), "clock"), (900, at(80), "in time")]
    assert got == sorted(want) and late == 1


def test_status_machine(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        # Video 1 in order of arrival that isn't that of time; 2 is refused; 3 stays in processing.
        [(1, at(30), 3, "analyzed"), (1, at(0), 1, "pending"), (2, at(0), 1, "analyzed"), (2, at(1), 2, "pending"), (2, at(2), 3, "failed"), (3, at(5), 1, "processing")],
        [(1, at(10), 2, "processing"), (4, at(0), 1, "pending"), (4, at(50), 2, "processing")],
        [(4, at(1000), 3, "analyzed"), (-1, at(4000), 1, "pending")],
    ]
    states.run(fed(spark, tmp_path / "in", batches, CHANGE), str(tmp_path), limit=3600, delay="100 minutes")
    us = lambda minutes: int((at(minutes) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = {r.video_id: tuple(r)[1:] for r in states.statuses(spark, str(tmp_path)).filter("video_id > 0").collect()}
    assert got == {
        1: ("analyzed", us(30), 0, 0),
        2: ("pending", us(1), 2, 0),
        3: ("failed", us(65), 0, 1),
        # It had failed by the timer before it came to be analysed, which was refused.
        4: ("failed", us(110), 1, 1),
    }
    # Only videos that changed are written by a batch.
    rows = spark.read.parquet(str(tmp_path / "statuses"))
    assert rows.groupBy("video_id", "version").count().filter("count > 1").count() == 0 and rows.filter("video_id = 2").count() == 1


def test_changes_that_wait_are_not_written_again():
    from types import SimpleNamespace

    class State:
        def __init__(self):
            self.held, self.did = [], []

        def get(self):
            self.did.append("get")
            return iter(list(self.held))

        def put(self, values):
            self.did.append("put")
            self.held = list(values)

        def appendValue(self, value):
            self.held.append(value)

        def clear(self):
            self.held = []

    class Value:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    waiting, timers = State(), []
    handle = SimpleNamespace(getValueState=lambda *_: Value(), getListState=lambda *_: waiting, registerTimer=timers.append)
    machine = states.Machine(10**9)
    machine.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    row = lambda ms, pos, to: Row(video_id=1, ts=None, at_us=1000 * ms, pos=pos, state=to)
    for n, (ms, to) in enumerate([(50, "analyzed"), (20, "pending"), (30, "processing")]):
        assert not list(machine.handleInputRows((1,), iter([row(ms, n, to)]), at(0)))
    assert waiting.did == [] and timers == [50, 20]
    (out,) = machine.handleExpiredTimer((1,), at(40), None)
    assert (out.state, out.version) == ("processing", 2) and timers[-1] == 50
    (out,) = machine.handleExpiredTimer((1,), at(60), None)
    assert (out.state, out.refused, out.version) == ("analyzed", 0, 3) and waiting.held == []
