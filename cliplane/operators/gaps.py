"""Times of a video at least a gap apart: of sorted times each is kept that is that far from the last one kept.

Which times are kept follows from the first one, so a range of a long video can't be
worked on by itself; but all it needs to know is the time at which it is entered, and that
lies within one gap of its start. Every range is read once, as a stream, with a
chain for each time at which it may be entered. Chains that meet go on as one, so there are no more
of them than times within one gap. A row that some chain keeps is written with the
entries that lead to it; in their order, the first time after the zone before all
others, these are one interval of a circle.

Each entry then points to the one at which its chain enters a later range. Which entries
are reached from the start of their video is found by pointer doubling: reached entries and
those that they point to, then pointers of pointers, so that a video over n ranges takes
log2 n rounds of joins over entries only.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.session import written

BEFORE_ALL = float("-inf")  # the key of the first time after a range's zone of entries
ROW = "range int, video_id long, t double, lo double, hi double, sure boolean, entry double, key double, exit double"
KINDS = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64())


# Workers get what this module defines with their task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Chains:
    """A video's times within a range: the chains from each time at which it may be entered."""

    def __init__(self, video: int | None, least: float):
        self.video, self.least = video, least
        self.first = self.last = None
        self.entries: list[tuple[float, float]] = []
        self.beyond = False
        self.heads: deque[tuple[float, float, float]] = deque()  # last kept time, entries from, to

    def take(self, t: float) -> tuple[float, float] | None:
        """The entries that keep ``t``, or None."""
        if t == self.last:
            return None
        self.last = t
        if self.first is None:
            self.first = t
        lo = hi = None
        while self.heads and t - self.heads[0][0] >= self.least:
            _, a, hi = self.heads.popleft()
            lo = a if lo is None else lo
        if t - self.first < self.least:
            lo = hi = t
            self.entries.append((t, t))
        elif not self.beyond:
            # The first time after the zone follows the first entry and is an entry itself.
            self.beyond, lo = True, BEFORE_ALL
            self.entries.append((t, BEFORE_ALL))
        if lo is None:
            return None
        self.heads.append((t, lo, hi))
        return lo, hi

    def exits(self) -> Iterator[tuple[float, float, float]]:
        """(entry, key, last time kept) of each entry."""
        for entry, key in self.entries:
            for head, lo, hi in self.heads:
                if (lo <= key <= hi) if lo <= hi else (key >= lo or key <= hi):
                    yield entry, key, head
                    break


def _streamed(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        number, chains, first = None, None, True
        start = kept = None

        def summary() -> None:
            """What is known of the video that ends here; only the range's first and last videos go on elsewhere."""
            if first:
                out.extend((number, chains.video, None, None, None, None, *e) for e in chains.exits())
            else:
                out.append((number, video, None, None, None, None, start, start, kept))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], [f.split()[0] for f in ROW.split(", ")])

        video = None
        for batch in batches:
            for r, v, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if number is None:
                    number, video, chains = r, v, Chains(v, least)
                if v != video:
                    if first:
                        summary()
                        first = False
                    video, start = v, None
                if first:
                    found = chains.take(t)
                    if found:
                        out.append((number, v, t, *found, False, None, None, None))
                elif start is None or t - kept >= least:
                    start, kept = t if start is None else start, t
                    out.append((number, v, t, None, None, True, None, None, None))
            if len(out) > 20000:
                yield made()
                out.clear()
        if number is not None:
            summary()
        if out:
            yield made()

    return run


def _pointers(entries: DataFrame, least: float) -> DataFrame:
    """(video_id, entry, to): the first entry of a later range that is a gap away from where each chain ends."""
    own = Window.partitionBy("video_id").orderBy("entry")
    points = entries.withColumn("behind", F.lead("entry").over(own))
    asked = points.select("video_id", F.col("entry").alias("of"), "exit", (F.col("exit") + least).alias("at"), F.lit(None).cast("double").alias("entry"), F.lit(None).cast("double").alias("behind"))
    both = points.select("video_id", F.lit(None).cast("double").alias("of"), F.lit(None).cast("double").alias("exit"), F.col("entry").alias("at"), "entry", "behind").unionByName(asked)
    order = Window.partitionBy("video_id").orderBy("at", F.col("of").isNotNull())
    past = F.last("entry", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.first("entry", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    then = F.first("behind", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumns({"a": past, "b": nearest, "c": then}).filter("of is not null")
    # The sum is rounded, the rule is about the difference: the neighbours of the sum are tried in order.
    far = lambda c: F.when(F.col(c) - F.col("exit") >= least, F.col(c))
    return found.select("video_id", F.col("of").alias("entry"), F.coalesce(far("a"), far("b"), far("c")).alias("to")).filter("to is not null")


def _reached(entries: DataFrame, least: float) -> DataFrame:
    """(video_id, entry) of the entries that are reached from the first one of each video."""
    reached = entries.groupBy("video_id").agg(F.min("entry").alias("entry"))
    pointers = written(_pointers(entries, least), "gaps-pointers")
    while not pointers.isEmpty():
        more = reached.join(pointers, ["video_id", "entry"]).select("video_id", F.col("to").alias("entry"))
        reached = written(reached.unionByName(more).distinct(), "gaps-reached")
        behind = pointers.select("video_id", F.col("entry").alias("to"), F.col("to").alias("then"))
        pointers = written(pointers.join(behind, ["video_id", "to"]).select("video_id", "entry", F.col("then").alias("to")), "gaps-pointers")
    return reached


def kept_times(times: DataFrame, least: float = 1.0) -> DataFrame:
    """(video_id, t) of the times that are kept of (video_id, t): a video's first, then each at least ``least`` after the last one kept.

    Equal times count once; null and NaN ones don't. Null videos are left out. No task holds a
    video's times; an empty table stays empty.
    """
    rows = times.select(F.col("video_id").cast("long").alias("video_id"), F.col("t").cast("double").alias("t")).filter(F.col("video_id").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t"))
    ranged = rows.repartitionByRange("video_id", "t").sortWithinPartitions("video_id", "t").select(F.spark_partition_id().alias("range"), "video_id", "t")
    found = written(ranged.mapInArrow(_streamed(least), ROW), "gaps")
    entries = found.filter("exit is not null").select("range", "video_id", "entry", "key", "exit")
    # A range is entered once at most by the video that goes on there, so there are no more rows than ranges and their last videos.
    chosen = _reached(entries.select("video_id", "entry", "exit"), least).join(entries, ["video_id", "entry"]).select("range", F.col("video_id").alias("_v"), F.col("key").alias("_key"))
    kept = found.filter("t is not null")
    within = F.when(F.col("lo") <= F.col("hi"), F.col("_key").between(F.col("lo"), F.col("hi"))).otherwise((F.col("_key") >= F.col("lo")) | (F.col("_key") <= F.col("hi")))
    entered = kept.filter(~F.col("sure")).join(F.broadcast(chosen), "range").filter((F.col("video_id") == F.col("_v")) & within)
    return kept.filter("sure").select("video_id", "t").unionByName(entered.select("video_id", "t"))
