"""Ordered work on groups of any size, in two passes over ranges.

Rows are dealt out by ranges of (group, order), so that a group that holds a third of
all rows is spread like any other. What one range knows of a group is put together
from a table with a row for each range and group; only groups that go on from range to
range need more than their own range, at most one for each range, so that table is
broadcast with the number of ranges as its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.session import written

STEPS = 4096  # of a sequence in one array


def place(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``_range``, the number of the range of (by, order) that each is in; written, so that it stays."""
    ranged = rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    return written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def number(placed: DataFrame, name: str, by: str, *order: str) -> DataFrame:
    """Positions from 0 within each group of placed rows: those of the range, and behind them what earlier ranges hold of the group."""
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("_range").alias("_at"), F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_at", "_by", F.sum("_n").over(earlier).alias("_before")).filter("_before > 0")
    own = F.row_number().over(Window.partitionBy("_range", by).orderBy(*order)) - 1
    found = placed.withColumn("_own", own).join(F.broadcast(offsets), (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    return found.withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("int")).select(*(c for c in placed.columns if c != name), name)


def running(placed: DataFrame, name: str, value: Column, by: str, *order: str) -> DataFrame:
    """The sum of ``value`` over the rows of the group before each placed row; 0 for the first."""
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col("_range").alias("_at"), F.col(by).alias("_by")).agg(F.sum(value).alias("_n"))
    offsets = sums.select("_at", "_by", F.sum("_n").over(earlier).alias("_before")).filter("_before is not null")
    own = F.sum(value).over(Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = placed.withColumn("_own", own).join(F.broadcast(offsets), (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    return found.withColumn(name, F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))).select(*(c for c in placed.columns if c != name), name)


def following(placed: DataFrame, name: str, value: Column, by: str, *order: str) -> DataFrame:
    """``value`` of the next row of the group, from the next range with rows of the group where the own one ends; null at the end."""
    own = Window.partitionBy("_range", by).orderBy(*order)
    firsts = placed.groupBy(F.col("_range").alias("_at"), F.col(by).alias("_by")).agg(F.min_by(F.struct(value.alias("v")), F.struct(*order)).alias("_first"))
    ahead = firsts.select("_at", "_by", F.lead("_first").over(Window.partitionBy("_by").orderBy("_at")).alias("_ahead")).filter("_ahead is not null")
    # The next value may be null itself, so it comes in a struct.
    found = placed.withColumn("_next", F.lead(F.struct(value.alias("v"))).over(own))
    found = found.join(F.broadcast(ahead), (F.col("_range") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")), "left")
    return found.withColumn(name, F.coalesce("_next", "_ahead")["v"]).select(*(c for c in placed.columns if c != name), name)


def numbered(rows: DataFrame, name: str, *order: str, by: str) -> DataFrame:
    """Positions from 0 within each group, whatever its size."""
    return number(place(rows, by, *order), name, by, *order).drop("_range")


def counted(rows: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``, none if that is less; no array holds more than STEPS of them."""
    bounds = rows.withColumns({"_lo": first.cast("long"), "_hi": last.cast("long")}).filter("_lo <= _hi")
    blocks = bounds.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / (STEPS * STEPS)))))
    parts = blocks.withColumn("_at", F.col("_lo") + F.col("_block") * (STEPS * STEPS)).withColumn("_part", F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + STEPS * STEPS - 1, F.col("_hi")), F.lit(STEPS).cast("long"))))
    return parts.withColumn(name, F.explode(F.sequence("_part", F.least(F.col("_part") + STEPS - 1, F.col("_hi"))))).drop("_lo", "_hi", "_block", "_at", "_part")


def texts_in_parts(rows: DataFrame, by: str, order: tuple[str, ...], text: str, separator: str, size: int = 1 << 20) -> DataFrame:
    """The texts of each group in order, a separator apart, as parts that concatenate to the whole: (by, part, offset, text).

    A part holds the texts that start within its ``size`` characters, so it is longer by one text at
    most; a group of any length is no row and no task. ``offset`` is the place of a part's first character.
    Part numbers rise, but a part that a long text covers has no row. Empty texts and nulls are left out.
    """
    some = place(rows.filter(F.col(text) != "").select(*dict.fromkeys((by, *order, text))), by, *order)
    starts = running(some, "_start", F.length(text).cast("long") + len(separator), by, *order)
    parts = starts.groupBy(by, F.floor(F.col("_start") / size).alias("part")).agg(F.min("_start").alias("_first"), F.array_sort(F.collect_list(F.struct("_start", F.col(text).alias("t")))).alias("_items"))
    joined = F.array_join(F.transform("_items", lambda x: x["t"]), separator)
    behind = F.col("_first") > 0
    return parts.select(by, "part", F.when(behind, F.col("_first") - len(separator)).otherwise(0).cast("long").alias("offset"), F.when(behind, F.concat(F.lit(separator), joined)).otherwise(joined).alias("text"))
