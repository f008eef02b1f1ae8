"""An access path for pattern search: a trigram index of the library that grows by insert.

A text's trigrams are those of its folded characters. The index has rows for a
trigram and block of ids, with the ids of the block that hold it, so that no list
grows with the library; it lies in shards by trigram, sorted within, so that a search reads
the shards of its trigrams and few row groups there. A pattern is translated to trigrams that
every hit must hold, joined by and and or. What has them is a candidate, and the pattern itself decides. A
pattern from which no trigram follows is searched by a scan.
"""

from __future__ import annotations

import re
import uuid
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplane.operators import grams
from cliplane.operators.search import pattern as checked

COLUMNS = ("title", "analysis_title", "category", "key_message")
BLOCK = 4096  # ids in a row of the index
SHARDS = 16
FILES = 4  # files of a shard that an insert writes
FEW = 1000  # ids that are pushed down to the scan one by one
CLASS = 4  # characters of a class that are taken one by one
# What Java's and Python's patterns don't read alike is not translated.
FOREIGN = re.compile(r"&&|\(\?(?!:)|\\[^bBswdSWD.\-+*?()\[\]{}|^$/ ]|\[[^\]]*\[|[*+?}]\+")

Formula = tuple | str | None  # ("and" | "or", parts), a trigram, or None for no condition


def folded(text: Column) -> Column:
    """Characters that a case-insensitive pattern takes for one are the same."""
    # Sigma has two lower-case forms; and without a step between, Spark would drop the upper case.
    return F.lower(F.translate(F.upper(F.translate(text, "İẞ", "iß")), "Σ", "σ"))


def _plain(c: str) -> str | None:
    """The folded character, or None if folding it is more than a change of case."""
    up = c.upper()
    return up.lower() if len(up) == 1 and len(up.lower()) == 1 and c not in "İẞßςσΣ" else None


def _both(parts: list[Formula], kind: str) -> Formula:
    if kind == "or" and (None in parts or not parts):
        return None
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else (kind, tuple(kept))


def _grams(run: str) -> list[Formula]:
    return [run[i : i + 3] for i in range(len(run) - 2)]


def _sequence(items) -> Formula:
    """What a sequence must hold: the trigrams of its runs of characters, and what its parts must hold."""
    parts: list[Formula] = []
    runs = [""]  # a run may have a few variants, where a class has few characters

    def close() -> None:
        parts.append(_both([_both(_grams(r), "and") for r in runs], "or"))
        runs[:] = [""]

    for code, value in items:
        options = None
        if code is op.LITERAL:
            options = [_plain(chr(value))]
        elif code is op.IN and all(c is op.LITERAL for c, _ in value) and len(value) <= CLASS:
            options = [_plain(chr(v)) for _, v in value]
        if options is not None and None not in options and len(runs) * len(set(options)) <= 16:
            runs[:] = [r + o for r in runs for o in dict.fromkeys(options)]
            continue
        close()
        if options is not None:
            continue
        if code is op.SUBPATTERN:
            parts.append(_sequence(value[-1]))
        elif code is op.BRANCH:
            parts.append(_both([_sequence(b) for b in value[1]], "or"))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            parts.append(_sequence(value[2]))
    close()
    return _both(parts, "and")


def required(pattern: str) -> Formula:
    """The trigrams that whatever holds ``pattern`` must have; None if none follow."""
    checked(pattern)
    return None if FOREIGN.search(pattern) else _sequence(parser.parse(pattern))


def _leaves(formula: Formula) -> set[str]:
    return {formula} if isinstance(formula, str) else set().union(*(_leaves(p) for p in formula[1]))


def holds(formula: Formula, grams: Column) -> Column:
    """Whether an array of trigrams meets the formula."""
    if isinstance(formula, str):
        return F.array_contains(grams, formula)
    kind, parts = formula
    out = holds(parts[0], grams)
    for p in parts[1:]:
        out = (out & holds(p, grams)) if kind == "and" else (out | holds(p, grams))
    return out


class SearchIndex:
    """The library at a path with its index. ``insert`` adds videos; ids are whole numbers."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns

    def insert(self, videos: DataFrame) -> SearchIndex:
        """Add videos and their trigrams; nothing that is there is written again."""
        part = uuid.uuid4().hex
        videos.repartitionByRange("video_id").sortWithinPartitions("video_id").write.parquet(f"{self.path}/videos/part={part}")
        stored = self.spark.read.schema(videos.schema).parquet(f"{self.path}/videos/part={part}")
        # Several rows may hold a gram of a block, with ids of their own.
        texts = stored.filter("video_id is not null").select(F.col("video_id").cast("long"), *(folded(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in self.columns))
        rows = texts.mapInArrow(lambda batches: grams.run(batches, BLOCK), "gram string, block long, ids array<long>")
        placed = rows.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int"))
        files = F.pmod("block", F.lit(FILES))
        placed.repartition("shard", files).sortWithinPartitions("shard", "gram", "block").write.partitionBy("shard").parquet(f"{self.path}/grams/part={part}")
        return self

    def videos(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/videos").drop("part")

    def ids(self, formula: Formula) -> DataFrame:
        """The ids that meet a formula of trigrams."""
        asked_for = sorted(_leaves(formula))
        shards = self.spark.createDataFrame([(g,) for g in asked_for], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int")).distinct().collect()
        index = self.spark.read.schema("gram string, block long, ids array<long>, part string, shard int").parquet(f"{self.path}/grams")
        asked = index.filter(F.col("shard").isin([r[0] for r in shards]) & F.col("gram").isin(asked_for)).select("gram", F.explode("ids").alias("video_id"))
        return asked.groupBy("video_id").agg(F.collect_set("gram").alias("grams")).filter(holds(formula, F.col("grams"))).select("video_id")

    def candidates(self, pattern: str) -> DataFrame:
        """The videos that may hold ``pattern``: all of them, if no trigram follows from it."""
        formula = required(pattern)
        if formula is None:
            return self.videos()
        found = self.ids(formula)
        few = [r["video_id"] for r in found.limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return self.videos().filter(F.col("video_id").isin(few))
        return self.videos().join(found, "video_id", "left_semi")

    def report(self, pattern: str) -> tuple[int, int]:
        """How many rows a search of ``pattern`` tests, and how many there are."""
        return self.candidates(pattern).count(), self.videos().count()
