"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join; edges only ever move to smaller
labels. Every round is written to the shared folder, so lineage stays short and
a lost executor costs one round at most. The rounds end when nothing changes any
more; each one that goes on lowers a label, so they do end, after about the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm.runtime import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, label): for every node of ``links`` (x, y), the smallest node that it reaches."""
    edges = stash(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    while True:
        edges = stash(_small_star(_large_star(edges)), "components")
        # A star forest is reached when the sums of both ends stand still.
        now = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
