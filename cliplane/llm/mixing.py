"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: its target share of the mixture over its
share of the documents. A document's number of copies is drawn from the Poisson
distribution with that rate by inverting its cumulative distribution at a
uniform number that a hash of seed and document gives. So copies don't depend on
partitions or order, and a rerun draws the same. Documents are exploded by their
counts and dealt out by a hash of document and copy, which shuffles globally.

All of it is DataFrame functions. The cumulative distributions are a table with
one short array per source, joined to the documents by source; Spark picks the
join by the table's size, and splits a hot source's partition if it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.runtime import stash

SEED = 17
TEMPERATURE = 0.5
EQUAL_BLOCK = 4096  # of equal rows without an id that are numbered in one array


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, key: str = "source", temperature: float = TEMPERATURE, weights: DataFrame | None = None, size: float = 1.0) -> DataFrame:
    """(key, n, rate): documents and repetition rate of each source.

    ``weights`` (key, weight) gives target weights, of any sum; a source without
    one gets rate 0. Without ``weights`` a source weighs its number of documents
    to the power ``temperature``. The expected size of the mixture is ``size``
    times the documents.
    """
    counts = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.select(F.col(key).alias("wkey"), F.col("weight").cast("double").alias("w"))
        weighed = counts.join(given, F.col("key").eqNullSafe(F.col("wkey")), "left").select("key", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    # Rounded, so that the order in which sums are taken can't be seen in a rate.
    totals = weighed.agg(F.struct(F.sum("n").alias("n"), F.round(F.sum("w"), 6).alias("w")).alias("t")).scalar()
    share = F.col("w") / F.nullif(F.col("t.w"), F.lit(0.0))
    return weighed.withColumn("t", totals).select("key", "n", F.coalesce(F.round(F.lit(size) * share * F.col("t.n") / F.col("n"), 9), F.lit(0.0)).alias("rate"))


def distributions(table: DataFrame) -> DataFrame:
    """(key, rate, cdf) of (key, rate): the cumulative Poisson distribution at 0, 1, ... up to where doubles show no tail."""
    ordered = Window.partitionBy("key").orderBy("k")
    steps = F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    counted = table.select("key", "rate", F.explode(steps).alias("k")).withColumn("log_k", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(ordered))
    log_p = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.col("k") * F.log(F.greatest("rate", F.lit(1e-300))) - F.col("rate") - F.col("log_k"))
    summed = counted.withColumn("c", F.sum(F.exp(log_p)).over(ordered))
    return summed.groupBy("key", "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix(docs: DataFrame, key: str = "source", id_col: str = "doc_id", seed: int = SEED, temperature: float = TEMPERATURE, weights: DataFrame | None = None, size: float = 1.0, text_col: str = "text") -> DataFrame:
    """The mixture: every column of ``docs``, and copy (from 1), n_copies, rate, shuffle_key.

    A source's expected number of rows follows its target weight. Null is a
    source like any other. A document draws by its id and an MD5 of its text, so
    rows that repeat an id draw apart unless the text is the same, too. Of rows without
    an id equal ones (in all columns) are counted and numbered, and each draws by its content and
    number, so draws don't depend on how ``docs`` lies in partitions. Rows come in ``shuffle_key`` order within
    partitions that hash of the key deals out. Columns of ``docs`` that have the
    names of the added ones are replaced by them. An empty table stays empty.
    """
    added = ("copy", "n_copies", "rate", "shuffle_key")
    own = [c for c in docs.columns if c.lower() not in added]
    table = rates(docs, key, temperature, weights, size)
    # Written, so that Spark knows its size when it plans the join.
    table = stash(distributions(table.select("key", "rate")), "mixing-rates")
    ident = F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    named = docs.filter(F.col(id_col).isNotNull()).select(F.struct(*own).alias("doc"), F.col(key).alias("own_key"), ident.alias("ident"))
    # Counted before they are shuffled, so that many equal rows don't meet; blocks keep arrays short.
    content = F.md5(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
    equal = docs.filter(F.col(id_col).isNull()).select(F.struct(*own).alias("doc"), F.col(key).alias("own_key"), content.alias("content"))
    equal = equal.groupBy("content").agg(F.first("doc").alias("doc"), F.first("own_key").alias("own_key"), F.count("*").alias("many"))
    blocks = equal.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(EQUAL_BLOCK).cast("long"))))
    each = blocks.withColumn("number", F.explode(F.sequence("at", F.least(F.col("at") + EQUAL_BLOCK, F.col("many")) - 1)))
    unnamed = each.select("doc", "own_key", F.concat_ws("|", F.lit("null"), F.col("content"), F.col("number").cast("string")).alias("ident"))
    rows = named.unionByName(unnamed).withColumn("u", uniform(F.lit(str(seed)), F.col("ident")))
    # The number of cumulative values up to u is the first count whose cumulative value exceeds it.
    drawn = rows.join(table, F.col("own_key").eqNullSafe(F.col("key"))).withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).cast("long"))
    copies = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.col("ident"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = copies.select("doc.*", "copy", "n_copies", "rate", order.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
