"""Approximate nearest neighbours in a forest of hash-prefix trees.

Each tree gives a vector a long hash string: the sides of ``DEPTH`` random
hyperplanes on which it lies. A tree is the sorted array of these strings over the
whole table, dealt out in slices; the vectors that share a prefix are a range of it.
A query descends in every tree to its longest shared prefix and then ascends in all
trees at once, a bit at a time, until the ranges hold ``wanted(rows, k)`` entries
together. It visits only the slices that its ranges meet. What the ranges hold is
scored exactly, and nothing else is.

The ends of the slices and the level of a query are read from a sample of at most
``SAMPLE`` vectors; every vector is indexed. Where the table is no larger than the
sample, the levels are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm.runtime import ship, stash

TREES = 64
DEPTH = 32
SAMPLE = 16_384
SLICE_ROWS = 16_384
QUERY_ROWS = 4096
SCORE_ROWS = 8192
CHUNK_ROWS = 2048
SEED = 11


def wanted(rows: float, k: int) -> float:
    """Entries of a query's ranges, all trees together. It grows more slowly than the table.

    One vector has at most an entry a tree, so there are several times ``k`` vectors beside the query's own.
    """
    return 6 * rows**0.75 + 4 * TREES * (k + 1)


@functools.lru_cache(maxsize=4)
def hyperplanes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, TREES * DEPTH)).astype(np.float32)


def hash_strings(x: np.ndarray) -> np.ndarray:
    """(trees, rows): the string of each vector in each tree as a number, its first bit highest."""
    sides = x.astype(np.float32) @ hyperplanes(x.shape[1]) > 0
    packed = np.packbits(sides.reshape(len(x), TREES, DEPTH), axis=2)
    return np.ascontiguousarray(packed.view(">u4").reshape(len(x), TREES).T.astype(np.uint64))


class Forest:
    """The sorted strings of a sample of ``rows`` vectors of one size: slices of the trees and levels of queries."""

    def __init__(self, unit: np.ndarray, rows: float, k: int):
        self.strings = np.sort(np.concatenate([hash_strings(unit[i : i + CHUNK_ROWS]) for i in range(0, len(unit), CHUNK_ROWS)], axis=1), axis=1)
        self.wanted = wanted(rows, k) * len(unit) / rows
        slices = min(len(unit), max(1, int(np.ceil(rows / SLICE_ROWS))))
        self.ends = self.strings[:, np.linspace(0, len(unit), slices + 1)[1:-1].astype(int)]

    def slices(self, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slice of each entry, (trees, rows). A string that fills several slices is dealt out to them by key."""
        first, last = self.meet(codes, codes)
        return first + (keys.view(np.uint64) % (last - first + 1).astype(np.uint64)).astype(np.int64)

    def meet(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last slice of each range, (trees, ranges)."""
        first = np.stack([np.searchsorted(e, c) for e, c in zip(self.ends, low, strict=True)])
        last = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.ends, high, strict=True)])
        return first, last

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest string of each query's range, (trees, queries), at the deepest level with enough entries."""

        def at(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            open_bits = (np.uint64(1) << (DEPTH - level).astype(np.uint64)) - np.uint64(1)
            return codes & ~open_bits, codes | open_bits

        low, high = np.zeros(codes.shape[1], np.int64), np.full(codes.shape[1], DEPTH)
        while (low < high).any():  # the number of entries only grows on the way up
            mid = (low + high + 1) // 2
            a, b = at(mid)
            held = sum(np.searchsorted(s, q, side="right") - np.searchsorted(s, p) for s, p, q in zip(self.strings, a, b, strict=True))
            low, high = np.where(held >= self.wanted, mid, low), np.where(held >= self.wanted, high, mid - 1)
        return at(low)


def scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components to about one, so that no square is lost or too large."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, unit vectors) of a column of vectors, some rows of one size at a time."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        for rows in np.split(every, range(CHUNK_ROWS, len(every), CHUNK_ROWS)):
            x = scaled(flat[starts[rows][:, None] + np.arange(size)])
            yield size, rows, x / lengths(x)[:, None]


def covering(strings: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, place: np.ndarray) -> pa.Table:
    """The entries of a slice that some range holds: key, block of queries, and the queries' places there as 16-bit numbers."""
    order = np.argsort(strings, kind="stable")
    strings, keys = strings[order], keys[order]
    parts = []
    for b in np.unique(block).tolist():
        of = block == b
        start, end = np.searchsorted(strings, low[of]), np.searchsorted(strings, high[of], side="right")
        count = end - start
        where = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        who = np.repeat(place[of].astype(np.uint16), count)
        by_entry = np.argsort(where, kind="stable")
        held = np.bincount(where, minlength=len(keys))
        some = np.flatnonzero(held)
        offsets = np.concatenate([[0], np.cumsum(held[some])]).astype(np.int32) * 2
        places = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(who[by_entry])])
        parts.append(pa.table([pa.array(keys[some]), pa.array(np.full(len(some), b)), places], LINK.names))
    return pa.concat_tables(parts) if parts else LINK.empty_table()


LINK = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("places", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def pairs(places: pa.Array, queries: int) -> Iterator[np.ndarray]:
    """For each query the rows whose lists of places name it, each row once."""
    inner = places.values
    ends = np.frombuffer(inner.buffers()[1], np.int32)[inner.offset : inner.offset + len(inner) + 1]
    ends = ends[places.offsets.to_numpy()].astype(np.int64) // 2
    flat = np.frombuffer(inner.buffers()[2] or b"", np.uint16)[ends[0] : ends[-1]].astype(np.int64)
    both = np.unique(flat * len(places) + np.repeat(np.arange(len(places)), np.diff(ends)))
    cuts = np.searchsorted(both, np.arange(queries + 1) * len(places))
    for i in range(queries):
        yield both[cuts[i] : cuts[i + 1]] - i * len(places)


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, candidates: Iterator[np.ndarray], k: int) -> pa.Table:
    """The ``k`` nearest of each query's candidates by cosine; a query's own row is none."""
    x, q = scaled(x), scaled(q)
    norm, q_norm = lengths(x), lengths(q)
    unit, q_unit = x / norm[:, None], q / q_norm[:, None]
    out = []
    for i, found in enumerate(candidates):
        found = found[ids[found] != q_ids[i]]
        if not len(found):
            continue
        rough = unit[found] @ q_unit[i]
        if len(found) > k:
            found = found[rough >= np.partition(rough, len(found) - k)[len(found) - k] - 1e-9]
        score = (x[found] * q[i]).sum(1) / (norm[found] * q_norm[i])
        best = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(best), q_ids[i]), ids[found][best], score[best]))
    if not out:
        return FOUND.empty_table()
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], FOUND.names)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def distinct_vectors(data: DataFrame, k: int) -> DataFrame:
    """key, v, ids: equal vectors once, with the ids that can be among a query's ``k`` nearest.

    Those are the k + 1 smallest, for one of them may be the query's own, each as
    often as it occurs but k times at most. The key is a hash of the vector; two
    vectors that should share one would only be scored together.
    """
    counted = data.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = counted.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("at") <= k + 1)
    ids = F.flatten(F.collect_list(F.array_repeat("id", F.col("n"))))
    return first.groupBy("v").agg(ids.alias("ids")).select(F.xxhash64("v").alias("key"), "v", "ids")


def in_blocks(asked: DataFrame, rows: int) -> DataFrame:
    """id, v, block, place: queries near each other in the first tree share a block of ``QUERY_ROWS``.

    Blocks are counted through all partitions, so there are no more of them than the queries need.
    """

    def first_string(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for _, at, unit in matrices(batch["v"]):
                code[at] = hash_strings(unit)[0]
            yield batch.append_column("code", pa.array(code))

    def number(batches):
        n = 0
        for batch in batches:
            at = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            task = np.full(batch.num_rows, TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(task), pa.array(at)], ["id", "v", "task", "at"])

    strings = asked.mapInArrow(first_string, "id long, v array<double>, code long")
    dealt = strings.repartitionByRange(max(1, -(-rows // QUERY_ROWS)), F.size("v"), "code", "id")
    dealt = stash(dealt.mapInArrow(number, "id long, v array<double>, task long, at long"), "asked")
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = dealt.groupBy("task").agg(F.count("*").alias("n")).select("task", before.alias("before"))
    at = F.col("before") + F.col("at")
    return dealt.join(tasks, "task").select("id", "v", F.floor(at / QUERY_ROWS).alias("block"), (at % QUERY_ROWS).alias("place"))


def fit(spots: DataFrame, rows: int, k: int) -> dict[int, Forest]:
    """A forest for each size of vector in a sample of at most ``SAMPLE`` rows."""
    sample = spots.select("v", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    units: dict[int, list] = {}
    for size, _, unit in matrices(sample):
        units.setdefault(size, []).append(unit)
    return {size: Forest(np.concatenate(u), rows * sum(map(len, u)) / len(sample), k) for size, u in units.items()}


def candidates(spots: DataFrame, asked: DataFrame, rows: int, k: int) -> DataFrame:
    """key, block, places: which queries' ranges hold which vectors, one row for each slice that tells so.

    Vectors of a size that the sample lacks are few; each is a candidate of all queries of its size.
    """
    shared = spots.sparkSession.sparkContext.broadcast(fit(spots, rows, k))
    tree = np.arange(TREES)[:, None]

    def entries(batches):
        for batch in batches:
            keys = batch["key"].to_numpy()
            for size, at, unit in matrices(batch["v"]):
                forest, codes = shared.value.get(size), hash_strings(unit)
                slices = forest.slices(codes, keys[at]) if forest else (codes[:1] * np.uint64(0)).astype(np.int64)
                codes = codes[: len(slices)]
                columns = np.full_like(slices, size), np.broadcast_to(tree[: len(slices)], slices.shape), slices, codes.astype(np.int64), np.broadcast_to(keys[at], slices.shape)
                yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in columns], ["size", "tree", "slice", "code", "key"])

    def ranges(batches):
        for batch in batches:
            block, place = batch["block"].to_numpy(), batch["place"].to_numpy()
            for size, at, unit in matrices(batch["v"]):
                forest = shared.value.get(size)
                if forest:
                    low, high = forest.ranges(hash_strings(unit))
                    first, last = forest.meet(low, high)
                else:
                    low, high = np.zeros((1, len(at)), np.uint64), np.full((1, len(at)), 2**DEPTH - 1, np.uint64)
                    first = last = np.zeros((1, len(at)), np.int64)
                n = (last - first + 1).ravel()
                slices = np.repeat(first.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
                columns = (np.broadcast_to(c, first.shape).ravel() for c in (np.full_like(first, size), tree[: len(first)], low.astype(np.int64), high.astype(np.int64), block[at], place[at]))
                size_, tree_, low_, high_, block_, place_ = (np.repeat(c, n) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (size_, tree_, slices, low_, high_, block_, place_)], ["size", "tree", "slice", "low", "high", "block", "place"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return covering(*(np.array(left[c]) for c in ("code", "key")), *(np.array(right[c]) for c in ("low", "high", "block", "place")))

    keys = ["size", "tree", "slice"]
    left = spots.mapInArrow(entries, "size long, tree long, slice long, code long, key long")
    right = asked.mapInArrow(ranges, "size long, tree long, slice long, low long, high long, block long, place long")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "key long, block long, places binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score.

    Nearness is the cosine in double precision; ties go to the smaller id; a
    query's own id is left out, so of rows that share an id none finds another.
    Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part. Only vectors of one length are compared. A row that occurs
    twice is found twice; a query that occurs twice is answered once, by the
    smaller of its vectors. Fewer than ``k`` candidates give fewer rows; empty
    tables give none. Other columns are ignored.
    """

    def match(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        q_sizes = asked["v"].combine_chunks().value_lengths().to_numpy()
        sizes = data["v"].combine_chunks().value_lengths().to_numpy()
        places = np.array(asked["place"])
        out = []
        for size in np.unique(sizes).tolist():
            some, of = data.filter(pa.array(sizes == size)), asked.filter(pa.array(q_sizes == size))
            x, q = (np.array(t["v"].combine_chunks().flatten()).reshape(-1, size) for t in (some, of))
            rows = list(pairs(some["places"].combine_chunks(), int(places.max()) + 1))
            named = (rows[i] for i in places[q_sizes == size].tolist())
            out.append(nearest(x, np.array(some["id"]), q, np.array(of["id"]), named, k))
        return pa.concat_tables(out)

    ship(vectors.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    data, asked = (t.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))) for t in (vectors, queries))
    spots = stash(distinct_vectors(data, k), "vectors")
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    asked = in_blocks(asked, asked.count())
    links = candidates(spots, asked, spots.count(), k).repartition("key").groupBy("key", "block").agg(F.collect_list("places").alias("places"))
    links = stash(links.join(spots, "key").select("block", F.explode("ids").alias("id"), "v", "places"), "candidates")
    parts = links.groupBy("block").agg(F.ceil(F.count("*") / SCORE_ROWS).cast("int").alias("parts"))
    data = links.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts").cast("int")).drop("parts")
    asked = asked.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = data.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(match, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
