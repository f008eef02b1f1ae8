"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the number of set bits
of each segment embeds it as a point with 32 coordinates in 0..2. One flipped
bit moves one coordinate by one, so the Manhattan distance of two points is a
lower bound of the Hamming distance of their fingerprints, and fingerprints
within k = 3 bits lie within Manhattan distance 3.

The range join works on a grid in half of the coordinates: of two points within
distance 3, at least one half (16 coordinates) is within distance 1, that is,
the points agree there in all coordinates but one at most. Each point goes into
the 16 cells of each half that leave one coordinate open, so partners share a
cell. Within a cell, pairs are verified exactly by Hamming distance, and only a
spanning forest of the cell's links is passed on, never all pairs. Cells with
over ``CELL_LIMIT`` different fingerprints are divided without loss until they are
small: three differing bits leave one quarter of the bits untouched, so each
point goes into four sub-cells, each keyed by one quarter of the bits that no
division has used yet. At the end nine bits are open, so a cell holds 512
fingerprints at most.

Only different fingerprints meet; links and components are those of fingerprints.
Ids join their fingerprint's class at the end, so rows without an id carry links
like all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplane.llm import components, kernels
from cliplane.llm.runtime import ship, stash

MAX_BITS = 3
SHINGLE = 3
CELL_LIMIT = 2048
HALVES = 2
SEGMENTS = 16


def shingle_hashes(texts: kernels.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and the first shingle of each text (one more entry at the end)."""
    words = kernels.words_of(texts)
    buf, start, end = kernels.joined_by_space(words, lower=True)
    n = np.diff(words.first)
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    word = np.arange(first[-1]) - first[text] + words.first[text]
    last = np.minimum(word + size, words.first[text + 1]) - 1
    return kernels.xxh64(buf, start[word], end[last]), first


def fingerprints(texts: kernels.Texts) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is set if over half of the shingle hashes set it."""
    hashes, first = shingle_hashes(texts)
    many = np.diff(first)
    out = np.zeros(len(texts), np.uint64)
    # Bits are summed in the byte lanes of 64-bit words, 255 hashes at most at a time.
    block = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:], strict=True) if b > a] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(block):
        return out
    blocks = -(-many // 255)
    owner = np.concatenate([[0], np.cumsum(blocks)])[:-1][many > 0]
    half = many[many > 0]
    found = np.zeros(len(half), np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & lanes, block)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        for lane in range(8):
            found |= (2 * counts[:, lane] > half).astype(np.uint64) << np.uint64(8 * lane + b)
    out[many > 0] = found
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            parts = [fingerprints(kernels.part_of(texts, a, b)) for a, b in kernels.row_chunks(texts)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def popcounts(fp, half: int) -> list:
    """The 16 coordinates of one half, as 64-bit columns of values 0..2."""
    at = half * 32
    return [(F.shiftrightunsigned(fp, at + 2 * i).bitwiseAND(F.lit(1)) + F.shiftrightunsigned(fp, at + 2 * i + 1).bitwiseAND(F.lit(1))) for i in range(SEGMENTS)]


def cells(points: DataFrame) -> DataFrame:
    """(cell, fp): the 32 grid cells of each fingerprint.

    A cell's number holds the half, the open coordinate and the packed
    coordinates with the open one set to 3, so it is exact and not a hash.
    """
    packed = points.select(
        "fp",
        *(
            sum((c * F.lit(1 << (2 * i)) for i, c in enumerate(popcounts(F.col("fp"), h))), F.lit(0).cast("long")).alias(f"p{h}")
            for h in range(HALVES)
        ),
    )
    keys = [
        F.col(f"p{h}").bitwiseOR(F.lit(3 << (2 * i))).bitwiseOR(F.lit((h * SEGMENTS + i) << 32)) for h in range(HALVES) for i in range(SEGMENTS)
    ]
    return packed.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that span what is linked within each row's list of fingerprints."""
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.concatenate([[0], np.cumsum(sizes)])
        two = at[:-1][sizes == 2]
        a, b = values[two], values[two + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
        left, right = [a[near]], [b[near]]
        for i in np.flatnonzero(sizes > 2).tolist():
            x = values[at[i] : at[i + 1]]
            for p, q in spanning(x):
                left.append(x[p : p + 1])
                right.append(x[q : q + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def spanning(x: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among ``x``; breadth first, one row of distances at a time."""
    bits = x.view(np.uint64)
    rest = np.arange(len(x))
    out = []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = np.bitwise_count(bits[rest] ^ bits[p]) <= MAX_BITS
            if near.any():
                found = rest[near].tolist()
                out += [(p, q) for q in found]
                queue += found
                rest = rest[~near]
    return out


def divided(crowded: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(cell, fp, rest) of crowded cells, in four sub-cells each, and the bits left in ``rest``.

    ``rest`` holds the ``width`` bits of a fingerprint that don't decide its cell yet.
    A sub-cell is known by a hash; if two have one hash, they are searched together.
    """
    part = -(-width // 4)
    bits = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")

    def quarter(i: int) -> Column:
        value = F.shiftrightunsigned("rest", i * part).bitwiseAND(bits(part))
        above = F.shiftrightunsigned("rest", (i + 1) * part) if (i + 1) * part < 64 else F.lit(0).cast("long")
        left = F.col("rest").bitwiseAND(bits(i * part)).bitwiseOR(F.shiftleft(above, i * part))
        return F.struct(F.xxhash64("cell", F.lit(i), value).alias("cell"), left.alias("rest"))

    subs = crowded.withColumn("sub", F.explode(F.array(*(quarter(i) for i in range(4)))))
    return subs.select(F.col("sub.cell").alias("cell"), "fp", F.col("sub.rest").alias("rest")), 3 * part


def links(points: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints that span the same components as all links within MAX_BITS."""
    ship(points.sparkSession)
    placed, width, found = cells(points).withColumn("rest", F.col("fp")), 64, []
    while True:
        counts = stash(placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-cells")
        # Three quarters of nine bits are still nine when rounded up to whole ones; a cell is small then.
        last = 3 * -(-width // 4) >= width
        small = placed.join(counts if last else counts.filter(F.col("n") <= CELL_LIMIT), "cell")
        groups = small.groupBy("cell").agg(F.collect_list("fp").alias("fps"))
        found.append(groups.select("fps").mapInArrow(forest, "a long, b long"))
        if last or counts.filter(F.col("n") > CELL_LIMIT).isEmpty():
            return functools.reduce(DataFrame.union, found).distinct()
        placed, width = divided(placed.join(counts.filter(F.col("n") > CELL_LIMIT), "cell").select("cell", "fp", "rest"), width)
        placed = stash(placed, "simhash-subcells")


def classes(points: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint, as a signed number, that each one of ``points`` (fp) reaches."""
    edges = stash(links(points), "simhash-links")
    labels = components.connected(edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
    return points.join(labels, points["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id).

    Texts are lower-cased (A-Z), cut into words and 3-word shingles; fingerprints
    within 3 differing bits are linked, and ``component_id`` is the smallest id
    that links reach. Null and empty texts have fingerprint zero and are linked
    like any other. A null id stays null and reaches the ids of its fingerprint's
    component. Rows that repeat an id give repeated rows. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    marked = stash(with_fingerprint(docs, id_col, text_col), "simhash-fingerprints")
    points = stash(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-points")
    roots = stash(classes(points.select("fp")).join(points, "fp"), "simhash-roots")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    found = roots.join(named, "root").select("fp", "component_id")
    return marked.join(found, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; all columns kept.

    Rows that share an id or have none are documents like all others: one row stays
    of each group, one without an id only if the group has no other.
    """
    key = F.xxhash64(text_col, *(c for c in docs.columns if c != text_col and not isinstance(docs.schema[c].dataType, T.MapType)))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), F.monotonically_increasing_id().alias("row"), key.alias("own_key"))
    at = rows.columns.index("own_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(at))
            parts = [fingerprints(kernels.part_of(texts, a, b)) for a, b in kernels.row_chunks(texts)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), pa.array(fp.view(np.int64))], ["doc", "own_id", "row", "own_key", "fp"])

    ship(docs.sparkSession)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc", "own_id", "row", "own_key"))
    marked = stash(rows.mapInArrow(run, f"{kinds}, fp long"), "simhash-documents")
    roots = stash(classes(marked.select("fp").distinct()), "simhash-roots")
    order = F.struct(F.col("own_id").isNull(), "own_id", "own_key", "row")
    first = marked.join(roots, "fp").groupBy("root").agg(F.min_by("row", order).alias("row"))
    return marked.join(first.select("row"), "row", "left_semi").select("doc.*")
