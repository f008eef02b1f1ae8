"""Vector code compression: product codes learned in rounds, with norm-of-sum bounds.

A vector's components become integers, ``floor(256 * x)``, and the vector is cut into
``PARTS`` equal parts. Each part position has a codebook of ``ENTRIES`` entries, at
first those of the smallest ids; a round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the
floored mean of its parts.

Assignments after the first are decided by bounds where these suffice. A part
keeps an upper bound of the distance to its entry and a lower bound of the distance to
every other one, each with the round in which it was exact (its stamp). All codebooks
so far are retained, so a bound is carried to the present round by the true net
displacement of the entries since its stamp, the norm of the sum of their moves,
which is at most the sum of the norms that an accumulated drift would take. First
the carried upper bound is tried, then the exact distance to the part's own entry; only
parts that neither settles are compared with all entries. Comparisons are strict and
leave room for rounding, so that no tie is decided by a bound; distances are integers
and exact.

Spark reads the vectors once for each round and writes them with their bounds, so a
lost executor costs its tasks only. Entries are moved by sums that every task takes
for itself: what meets is PARTS * ENTRIES sums a task, whatever the vectors' number
and however many are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm.runtime import ship, stash

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 4096  # rows of a batch that are compared at a time
EXACT = 1 << 22  # up to this magnitude products of doubles are exact integers
ROOM = 1e-6  # share of a bound left for rounding


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and of ``book``."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < EXACT:
        a, b = x.astype(float), book.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, its distance, and the least distance of another entry."""
    d = squared(x, book).astype(float)
    code = d.argmin(1)
    rows = np.arange(len(x))
    nearest = d[rows, code]
    d[rows, code] = np.inf
    return code, np.sqrt(nearest), np.sqrt(d.min(1))


class Bounds:
    """Codes of some vectors' parts, with bounds and the rounds that these are from; all are (rows, parts)."""

    NAMES = ("code", "upper", "upper_round", "lower", "lower_round")
    KINDS = (np.uint8, np.float32, np.uint8, np.float32, np.uint8)

    def __init__(self, rows: int, parts: int):
        self.code, self.upper, self.upper_round, self.lower, self.lower_round = (np.zeros((rows, parts), k) for k in self.KINDS)
        self.scans = np.zeros(rows, np.int32)

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int) -> Bounds:
        out = cls(batch.num_rows, parts)
        for name, kind in zip(cls.NAMES, cls.KINDS, strict=True):
            raw = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
            setattr(out, name, np.frombuffer(raw, kind).reshape(-1, parts).copy())
        out.scans = batch.column(batch.schema.get_field_index("scans")).to_numpy(zero_copy_only=False).copy()
        return out

    def columns(self) -> list[pa.Array]:
        packed = [pa.array([r.tobytes() for r in getattr(self, n)], pa.binary()) for n in self.NAMES]
        return [*packed, pa.array(self.scans)]


def outward(value: np.ndarray, to: float) -> np.ndarray:
    """Single precision, rounded towards ``to``, so that bounds stay bounds."""
    return np.nextafter(value.astype(np.float32), np.float32(to))


def rescan(x: np.ndarray, book: np.ndarray, part: int, bounds: Bounds, rows: np.ndarray, now: int) -> None:
    for a in range(0, len(rows), BLOCK):
        r = rows[a : a + BLOCK]
        code, near, other = scan(x[r], book)
        bounds.code[r, part], bounds.upper[r, part], bounds.lower[r, part] = code, outward(near, np.inf), outward(other, 0)
        bounds.upper_round[r, part] = bounds.lower_round[r, part] = now
        bounds.scans[r] += 1


def assign(x: np.ndarray, history: list[np.ndarray], bounds: Bounds | None) -> Bounds:
    """Nearest entries of ``x`` (rows, parts, width) in the last codebooks of ``history`` (parts, entries, width)."""
    now, books = len(history) - 1, history[-1]
    fresh = bounds is None
    bounds = bounds or Bounds(len(x), len(books))
    for p, book in enumerate(books):
        own = x[:, p]
        if fresh:
            rescan(own, book, p, bounds, np.arange(len(x)), now)
            continue
        # Net displacements since each earlier round, and the greatest one but an entry's own.
        moved = np.sqrt(np.stack([((book - h[p]).astype(float) ** 2).sum(1) for h in history]))
        order = np.argsort(-moved, axis=1)
        first = order[:, 0]
        greatest = np.take_along_axis(moved, order, 1)
        code, since = bounds.code[:, p].astype(int), bounds.lower_round[:, p]
        others = np.where(code == first[since], greatest[since, 1] if greatest.shape[1] > 1 else 0.0, greatest[since, 0])
        limit = (bounds.lower[:, p].astype(float) - others) * (1 - ROOM) - ROOM
        open_ = np.flatnonzero(~((bounds.upper[:, p] + moved[bounds.upper_round[:, p], code]) * (1 + ROOM) < limit))
        if not len(open_):
            continue
        exact = np.sqrt(((own[open_] - book[code[open_]]).astype(float) ** 2).sum(1))
        bounds.upper[open_, p], bounds.upper_round[open_, p] = outward(exact, np.inf), now
        rescan(own, book, p, bounds, open_[~(exact * (1 + ROOM) < limit[open_])], now)
    return bounds


def errors(x: np.ndarray, books: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Each vector's squared distance to its entries."""
    total = np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        total += ((x[:, p] - book[code[:, p]]) ** 2).sum(1)
    return total


def parts_of(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) of lists of integers; zeros behind shorter lists."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    if len(flat) == n * parts * width and (sizes == parts * width).all():
        return flat.reshape(n, parts, width)
    out = np.zeros((n, parts * width), np.int64)
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(n, parts, width)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q) of the vectors that take part. Magnitudes end at the largest whose errors fit a long."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * F.lit(float(SCALE))).cast("double"), most), -most).cast("int"))
    return vectors.filter(v.isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("q"))


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floored mean of the parts that it has; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            x = parts_of(batch.column(0), parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                at = p * entries + code[:, p].astype(int)
                np.add.at(total, at, np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        entry, place = np.nonzero(total[:, -1:] + np.zeros(width + 1, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(place), pa.array(total[entry, place])], ["entry", "place", "value"])

    found = state.select("q", "code").mapInArrow(run, "entry long, place long, value long").groupBy("entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = {(r["entry"], r["place"]): int(r["value"]) for r in found}
    out = books.copy()
    for (entry, place), value in sums.items():
        if place < width:
            out[entry // entries, entry % entries, place] = value // sums[entry, width]
    return out


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def learn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[np.ndarray]]:
    """Codes of all vectors after ``rounds`` rounds and the codebooks of every round, the last of which they are of.

    Codes are (id, label, code, error, scans): one byte a part, the squared distance summed
    over parts, and how often a part was compared with all entries. None and no
    codebooks if no vector takes part.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    if longest is None:
        return None, []
    width = max(1, -(-longest // parts))
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()
    start = np.zeros((len(seeds), parts * width), np.int64)
    for i, r in enumerate(seeds):
        start[i, : len(r["q"])] = r["q"]
    history = [np.ascontiguousarray(start.reshape(len(seeds), parts, width).transpose(1, 0, 2))]
    kind = vectors.schema[label_col].dataType.simpleString()
    kept = "code binary, upper binary, upper_round binary, lower binary, lower_round binary, scans int"
    ship(vectors.sparkSession)

    def step(history: list[np.ndarray], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = parts_of(batch.column(2), parts, width)
                found = assign(x, history, Bounds.read(batch, parts) if len(history) > 1 else None)
                if last:
                    code = pa.array([r.tobytes() for r in found.code], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(errors(x, history[-1], found.code)), pa.array(found.scans)], ["id", "label", "code", "error", "scans"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *found.columns()], ["id", "label", "q", *Bounds.NAMES, "scans"])

        return run

    state = rows
    for _ in range(rounds):
        state = stash(state.mapInArrow(step(list(history), False), f"id long, label {kind}, q array<int>, {kept}"), "codes-round")
        history.append(moved(state, history[-1]))
    coded = stash(state.mapInArrow(step(list(history), True), f"id long, label {kind}, code binary, error long, scans int"), "codes")
    return coded, history


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **conf: int) -> DataFrame:
    """One row per vector that takes part: id_col, code, error, label_error, codebooks_sha256, scans.

    Vectors that are null or hold a null or non-finite component don't take part; an
    empty one does. Shorter vectors, and lengths that ``PARTS`` doesn't divide, have
    zeros behind them. Components beyond what keeps errors within a long count as the
    nearest that does. Of fewer vectors than entries, each gives an entry. Null ids come after all others.
    ``code`` has two hex digits a part, ``label_error`` sums errors over equal labels
    (nulls together; null where the sum leaves a long). Rows that repeat an id have a code each; an empty table
    stays empty. Other columns are ignored.
    """
    coded, history = learn(vectors, id_col, vector_col, label_col, **conf)
    if coded is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` long, code string, error long, label_error long, codebooks_sha256 string, scans int")
    # Written, so that Spark knows its size and can split a hot label in the join.
    sums = stash(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "codes-labels")
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(history[-1])).alias("codebooks_sha256"), "scans")
