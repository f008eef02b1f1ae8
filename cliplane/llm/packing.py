"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into classes by the reciprocal of the capacity: class k holds
lengths over capacity/(k+1) and up to capacity/k, and each of its bins takes k
pieces, whatever they are. So a task fills the bins of a class by counting, with
no search and no word from other tasks, and nothing is shuffled.

Documents may be cut, so most pieces are cut to fill their class exactly: whole
sequences first (class 1), then at most one piece each of capacity/2, /4, ...
down to ``SMALLEST``; the rest of under ``SMALLEST`` tokens goes to its class
uncut. What is left in open bins when a task ends is put together, largest
pieces first.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm.runtime import ship

CAPACITY = 1024
SMALLEST = 32
END_ID = 0
ROWS_PER_BATCH = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# Texts with other characters or with the special token's string are left to the tokenizers library.
PLAIN = re.compile("[^\x00-ɏ‐-‧€]|<\\|endoftext\\|>")


class Encoder:
    """Ids as the tokenizers library gives them for a vocabulary file.

    ``ranks`` names the same vocabulary as tiktoken ranks; it gives equal ids
    faster for common texts (tests hold the two against each other).
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        self.vocabulary = vocabulary
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not PLAIN.search(text):
            found = self.fast.encode_ordinary(text)
        else:
            found = self.slow.encode(text, add_special_tokens=False).ids
        found.append(END_ID)
        return np.array(found, "<u4")


class Bins:
    """The open bins of one task; closed ones are handed to ``emit``."""

    def __init__(self, capacity: int, first_id: int, emit):
        self.capacity, self.next_id, self.emit = capacity, first_id, emit
        self.cuts = [c for k in range(1, 40) if (c := capacity >> k) >= SMALLEST]
        self.open: dict[int, list] = {}

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at, raw = len(ids), 0, ids.tobytes()
        while total - at >= self.capacity:
            self.put(doc_id, at, self.capacity, raw, total)
            at += self.capacity
        for size in self.cuts:
            if total - at >= size:
                self.put(doc_id, at, size, raw, total)
                at += size
        if at < total:
            self.put(doc_id, at, total - at, raw, total)

    def put(self, doc_id, start: int, length: int, raw: bytes, total: int) -> None:
        k = self.capacity // length
        kept = self.open.setdefault(k, [])
        kept.append((doc_id, start, length, raw[4 * start : 4 * (start + length)], total))
        if len(kept) == k:
            self.close(kept)
            self.open[k] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, length, raw, total in pieces:
            self.emit((doc_id, start, length, raw, total, self.next_id, offset))
            offset += length
        self.next_id += 1

    def finish(self) -> None:
        """First fit, largest pieces first; at most the pieces of one open bin per class are left here."""
        rest = sorted((p for kept in self.open.values() for p in kept), key=lambda p: -p[2])
        bins: list[list] = []
        room: list[int] = []
        for p in rest:
            i = next((i for i, r in enumerate(room) if r >= p[2]), len(bins))
            if i == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[i].append(p)
            room[i] -= p[2]
        for pieces in bins:
            self.close(pieces)
        self.open = {}


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds a piece's token ids, little-endian unsigned 32-bit; a document
    is its text's ids and an end id. A null or empty text is the end id alone; a
    null doc_id is kept. Rows that repeat a document are packed each. Sequence
    numbers are unique over all tasks. Other columns are ignored; an empty table
    gives no pieces. ``vocabulary`` and ``ranks`` are paths that workers can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks, pattern)
        rows: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        bins = Bins(capacity, TaskContext.get().partitionId() << 33, rows.append)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bins.add(doc_id, encoder.ids(text.as_py() or ""))
                if len(rows) >= ROWS_PER_BATCH:
                    yield taken()
        bins.finish()
        if rows:
            yield taken()

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
