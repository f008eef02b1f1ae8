"""Trigrams of the texts of a record batch, with the ids that hold them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers get what this module defines with their task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 22  # characters that are sorted at a time


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and how many each text has."""
    parts = ["" if t is None else t for t in texts.to_pylist()]
    return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))


def strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as an array of strings."""
    flat = np.ascontiguousarray(points, np.uint32).reshape(-1)
    size = 1 + (flat > 0x7F).astype(np.int32) + (flat > 0x7FF) + (flat > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(size.reshape(points.shape).sum(1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(ends), pa.py_buffer(flat.tobytes().decode("utf-32-le").encode()))


def postings(ids: np.ndarray, texts: list[pa.Array], block: int) -> Iterator[pa.RecordBatch]:
    """(gram, block, ids) of columns of texts of rows that ``ids`` names, rising within a list; a gram and block may come in several rows."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    found = [characters(t.take(pa.array(order))) for t in texts]
    points = np.concatenate([p for p, _ in found])
    row = np.concatenate([np.repeat(np.arange(len(ids)), n) for _, n in found])
    # Whole texts of two columns may meet in one row; where a text ends no trigram goes on.
    text = np.repeat(np.arange(len(ids) * len(found)), np.concatenate([n for _, n in found]))
    there = np.zeros(0x110000, bool)
    there[points] = True
    letters = np.flatnonzero(there).astype(np.uint32)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    width = max(1, int(len(letters) - 1).bit_length())
    rows = 1 << min(40, 63 - 3 * width)  # as many as fit into a key beside a trigram
    at = 0
    while at < len(points) - 2:
        end = min(at + SLICE, len(points) - 2)
        first = row[at]
        # Rows don't fall but where a column begins.
        far = np.flatnonzero((row[at:end] - first >= rows) | (row[at:end] < first))
        end = at + int(far[0]) if len(far) else end
        c = number[points[at : end + 2]]
        key = ((c[:-2] << 2 * width | c[1:-1] << width | c[2:]) * np.int64(rows) + (row[at:end] - first))[text[at:end] == text[at + 2 : end + 2]]
        key = np.unique(key)
        if len(key):
            gram, held = key // rows, ids[key % rows + first]
            place = np.floor_divide(held, block)
            starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (place[1:] != place[:-1])]))
            code = gram[starts]
            mask = (1 << width) - 1
            names = letters[np.stack([code >> 2 * width, code >> width & mask, code & mask], 1)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(held))
            yield pa.RecordBatch.from_arrays([strings(names), pa.array(place[starts]), lists], ["gram", "block", "ids"])
        at = end


def run(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield from postings(b.column(0).to_numpy(zero_copy_only=False), b.columns[1:], block)
