"""Vectorised text kernels that run inside Spark tasks on Arrow buffers.

A column of texts arrives as one UTF-8 buffer with offsets. The kernels cut it
into words, hash words and hash runs of words without a Python loop over words.
Chunks bound the memory: a chunk holds whole texts, about ``CHUNK_BYTES`` of
them, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# The separators of the word pattern [^\x20\x09-\x0D]+
SEPARATOR_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

# The constants of the public XXH64 specification
XX1, XX2, XX3, XX4, XX5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)

IS_WORD_BYTE = np.ones(256, bool)
IS_WORD_BYTE[list(SEPARATOR_BYTES)] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Texts:
    """Whole texts as one byte buffer; text i is ``buf[offsets[i]:offsets[i+1]]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Word i is ``buf[start[i]:end[i]]``; ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.buf, self.start, self.end, self.first = buf, start, end, first

    def __len__(self) -> int:
        return len(self.start)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf[at[0] : at[-1]], at - at[0])


def row_chunks(texts: Texts, limit: int = CHUNK_BYTES, rows: int = 1 << 31) -> Iterator[tuple[int, int]]:
    """Ranges of ``rows`` rows at most whose texts hold about ``limit`` bytes, at least one row each."""
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to), at + rows)
        yield at, to
        at = to


def part_of(texts: Texts, at: int, to: int) -> Texts:
    offsets = texts.offsets[at : to + 1]
    return Texts(texts.buf[offsets[0] : offsets[-1]], offsets - offsets[0])


def words_of(texts: Texts) -> Words:
    buf, offsets = texts.buf, texts.offsets
    n = len(buf)
    if n == 0:
        return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = IS_WORD_BYTE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return Words(buf, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def byte_codes(seed: int) -> np.ndarray:
    """A random odd 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def multiplier(seed: int) -> int:
    return int(np.random.default_rng(seed + 7919).integers(1 << 58, 1 << 60)) * 8 + 5


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's multiplier and of its inverse modulo 2**64, 0..n at least."""
    if seed not in _powers or len(_powers[seed][0]) <= n:
        p = multiplier(seed)
        size = max(n, CHUNK_BYTES) + 1
        both = []
        for x in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, out=a))
        _powers[seed] = tuple(both)
    return _powers[seed]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, equal for equal content.

    Prefix sums of value times power give any span's polynomial in constant
    time; multiplying with an inverse power makes it independent of the place.
    """
    up, down = powers(seed, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(words: Words, seed: int, lower: bool = False) -> np.ndarray:
    codes = byte_codes(seed)
    if lower:
        codes = codes[ASCII_LOWER]
    return spans_hash(codes[words.buf], words.start, words.end, seed)


def word_names(words: Words, seed: int, lower: bool = False) -> np.ndarray:
    """XXH64 of each word. Unlike ``word_hashes``, whose sums are linear, it tells words of any make apart."""
    return xxh64(ASCII_LOWER[words.buf] if lower else words.buf, words.start, words.end, seed)


def joined_by_space(words: Words, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: buffer, starts, ends."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1 if len(words) else np.zeros(0, np.int64)
    start = end - length
    keep = np.zeros(len(words.buf) + 1, bool)
    keep[:-1] = IS_WORD_BYTE[words.buf]
    out = np.full(int(end[-1]) + 1 if len(words) else 0, 32, np.uint8)
    place = np.ones(len(out), bool)
    place[end] = False
    flat = words.buf[keep[:-1]]
    out[place] = ASCII_LOWER[flat] if lower else flat
    return out, start, end


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * XX2, 31) * XX1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``buf[start:end]``; spans of one length are hashed together.

    Lengths that few spans have are left to the xxhash library.
    """
    import xxhash

    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    length = (end - start).astype(np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words64 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    words32 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    order = np.argsort(length.astype(np.uint16) if length.max() < 65536 else length, kind="stable")
    kinds, first, counts = np.unique(length[order], return_index=True, return_counts=True)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        for size, at, many in zip(kinds.tolist(), first.tolist(), counts.tolist(), strict=True):
            rows = order[at : at + many]
            p = start[rows]
            if many < 8 or size > 512:
                out[rows] = [xxhash.xxh64_intdigest(buf[a : a + size].tobytes(), seed=seed) for a in p.tolist()]
                continue
            done = 0
            if size >= 32:
                a, b, c, d = (np.full(many, x, np.uint64) for x in (s + XX1 + XX2, s + XX2, s, s - XX1))
                while done + 32 <= size:
                    a, b, c, d = (_round(v, words64[p + (done + 8 * i)]) for i, v in enumerate((a, b, c, d)))
                    done += 32
                h = _rot(a, 1) + _rot(b, 7) + _rot(c, 12) + _rot(d, 18)
                for v in (a, b, c, d):
                    h = (h ^ _round(np.zeros(many, np.uint64), v)) * XX1 + XX4
            else:
                h = np.full(many, s + XX5, np.uint64)
            h = h + np.uint64(size)
            while done + 8 <= size:
                h = _rot(h ^ _round(np.zeros(many, np.uint64), words64[p + done]), 27) * XX1 + XX4
                done += 8
            if done + 4 <= size:
                h = _rot(h ^ (words32[p + done].astype(np.uint64) * XX1), 23) * XX2 + XX3
                done += 4
            while done < size:
                h = _rot(h ^ (buf[p + done].astype(np.uint64) * XX5), 11) * XX1
                done += 1
            h ^= h >> np.uint64(33)
            h *= XX2
            h ^= h >> np.uint64(29)
            h *= XX3
            h ^= h >> np.uint64(32)
            out[rows] = h
    return out
