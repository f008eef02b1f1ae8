"""Elias-Fano sequences and a three-level n-gram trie on them, memory-mapped.

A monotone sequence keeps the low bits of its values packed and the high bits in
unary, with directories of the zeros and ones before each word. A successor search
jumps to the zeros that bound the values with its high part and halves the range
between them; a value is read at the place of its one. All searches take arrays.

A level of the trie holds the children of the nodes above it. Pointers to where
each node's children begin are one monotone sequence. The children's words are
another: within a node they rise, and each node goes on from the last value of the
node before, so a child is searched relative to that value, in the pointed range.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 100_000  # searches at a time
STEPS = 4096  # of the quantised logarithms, to one power of ten


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays again, backed by an unnamed temporary file that goes with them."""
    out = {}
    with tempfile.TemporaryFile() as file:
        places = {}
        for name, a in arrays.items():
            places[name] = file.tell()
            file.write(a.tobytes())
            file.write(b"\0" * (-file.tell() % 16))
        file.flush()
        for name, a in arrays.items():
            out[name] = np.memmap(file, a.dtype, "r", places[name], a.shape) if a.size else a
    return out


def _select_zero(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of the nth zero (from 0) in each 64-bit word."""
    ones, at, left = ~word, np.zeros(len(word), np.uint64), nth.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((ones >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
        go = left >= low
        left = left - np.where(go, low, 0)
        at = at + np.where(go, np.uint64(half), np.uint64(0))
    return at.astype(np.int64)


class Monotone:
    """A sorted sequence of integers under 2**62."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, min(52, (top // max(self.n, 1)).bit_length() - 1))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = (top >> self.low_bits) + 1
        bits = np.zeros(((self.n + self.buckets + 1) // 64 + 2) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64)) - (64 - np.bitwise_count(words))
        packed = np.zeros(self.n * self.low_bits // 64 + 3, np.uint64)
        if self.low_bits and self.n:
            low = values & np.uint64((1 << self.low_bits) - 1)
            at = np.arange(self.n, dtype=np.int64) * self.low_bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(packed, at >> 6, low << shift)
            over = (shift + np.uint64(self.low_bits)) > 64
            np.bitwise_or.at(packed, (at[over] >> 6) + 1, low[over] >> (np.uint64(64) - shift[over]))
        ones = 64 * np.arange(len(words)) - zeros
        kind = np.uint32 if len(bits) < 1 << 32 else np.int64
        self.a = mapped({"words": words, "zeros": zeros.astype(kind), "ones": ones.astype(kind), "low": packed})

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part under ``bucket``."""
        zero = np.maximum(bucket - 1, 0)  # the zero that ends the bucket before
        word = np.searchsorted(self.a["zeros"], zero.astype(self.a["zeros"].dtype), side="right") - 1
        place = word * 64 + _select_zero(self.a["words"][word], zero - self.a["zeros"][word].astype(np.int64))
        return np.where(bucket > 0, place - zero, 0)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        shift = (at & 63).astype(np.uint64)
        first, second = self.a["low"][at >> 6], self.a["low"][(at >> 6) + 1]
        joined = (first >> shift) | np.where(shift > 0, second << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return joined & np.uint64((1 << self.low_bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        word = np.searchsorted(self.a["ones"], i.astype(self.a["ones"].dtype), side="right") - 1
        place = word * 64 + _select_zero(~self.a["words"][word], i - self.a["ones"][word].astype(np.int64))
        return ((place - i) << self.low_bits) | self.low(i).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of the first value equal to each of ``values``, -1 where there is none."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        bucket = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(bucket < self.buckets)
        want = values[inside] & np.uint64((1 << self.low_bits) - 1)
        lo, end = self._before(bucket[inside]), self._before(bucket[inside] + 1)
        hi, busy = end.copy(), np.arange(len(inside))
        while len(busy := busy[lo[busy] < hi[busy]]):
            mid = (lo[busy] + hi[busy]) // 2
            less = self.low(mid) < want[busy]
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        there = np.flatnonzero(lo < end)
        hit = there[self.low(lo[there]) == want[there]]
        out[inside[hit]] = lo[hit]
        return out


class Level:
    """Children (``owner``, ``key``), in this order, of ``parents`` nodes, each with a quantised logarithm."""

    def __init__(self, parents: int, owner: np.ndarray, key: np.ndarray, log10: np.ndarray):
        self.start = Monotone(np.searchsorted(owner, np.arange(parents + 1)))
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(owner)))
        last = key[head + size - 1].astype(np.int64) + 1
        self.keys = Monotone(np.repeat(np.cumsum(last) - last, size) + key + 1)
        self.code = mapped({"code": np.minimum(np.rint(-log10 * STEPS), 65535).astype(np.uint16)})["code"]

    def find(self, parent: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The place of each child, -1 where there is none (or no parent)."""
        out = np.full(len(parent), -1, np.int64)
        there = np.flatnonzero(parent >= 0)
        if not len(there) or not self.keys.n:
            return out
        begin, end = self.start.at(parent[there]), self.start.at(parent[there] + 1)
        before = np.where(begin > 0, self.keys.at(np.maximum(begin - 1, 0)), 0)
        at = self.keys.find(before + key[there] + 1)
        out[there] = np.where((at >= begin) & (at < end), at, -1)
        return out

    def power(self, at: np.ndarray, none: float) -> np.ndarray:
        """Ten to the stored logarithm at each place, ``none`` where it is -1."""
        if not len(self.code):
            return np.full(len(at), none)
        return np.where(at >= 0, 10.0 ** (-self.code[np.maximum(at, 0)].astype(float) / STEPS), none)


class Trie:
    """Interpolated trigrams: p(w | u v) = a3 + b3 * (a2 + b2 * p(w)).

    Words are numbers in ``words``, a sequence of their names, which ``number`` searches. Below a word v are the
    words w seen after it, with a2 = c(v w) / (c(v) + prior), and, in a level of
    their own, the words u seen before it, with b3 = prior / (c(u v) + prior). Below
    u are the words w seen after u v, with a3 = c(u v w) / (c(u v) + prior).
    """

    def __init__(self, names: np.ndarray, pairs: tuple, contexts: tuple, triples: tuple, weights: np.ndarray):
        """``pairs`` (v, w, log10 a2), ``contexts`` (v, u, log10 b3), ``triples`` (number of the context, w, log10 a3), log10 b2 of each word."""
        self.words = Monotone(names)
        self.pairs = Level(len(names), *pairs)
        self.contexts = Level(len(names), *contexts)
        self.triples = Level(len(contexts[0]), *triples)
        self.weights = mapped({"code": np.minimum(np.rint(-weights * STEPS), 65535).astype(np.uint16)})["code"]

    def number(self, names: np.ndarray) -> np.ndarray:
        return self.words.find(names)

    def parts(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a3, b3, a2, b2) of words by number; -1 is an unknown word."""
        found = [self._parts(*(x[a : a + BLOCK] for x in (u, v, w))) for a in range(0, len(u), BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 4

    def _parts(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        # Searches of one context and of one pair of words are done once.
        pairs = [np.unique(v * len(self.weights) + x, return_index=True, return_inverse=True)[1:] for x in (u, w)]
        (one, back), (other, again) = pairs
        context = self.contexts.find(v[one], u[one])[back]
        pair = self.pairs.find(v[other], w[other])[again]
        triple = self.triples.find(context, w)
        b2 = np.where(v >= 0, 10.0 ** (-self.weights[np.maximum(v, 0)].astype(float) / STEPS), 1.0) if len(self.weights) else np.ones(len(u))
        return self.triples.power(triple, 0.0), self.contexts.power(context, 1.0), self.pairs.power(pair, 0.0), b2
