"""Lossless WebP in numpy: a full decoder and an encoder.

The decoder reads every feature of the lossless format: prefix codes, meta prefix
codes, back-references, colour cache, and the predictor, cross-colour,
subtract-green and colour-indexing transforms. Images with one group of codes are
decoded in arrays: what a token takes is looked up at every bit position at once,
and only the chain of positions and the copies are followed step by step.

The encoder writes back-references and a colour cache, and chooses transforms by
the entropy that they leave in the channels: a palette, or a predictor and then
cross-colour or subtract-green, or none. It has one group of prefix codes.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
MAX_CODE = 12  # bits of the encoder's longest code
WINDOW_BYTES = 1 << 12  # of the stream that are looked at together
LEAST_MATCH, MOST_MATCH, FARTHEST = 2, 4096, (1 << 20) - 120  # pixels
CHUNK = 1 << 16  # pixels that are encoded together
LOOK_BYTES = 1 << 11  # of a stream in which tokens are looked up at every bit
STREAM_BYTES = 1 << 19  # of streams, or pixels, that are decoded together
LOOK = 15  # bits of code lengths that are looked up at once
BLOCK_BITS = 4  # of the encoder's predictor and cross-colour blocks

# Fixed values of the lossless WebP format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# All 16-bit numbers with their bits in reverse order.
TURNED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16)[:, ::-1], axis=1).view(">u2").reshape(-1).astype(np.int64)


class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        word = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return word & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def canonical(lengths: np.ndarray, segments: np.ndarray | None = None) -> np.ndarray:
    """The code of each symbol as it lies in the stream (its first bit lowest); each segment (where it starts) is a code of its own."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return out
    of = np.zeros(len(used), np.int64) if segments is None else np.searchsorted(segments, used, "right")
    order = np.argsort(16 * of + lengths[used], kind="stable")
    used, of = used[order], of[order]
    size = lengths[used].astype(np.int64)
    # Codes of one length follow each other; each takes 2**(15 - length) of the numbers of 15 bits.
    start = np.concatenate([[0], np.cumsum(1 << (15 - size))[:-1]])
    head = np.flatnonzero(np.diff(of, prepend=-1))
    start -= np.repeat(start[head], np.diff(head, append=len(of)))
    out[used] = TURNED[start >> (15 - size)] >> (16 - size)
    return out


class Code:
    """A prefix code as a table over the next ``width`` bits; a code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        if self.only is not None:
            self.width, self.size, self.symbol = 0, np.zeros(1, np.uint8), np.array([self.only], np.int32)
            return
        self.width = int(lengths.max())
        if int((1 << (self.width - lengths[used].astype(np.int64))).sum()) != 1 << self.width:
            raise ValueError("not a complete prefix code")
        used = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[used]
        # The numbers that start with a code follow each other if its first bit is the highest.
        turned = TURNED[np.arange(1 << self.width)] >> (16 - self.width)
        which = np.repeat(np.arange(len(used)), 1 << (self.width - size.astype(np.int64)))[turned]
        self.size, self.symbol = size[which], used[which].astype(np.int32)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        byte = bits.at >> 3
        word = (int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7)) & ((1 << self.width) - 1)
        bits.at += int(self.size[word])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends too early")
        return int(self.symbol[word])


    def pairs(self) -> tuple[list[tuple[int, int]], int]:
        """(symbol, size) by the next bits, and the mask of these bits."""
        return list(zip(self.symbol.tolist(), self.size.tolist(), strict=True)), (1 << self.width) - 1


def _window(data: bytes, byte: int) -> list[int]:
    """The 32 bits from each of some bytes on; what lies behind the end is zero."""
    raw = np.zeros(WINDOW_BYTES + 3, np.uint32)
    part = np.frombuffer(data, np.uint8, min(len(raw), max(0, len(data) - byte)), min(byte, len(data)))
    raw[: len(part)] = part
    return (raw[:-3] | (raw[1:-2] << 8) | (raw[2:-1] << 16) | (raw[3:] << 24)).tolist()


@lru_cache(maxsize=64)
def _inner(given: int, word: int) -> tuple[list[tuple[int, int]], int, dict[int, tuple[bytes, int]]]:
    """The code for code lengths: (symbol, size) by the next bits, their mask, and what ``_ahead`` has found."""
    inner = np.zeros(19, np.uint8)
    for i in range(given):
        inner[LENGTH_ORDER[i]] = (word >> (3 * i)) & 7
    return *Code(inner).pairs(), {}


def _ahead(table: list[tuple[int, int]], mask: int, word: int) -> tuple[bytes, int]:
    """The code lengths that LOOK bits hold as a whole, but for repeats of the last one, and the bits that they take."""
    found, at = [], 0
    while True:
        s, k = table[(word >> at) & mask]
        more = 0 if s < 16 else 3 if s == 17 else 7
        if s == 16 or not k or at + k + more > LOOK:
            return bytes(found), at
        at += k
        found += [s] if s < 16 else [0] * ((3 if s == 17 else 11) + ((word >> at) & ((1 << more) - 1)))
        at += more


def read_lengths(bits: Bits, alphabet: int) -> bytearray:
    """The code lengths of a prefix code, symbols behind the last one left out."""
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        first = bits.take(8 if wide else 1)
        second = bits.take(8) if two else first
        found = bytearray(max(first, second) + 1)
        found[first] = found[second] = 1
        return found
    given = 4 + bits.take(4)
    table, mask, known = _inner(given, bits.take(3 * given))
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    found, free = bytearray(), most == alphabet
    byte, have, ahead = (bits.at >> 3) + 8, 64 - (bits.at & 7), int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 8], "little") >> (bits.at & 7)
    while len(found) < alphabet and most:
        if have < 32:  # a symbol and its extra bits take 14 at most
            ahead |= int.from_bytes(bits.data[byte : byte + 4], "little") << have
            byte, have = byte + 4, have + 32
        if free:
            word = ahead & ((1 << LOOK) - 1)
            next_ = known.get(word)
            if next_ is None:
                next_ = known[word] = _ahead(table, mask, word)
            some, k = next_
            if k and len(found) + len(some) <= alphabet:
                found += some
                ahead, have = ahead >> k, have - k
                continue
        most -= 1
        s, k = table[ahead & mask]
        ahead, have = ahead >> k, have - k
        if s < 16:
            found.append(s)
            continue
        value, k, least = (next((x for x in reversed(found) if x), 8), 2, 3) if s == 16 else (0, 3, 3) if s == 17 else (0, 7, 11)
        found += bytes([value]) * (least + (ahead & ((1 << k) - 1)))
        ahead, have = ahead >> k, have - k
    bits.at = 8 * byte - have
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends too early")
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    return found


def read_code(bits: Bits, alphabet: int) -> Code:
    return Code(np.frombuffer(read_lengths(bits, alphabet), np.uint8))


def _extra(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _literals(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """``n`` pixels of literals: the bits that a pixel takes from every position, then the chain of pixels."""
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8)[start:]
    live = [c for c in codes if c.width]
    pos = np.full(n, bits.at - 8 * start, np.int64)
    padded = np.concatenate([raw, np.zeros(64, np.uint8)])
    word = padded[:-3].astype(np.uint32) | (padded[1:-2].astype(np.uint32) << 8) | (padded[2:-1].astype(np.uint32) << 16) | (padded[3:].astype(np.uint32) << 24)
    word = word[: len(raw) + 32]
    if live:
        total = 8 * len(word)
        step, seen = None, []
        for c in live:
            if seen and np.array_equal(c.size, seen[0][0].size):
                size = seen[0][1]
            else:
                size = np.empty((len(word), 8), np.uint8)
                for r in range(8):
                    size[:, r] = c.size[(word >> np.uint32(r)) & np.uint32((1 << c.width) - 1)]
                size = size.reshape(-1)
            seen.append((c, size))
            step = size if step is None else step + size[np.minimum(np.arange(total) + step, total - 1)]
        jump, p = step.tobytes(), int(pos[0])
        try:
            places = [p] + [p := p + jump[p] for _ in range(n)]
        except IndexError:
            places = [8 * len(raw) + 1]
        if places[-1] > 8 * len(raw):
            raise ValueError("the image ends too early")
        pos = np.array(places, np.int64)[:-1]
        bits.at = 8 * start + places[-1]
    out = np.zeros(n, np.uint32)
    for c, shift in zip(codes, (8, 16, 0, 24), strict=True):
        if not c.width:
            out |= np.uint32(c.only << shift)
            continue
        at = (word[pos >> 3] >> (pos & 7).astype(np.uint32)) & np.uint32((1 << c.width) - 1)
        out |= c.symbol[at].astype(np.uint32) << np.uint32(shift)
        pos = pos + c.size[at]
    return out


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB values; only the main one can have meta prefix codes."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, group_of, block = 1, None, 0
    if main and bits.take(1):
        block = bits.take(3) + 2
        meta = _image(bits, -(-width >> block), -(-height >> block), False)
        group_of = (meta >> 8) & 0xFFFF
        groups = int(group_of.max()) + 1
    codes = [[read_code(bits, s) for s in _alphabets(cache_bits)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_bits and codes[0][0].symbol.max() < 256:
        return _literals(bits, codes[0][:4], n).reshape(height, width)
    tables = [[c.pairs() for c in group] for group in codes]
    return _tokens(bits, tables, cache_bits, width, height, array("I"), group_of, block)


def _alphabets(cache_bits: int) -> tuple[int, ...]:
    return (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)


def _tokens(bits: Bits, tables: list, cache_bits: int, width: int, height: int, out: array, group_of: np.ndarray | None = None, block: int = 0) -> np.ndarray:
    """The pixels of an image token by token, after those that are there."""
    n, at, kept = width * height, len(out), 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    size, place, base, last, window, append = 8 * len(bits.data), bits.at, 0, -1, [], out.append
    slot = 32 - cache_bits
    (green, m0), (red, m1), (blue, m2), (alpha, m3), (distance, m4) = tables[0]
    a = alpha[0][0]
    while at < n:
        byte = place >> 3
        if byte > last:
            base, last, window = byte, byte + WINDOW_BYTES - 20, _window(bits.data, byte)  # a token takes less than 20 bytes
        if group_of is not None:
            x, y = at % width, at // width
            group = tables[group_of[y >> block, x >> block]]
            (green, m0), (red, m1), (blue, m2), (alpha, m3), (distance, m4) = group
            a = alpha[0][0]
        s, k = green[(window[byte - base] >> (place & 7)) & m0]
        place += k
        if s < 256:
            r, k = red[(window[(place >> 3) - base] >> (place & 7)) & m1]
            place += k
            b, k = blue[(window[(place >> 3) - base] >> (place & 7)) & m2]
            place += k
            if m3:
                a, k = alpha[(window[(place >> 3) - base] >> (place & 7)) & m3]
                place += k
            append((a << 24) | (r << 16) | (s << 8) | b)
            at += 1
        elif s < 280:
            bits.at = place
            many = _extra(s - 256, bits)
            place = bits.at
            s, k = distance[(window[(place >> 3) - base] >> (place & 7)) & m4]
            bits.at = place + k
            far = _extra(s, bits)
            place = bits.at
            if far > 120:
                far -= 120
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + many > n:
                raise ValueError("a reference leaves the image")
            if far >= many:
                out.extend(out[at - far : at - far + many])
            else:
                out.extend((out[at - far :] * (many // far + 1))[:many])
            at += many
        else:
            for v in out[kept:]:
                cache[((CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> slot] = v
            kept = at
            append(cache[s - 280])
            at += 1
        if place > size:
            raise ValueError("the image ends too early")
    bits.at = place
    return np.frombuffer(out, np.uint32).reshape(height, width)


def _channels(image: np.ndarray) -> np.ndarray:
    """(h, w, 4) integers: alpha, red, green, blue."""
    return np.stack([(image >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


def _guess(mode: int, left, top, right_top, left_top):
    """The predicted channels from the pixels around."""
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode == 11:
        p = left + top - left_top
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        a = half(left, top)
        return np.clip(a + np.trunc((a - left_top) / 2).astype(int), 0, 255)
    return {
        1: lambda: left,
        2: lambda: top,
        3: lambda: right_top,
        4: lambda: left_top,
        5: lambda: half(half(left, right_top), top),
        6: lambda: half(left, left_top),
        7: lambda: half(left, top),
        8: lambda: half(left_top, top),
        9: lambda: half(top, right_top),
        10: lambda: half(half(left, left_top), half(top, right_top)),
    }[mode]()


def undo_predictor(image: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    c = _channels(image)
    height, width = image.shape
    kind = (modes >> 8) & 0xF
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0] = np.cumsum(c[0], 0) & 255  # the top row predicts from the left
    for y in range(1, height):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < width:
            mode = int(kind[y >> block, x >> block])
            end = min(width, ((x >> block) + 1) << block)
            if mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], 0)) & 255
            elif mode == 2:
                row[x:end] = (row[x:end] + above[x:end]) & 255
            else:
                for i in range(x, end):
                    ahead = above[i + 1] if i + 1 < width else row[0]
                    row[i] = (row[i] + _guess(mode, row[i - 1], above[i], ahead, above[i - 1])) & 255
            x = end
    return _packed(c)


def undo_cross_colour(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    c = _channels(image)
    height, width = image.shape
    f = _channels(factors)[np.arange(height)[:, None] >> block, np.arange(width)[None, :] >> block]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda t, v: (signed(t) * signed(v)) >> 5
    red = (c[..., 1] + delta(f[..., 3], c[..., 2])) & 255
    blue = (c[..., 3] + delta(f[..., 2], c[..., 2]) + delta(f[..., 1], red)) & 255
    return _packed(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    green = (image >> 8) & 0xFF
    return (image & np.uint32(0xFF00FF00)) | ((((image >> 16) + green) & 0xFF) << 16) | ((image + green) & 0xFF)


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    n = len(palette)
    per_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = (image >> 8) & 0xFF
    if per_bits:
        size = 8 >> per_bits
        x = np.arange(width)
        index = (index[:, x >> per_bits] >> ((x & ((1 << per_bits) - 1)) * size).astype(np.uint32)) & np.uint32((1 << size) - 1)
    table = np.zeros(256, np.uint32)
    table[:n] = palette
    return table[index]


def _opened(data: bytes) -> tuple[Bits, list[tuple], int, int]:
    """A stream at its main image, the transforms before it, and the image's width and height."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    steps, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in [k for k, *_ in steps]:
            raise ValueError("a transform occurs twice")
        if kind < 2:
            block = bits.take(3) + 2
            steps.append((kind, _image(bits, -(-now >> block), -(-height >> block), False), block))
        elif kind == 2:
            steps.append((kind, None, 0))
        else:
            n = bits.take(8) + 1
            table = _packed(np.cumsum(_channels(_image(bits, n, 1, False)[0]), 0) & 255)
            steps.append((kind, table, now))
            per_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            now = -(-now >> per_bits)
    return bits, steps, now, height


def _restored(image: np.ndarray, steps: list[tuple]) -> np.ndarray:
    for kind, data_, more in reversed(steps):
        if kind == 0:
            image = undo_predictor(image, data_, more)
        elif kind == 1:
            image = undo_cross_colour(image, data_, more)
        elif kind == 2:
            image = undo_subtract_green(image)
        else:
            image = undo_palette(image, data_, more)
    return image


def decode_stream(data: bytes) -> np.ndarray:
    """The ARGB pixels of a lossless stream (what a VP8L chunk holds)."""
    bits, steps, width, height = _opened(data)
    return _restored(_image(bits, width, height, True), steps)


def _tables(lengths: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes whose lengths lie in segments: 16 * symbol + size by the next bits, where each code's table starts, and the bits that it looks at."""
    used = np.flatnonzero(lengths)
    of = np.searchsorted(segments, used, "right") - 1
    size = np.where(np.bincount(of, minlength=len(segments))[of] > 1, lengths[used], 0).astype(np.int64)
    width = np.zeros(len(segments), np.int64)
    np.maximum.at(width, of, size)
    share = 1 << (width[of] - size)
    if (np.bincount(of, share, len(segments)) != 1 << width).any():
        raise ValueError("not a complete prefix code")
    order = np.argsort(16 * of + size, kind="stable")
    entry = np.repeat((((used - segments[of]) << 4) | size)[order], share[order])
    base = np.cumsum(1 << width) - (1 << width)
    # The numbers that start with a code follow each other if its first bit is the highest.
    wide, start = np.repeat(width, 1 << width), np.repeat(base, 1 << width)
    table = np.empty(len(entry), np.uint16)  # symbols are of 12 bits
    table[start + (TURNED[np.arange(len(entry)) - start] >> (16 - wide))] = entry
    return table, base, width


# What length and distance symbols stand for: the least value, and how many bits are added to it.
_MORE = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(40)])
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)])
_NEAR_X, _NEAR_Y = np.array(NEAR).T
# The bits of a length or distance with its added ones, by 16 * symbol + size.
_TAKES = (np.arange(16) + _MORE[:, None]).reshape(-1)
_HERE = np.arange(8 * LOOK_BYTES + 64)


class _Plain:
    """A stream at the pixels of its main image, which has one group of codes."""

    def __init__(self, data: bytes):
        self.bits, self.steps, self.width, self.height = _opened(data)
        self.cache_bits = self.bits.take(4) if self.bits.take(1) else 0
        self.plain = not self.bits.take(1) and self.cache_bits < 12
        if self.plain:
            self.lengths = [read_lengths(self.bits, s) for s in _alphabets(self.cache_bits)]
            # A green code of one symbol takes no bits, so a token could take none.
            self.plain = len(self.lengths[0]) - self.lengths[0].count(0) > 1 and not any(k in code for code in self.lengths for k in range(MAX_CODE + 1, 16))


def _places(window: np.ndarray, at: int, end: int, codes: list[np.ndarray], sizes: list[np.ndarray], see_through: bool) -> list[np.ndarray]:
    """Where tokens start between two bits: what a token takes is looked up at every bit, only the chain is followed step by step.

    ``window`` has the 64 bits from every byte on.
    """
    found, colours = [], sizes[3:0:-1] if see_through else sizes[2:0:-1]
    while at < end:
        byte = at >> 3
        some = window[byte : byte + LOOK_BYTES + 8]  # a token takes less than 8 bytes
        words = np.empty((len(some), 8), np.int64)
        for r in range(8):
            np.right_shift(some, r, out=words[:, r])
        words = words.reshape(-1)
        here = _HERE[: len(words)]
        # What red, blue and alpha take if they start here, the last one first.
        step = None
        for size in colours:
            own = size.take(words & (len(size) - 1), mode="clip") if len(size) > 1 else None
            step = own if step is None else step if own is None else own + step.take(here + own, mode="clip")
        e = codes[0].take(words & (len(codes[0]) - 1), mode="clip")
        jump = (e & 15).astype(np.uint8)
        if step is not None:
            jump += step.take(here + jump, mode="clip")
        other = (e >= 256 << 4).nonzero()[0]
        e = e.take(other)
        size = e & 15
        jump[other] = size
        copied = (e < 280 << 4).nonzero()[0]
        other = other.take(copied)
        then = other + _TAKES.take(e.take(copied) - (256 << 4))
        e = codes[4].take(words.take(then, mode="clip") & (len(codes[4]) - 1))
        jump[other] = then - other + _TAKES.take(e)
        chain, jump, p, last = [], jump.tobytes(), at - 8 * byte, min(8 * LOOK_BYTES, end - 8 * byte)
        append = chain.append
        while p < last:
            append(p)
            p += jump[p]
        found.append(np.array(chain, np.int64) + 8 * byte)
        at = 8 * byte + p
    return found


def _decoded(images: list[_Plain]) -> list[np.ndarray]:
    """The main images of streams, all read at once."""
    count = len(images)
    every = [code if any(code) else b"\1" for i in images for code in i.lengths]
    segments = np.cumsum([0, *map(len, every)])[:-1]
    table, base, wide = _tables(np.frombuffer(b"".join(every), np.uint8), segments)
    codes, sizes = np.split(table, base[1:]), np.split((table & 15).astype(np.uint8), base[1:])
    base, mask = base.reshape(-1, 5).T, ((1 << wide) - 1).reshape(-1, 5).T
    see_through = (mask[3] > 0).tolist()
    begin = np.cumsum([0, *(len(i.bits.data) + 8 for i in images)])
    joined = b"".join(part for i in images for part in (i.bits.data, bytes(8)))
    window = np.ndarray(len(joined) - 7, "<i8", joined, strides=(1,)).copy()  # 64 bits from every byte on
    width, total = np.array([i.width for i in images]), np.array([i.width * i.height for i in images])
    ends = 8 * begin[1:] - 64
    found = [_places(window, 8 * b + i.bits.at, e, codes[5 * k : 5 * k + 5], sizes[5 * k : 5 * k + 5], see_through[k]) for k, (i, b, e) in enumerate(zip(images, begin.tolist(), ends.tolist()))]
    image = np.repeat(np.arange(count), [sum(map(len, x)) for x in found])
    place = np.concatenate([np.zeros(0, np.int64), *(x for one in found for x in one)])
    # Up to 12 bits each for green, red, blue and alpha, or 12, 10, 12 and 18 for a reference; 57 are there.
    w = window[place >> 3] >> (place & 7)
    look = lambda k, which, w: table[base[k][which] + (w & mask[k][which])]
    e = look(0, image, w)
    symbol = (e >> 4).astype(np.int16)
    taken = (e & 15).astype(np.int64)
    many = np.ones(len(place), np.int64)
    value = symbol.astype(np.uint32)
    value -= np.uint32(280)
    rest = np.flatnonzero((symbol > 255) & (symbol < 280))
    if len(rest):
        which, s, left = image[rest], symbol[rest] - 256, w[rest] >> taken[rest]
        k = _MORE[s]
        many[rest] = _LEAST[s] + (left & ((1 << k) - 1))
        left >>= k
        e = look(4, which, left)
        s, more = e >> 4, _MORE[e >> 4]
        value[rest] = _LEAST[s] + ((left >> (e & 15)) & ((1 << more) - 1))
        taken[rest] += k + (e & 15) + more
    rest = np.flatnonzero(symbol < 256)
    which, left = image[rest], w[rest] >> taken[rest]
    got = symbol[rest].astype(np.uint32) << np.uint32(8)
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        e = look(k, which, left)
        got |= (e >> 4).astype(np.uint32) << np.uint32(shift)
        left >>= e & 15
        taken[rest] += e & 15
    value[rest] = got
    first = np.cumsum(total) - total
    at = np.cumsum(many) - many
    head = np.searchsorted(image, np.arange(count))
    at -= np.append(at, 0)[head][image]
    inside = at < total[image]  # the bits behind an image may look like tokens
    if not inside.all():
        image, place, symbol, value, many, taken, at = (x[inside] for x in (image, place, symbol, value, many, taken, at))
    tail = np.searchsorted(image, np.arange(count), "right") - 1
    if not len(image) or (tail < np.searchsorted(image, np.arange(count))).any() or ((place + taken)[tail] > ends).any() or ((at + many)[tail] < total).any():
        raise ValueError("the image ends too early")
    copied = (symbol > 255) & (symbol < 280)
    near = np.flatnonzero(copied & (value <= 120))
    value[copied & (value > 120)] -= 120
    value[near] = np.maximum(1, _NEAR_X[value[near] - 1] + _NEAR_Y[value[near] - 1] * width[image[near]])
    if (copied & ((value > at) | (at + many > total[image]))).any():
        raise ValueError("a reference leaves the image")
    cache_bits = np.array([i.cache_bits for i in images])
    pixels, empty = _filled(first[image] + at, symbol, value, many, cache_bits[image], first, total)
    result = [x.reshape(i.height, i.width) for x, i in zip(np.split(pixels, first[1:]), images, strict=True)]
    # A pixel from a slot that nothing was put into is zero, and goes to another slot itself; such images are read token by token.
    for k in np.unique(np.searchsorted(first, empty, "right") - 1).tolist():
        one = images[k]
        tables = [[Code(np.frombuffer(code, np.uint8)).pairs() for code in one.lengths]]
        result[k] = _tokens(one.bits, tables, one.cache_bits, one.width, one.height, array("I"))
    return result


def _filled(where: np.ndarray, symbol: np.ndarray, value: np.ndarray, many: np.ndarray, cache_bits: np.ndarray, first: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of images (where they start, and how many there are) from tokens, and places that read an empty slot of the cache.

    Each pixel has its origin: the literal or the pixel from the cache that it is a copy of. So its slot of the cache is
    known, and what a pixel from the cache is: the last one before it of the same slot.
    """
    n = int(total.sum())
    literal, cached = np.flatnonzero(symbol < 256), np.flatnonzero(symbol > 279)
    origin = array("i", np.arange(n, dtype=np.int32).tobytes())
    rest = np.flatnonzero((symbol > 255) & (symbol < 280))
    for a, v, k in zip(where[rest].tolist(), value[rest].tolist(), many[rest].tolist(), strict=True):
        c = a - v
        if v >= k:
            origin[a : a + k] = origin[c : c + k]
        else:
            origin[a : a + k] = (origin[c:a] * (k // v + 1))[:k]
    origin = np.frombuffer(origin, np.int32)
    pixels = np.zeros(n, np.uint32)
    pixels[where[literal]] = value[literal]
    if not len(cached):
        return pixels[origin], cached
    slot = np.zeros(n, np.uint16)
    slot[where[literal]] = (value[literal] * np.uint32(CACHE_MULTIPLIER)) >> np.minimum(32 - cache_bits[literal], 31).astype(np.uint32)
    slot[where[cached]] = value[cached]
    slot = slot[origin]
    own = np.zeros(n, bool)
    own[where[cached]] = True
    order = np.concatenate([(a + np.argsort(slot[a : a + k], kind="stable")).astype(np.int32) for a, k in zip(first.tolist(), total.tolist(), strict=True)])
    # The last pixel of a slot before each that isn't from the cache itself, which has the same value; below zero, there is none.
    slot = slot[order]
    start = np.append(True, slot[1:] != slot[:-1])
    start[first] = True
    here = np.where(own[order] & ~start, 0, np.arange(n, dtype=np.int32))
    last = np.maximum.accumulate(here)
    link = np.empty(n, np.int32)
    link[order] = np.where(own[order[last]], -1, origin[order[last]])
    todo = where[cached]
    to = link[todo]
    while True:
        more = np.flatnonzero((to >= 0) & own[to])
        if not len(more):
            break
        to[more] = link[to[more]]
    pixels[todo] = np.where(to >= 0, pixels[to], 0)
    return pixels[origin], todo[to < 0]


def _area(data: bytes) -> int:
    """The pixels of a stream, by its head."""
    head = int.from_bytes(data[1:5], "little")
    return ((head & 0x3FFF) + 1) * ((head >> 14 & 0x3FFF) + 1)


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """The ARGB pixels of each lossless stream."""
    out = [None] * len(streams)
    for group in together([max(len(s), _area(s)) for s in streams], STREAM_BYTES):
        images = {k: _Plain(streams[k]) for k in group}
        plain = [k for k, i in images.items() if i.plain]
        for k, image in zip(plain, _decoded([images[k] for k in plain]) if plain else [], strict=True):
            out[k] = _restored(image, images[k].steps)
        for k in group:
            if out[k] is None:
                out[k] = decode_stream(streams[k])
    return out


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def files_in(data: bytes) -> list[bytes]:
    """The lossless streams of one or more WebP files written one after another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size, n = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
        out.append(data[at + 20 : at + 20 + n])
        at += 8 + size
    return out


def _depths(weights: list[int], most: int) -> list[int]:
    """Depths of the leaves of Huffman's tree for ascending weights, ``most`` at most.

    Leaves and inner nodes are two queues. If a leaf is too deep, rare symbols are counted as more frequent.
    """
    n, total, floor = len(weights), sum(weights), 0
    if n < 2:
        return [1] * n
    while True:
        queue, parent, leaf, node, nodes = [*weights, *[0] * (n - 1)], [0] * (2 * n - 1), 0, n, n
        while nodes < 2 * n - 1:
            weight = 0
            for _ in (0, 1):
                if leaf < n and (node >= nodes or queue[leaf] <= queue[node]):
                    one, leaf = leaf, leaf + 1
                else:
                    one, node = node, node + 1
                weight += queue[one]
                parent[one] = nodes
            queue[nodes] = weight
            nodes += 1
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if depth[0] <= most:
            return depth[:n]
        floor = max(2 * floor, -(-total >> most))
        weights = [w if w > floor else floor for w in weights]


def code_lengths(counts: np.ndarray, segments: np.ndarray | None = None, most: int = MAX_CODE) -> np.ndarray:
    """Lengths of a prefix code for the counted symbols of each segment (where it starts), ``most`` bits at most."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    segments = np.zeros(1, np.int64) if segments is None else segments
    order = used[np.lexsort((counts[used], np.searchsorted(segments, used, "right")))]
    ends = np.searchsorted(used, segments).tolist() + [len(used)]
    weights, depths = counts[order].tolist(), []
    for a, b in zip(ends, ends[1:]):
        depths += _depths(weights[a:b], most)
    out[order] = depths
    return out


# The encoder's code for code lengths: 13 symbols of four bits and six of five; together they are complete.
_INNER = np.array([4] * 13 + [5] * 6, np.uint8)
_INNER_CODES = canonical(_INNER)
# What comes before the code lengths of a code that isn't simple, 63 bits: all lengths of the inner code, no limit of symbols.
_HEAD = 15 << 1 | sum(int(_INNER[s]) << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER))


def _code_fields(lengths: np.ndarray, segments: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """How codes are written whose lengths lie in segments: head and its size of each, then value, size and segment of the fields that follow the heads, in order.

    Runs of zeros are pieces of 138 at most; a segment ends at its ``ends``, what lies behind is not written.
    """
    n = len(segments)
    i = np.arange(len(lengths))
    of = np.repeat(np.arange(n), np.diff(segments, append=len(lengths)))
    count = np.add.reduceat(lengths > 0, segments, dtype=np.int64)
    last = np.maximum.reduceat(np.where(lengths > 0, i, 0), segments) - segments
    simple = (count == 0) | ((count == 1) & (last < 256))
    head = np.where(simple, np.where(count > 0, 5 | np.maximum(last, 0) << 3, 5), _HEAD)
    zero = lengths == 0
    fresh = zero.copy()
    fresh[1:] &= ~zero[:-1]
    fresh[segments] = zero[segments]
    run = i - np.maximum.accumulate(np.where(fresh, i, 0))
    field = np.flatnonzero(~(zero & (run % 138 > 0)) & (i < ends[of]) & ~simple[of])
    if not len(field):
        return head, np.where(simple, 11, 63), field, field, field
    seg = of[field]
    until = np.append(field[1:], 0)
    edge = np.append(seg[1:] != seg[:-1], True)
    until[edge] = ends[seg[edge]]
    many = np.where(zero[field], until - field, 1)
    code = np.where(zero[field] & (many >= 3), np.where(many >= 11, 18, 17), lengths[field])
    value = _INNER_CODES[code] | np.where(code < 17, 0, (many - np.where(code == 18, 11, 3)) << 5)
    size = np.where(code < 17, _INNER[code], np.where(code == 18, 12, 8))
    times = np.where((code == 0) & (many == 2), 2, 1)
    return head, np.where(simple, 11, 63), np.repeat(value, times), np.repeat(size, times), np.repeat(seg, times)


def _put_code(out: BitWriter, lengths: np.ndarray) -> None:
    head, head_size, value, size, _ = _code_fields(np.asarray(lengths), np.zeros(1, np.int64), np.array([len(lengths)]))
    for v, k in [(head[0], head_size[0]), *zip(value, size, strict=True)]:
        out.put(int(v), int(k))


def put_fields(words: np.ndarray, at: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
    """Add values to 64-bit words, each at its bit; the bits are ascending and what they meet is zero."""
    some = np.flatnonzero(sizes)
    if not len(some):
        return
    at, values, sizes = at[some], values[some].astype(np.uint64), sizes[some]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    head = np.ones(len(word), bool)
    head[1:] = word[1:] != word[:-1]
    words[word[head]] |= np.bitwise_or.reduceat(values << shift, np.flatnonzero(head))
    over = np.flatnonzero((at & 63) + sizes > 64)
    words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])


def _with_extra(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many of them) that stand for lengths or distance codes from 1 on."""
    x = v.astype(np.int64) - 1
    top = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    n = np.maximum(top - 1, 0)
    return np.where(x < 4, x, 2 * top + ((x >> n) & 1)), np.where(x < 4, 0, x & ((1 << n) - 1)), np.where(x < 4, 0, n)


def references(p: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of matches, first come: each with the nearest earlier place that starts with the same pixels.

    ``first`` says where images start; matches stay within one.
    """
    first = np.zeros(1, np.int64) if first is None else first
    n = len(p)
    ends = np.append(first[1:], n)
    of = np.repeat(np.arange(len(first)), ends - first)
    # 24 bits tell the pixels apart: their colours if alpha is the same, else their numbers.
    number = (p & np.uint32(0xFFFFFF) if (p >> 24 == p[0] >> 24).all() else np.unique(p, return_inverse=True)[1]).astype(np.uint64)
    before = np.full(n, -1, np.int64)
    if n <= CHUNK:
        # A place has 16 bits: numbers that hold it behind the pair are sorted faster than places are by pairs.
        key = np.sort((number[:-1] << np.uint64(40)) | (number[1:] << np.uint64(16)) | np.arange(n - 1, dtype=np.uint64))
        pair, order = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int64)
        again = np.flatnonzero(pair[1:] == pair[:-1])
        here, there = order[again + 1], order[again]
        same = there >= first[of[here]]
        before[here[same]] = there[same]
    else:
        key = (of[:-1].astype(np.uint64) << np.uint64(48)) | (number[:-1] << np.uint64(24)) | number[1:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = np.flatnonzero(key[1:] == key[:-1])
        before[order[again + 1]] = order[again]
    before[ends - 1] = -1  # no pair starts with an image's last pixel
    starts = np.flatnonzero((before >= 0) & (np.arange(n) - before <= FARTHEST))
    found, values, at = [], p.tolist(), 0
    for i, far, end in zip(starts.tolist(), (starts - before[starts]).tolist(), np.minimum(ends[of[starts]], starts + MOST_MATCH).tolist(), strict=True):
        if i >= at:
            at = i + LEAST_MATCH
            while at < end and values[at] == values[at - far]:
                at += 1
            found.append((i, at - i, far))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _cached(p: np.ndarray, bits: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's slot of its image's colour cache, and whether it holds this pixel already."""
    slot = (p * np.uint32(CACHE_MULTIPLIER)) >> (32 - bits).astype(np.uint32)
    key = (of << 11) | slot
    if len(p) <= CHUNK:
        key = np.sort((key << 16) | np.arange(len(p)))
        key, order = key >> 16, key & 0xFFFF
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    hit = np.zeros(len(p), bool)
    sorted_ = p[order]
    hit[order[1:]] = (key[1:] == key[:-1]) & (sorted_[1:] == sorted_[:-1])
    return slot.astype(np.int64), hit


# Where the five codes of an image lie in a row of counts; the first has room for the largest cache.
_PLACES = np.array([0, 280 + 1024, 280 + 1024 + 256, 280 + 1024 + 512, 280 + 1024 + 768])
_ROW = int(_PLACES[-1]) + 40


def _image_bits(images: list[np.ndarray], main: bool, openings: list[BitWriter]) -> list[tuple[bytes, int]]:
    """Entropy-coded images, each behind its opening: references, colours from the cache and literals. Bytes and number of bits."""
    p = np.concatenate([i.reshape(-1) for i in images])
    sizes = np.array([i.size for i in images])
    count, n, first = len(images), len(p), np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(count), sizes)
    place, many, far = references(p, first)
    cover = np.zeros(n + 1, np.int64)
    cover[place] += 1
    np.subtract.at(cover, place + many, 1)
    single = np.cumsum(cover[:-1]) == 0
    cache_bits = np.clip(np.frexp(sizes.astype(np.float64))[1] - 3, 1, 10).astype(np.int64)
    slot, hit = _cached(p, cache_bits[of], of)
    hit &= single
    cache_bits[np.bincount(of[hit], minlength=count) == 0] = 0
    length, length_more, length_bits = _with_extra(many)
    reach, reach_more, reach_bits = _with_extra(far + 120)
    symbol = ((p >> 8) & 0xFF).astype(np.int64)
    symbol[hit] = 280 + slot[hit]
    symbol[place] = 256 + length
    literal, token = np.flatnonzero(single & ~hit), single.copy()
    token[place] = True
    token = np.flatnonzero(token)
    base = of * _ROW
    # Where each pixel's symbols lie in the rows of counts.
    at = [base[token] + symbol[token], *(base[literal] + int(_PLACES[1 + i]) + ((p[literal] >> s) & 0xFF) for i, s in enumerate((16, 0, 24))), base[place] + int(_PLACES[4]) + reach]
    counts = sum(np.bincount(a, minlength=count * _ROW) for a in at)
    segments = (np.arange(count)[:, None] * _ROW + _PLACES).reshape(-1)
    ends = segments + np.stack([280 + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(count, k) for k in (256, 256, 256, 40)]], 1).reshape(-1)
    lengths = code_lengths(counts, segments)
    head, head_size, value, size, seg = _code_fields(lengths, segments, ends)
    codes = canonical(lengths, segments)
    # A code of one symbol takes no bits.
    alone = np.add.reduceat(lengths > 0, segments, dtype=np.int64) < 2
    lengths = np.where(np.repeat(alone, np.diff(segments, append=len(lengths))), 0, lengths).astype(np.int64)
    # Up to four fields of each token, one behind the other: 52 bits at most.
    values, widths = codes[at[0]], lengths[at[0]]
    number = np.zeros(n, np.int64)
    number[token] = np.arange(len(token))
    for where, fields in ((literal, [(codes[a], lengths[a]) for a in at[1:4]]), (place, [(length_more, length_bits), (codes[at[4]], lengths[at[4]]), (reach_more, reach_bits)])):
        where = number[where]
        value_, width_ = values[where], widths[where]
        for more, k in fields:
            value_ |= more << width_
            width_ += k
        values[where], widths[where] = value_, width_
    # Bits of each part: the opening with cache and group flags, five codes, pixels.
    for opening, bits in zip(openings, cache_bits.tolist(), strict=True):
        opening.put(1 | bits << 1 if bits else 0, 5 if bits else 1)
        if main:
            opening.put(0, 1)  # one group of codes
    opened = np.array([o.n for o in openings], np.int64)
    code_bits = head_size + np.bincount(seg, size, 5 * count).astype(np.int64)
    head_of = np.searchsorted(token, first)  # an image's first pixel starts a token
    pixel_bits = np.add.reduceat(widths, head_of)
    total = opened + code_bits.reshape(-1, 5).sum(1) + pixel_bits
    room = (total >> 6) + 2
    start = 64 * (np.cumsum(room) - room)
    words = np.zeros(int(room.sum()), np.uint64)
    code_at = (start + opened)[:, None] + np.cumsum(code_bits.reshape(-1, 5), 1) - code_bits.reshape(-1, 5)
    code_at = code_at.reshape(-1)
    put_fields(words, code_at, head, head_size)
    within = np.cumsum(size) - size
    before = np.cumsum(code_bits - head_size) - (code_bits - head_size)
    put_fields(words, code_at[seg] + head_size[seg] + within - before[seg], value, size)
    within = np.cumsum(widths) - widths
    pixels_at = start + total - pixel_bits - within[head_of]
    put_fields(words, pixels_at[of[token]] + within, values, widths)
    out = []
    for opening, a, k, bits in zip(openings, (start >> 6).tolist(), room.tolist(), total.tolist(), strict=True):
        width = -(-opening.n // 64)
        words[a : a + width] |= np.frombuffer(opening.value.to_bytes(8 * width, "little"), np.uint64)
        out.append((words[a : a + k].tobytes()[: -(-bits // 8)], bits))
    return out


def _put_pixels(out: BitWriter, p: np.ndarray, main: bool) -> None:
    """An entropy-coded image behind what is there."""
    data, n = _image_bits([p], main, [BitWriter()])[0]
    out.put(int.from_bytes(data, "little"), n)


def _bytes(image: np.ndarray) -> np.ndarray:
    """(h, w, 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(image, "<u4").view(np.uint8).reshape(*image.shape, 4)


_COUNTED = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def _counted(found: np.ndarray) -> np.ndarray:
    """Each count times its logarithm."""
    return _COUNTED.take(found) if found.max() < len(_COUNTED) else found * np.log2(np.maximum(found, 1))


def _entropy(image: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """The bits that the channels of each image take by themselves, without references; ``of`` names each row's image."""
    size = np.bincount(of, minlength=count) * image.shape[1]
    out, base, bytes_ = np.zeros(count), (256 * of)[:, None], _bytes(image)
    for k in (3, 2, 1, 0) if image.min() >> 24 != 255 else (2, 1, 0):
        found = np.bincount((base + bytes_[..., k]).reshape(-1), minlength=256 * count).reshape(count, 256)
        out += size * np.log2(size) - _counted(found).sum(1)
    return out


def _block_rows(first: np.ndarray, height: int, block: int) -> np.ndarray:
    """Where rows of blocks start in images that stand one above the other."""
    return np.concatenate([np.arange(a, b, 1 << block) for a, b in zip(first, np.append(first[1:], height), strict=True)])


def _grid(image: np.ndarray, rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each pixel's block."""
    height, width = image.shape
    return np.repeat(np.arange(len(rows)), np.diff(rows, append=height))[:, None], np.arange(width)[None, :] >> block


def _block_sums(x: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    return np.add.reduceat(np.add.reduceat(x, rows, 0), np.arange(0, x.shape[1], 1 << block), 1)


def predicted(image: np.ndarray, first: np.ndarray, rows: np.ndarray, block: int = BLOCK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """What is left after predicting each block from the left or from above, whichever leaves less, and the modes."""
    c = _bytes(image)
    height, width = image.shape
    left, top = c.copy(), c.copy()
    left[:, 1:] -= c[:, :-1]
    top[1:] -= c[:-1]
    top[first] = c[first]
    # A byte is as far from zero as it or its negative; the columns of a block are summed first.
    columns = np.arange(0, 4 * width, 4 << block)
    cost = [np.add.reduceat(np.add.reduceat(np.minimum(r, -r).reshape(height, -1), columns, 1, np.int32), rows, 0) for r in (left, top)]
    mode = np.where(cost[0] <= cost[1], 1, 2)
    left, top = left.view("<u4")[..., 0], top.view("<u4")[..., 0]
    out = np.where(mode[_grid(image, rows, block)] == 1, left, top)
    # The edges predict in one way only.
    out[:, 0] = top[:, 0]
    out[first] = left[first]
    out[first, 0] = _packed((_channels(image[first, 0]) - [255, 0, 0, 0]) & 255)
    return out, np.uint32(0xFF000000) | (mode.astype(np.uint32) << 8)


def decorrelated(image: np.ndarray, rows: np.ndarray, block: int = BLOCK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """What is left of red and blue after taking green's share out, and the factors by block."""
    c = _channels(image)
    signed = (c ^ 128) - 128
    green = signed[..., 2]
    weight = np.maximum(_block_sums(green * green, rows, block), 1)
    to_red, to_blue = (np.clip(np.rint(32 * _block_sums(green * signed[..., k], rows, block) / weight), -128, 127).astype(np.int32) for k in (1, 3))
    where = _grid(image, rows, block)
    out = c.copy()
    for k, t in ((1, to_red), (3, to_blue)):
        out[..., k] = (c[..., k] - ((t[where] * green) >> 5)) & 255
    full = np.full(to_red.shape, 255)
    return _packed(out), _packed(np.stack([full, np.zeros_like(full), to_blue & 255, to_red & 255], -1))


def indexed(image: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray] | None:
    """Palette numbers in place of the pixels, several in one where they are few, and the palette, unless that takes more bits than ``most``."""
    colours, count = np.unique(image, return_counts=True)
    if len(colours) > 256 or (len(colours) > 16 and 24 * len(colours) + image.size * np.log2(image.size) - (count * np.log2(count)).sum() > most):
        return None
    palette, index = np.unique(image, return_inverse=True)
    n, index = len(palette), index.reshape(image.shape).astype(np.uint32)
    per_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    if per_bits:
        per, size = 1 << per_bits, 8 >> per_bits
        wide = np.zeros((image.shape[0], -(-image.shape[1] >> per_bits) * per), np.uint32)
        wide[:, : image.shape[1]] = index
        index = np.bitwise_or.reduce(wide.reshape(len(wide), -1, per) << (np.arange(per, dtype=np.uint32) * np.uint32(size)), axis=2)
    return np.uint32(0xFF000000) | (index << 8), palette


def _colours(image: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """How many colours each image has; ``of`` names each row's image."""
    key = np.sort(((of.astype(np.uint64) << np.uint64(32))[:, None] | image).reshape(-1))
    return np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(32)).astype(np.int64), minlength=count)


def without_green(image: np.ndarray) -> np.ndarray:
    green = (image >> 8) & 0xFF
    return (image & np.uint32(0xFF00FF00)) | ((((image >> 16) - green) & 0xFF) << 16) | ((image - green) & 0xFF)


def _encoded(images: list[np.ndarray]) -> list[bytes]:
    """WebP files of images of one width: transforms are chosen for all that stand one above the other, then pixels are written."""
    heights = [len(i) for i in images]
    image, first = np.concatenate(images), np.cumsum(heights) - heights
    count, width = len(images), image.shape[1]
    of = np.repeat(np.arange(count), heights)
    rows = _block_rows(first, len(image), BLOCK_BITS)
    blocks = np.searchsorted(rows, np.append(first, len(image)))  # each image's rows of blocks
    area = np.diff(blocks) * -(-width >> BLOCK_BITS)
    rest, modes = predicted(image, first, rows)
    left, plain = _entropy(rest, of, count), _entropy(image, of, count)
    guessed = left + 8 * area < plain
    rest = np.where(guessed[of][:, None], rest, image)
    crossed, factors = decorrelated(rest, rows)
    flat = without_green(rest)
    costs = np.stack([np.where(guessed, left, plain), _entropy(crossed, of, count) + 16 * area, _entropy(flat, of, count)])
    see_through = np.logical_or.reduceat((image >> 24 != 255).any(1), first)
    best, least = costs.argmin(0).tolist(), costs.min(0).tolist()
    few = _colours(image, of, count) <= 256
    out, mains, steps = [], [], []
    for k, (one, a, height) in enumerate(zip(images, first.tolist(), heights, strict=True)):
        bits = BitWriter()
        for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(see_through[k]), 1), (0, 3)):
            bits.put(value, n)
        numbers = indexed(one, least[k]) if few[k] else None
        if numbers is not None and _entropy(numbers[0], np.zeros(height, np.int64), 1)[0] + 24 * len(numbers[1]) <= least[k]:
            main, palette = numbers
            step = _channels(palette)
            step[1:] -= step[:-1].copy()
            steps.append([(1 | 3 << 1 | (len(palette) - 1) << 3, 11, _packed(step & 255)[None])])
        else:
            above = slice(blocks[k], blocks[k + 1])
            steps.append([(1 | kind << 1 | (BLOCK_BITS - 2) << 3, 6, data[above]) for kind, data, use in ((0, modes, guessed[k]), (1, factors, best[k] == 1)) if use])
            if best[k] == 2:
                steps[-1].append((1 | 2 << 1, 3, None))
            main = (rest, crossed, flat)[best[k]][a : a + height]
        out.append(bits)
        mains.append(main)
    # The images that transforms need are written together, too.
    small = [x for some in steps for *_, x in some if x is not None]
    written = iter(_image_bits(small, False, [BitWriter() for _ in small]) if small else [])
    for bits, some in zip(out, steps, strict=True):
        for value, n, x in some:
            bits.put(value, n)
            if x is not None:
                data, n = next(written)
                bits.put(int.from_bytes(data, "little"), n)
        bits.put(0, 1)
    return [container(data) for data, _ in _image_bits(mains, True, out)]


def together(sizes: list[int], most: int) -> list[list[int]]:
    """Which of some sizes are taken together: of like size, and ``most`` in all, or one that is larger."""
    out, total = [], most
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        if total + sizes[i] > most or len(out[-1]) >= 1 << 12:
            out.append([])
            total = 0
        out[-1].append(i)
        total += sizes[i]
    return out


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """A WebP file for each image of ARGB pixels (h, w)."""
    out = [b""] * len(images)
    for width in {i.shape[1] for i in images}:
        these = [k for k, i in enumerate(images) if i.shape[1] == width]
        for group in together([images[k].size for k in these], CHUNK):
            group = [these[g] for g in group]
            for k, data in zip(group, _encoded([images[k].astype(np.uint32, copy=False) for k in group]), strict=True):
                out[k] = data
    return out


def encode(image: np.ndarray) -> bytes:
    """A WebP file of ARGB pixels (h, w)."""
    return encode_all([image])[0]
