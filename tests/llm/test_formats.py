import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliplane.llm import chat, media, mixing, packing, webp
from cliplane.llm.queries import vocabulary


def test_packing_holds_every_token_once(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()["vocabulary"])
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    pieces = packing.pack(docs, **vocabulary()).collect()
    cut = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        cut[p.doc_id].append(p)
    got = Counter()
    for doc_id, own in cut.items():
        copies = defaultdict(list)
        for p in own:
            copies[p.start].append(p)
        # Rows that repeat an id have pieces of their own; put them together by where pieces end.
        for first in copies.pop(0):
            parts, at = [first.ids], first.length
            while at < first.doc_tokens:
                nxt = next(p for p in copies[at] if p.doc_tokens == first.doc_tokens)
                copies[at].remove(nxt)
                parts.append(nxt.ids)
                at += nxt.length
            got[(doc_id, b"".join(parts))] += 1
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
        assert sum(p.length for p in s) <= 1024
    sums = {(r.doc_id, r.start, r.sequence_id): r.ids_crc32 for r in packing.digests(packing.pack(docs, **vocabulary())).collect()}
    assert sums == {(p.doc_id, p.start, p.sequence_id): zlib.crc32(p.ids) for p in pieces}
    assert packing.pack(nothing, **vocabulary()).count() == 0


def test_fast_ids_are_the_tokenizers_ids():
    enc = packing.Encoder(**vocabulary())
    texts = ["", "Hello  world\n\n x", "It's 1234 déjà vu — “quoted”… 10€", "<|endoftext|> and 日本語 🎵", "a" * 5000, " \t\r\n z", "naïve ÀÉß ſ"]
    for t in texts:
        assert enc.ids(t).tolist() == [*enc.slow.encode(t, add_special_tokens=False).ids, 0]


def test_padding_is_small():
    out = []
    bins = packing.Bins(1024, 0, out.append)
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4000, 3000)
    for i, n in enumerate(lengths.tolist()):
        bins.add(i, np.arange(n, dtype="<u4"))
    bins.finish()
    used = Counter()
    for p in out:
        used[p[5]] += p[2]
    padding = sum(1024 - n for n in used.values())
    assert sum(used.values()) == lengths.sum() and padding < 0.002 * lengths.sum()


def test_mixing_follows_weights(spark, docs, nothing):
    many = spark.range(20000).selectExpr("id as doc_id", "case when id % 20 = 0 then 'a' else 'b' end as source", "'t' as text")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    rows = mixing.mix(many, weights=weights).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in rows}
    assert abs(got["a"] - 10000) < 600 and abs(got["b"] - 10000) < 600
    out = mixing.mix(docs).collect()
    assert mixing.mix(nothing).count() == 0
    copies = Counter((r.doc_id, r.text) for r in out)
    assert all(r.n_copies >= r.copy >= 1 for r in out)
    assert all(copies[(r.doc_id, r.text)] == r.n_copies for r in out if r.doc_id not in (3, None))
    # Rows without an id and rows that share one are drawn apart.
    for same in (None, 7):
        one = spark.range(2000).selectExpr(f"cast({'null' if same is None else same} as long) as doc_id", "'a' as source", "concat('t', id) as text")
        drawn = mixing.mix(one, size=0.5)
        assert 850 < drawn.count() < 1150 and drawn.select("shuffle_key").distinct().count() > 500
    keep_all = mixing.mix(many, weights=weights.limit(1)).select("source").distinct().collect()
    assert [r.source for r in keep_all] == ["a"]


def test_draws_do_not_depend_on_partitions(spark, docs):
    rows = [(i if i % 3 else None, f"t{i % 40}", f"s{i % 4}", i % 5) for i in range(600)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    drawn = [Counter(tuple(r) for r in mixing.mix(many.repartition(n)).collect()) for n in (3, 7)]
    assert drawn[0] == drawn[1] and any(r[0] is None for r in drawn[0])
    # Equal rows without an id are numbered over more than one block and draw apart.
    equal = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'t' as text", "'a' as source")
    got = mixing.mix(equal, size=0.5)
    assert 4700 < got.count() < 5300 and got.select("shuffle_key").distinct().count() > 4500


def test_odd_parts_have_a_place(spark):
    kinds = [("audio", float("nan")), ("audio", float("inf")), ("audio", -3.0), ("audio", None), ("audio", 1e300), ("audio", 2.5), ("video", 9.0), (None, None)]
    parts = [None, *((k, None, "r", None, None, s, None) for k, s in kinds), ("text", "<|other|> a", None, None, None, None, None), None]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [None])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {(r.conv_id, r.turn): r for r in chat.format_turns(turns).collect()}
    assert [(a.kind, a.tokens) for a in got[1, 0].attachments] == [*[("audio", 1)] * 5, ("audio", 63), ("other", 1), ("other", 1)]
    assert got[1, 0].formatted == "<|im_start|>user\n" + "<|audio|>" * 6 + "<|other|>" * 2 + "<\\|other|> a<|im_end|>\n"
    for a in got[1, 0].attachments:
        assert got[1, 0].formatted[a.at :].startswith(f"<|{a.kind}|>")
    assert got[1, 1].n_tokens_expanded == got[2, 0].n_tokens_expanded == 0


def test_poisson_table(spark):
    table = spark.createDataFrame([(str(x), x) for x in (0.0, 0.3, 5.0, 900.0)], "key string, rate double")
    for rate, cdf in mixing.distributions(table).select("rate", "cdf").collect():
        want, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
            want.append(total)
        assert np.allclose(cdf, want, atol=1e-9) and cdf[-1] > 1 - 1e-9


def test_media_round_trip(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    stored = media.store(docs)
    got = media.digests(media.read(stored)).collect()
    want = Counter()
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert {hashlib.sha256(r.media).hexdigest() for r in stored.collect()} == {r.media_sha256 for r in got}
    assert media.read(media.store(nothing)).count() == 0


class Writer(webp.BitWriter):
    """Writes streams with every feature, for the decoder to read."""

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def flat(self, alphabet, bits, most=None):
        """A code of 2**bits symbols of one length."""
        lengths = np.zeros(alphabet, np.uint8)
        lengths[: 1 << bits] = bits
        webp._put_code(self, lengths)
        return webp.canonical(lengths), bits

    def start(self, w, h):
        self.put(0x2F, 8)
        self.put(w - 1, 14)
        self.put(h - 1, 14)
        self.put(1, 1)
        self.put(0, 3)

    def image(self, argb, main=True, cache_bits=0):
        """Literal pixels with full eight-bit codes."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        green = self.flat(280 + (1 << cache_bits if cache_bits else 0), 8)
        other = [self.flat(256, 8) for _ in range(3)]
        self.simple(0)
        for p in argb.reshape(-1).tolist():
            for (codes, n), value in zip([green, *other], ((p >> 8) & 255, (p >> 16) & 255, p & 255, p >> 24), strict=True):
                self.put(int(codes[value]), n)

    def done(self):
        return self.value.to_bytes(-(-self.n // 8), "little")


def shifted(image, change):
    return webp._packed((webp._channels(image) + change) & 255)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng = np.random.default_rng(mode)
    h, w = 9, 11
    image = rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
    c = webp._channels(image)
    rest = np.zeros_like(c)
    for y in range(h):
        for x in range(w):
            if y == 0 and x == 0:
                guess = np.array([255, 0, 0, 0])
            elif y == 0:
                guess = c[0, x - 1]
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                guess = webp._guess(mode, c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < w else c[y, 0], c[y - 1, x - 1])
            rest[y, x] = (c[y, x] - guess) & 255
    out = Writer()
    out.start(w, h)
    out.put(1, 1)
    out.put(0, 2)
    out.put(0, 3)
    out.image(np.full((-(-h // 4), -(-w // 4)), mode << 8, np.uint32), main=False)
    out.put(0, 1)
    out.image(webp._packed(rest))
    assert (webp.decode_stream(out.done()) == image).all()


def test_cross_colour_subtract_green_and_palette():
    rng = np.random.default_rng(20)
    image = rng.integers(0, 1 << 32, (8, 8), dtype=np.uint64).astype(np.uint32)
    c = webp._channels(image)
    factors = np.array([[0xFF2010F0, 0xFF80A005], [0xFF0000FF, 0xFF7F7F7F]], np.uint32)
    signed = lambda v: ((v & 255) ^ 128) - 128
    f = webp._channels(factors)[np.arange(8)[:, None] >> 2, np.arange(8)[None, :] >> 2]
    stored = c.copy()
    stored[..., 3] = (c[..., 3] - ((signed(f[..., 2]) * signed(c[..., 2])) >> 5) - ((signed(f[..., 1]) * signed(c[..., 1])) >> 5)) & 255
    stored[..., 1] = (c[..., 1] - ((signed(f[..., 3]) * signed(c[..., 2])) >> 5)) & 255
    stored[..., 1] = (stored[..., 1] - stored[..., 2]) & 255
    stored[..., 3] = (stored[..., 3] - stored[..., 2]) & 255
    out = Writer()
    out.start(8, 8)
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    out.image(factors, main=False)
    out.put(1, 1)
    out.put(2, 2)
    out.put(0, 1)
    out.image(webp._packed(stored))
    assert (webp.decode_stream(out.done()) == image).all()
    for n, per in ((2, 8), (4, 4), (16, 2), (40, 1)):
        palette = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        index = rng.integers(0, n, (5, 13))
        wide = -(-13 // per)
        packed = np.zeros((5, wide), np.uint32)
        for x in range(13):
            packed[:, x // per] |= (index[:, x] << ((x % per) * (8 // per))).astype(np.uint32)
        step = webp._channels(palette)
        step[1:] = (step[1:] - step[:-1]) & 255
        out = Writer()
        out.start(13, 5)
        out.put(1, 1)
        out.put(3, 2)
        out.put(n - 1, 8)
        out.image(webp._packed(step)[None], main=False)
        out.put(0, 1)
        out.image(packed << np.uint32(8))
        assert (webp.decode_stream(out.done()) == palette[index]).all()


def test_references_and_cache():
    """Pixels as literals, one from the cache, and copies of near and far ones."""
    out = Writer()
    out.start(8, 4)
    out.put(0, 1)
    out.put(1, 1)
    out.put(4, 4)
    out.put(0, 1)
    green, n = out.flat(280 + 16, 8)
    lengths = np.zeros(296, np.uint8)
    del green, n
    out = Writer()
    out.start(8, 4)
    out.put(0, 1)
    out.put(1, 1)
    out.put(4, 4)
    out.put(0, 1)
    pixel = 0xFF000000 | (7 << 8)
    slot = ((webp.CACHE_MULTIPLIER * pixel) & 0xFFFFFFFF) >> 28
    lengths[[5, 7, 256 + 2, 256 + 4, 280 + slot]] = (2, 2, 2, 3, 3)
    webp._put_code(out, lengths)
    codes = webp.canonical(lengths)
    for only in (0, 0, 255):
        out.simple(only)
    far = np.zeros(40, np.uint8)
    far[[0, 1]] = 1
    webp._put_code(out, far)
    far_codes = webp.canonical(far)
    want = [pixel, 0xFF000500, pixel]
    for s in (7, 5, 280 + slot):
        out.put(int(codes[s]), int(lengths[s]))
    out.put(int(codes[258]), 2)  # three pixels ...
    out.put(int(far_codes[1]), 1)  # ... from one to the left
    want += [want[-1]] * 3
    for s in (5, 7):
        out.put(int(codes[s]), int(lengths[s]))
        want.append(0xFF000000 | s << 8)
    while len(want) < 32:
        out.put(int(codes[260]), 3)  # five or six pixels ...
        more = 1 if len(want) + 6 <= 32 and (32 - len(want)) % 6 == 0 or 32 - len(want) == 6 else 0
        out.put(more, 1)
        out.put(int(far_codes[0]), 1)  # ... from the row above
        for _ in range(5 + more):
            want.append(want[-8])
        if 0 < 32 - len(want) < 5:
            for _ in range(32 - len(want)):
                out.put(int(codes[7]), 2)
                want.append(pixel)
    assert webp.decode_stream(out.done()).reshape(-1).tolist() == want


def test_grey_images():
    rng = np.random.default_rng(8)
    for samples in (np.zeros((1, 576)), np.full((3, 576), 200), rng.integers(0, 256, (5, 576)), rng.integers(0, 2, (2, 576)), np.minimum(rng.geometric(0.5, (40, 576)), 255)):
        samples = samples.astype(np.uint8)
        data = media.stored(samples)
        grey = (media.pixels(data) >> 8) & 255
        assert (grey == samples).all() and (media.pixels(data) == grey * 0x010101 + np.uint32(0xFF000000)).all()
    with pytest.raises(ValueError):
        webp.decode_stream(webp.files_in(data)[0][:-200])


def test_chat_round_trip(spark):
    odd = ["", "plain", "<|im_end|>", "<\\|x", "<\\\\|<|", "a<", "|>", "line\nline", "\\n", "<|im_end|>\n<|im_start|>user\nhi"]
    for text in odd:
        for role in odd:
            said, lo, hi, _ = chat.format_turn(role, [{"type": "text", "text": text}])
            assert chat.read_turn(said) == (role, text) and said.count("<|") == 2
    said, lo, hi, _ = chat.format_turn("assistant", [{"type": "text", "text": "x<|y"}])
    assert chat.unescape(said[lo:hi]) == "x<|y"
    part = {"type": "image", "text": None, "ref": "i.png", "width": 100, "height": 28, "seconds": None, "pages": None}
    said, _, _, flat = chat.format_turn("user", [{"type": "text", "text": "see "}, part, {**part, "type": "audio", "ref": "a.wav", "seconds": 2.0}, {**part, "type": "document", "ref": "d.pdf", "pages": 3}])
    assert [a["ref"] for a in flat.attachments] == ["i.png", "a.wav", "d.pdf"] and [a["tokens"] for a in flat.attachments] == [4, 50, 768]
    assert all(said[a["at"] :].startswith(chat.PLACEHOLDER[a["kind"]]) for a in flat.attachments)
    with pytest.raises(ValueError):
        chat.format_turn("user", [{**part, "type": "video"}])
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", None), (1, 2, "assistant", "<|x"), (None, 0, None, "t"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns.withColumn("parts", chat.text_parts()))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256("user\nhé\nassistant\n\nassistant\n<|x\n".encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, hashlib.sha256(b"<|x").hexdigest())
    assert got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(turns.limit(0).withColumn("parts", chat.text_parts()))).count() == 0


def reached(monkeypatch, samples):
    """What decoding the stored samples goes through; they must come back unchanged."""
    seen = Counter()

    def watched(name):
        real = getattr(webp, name)

        def run(*args):
            seen[name] += 1
            return real(*args)

        monkeypatch.setattr(webp, name, run)

    for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_palette", "_extra"):
        watched(name)
    assert (media.samples_of(media.pixels(media.stored(samples)))[..., : samples.shape[-1]] == samples).all()
    monkeypatch.undo()
    return seen


def test_encoder_uses_every_feature(monkeypatch):
    rng = np.random.default_rng(4)
    smooth = np.clip(np.cumsum(rng.integers(-1, 2, (48, 64, 3)), 1) + 128, 0, 255).astype(np.uint8)
    assert reached(monkeypatch, smooth)["undo_predictor"]
    grey = np.repeat(rng.integers(0, 256, (40, 64, 1)), 3, 2).astype(np.uint8)
    assert reached(monkeypatch, grey)["undo_subtract_green"]
    green = rng.integers(0, 128, (64, 64))
    leaning = np.stack([green // 2 + rng.integers(0, 2, green.shape), green, green // 4], -1).astype(np.uint8)
    assert reached(monkeypatch, leaning)["undo_cross_colour"]
    for colours in (2, 4, 16, 200):
        few = rng.integers(0, 256, (colours, 3)).astype(np.uint8)[rng.integers(0, colours, (30, 37))]
        assert reached(monkeypatch, few)["undo_palette"]
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(300)]
    text = b" ".join(words[i] for i in np.minimum(rng.zipf(1.3, 2000), 300) - 1)
    assert reached(monkeypatch, media.payload_of(text))["_extra"] > 20
    pixels = np.uint32(0xFF000000) | rng.integers(0, 1 << 24, 600).astype(np.uint32)
    bits = webp.BitWriter()
    webp._put_pixels(bits, pixels[np.minimum(rng.geometric(0.02, 2000), 599)], True)
    assert bits.value & 1  # a colour cache


def test_references_are_matches():
    p = np.random.default_rng(5).integers(0, 6, 3000).astype(np.uint32)
    end = 0
    for place, many, far in zip(*(x.tolist() for x in webp.references(p)), strict=True):
        assert place >= end and far > 0 and all(p[i] == p[i - far] for i in range(place, place + many))
        end = place + many
    for v, (symbol, extra, n) in {int(v): x for v, *x in zip(*(a.tolist() for a in (np.arange(1, 70000), *webp._with_extra(np.arange(1, 70000)))), strict=True)}.items():
        reader = webp.Bits(int(extra).to_bytes(8, "little"))
        assert webp._extra(symbol, reader) == v and reader.at == n


def test_random_images_come_back():
    rng = np.random.default_rng(6)
    for h, w, top in ((1, 1, 256), (1, 2, 256), (2, 1, 3), (17, 33, 256), (5, 192, 2), (3, 192, 40)):
        image = rng.integers(0, top, (h, w, 4)).astype(np.uint8)
        argb = image.view("<u4")[..., 0]
        assert (webp.decode_stream(webp.files_in(webp.encode(argb))[0]) == argb).all()


def test_texts_of_several_files():
    unit = " ".join(f"w{i % 977} {i}" for i in range(3000)).encode()
    payload = media.payload_of(unit * (10_000_000 // len(unit) + 1))
    data = media.stored(payload)
    assert len(webp.files_in(data)) == 2
    assert media.samples_of(media.pixels(data)).tobytes() == payload.tobytes()


def test_images_in_groups_come_back():
    rng = np.random.default_rng(9)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(500)]
    text = lambda n: b" ".join(words[i] for i in np.minimum(rng.zipf(1.3, n), 500) - 1)
    every = [media.payload_of(x) for x in (b"", b"a", *(text(int(n)) for n in rng.integers(1, 900, 60)), text(9000), rng.integers(0, 256, 3000).astype(np.uint8).tobytes())]
    every.append(np.clip(np.cumsum(rng.integers(-1, 2, (48, 64, 3)), 1) + 128, 0, 255).astype(np.uint8))
    stored = media.stored_all(every)
    assert stored == [media.stored(x) for x in every]  # equal texts have equal media, whatever they are stored with
    streams = [webp.files_in(s)[0] for s in stored]
    for x, got in zip(every, webp.decode_all(streams), strict=True):
        assert (media.samples_of(got) == x).all()
    for k, s in enumerate(streams[2:5]):
        with pytest.raises(ValueError):
            webp.decode_all([*streams[: 2 + k], s[: len(s) // 2], *streams[3 + k :]])
    # A slot of the cache that nothing has been put into holds zero, and streams with several groups are read, too.
    writer = Writer()
    writer.start(2, 1)
    writer.put(0, 1)
    writer.put(1 | 4 << 1, 5)
    writer.put(0, 1)
    lengths = np.zeros(280 + 16, np.uint8)
    lengths[[280, 285]] = 1
    webp._put_code(writer, lengths)
    for _ in range(4):
        writer.simple(0)
    writer.put(3, 2)
    assert webp.decode_all([writer.done()])[0].tolist() == [[0, 0]] == webp.decode_stream(writer.done()).tolist()


def odd_stream(rng, w, h, only_filled, cache_bits):
    """A stream of random tokens: literals that see through, copies that overlap or not, and pixels from the cache, empty slots too."""
    out = Writer()
    out.start(w, h)
    out.put(0, 1)
    out.put(1 | cache_bits << 1, 5)
    out.put(0, 1)
    slot_of = lambda v: ((webp.CACHE_MULTIPLIER * v) & 0xFFFFFFFF) >> (32 - cache_bits)
    slots = list(dict.fromkeys([slot_of(g << 8) for g in range(6)] + [(1 << cache_bits) - 1 - k for k in range(12)]))[:8]
    lengths = np.zeros(280 + (1 << cache_bits), np.uint8)
    lengths[[*range(16), *range(256, 264), *(280 + k for k in slots)]] = 5
    webp._put_code(out, lengths)
    green = webp.canonical(lengths)
    red, blue, alpha, far = out.flat(256, 2), out.flat(256, 0 if only_filled else 1), out.flat(256, 1), out.flat(40, 5)
    at, filled = 0, set()
    pixels = []
    while at < w * h:
        kind = rng.choice(["literal", "copy", "cache"])
        if kind == "literal":
            g, r, b, a = (int(rng.integers(0, k)) for k in (16, 4, 1 if only_filled else 2, 2))
            for value, n in ((green[g], 5), (red[0][r], 2), *([] if only_filled else [(blue[0][b], 1)]), (alpha[0][a], 1)):
                out.put(int(value), n)
            pixels.append(a << 24 | r << 16 | g << 8 | b)
        elif kind == "copy" and at:
            s, more, d, dmore = int(rng.integers(0, 8)), int(rng.integers(0, 4)), int(rng.integers(0, 32)), int(rng.integers(0, 1 << 15))
            n, k = webp._extra(s, webp.Bits(more.to_bytes(8, "little"))), max(0, (s - 2) >> 1) if s > 3 else 0
            dk = (d - 2) >> 1 if d > 3 else 0
            f = webp._extra(d, webp.Bits((dmore & ((1 << dk) - 1)).to_bytes(8, "little")))
            dx, dy = webp.NEAR[f - 1] if f <= 120 else (0, 0)
            f = f - 120 if f > 120 else max(1, dx + dy * w)
            if f > at or at + n > w * h:
                continue
            for value, size in ((green[256 + s], 5), (more & ((1 << k) - 1), k), (far[0][d], 5), (dmore & ((1 << dk) - 1), dk)):
                out.put(int(value), size)
            for _ in range(n):
                pixels.append(pixels[-f])
        elif kind == "cache":
            slot = slots[int(rng.integers(0, 8))]
            if only_filled and slot not in filled:
                continue
            out.put(int(green[280 + slot]), 5)
            found = [v for v in pixels if slot_of(v) == slot]
            pixels.append(found[-1] if found else 0)
        filled |= set(map(slot_of, pixels[at:]))
        at = len(pixels)
    return out.done(), pixels


@pytest.mark.parametrize("only_filled", [True, False])
@pytest.mark.parametrize("cache_bits", [4, 11])
def test_odd_streams_come_back_together(only_filled, cache_bits):
    rng = np.random.default_rng(12)
    made = [odd_stream(rng, w, h, only_filled, cache_bits) for w, h in [(3, 2), (1, 1), (7, 30), (80, 120), *[(9, 8)] * 20]]
    assert max(len(data) for data, _ in made) > webp.LOOK_BYTES  # of several parts
    for (data, want), got in zip(made, webp.decode_all([data for data, _ in made]), strict=True):
        assert got.reshape(-1).tolist() == want == webp.decode_stream(data).reshape(-1).tolist()


def test_no_stored_text_is_decoded_token_by_token(monkeypatch):
    rng = np.random.default_rng(13)
    words = [rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8).tobytes() for _ in range(500)]
    every = [b" ".join(words[i] for i in np.minimum(rng.zipf(1.3, n), 500) - 1) for n in (0, 1, 40, 400, 9000, 60000)]
    stored = media.stored_all([media.payload_of(x) for x in every])

    def slow(*args):
        raise AssertionError("an image is decoded token by token")

    monkeypatch.setattr(webp, "_tokens", slow)
    for text, got in zip(every, media.pixels_all(stored), strict=True):
        assert media.samples_of(got).tobytes() == media.payload_of(text).tobytes()


def test_long_repeats_are_decoded_in_groups_bounded_by_pixels(monkeypatch):
    seen, real = [], webp._decoded
    monkeypatch.setattr(webp, "_decoded", lambda images: seen.append(sum(i.width * i.height for i in images)) or real(images))
    payload = media.payload_of(b"ab c" * 300_000)
    for got in media.pixels_all(media.stored_all([payload] * 4)):
        assert media.samples_of(got).tobytes() == payload.tobytes()
    assert len(seen) > 1 and max(seen) <= max(webp.STREAM_BYTES, payload.size // 3)
