"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a document's bytes in both directions and labels every position
with a probability for each language. A document pools the probabilities of all
positions that belong to a letter (A-Z, a-z, or any byte of a longer character):
its probability of a language is their mean, so the score of a text doesn't grow
with its length, and a text in two languages gets the share of each.

So that long texts run in step with short ones, texts are read in pieces of about
``PIECE`` bytes, cut between characters, each with ``CONTEXT`` bytes of the text on
either side; only a piece's own positions count. Equal pieces of a batch run once.

Training is numpy back-propagation through time on the driver, over a sample
with a documented bound: ``PER_LANGUAGE`` documents of each language (the first
by a hash of their id), and of all their pieces, cut as for labelling, about as
many at random places as training draws. Every language that a row names
is learned; the network grows with their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplane.llm import kernels
from cliplane.llm.runtime import ship, stash

UNKNOWN = "und"
PER_LANGUAGE = 400
HIDDEN = 12
PIECE = 384
CONTEXT = 16
SPAN = 64
STEPS = 300
BATCH = 160
LEAST_DRAWS = 8
RATE = 0.02
BLOCK = 3_000
GROUP_BYTES = 4 << 20  # of texts whose pieces are labelled together
LEAST_SCORE = 0.5
# The sample that training collects is bounded whatever the number of languages: beyond these, each has fewer documents and pieces, but two documents.
SAMPLE_DOCUMENTS = 25_600
SAMPLE_PIECES = 200_000


IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def per_class(classes: int) -> int:
    """Pieces of each language in a training batch."""
    return max(LEAST_DRAWS, -(-BATCH // classes))


def documents_for(classes: int) -> int:
    """Documents of each language in the sample."""
    return min(PER_LANGUAGE, max(2, SAMPLE_DOCUMENTS // classes))


def pieces_for(classes: int) -> int:
    """Pieces of each language in the sample, but for a few more of each document."""
    return min(STEPS * per_class(classes), max(LEAST_DRAWS, SAMPLE_PIECES // classes))


def hidden_for(classes: int) -> int:
    """Units of each direction: HIDDEN up to 16 languages, then with the root of their number."""
    return HIDDEN * max(1, int(np.ceil(np.sqrt(classes / 16))))


def at_once(size: int, classes: int) -> int:
    """``size`` pieces or bytes, fewer as a position's row of languages gets longer."""
    return max(1, size // max(1, -(-classes // 16)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; numpy's exponential of floats is several times as fast as its tanh."""
    np.negative(x, out=x)
    return _inverse(x)


def _inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; an overflow gives the right limit."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _by_byte(byte: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sums of the rows of each byte value, (256, columns)."""
    order = np.argsort(byte, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(byte[order].astype(np.int16)) != 0))
    out = np.zeros((256, rows.shape[1]), rows.dtype)
    out[byte[order[head]]] = np.add.reduceat(rows[order], head, axis=0)
    return out


class Direction:
    """One direction: byte table ``x`` (256, 3h), recurrent ``u`` (h, 3h), read-out ``o`` (h, c). Gates: update, reset, new."""

    def __init__(self, hidden: int, classes: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32),
            "o": rng.normal(0, 0.3, (hidden, classes)).astype(np.float32),
        }

    def step(self, h: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, tuple]:
        k = self.h
        g, s = self.p["x"][byte], h @ self.p["u"]
        zr = _sigmoid(g[:, : 2 * k] + s[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = _tanh(g[:, 2 * k :] + r * s[:, 2 * k :])
        return n + z * (h - n), (h, z, r, n, s[:, 2 * k :], byte)

    def reader(self):
        """``step`` for many rows in place, without what training keeps."""
        k, x, u = self.h, self.p["x"], self.p["u"]
        xg, ug, xn, un = (np.ascontiguousarray(a) for a in (-x[:, : 2 * k], -u[:, : 2 * k], -2 * x[:, 2 * k :], -2 * u[:, 2 * k :]))

        def read(h: np.ndarray, byte: np.ndarray) -> None:
            g = xg.take(byte, 0)
            g += h @ ug
            _inverse(g)
            n = h @ un
            n *= g[:, k:]
            n += xn.take(byte, 0)
            _inverse(n)
            n *= 2
            n -= 1
            h -= n
            h *= g[:, :k]
            h += n

        return read

    def back(self, dh: np.ndarray, kept: tuple, grad: dict) -> np.ndarray:
        """Adds a step's gradients to ``grad``; the gradient of the state before it."""
        h, z, r, n, sn, byte = kept
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * sn * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        grad["x"].append((byte, np.concatenate([dz, dr, dn], axis=1)))
        grad["u"] += h.T @ da
        return dh * z + da @ self.p["u"].T


class Network:
    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ways = [Direction(hidden, classes, rng) for _ in range(2)]
        self.bias = np.zeros(classes, np.float32)

    def train_step(self, padded: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[dict], np.ndarray]:
        """Mean loss over all positions of a batch, and gradients. padded: (pieces, positions)."""
        many, steps = padded.shape
        at = np.arange(steps)
        inside = at[None, :] < length[:, None]
        flipped = np.where(inside, length[:, None] - 1 - at[None, :], at[None, :])
        both = [padded, np.take_along_axis(padded, flipped, 1)]
        states, kept = [], []
        for way, data in zip(self.ways, both, strict=True):
            h, hs, ks = np.zeros((many, way.h), np.float32), [], []
            for t in range(steps):
                h, k = way.step(h, data[:, t])
                hs.append(h)
                ks.append(k)
            states.append(np.stack(hs, 1))
            kept.append(ks)
        states[1] = np.take_along_axis(states[1], flipped[:, :, None], 1)
        logits = states[0] @ self.ways[0].p["o"] + states[1] @ self.ways[1].p["o"] + self.bias
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        total = inside.sum()
        right = np.take_along_axis(p, np.broadcast_to(label[:, None, None], (many, steps, 1)), 2)[:, :, 0]
        loss = float(-(np.log(right + 1e-9) * inside).sum() / total)
        d = p
        np.put_along_axis(d, np.broadcast_to(label[:, None, None], (many, steps, 1)), (right - 1)[:, :, None], 2)
        d *= (inside / total)[:, :, None].astype(np.float32)
        grads = []
        for i, way in enumerate(self.ways):
            g = {k: np.zeros_like(v) for k, v in way.p.items()} | {"x": []}
            g["o"] = np.einsum("bth,btc->hc", states[i], d)
            ds = d @ way.p["o"].T
            if i:
                ds = np.take_along_axis(ds, flipped[:, :, None], 1)
            dh = np.zeros((many, way.h), np.float32)
            for t in range(steps - 1, -1, -1):
                dh = way.back(dh + ds[:, t], kept[i][t], g)
            g["x"] = _by_byte(*(np.concatenate(x) for x in zip(*g["x"], strict=True)))
            grads.append(g)
        return loss, grads, d.sum((0, 1))

    def fit(self, pieces: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 6) -> float:
        """Adam over random batches; classes are drawn equally often, pieces of a class by their weights."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.bias))]
        sums = [np.cumsum(weights[c]) for c in by_class]
        every = [(w.p, k) for w in self.ways for k in w.p]
        moments = [[np.zeros_like(p[k]), np.zeros_like(p[k])] for p, k in every] + [[np.zeros_like(self.bias), np.zeros_like(self.bias)]]
        loss = 0.0
        for step in range(1, steps + 1):
            draws = [np.searchsorted(t, rng.random(per_class(len(by_class))) * t[-1], side="right") for t in sums]
            rows = np.concatenate([c[np.minimum(at, len(c) - 1)] for c, at in zip(by_class, draws, strict=True)])
            # Back-propagation goes through SPAN bytes at any place of a piece.
            chosen = [pieces[i][a : a + SPAN] for i, a in ((i, int(x * max(1, len(pieces[i]) - SPAN + 1))) for i, x in zip(rows.tolist(), rng.random(len(rows)).tolist(), strict=True))]
            length = np.array([len(w) for w in chosen])
            padded = np.frombuffer(b"".join(w.ljust(length.max(), b"\0") for w in chosen), np.uint8).reshape(len(chosen), -1)
            loss, grads, gb = self.train_step(padded, length, labels[rows])
            flat = [g[k] for w, g in zip(self.ways, grads, strict=True) for k in w.p] + [gb]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for j, (g, m) in enumerate(zip(flat, moments, strict=True)):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                change = (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                if j < len(every):
                    every[j][0][every[j][1]] -= change
                else:
                    self.bias -= change
        return loss

    def label(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Probabilities of the languages, summed over the letters of each piece ``buf[start:start+length]`` without its first ``lead`` and last ``tail``."""
        out = np.zeros((len(start), len(self.bias)))
        order = np.argsort(-length, kind="stable")
        block = at_once(BLOCK, len(self.bias))
        for a in range(0, len(order), block):
            rows = order[a : a + block]
            s, n, before, after = start[rows], length[rows], lead[rows], tail[rows]
            active = len(rows) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")
            # Positions lie step by step: those of step t from first[t] on, longest pieces first.
            first = np.concatenate([[0], np.cumsum(active)])
            logits = np.empty((first[-1], len(self.bias)), np.float32)
            logits[:] = self.bias
            for i, way in enumerate(self.ways):
                h, read, out_of = np.zeros((len(rows), way.h), np.float32), way.reader(), way.p["o"]
                for t, many in enumerate(active.tolist()):
                    at = n[:many] - 1 - t if i else t
                    read(h[:many], buf[s[:many] + at])
                    if i:
                        logits[first[at] + np.arange(many)] += h[:many] @ out_of
                    else:
                        logits[first[t] : first[t] + many] += h[:many] @ out_of
            counted, piece = np.empty(first[-1], bool), np.empty(first[-1], np.int32)
            for t, (a, many) in enumerate(zip(first.tolist(), active.tolist(), strict=False)):
                counted[a : a + many] = IS_LETTER[buf[s[:many] + t]] & (t >= before[:many]) & (t < n[:many] - after[:many])
                piece[a : a + many] = np.arange(many, dtype=np.int32)
            logits, piece = logits[counted], piece[counted]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            out[rows] = np.stack([np.bincount(piece, logits[:, c], len(rows)) for c in range(len(self.bias))], 1)
        return out


def _char_start(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The start of the character that holds each place of ``buf``."""
    for _ in range(3):
        at = at - ((at < len(buf)) & ((buf[np.minimum(at, len(buf) - 1)] & 0xC0) == 0x80))
    return at


def pieces(texts: kernels.Texts) -> tuple[np.ndarray, ...]:
    """Starts, lengths and texts of the pieces of about PIECE bytes with their context, and the bytes of it before and after."""
    begin, stop = texts.offsets[:-1], texts.offsets[1:]
    many = -(-(stop - begin) // PIECE)
    text = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start, end = begin[text] + nth * PIECE, stop[text]
    inner = np.flatnonzero(nth)
    cut = _char_start(texts.buf, start[inner])
    lead, tail = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    lead[inner] = cut - _char_start(texts.buf, np.maximum(cut - CONTEXT, begin[text[inner]]))
    tail[inner - 1] = _char_start(texts.buf, np.minimum(cut + CONTEXT, end[inner])) - cut
    start[inner], end[inner - 1] = cut, cut
    return start - lead, end - start + lead + tail, text, lead, tail


def pooled(net: Network, texts: kernels.Texts) -> np.ndarray:
    """The mean probabilities of the languages over the letters of each text; zero for texts without letters."""
    out = np.zeros((len(texts), len(net.bias)))
    letters = np.concatenate([[0], np.cumsum(IS_LETTER[texts.buf])])[texts.offsets]
    for a, b in kernels.row_chunks(texts, at_once(GROUP_BYTES, len(net.bias))):
        out[a:b] = _pooled_group(net, kernels.part_of(texts, a, b))
    return out / np.maximum(np.diff(letters), 1)[:, None]


def _pooled_group(net: Network, texts: kernels.Texts) -> np.ndarray:
    start, length, text, lead, tail = pieces(texts)
    if not len(start):
        return np.zeros((len(texts), len(net.bias)))
    h = kernels.spans_hash(kernels.byte_codes(101)[texts.buf], start, start + length, 101) ^ kernels.mixed((lead | tail << 16).astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    labels = net.label(texts.buf, start[one], length[one], lead[one], tail[one])
    return np.stack([np.bincount(text, labels[which, c], len(texts)) for c in range(labels.shape[1])], 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, sizes, bytes, n) of (lang, place, wanted, text): ``wanted`` of the n pieces of each text, at random places."""
    for batch in batches:
        texts = kernels.texts_of(batch.column(3))
        rows = []
        for i, wanted in enumerate(batch.column(2).to_pylist()):
            own = kernels.part_of(texts, i, i + 1)
            start, length, *_ = pieces(own)
            rng = np.random.default_rng(zlib.crc32(own.buf))
            chosen = np.sort(rng.choice(len(start), min(wanted, len(start)), replace=False)) if len(start) else np.zeros(0, np.int64)
            found = b"".join(own.buf[a : a + n].tobytes() for a, n in zip(start[chosen].tolist(), length[chosen].tolist(), strict=True))
            rows.append((length[chosen].astype(np.uint16).tobytes(), found, len(start)))
        sizes, found, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(found, pa.binary()), pa.array(n, pa.int64())], ["lang", "place", "sizes", "bytes", "n"])


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The sample: (lang, sizes, bytes, n), pieces of the first documents_for() documents of each language by a hash of their id."""
    usable = docs.filter(F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2))
    counts = stash(usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")), "langid-counts")
    # Hashes up to twice the share that is wanted and a few more, so that none of a language's rows is missing by chance: they meet in one task only as a small multiple of it.
    classes = max(1, counts.count())
    documents = documents_for(classes)
    share = F.least(F.lit(1.0), F.lit(2.0 * documents + 30) / F.col("n"))
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11).cast("double") / F.lit(float(1 << 53))
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A row for each language, and written first: Spark knows the size when it picks the join.
    near = rows.join(counts, "lang").withColumn("place", place).filter(F.col("place") < share)
    near = near.filter(F.col("text").rlike(r"\p{L}"))
    # About as many pieces as training draws, from each document by its length.
    chars = stash(near.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("many")), "langid-chars")
    draws = F.lit(1.0 * pieces_for(classes)) * F.greatest(F.lit(1.0), F.col("many") / F.lit(documents)) * F.length("text") / F.col("chars")
    ship(docs.sparkSession)
    wanted = near.join(chars, "lang").select("lang", "place", (F.ceil(draws) + 4).cast("int").alias("wanted"), "text")
    found = wanted.mapInArrow(_sampled, "lang string, place double, sizes binary, bytes binary, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "bytes"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= documents).select("lang", "sizes", "bytes", "n")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Network | None]:
    """The languages and the trained network; (none, None) if there is nothing to learn from."""
    rows = training_rows(docs, id_col, text_col, lang_col).filter(F.length("sizes") > 0).orderBy("lang", "bytes").collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return [], None
    nth = {lang: i for i, lang in enumerate(langs)}
    found, labels, weights = [], [], []
    for r in rows:
        sizes = np.frombuffer(r["sizes"], np.uint16).astype(np.int64)
        end = np.cumsum(sizes)
        found += [bytes(r["bytes"][a:b]) for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True)]
        labels += [nth[r["lang"]]] * len(sizes)
        weights += [r["n"] / max(1, len(sizes))] * len(sizes)
    net = Network(len(langs), hidden_for(len(langs)))
    net.fit(found, np.array(labels), np.array(weights))
    return langs, net


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred and score; columns of these names are replaced. See ``identify``."""
    langs, net = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            if net is None:
                pred, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
            else:
                p = pooled(net, kernels.texts_of(batch.column(0).field(text_at)))
                best = p.argmax(1)
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                pred = [langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score)], ["doc", "held_out", "lang_pred", "score"])

    ship(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    text_at = own.index(text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.struct(*own).alias("doc"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), held.alias("held"))
    out = rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
    return out.select("doc.*", "held_out", "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, and where there is nothing to learn from. Whole texts are read,
    whatever their length. Ties go to the language first in order. Rows that
    repeat a document are labelled each; a null id is not held out and not learned
    from. Other columns are ignored.
    """
    return with_language(docs.select(id_col, text_col, lang_col), id_col, text_col, lang_col).select(id_col, "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose letters have one language with a mean probability of ``least`` or more; their columns as they are."""
    return with_language(docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
