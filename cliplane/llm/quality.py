"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and its pairs of neighbouring characters (code
points of any script, A-Z in lower case apart from their capitals), hashed to
``WORD_TERMS`` and ``PAIR_TERMS`` places, and, as terms of their own, the share of
words that repeat the word before and the share of capitals; a text without any of these has one
term that says so. A term weighs the
root of its share in the text times its inverse document frequency over all
documents. A truncated singular value decomposition of labelled texts gives the
latent space. The labelled vectors are broadcast; their number is bounded by
``MAX_LABELLED`` rows, the first by a hash of their id. Each document is compared
with all of them by exact cosine products, block by block, and its ``NEIGHBOURS``
nearest vote with their labels, weighted by similarity: the nearest with its own,
others less by the power ``SHARPNESS`` of their share of it. Similarities are rounded
to ``DIGITS`` places; of equal ones the voter that comes first by (id, label) votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.llm import kernels
from cliplane.llm.runtime import ship

MAX_LABELLED = 3000
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
DIGITS = 5
THRESHOLD = 0.7
WORD_TERMS = 1 << 14
PAIR_TERMS = 1 << 13
REPEATS, CAPITALS = WORD_TERMS + PAIR_TERMS, WORD_TERMS + PAIR_TERMS + 1
EMPTY = CAPITALS + 1  # the only term of a text that has no other
TERMS = EMPTY + 1
PRIOR_VOTES = 1.5
CHUNK_ENTRIES = 1 << 18  # of a sparse matrix that are multiplied at a time
CHUNK_ROWS = 1024  # of texts at a time, whose terms and similarities are in memory together


class Terms:
    """The different terms of some texts: text, term and weight of each, by text."""

    def __init__(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.text, self.term, self.weight = text, term, weight


def counted(text: np.ndarray, term: np.ndarray, texts: int) -> Terms:
    """Terms with the root of their share among the terms of their text."""
    key, many = np.unique(text * TERMS + term, return_counts=True)
    text, term = key // TERMS, key % TERMS
    total = np.bincount(text, many, texts)
    return Terms(text, term, np.sqrt(many / total[text]))


def shares(texts: kernels.Texts, words: kernels.Words, h: np.ndarray) -> Terms:
    """The share of each text's words that are the same as the word before, and of capitals among its bytes."""
    n = np.diff(words.first)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[words.first[:-1][n > 0]] = False
    repeated = np.bincount(words.text_index(), same, len(texts)) / np.maximum(n - 1, 1)
    upper = np.concatenate([[0], np.cumsum((texts.buf >= 65) & (texts.buf <= 90))])[texts.offsets]
    capital = np.diff(upper) / np.maximum(np.diff(texts.offsets), 1)
    at = np.arange(len(texts))
    both = Terms(np.concatenate([at, at]), np.repeat([REPEATS, CAPITALS], len(texts)), np.sqrt(np.concatenate([repeated, capital])))
    used = both.weight > 0
    return Terms(both.text[used], both.term[used], both.weight[used])


def terms_of(texts: kernels.Texts) -> Terms:
    words = kernels.words_of(texts)
    h = kernels.word_hashes(words, 101, lower=True)
    word = counted(words.text_index(), (h % np.uint64(WORD_TERMS)).astype(np.int64), len(texts))
    start = np.flatnonzero((texts.buf & 0xC0) != 0x80)
    text = np.searchsorted(texts.offsets, start, side="right") - 1
    inside = np.flatnonzero(text[1:] == text[:-1])
    end = np.append(start[2:], len(texts.buf))[inside]
    pairs = kernels.spans_hash(kernels.byte_codes(102)[texts.buf], start[inside], end, 102)
    pair = counted(text[inside], WORD_TERMS + (pairs % np.uint64(PAIR_TERMS)).astype(np.int64), len(texts))
    every = [word, pair, shares(texts, words, h)]
    return Terms(*(np.concatenate([getattr(t, k) for t in every]) for k in ("text", "term", "weight")))


def all_terms(texts: kernels.Texts) -> Terms:
    """``terms_of``, and the term of a text without any."""
    terms = terms_of(texts)
    empty = np.setdiff1d(np.arange(len(texts)), terms.text)
    return Terms(np.append(terms.text, empty), np.append(terms.term, np.full(len(empty), EMPTY)), np.append(terms.weight, np.ones(len(empty))))


def inverse_frequency(docs: DataFrame, text_col: str) -> np.ndarray:
    """log(1 + documents / documents with the term) of every term, over all of ``docs``; TERMS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            rows += len(texts)
            for a, b in kernels.row_chunks(texts, rows=CHUNK_ROWS):
                total += np.bincount(all_terms(kernels.part_of(texts, a, b)).term, minlength=TERMS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, TERMS)), pa.array(np.append(total[used], rows))], ["term", "n"])

    found = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS + 1)
    n[[r["term"] for r in found]] = [r["n"] for r in found]
    return np.log1p(n[TERMS] / np.maximum(n[:TERMS], 1)).astype(np.float32)


class Matrix:
    """Weighted terms of some texts less their mean, as a sparse matrix and the mean: products take no more than its entries."""

    def __init__(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, terms: int):
        order = np.argsort(text, kind="stable")
        self.text, self.term, self.weight = text[order].astype(np.int32), term[order].astype(np.int32), weight[order].astype(np.float32)
        self.shape = texts, terms
        self.mean = (np.bincount(self.term, self.weight, terms) / texts).astype(np.float32)

    def _summed(self, to: np.ndarray, of: np.ndarray, v: np.ndarray, rows: int, sorted_: bool) -> np.ndarray:
        out = np.zeros((rows, v.shape[1]), np.float32)
        for a in range(0, len(to), CHUNK_ENTRIES):
            part = slice(a, a + CHUNK_ENTRIES)
            own, value = to[part], v[of[part]] * self.weight[part, None]
            if not sorted_:
                order = np.argsort(own, kind="stable")
                own, value = own[order], value[order]
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[at]] += np.add.reduceat(value, at, axis=0)
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._summed(self.text, self.term, v, self.shape[0], True) - self.mean @ v

    def transposed_times(self, u: np.ndarray) -> np.ndarray:
        return self._summed(self.term, self.text, u, self.shape[1], False) - np.outer(self.mean, u.sum(0))


def directions(x: Matrix, many: int = DIMENSIONS, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors of ``x`` by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    terms = x.shape[1]
    y = x.transposed_times(x.times(rng.normal(size=(terms, min(many + 16, terms))).astype(np.float32)))
    for _ in range(4):
        y = x.transposed_times(x.times(np.linalg.qr(y)[0]))
    q = np.linalg.qr(y)[0]
    _, _, v = np.linalg.svd(x.times(q), full_matrices=False)
    return (q @ v.T[:, :many]).astype(np.float32)


class Voters:
    """Labelled vectors on the unit sphere of the latent space."""

    def __init__(self, terms: Terms, label: np.ndarray, idf: np.ndarray):
        self.idf = idf
        used, at = np.unique(terms.term, return_inverse=True)
        weight = terms.weight * idf[terms.term]
        norm = np.sqrt(np.bincount(terms.text, weight.astype(float) ** 2, len(label)))
        x = Matrix(terms.text, at, weight / np.maximum(norm[terms.text], 1e-12), len(label), len(used))
        basis = directions(x)
        self.knows_empty = EMPTY in used
        # Terms that no voter has lie outside of the space.
        self.basis = np.zeros((len(idf), basis.shape[1]), np.float32)
        self.basis[used] = basis
        self.origin = x.mean @ basis
        self.vectors = self.embed(terms, len(label))
        self.label = label.astype(np.float32)
        self.prior = float(label.mean())

    def embed(self, terms: Terms, texts: int) -> np.ndarray:
        """Vectors of length one; zero for texts without terms."""
        weight = (terms.weight * self.idf[terms.term]).astype(np.float32)
        norm = np.sqrt(np.bincount(terms.text, weight.astype(float) ** 2, texts))
        order = np.argsort(terms.text, kind="stable")
        z = np.zeros((texts, self.basis.shape[1]), np.float32)
        for a in range(0, len(order), 1 << 18):
            part = order[a : a + (1 << 18)]
            text = terms.text[part]
            at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            z[text[at]] += np.add.reduceat(self.basis[terms.term[part]] * weight[part, None], at, axis=0)
        z = np.where(norm[:, None] > 0, z / np.maximum(norm, 1e-12)[:, None] - self.origin, 0)
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest voters of each vector, with a few votes of the prior."""
        sims = np.round(vectors @ self.vectors.T, DIGITS)
        k = min(NEIGHBOURS, sims.shape[1])
        last = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        nearer, level = sims > last, sims == last
        votes = nearer | (level & (np.cumsum(level, 1) <= k - nearer.sum(1, keepdims=True)))
        row, voter = np.nonzero(votes)
        sim, best = np.maximum(sims[row, voter], 0).astype(float), np.maximum(sims.max(1), 1e-9)[row]
        weight = best * (sim / best) ** SHARPNESS
        good = np.bincount(row, weight * self.label[voter], len(sims)) + PRIOR_VOTES * self.prior
        return good / (np.bincount(row, weight, len(sims)) + PRIOR_VOTES)

    def score(self, texts: kernels.Texts) -> np.ndarray:
        terms = all_terms(texts)
        vectors = self.embed(terms, len(texts))
        if not self.knows_empty:
            vectors[terms.text[terms.term == EMPTY]] = 0
        return np.where(vectors.any(1), np.clip(self.vote(vectors), 0, 1), self.prior).astype(float)


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Voters | None:
    """The voters, or None without labelled rows. Rows of held-out ids are never learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for a, b in kernels.row_chunks(texts, rows=CHUNK_ROWS):
                terms = all_terms(kernels.part_of(texts, a, b))
                own = [np.flatnonzero(terms.text == i) for i in range(b - a)]
                packed = [pa.array([x[i].astype(kind).tobytes() for i in own], pa.binary()) for x, kind in ((terms.term, np.int32), (terms.weight, np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), *packed], ["id", "label", "terms", "weights"])

    ship(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    # Only labels of documents that are there, so that labels of others take no voter's place.
    there = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    chosen = usable.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id", "label").limit(MAX_LABELLED)
    # At most MAX_LABELLED small rows, so this side may be broadcast at any scale.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "id", "label")
    rows = texts.mapInArrow(run, "id long, label int, terms binary, weights binary").orderBy("id", "label", "terms", "weights").limit(MAX_LABELLED).collect()
    if not rows:
        return None
    each = [np.frombuffer(r["terms"], np.int32) for r in rows]
    weights = [np.frombuffer(r["weights"], np.float32) for r in rows]
    terms = Terms(np.repeat(np.arange(len(rows)), [len(x) for x in each]), np.concatenate(each), np.concatenate(weights))
    return Voters(terms, np.array([r["label"] for r in rows]), inverse_frequency(docs, text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, score, predicted.

    ``score`` in 0..1 rises with the likelihood of label 1; ``predicted`` is 1
    from THRESHOLD on. Empty texts and nulls are learned from and have neighbours
    like others; where no labelled text is empty, they get the share of label 1 among the voters. Without any labelled row all scores are 0.5. Rows that
    repeat a document are scored each; rows that repeat a label vote each. A null
    id is not held out. Other columns are ignored.
    """
    voters = fit(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            parts = [np.zeros(0)] + [voters.score(kernels.part_of(texts, a, b)) if voters else np.full(b - a, 0.5) for a, b in kernels.row_chunks(texts, rows=CHUNK_ROWS)]
            score = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    return rows.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")
