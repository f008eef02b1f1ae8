import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cliplane.llm import ann, elias_fano, kernels, langid, lm, quality

WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.mark.parametrize("frequent", [5, 1 << 17])
def test_lm_is_brute_force(docs, nothing, monkeypatch, frequent):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1500)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "CROWD", 0.2)
    rows = docs.select("doc_id", "text").collect()
    texts = [re.findall(WORD, (r.text or "").translate(LOWER)) for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    one, two, three, after_one, after_two = Counter(), Counter(), Counter(), Counter(), Counter()
    steps = lambda w: list(zip([1, 1, *w], [1, *w], [*w, 0], strict=False))
    for w, h in zip(texts, held, strict=True):
        if not h:
            one.update([*w, 0])
            for x in steps(w):
                three[x] += 1
                two[x[1:]] += 1
                after_one[x[1]] += 1
                after_two[x[:2]] += 1
    n, z = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)

    def p(x):
        lower = (two[x[1:]] + lm.PRIOR * (one[x[2]] + 0.1) / z) / (after_one[x[1]] + lm.PRIOR)
        return (three[x] + lm.PRIOR * lower) / (after_two[x[:2]] + lm.PRIOR)

    want = []
    for r, w, h in zip(rows, texts, held, strict=True):
        t = [*w, 0]
        base = sum(math.log10((one[x] + 0.1) / z) for x in t)
        want.append((-1 if r.doc_id is None else r.doc_id, h, len(t), sum(one[x] > 0 for x in t), n, base, sum(math.log10(p(x)) for x in steps(w))))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(docs).collect()]
    assert len(got) == len(want) and any(held)
    for g, x in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == x[:5]
        assert g[5] == pytest.approx(x[5], abs=1e-6) and g[6] == pytest.approx(x[6], abs=3e-4 * x[2] + 1e-6)
    assert lm.score(nothing).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 12, 3000) ** 2 // 12
    names = np.sort(rng.choice(1 << 61, 12, replace=False).astype(np.uint64))
    v = len(names)
    c1, c2, c3 = np.bincount(text[1:-1], minlength=v), Counter(zip(text, text[1:-1], strict=False)), Counter(zip(text, text[1:], text[2:], strict=False))
    after = Counter(zip(text[1:], text[2:], strict=False))
    contexts = sorted({(b, a) for a, b in c2})
    nth = {c: i for i, c in enumerate(contexts)}
    triples = sorted((nth[b, a], w, n) for (a, b, w), n in c3.items())
    pairs = sorted((a, b, n) for (a, b), n in after.items())
    col = lambda x, i: np.array([r[i] for r in x])
    size = np.array([c2[a, b] for b, a in contexts])
    trie = elias_fano.Trie(
        names,
        (col(pairs, 0), col(pairs, 1), np.log10(col(pairs, 2) / (c1[col(pairs, 0)] + lm.PRIOR))),
        (col(contexts, 0), col(contexts, 1), np.log10(lm.PRIOR / (size + lm.PRIOR))),
        (col(triples, 0), col(triples, 1), np.log10(col(triples, 2) / (size[col(triples, 0)] + lm.PRIOR))),
        np.log10(lm.PRIOR / (c1 + lm.PRIOR)),
    )
    one = (np.bincount(text, minlength=v) + 0.1) / (len(text) + 0.1 * (v + 1))
    unknown = 0.1 / (len(text) + 0.1 * (v + 1))
    for a in range(v):
        for b in range(v):
            a3, b3, a2, b2 = trie.parts(*(trie.number(names[x]) for x in (np.full(v, a), np.full(v, b), np.arange(v))))
            assert (a3 + b3 * (a2 + b2 * one)).sum() + b3[0] * b2[0] * unknown == pytest.approx(1, abs=2e-3)


def test_elias_fano_finds_every_value():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (500, 600), (3000, 1 << 58), (2000, 1 << 20)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        m = elias_fano.Monotone(values)
        asked = np.concatenate([values, rng.integers(0, max(top, 2), 500).astype(np.uint64)])
        place = {int(v): i for i, v in reversed(list(enumerate(values.tolist())))}
        assert m.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
        assert m.at(np.arange(n)).tolist() == values.tolist()


def test_langid_learns_and_labels_every_document(docs, nothing):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[200].lang_pred, by[201].lang_pred, by[206].lang_pred, by[206].score) == ("und", "und", "und", 0.0)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    # Every ninth document holds an English passage, whatever its own language.
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120 and r.doc_id % 9 not in (0, 7, 8)]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(3, hidden=4, seed=1)
    length = rng.integers(1, 7, 20)
    padded, label = rng.integers(0, 256, (20, 6)).astype(np.uint8), rng.integers(0, 3, 20)
    for way in net.ways:
        way.p = {k: v.astype(np.float64) for k, v in way.p.items()}
    _, grads, _ = net.train_step(padded, length, label)
    for way, grad in zip(net.ways, grads, strict=True):
        for k, v in way.p.items():
            at = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
            old, out = v[at], []
            for step in (1e-3, -1e-3):
                v[at] = old + step
                out.append(net.train_step(padded, length, label)[0])
            v[at] = old
            assert grad[k][at] == pytest.approx((out[0] - out[1]) / 2e-3, rel=2e-2, abs=1e-5)


def plain_probabilities(net, text):
    """One document through the network, piece by piece and position by position."""
    total, letters, data = np.zeros(len(net.bias)), 0, text.encode()
    cuts = [0]
    while cuts[-1] < len(data):
        at = min(len(cuts) * langid.PIECE, len(data))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        cuts.append(at)
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = max(a - langid.CONTEXT, 0) if a else 0, min(b + langid.CONTEXT, len(data)) if b < len(data) else b
        while lo and data[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        part, states = data[lo:hi], []
        for way, seq in zip(net.ways, (part, part[::-1]), strict=True):
            h, own = np.zeros((1, way.h), np.float32), []
            for byte in seq:
                h = way.step(h, np.array([byte]))[0]
                own.append(h[0])
            states.append(own)
        for i in range(a - lo, b - lo):
            if langid.IS_LETTER[part[i]]:
                x = states[0][i] @ net.ways[0].p["o"] + states[1][len(part) - 1 - i] @ net.ways[1].p["o"] + net.bias
                p = np.exp(x - x.max())
                total += p / p.sum()
                letters += 1
    return total / max(letters, 1)


def test_labels_are_a_plain_loop():
    net = langid.Network(3, seed=2)
    texts = ["a", "hello größe " * 20, "", "x" * 96, "語言" * 100, None, " " * 300 + "end", "Zażółć gęślą jaźń. " * 11, "hello größe " * 20]
    got = langid.pooled(net, kernels.texts_of(pa.array(texts)))
    for p, text in zip(got, texts, strict=True):
        assert p == pytest.approx(plain_probabilities(net, text or ""), abs=1e-4)


def test_quality_learns(spark, docs, nothing):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) for _ in range(200)]
    rows = [(i, t if i % 2 else t.upper().replace(" ", "!! ")) for i, t in enumerate(good)] + [(900, None), (901, ""), (None, "x y")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(900, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(texts, labels).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0


def test_quality_learns_from_empty_texts(spark):
    """Empty, blank and missing texts that are labelled 0 are scored low, though most labels are 1."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)), 1) for i in range(300)]
    rows += [(1000 + i, ["", None, "\n"][i % 3], 0) for i in range(120)]
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = quality.classify(texts, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")).collect()
    assert all(r.predicted == int(r.doc_id < 1000) and (r.score < 0.3) == (r.doc_id >= 1000) for r in got)


def test_labels_of_other_documents_take_no_place(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(rng.choice(["alpha", "beta"] if i % 2 else ["gamma", "delta"], 20))) for i in range(200)]
    own = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    others = spark.range(10_000, 210_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    alone, crowded = ({r.doc_id: r.score for r in quality.classify(texts, labels).collect()} for labels in (own, own.unionByName(others)))
    assert alone == crowded and all((s >= 0.7) == bool(i % 2) for i, s in alone.items())


def test_sparse_products_are_dense_ones(monkeypatch):
    rng = np.random.default_rng(13)
    monkeypatch.setattr(quality, "CHUNK_ENTRIES", 37)
    dense = rng.random((40, 60)) * (rng.random((40, 60)) < 0.2)
    text, term = np.nonzero(dense)
    mixed = rng.permutation(len(text))
    x = quality.Matrix(text[mixed], term[mixed], dense[text, term][mixed], 40, 60)
    centred = dense - dense.mean(0)
    v, u = rng.random((60, 5)), rng.random((40, 5))
    assert np.allclose(x.times(v), centred @ v, atol=1e-4) and np.allclose(x.transposed_times(u), centred.T @ u, atol=1e-4)
    basis = quality.directions(x, 5)
    best = np.linalg.svd(centred, full_matrices=False)[1][:5]
    assert np.allclose(np.linalg.norm(centred @ basis), np.linalg.norm(best), rtol=1e-2)


def test_votes_are_brute_force():
    """Against a plain nearest-neighbour vote over the same vectors, with ties at the last place."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeéß語言"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(150)]
    texts = texts[:60] + texts[:30] + texts[60:] + ["", None, "A"]
    label = rng.integers(0, 2, len(texts))
    column = kernels.texts_of(pa.array(texts))
    voters = quality.Voters(quality.terms_of(column), label, np.linspace(1, 2, quality.TERMS).astype(np.float32))
    vectors = voters.embed(quality.terms_of(column), len(texts))
    for v, got in zip(vectors, voters.vote(vectors), strict=True):
        sims = np.round(v @ voters.vectors.T, quality.DIGITS)
        near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[: quality.NEIGHBOURS]
        best = max(float(sims[near[0]]), 1e-9)
        weight = [best * (max(float(sims[i]), 0) / best) ** quality.SHARPNESS for i in near]
        want = (sum(w * label[i] for w, i in zip(weight, near, strict=True)) + quality.PRIOR_VOTES * voters.prior) / (sum(weight) + quality.PRIOR_VOTES)
        assert got == pytest.approx(want, abs=2e-3)
    assert not vectors[-3].any() and vectors[-4].any()


def test_quality_reads_every_script(spark):
    """Words tell good from bad where letters are of no Latin script; short texts come in small groups."""
    rng = np.random.default_rng(9)
    good, bad = (["".join(rng.choice(list(chars), 3)) for _ in range(40)] for chars in ("日本語言文化", "買賣便宜快速"))
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 25))) for i in range(300)]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")).collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    sizes = [b - a for a, b in kernels.row_chunks(kernels.texts_of(pa.array(["abcde"] * 5000)), rows=quality.CHUNK_ROWS)]
    assert max(sizes) <= quality.CHUNK_ROWS and sum(sizes) == 5000


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[7] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] * 16, 0), (1200, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = ann.search(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    f = x.astype(float)
    n = np.sqrt((f * f).sum(1))
    hits = 0
    for q in range(0, 400, 50):
        s = f @ f[q] / (n * n[q])
        s[q] = -2
        want = sorted(range(400), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r[2] == pytest.approx(s[r[1]], abs=1e-12) for r in mine)
        hits += len({r[1] for r in mine} & set(want))
    assert hits >= 0.9 * 40
    assert not [r for r in got if r.query_id >= 1000 or r.vec_id >= 1000]
    assert [r.vec_id for r in got if r.query_id == 50 and r.rank == 1] == [7]
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_tiny_and_huge_components():
    x = np.array([[1e-300, 2e-300], [2e-320, 1e-320], [1e300, 3e300], [3.0, 1.0]])
    ids = np.arange(4)
    with np.errstate(all="raise", under="ignore"):
        every = (np.arange(len(x)) for _ in x)
        q, found, score = (np.array(c) for c in ann.nearest(x, ids, x, ids, every, 3).columns)
    assert len(score) == 12 and np.isfinite(score).all() and np.abs(score).max() <= 1 + 1e-12
    got = {(int(a), int(b)): float(s) for a, b, s in zip(q, found, score, strict=True)}
    assert got[0, 2] == pytest.approx(7 / math.sqrt(50), abs=1e-12) and got[1, 3] == pytest.approx(got[3, 1], abs=1e-12)


def test_forest_recall(spark, monkeypatch):
    """Slices and levels from a sample smaller than the table, many slices a tree, several blocks of queries; share examined."""
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    monkeypatch.setattr(ann, "SLICE_ROWS", 700)
    monkeypatch.setattr(ann, "QUERY_ROWS", 30)
    monkeypatch.setattr(ann, "SCORE_ROWS", 500)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(4000, 32)), rng.normal(size=32) + rng.normal(size=(2000, 32)) * 1e-3])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 50 = 0")
    got = ann.search(vectors, queries).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = np.arange(0, len(x), 50)
    sims = unit[at] @ unit.T
    sims[np.arange(len(at)), at] = -2
    best = {(q, j) for q, row in zip(at.tolist(), np.argsort(-sims, axis=1)[:, :5].tolist(), strict=True) for j in row}
    assert len(got) == 5 * len(at)
    assert len(best & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(best)


def test_neighbours_of_equal_vectors(spark):
    """Copies of one vector stand for all of it: the smallest ids first, no query its own, repeated rows repeated."""
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(3, [1.0, 2.0]), (500, [1.0, 0.0]), (500, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(vectors, vectors.filter("vec_id in (0, 3, 500)"), k=3).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 3, 500)}
    assert found == {0: [1, 2, 3], 3: [0, 1, 2], 500: [0, 1, 2]}
    assert {round(r.score, 9) for r in got if r.query_id == 500} == {round(2 / math.sqrt(5), 9)}


def test_slices_hold_every_entry():
    """A string shared by many is dealt out to several slices, and every range meets all slices of the strings it holds."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 700, axis=0)])
    forest = ann.Forest(x, 50 * ann.SLICE_ROWS, 5)
    codes = ann.hash_strings(x)
    slices = forest.slices(codes, np.arange(len(x)))
    low, high = forest.ranges(codes[:, ::100])
    first, last = forest.meet(low, high)
    assert len(np.unique(slices[0, 300:])) > 20 and slices.max() < 50
    for q in range(low.shape[1]):
        held = (codes >= low[:, q : q + 1]) & (codes <= high[:, q : q + 1])
        assert held.any() and (slices >= first[:, q : q + 1])[held].all() and (slices <= last[:, q : q + 1])[held].all()


def test_long_text_in_kernels():
    import pyarrow as pa

    text = "word " * 600_000
    words = kernels.words_of(kernels.texts_of(pa.array([text, None])))
    assert len(words) == 600_000 and len(set(kernels.word_hashes(words, 1).tolist())) == 1


def test_langid_learns_the_pieces_it_labels(spark):
    text = "a " + "語x言文é" * 5000
    texts = kernels.texts_of(pa.array(["", text, "b"]))
    start, length, owner, lead, tail = langid.pieces(texts)
    cut = [bytes(texts.buf[a : a + n]) for a, n in zip(start, length, strict=True)]
    assert all(p.decode() for p in cut)
    assert "".join(p[a : len(p) - b].decode() for p, a, b in zip(cut, lead, tail, strict=True)) == text + "b"
    assert (lead[1:-1] >= langid.CONTEXT).all() and (tail[:-2] > 0).all() and set(owner) == {1, 2}
    late = spark.createDataFrame([(i, f"{' ' * 20000}{'one ' * 900}{'語言' * 400} tail{i} ", "x") for i in range(8)] + [(i, " " * 20000 + "é", "y") for i in range(20, 26)] + [(i, "12", "z") for i in range(30, 36)], "doc_id long, text string, lang string")
    rows = langid.training_rows(late, "doc_id", "text", "lang").collect()
    assert {r["lang"] for r in rows} == {"x", "y"}
    found = b"|".join(bytes(r["bytes"]) for r in rows)
    assert b"one" in found and "語言".encode() in found
    assert {r.lang_pred for r in langid.identify(late).collect()} <= {"x", "y", "und"}


def test_langid_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 2)
    names = [f"l{i:02}" for i in range(70)]
    rows = [(i, f"word {lang}x", lang) for i, lang in enumerate(names * 6)]
    langs, net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == names and len(net.bias) == 70 and net.ways[0].h > langid.HIDDEN


def test_language_sample_is_bounded_and_loses_none(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCUMENTS", 60)
    monkeypatch.setattr(langid, "SAMPLE_PIECES", 240)
    rows = [(i, f"text number {i} with some words " * 30, f"l{i % 30:02}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs, "doc_id", "text", "lang").collect()
    assert len({r["lang"] for r in got}) == 30 and all(sum(r["lang"] == lang for r in got) <= 2 for lang in {r["lang"] for r in got})
    assert sum(len(r["sizes"]) // 2 for r in got) <= 60 * (4 + langid.LEAST_DRAWS)
    monkeypatch.undo()
    assert langid.documents_for(4) == langid.PER_LANGUAGE and langid.pieces_for(4) == langid.STEPS * langid.per_class(4)
