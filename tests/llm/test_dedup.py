import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from cliplane.llm import components, kernels, simhash, substring_dedup

WORD = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(WORD, text or "")


def brute_repeats(texts, size=35):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_substring_dedup_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows]), strict=True))
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want
    assert any(0 < r.n_removed < r.n_words for r in got)


def test_substring_dedup_keeps_columns(docs, nothing):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_words_of_any_make_are_told_apart(spark):
    """Words of 1,024 bytes that sums of powers can't tell apart, and a short stretch of a long repeat elsewhere."""
    turns = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = turns.translate(str.maketrans("ab", "ba"))
    frame = [f"w{i}" for i in range(61)]
    rng = np.random.default_rng(5)
    long = [f"v{i}" for i in rng.integers(0, 10**6, 400)]
    lone = lambda n: [f"x{i}" for i in rng.integers(0, 10**9, n)]
    texts = [" ".join(frame[:31] + [x] + frame[32:]) for x in (turns, other)]
    texts += [" ".join([*lone(20), *long, *lone(20)]) for _ in range(3)] + [" ".join([*lone(50), *long[a : a + n], *lone(9)]) for a, n in ((100, 36), (201, 35), (250, 34), (303, 90))]
    texts += [" ".join(["same"] * 200), " ".join(["same"] * 34), None, ""]
    rows = [(None if i % 3 == 0 else 7, t, i) for i, t in enumerate(texts)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, uid int"), keep=["uid"]).collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in sorted(got, key=lambda r: r.uid)] == brute_repeats(texts)


def test_long_symbols_are_found_in_long_repeats():
    rng = np.random.default_rng(6)
    word = kernels.mixed(rng.integers(0, 5000, 3000).astype(np.uint64))
    first = np.array([0, 3000])
    start, end = substring_dedup.high_symbols(word, first, np.arange(3000) + 35 <= 3000, 35)
    covered = np.zeros(3000, bool)
    for a, b in zip(start, end, strict=True):
        assert b - a >= 35
        covered[a : b - 34] = True
    assert covered.mean() > 0.7


def test_parse_is_decided_by_its_words():
    """Wherever a symbol's deciding words occur, the same symbol is found there."""
    rng = np.random.default_rng(2)
    text = rng.integers(0, 6, 4000).astype(np.uint64)
    text[500:540] = 3  # a run
    x = substring_dedup.recompress(kernels.mixed(text), np.array([0, len(text)]))
    core = slice(1000, 1200)
    other = np.concatenate([rng.integers(0, 6, 77).astype(np.uint64), text[core], rng.integers(0, 6, 50).astype(np.uint64)])
    y = substring_dedup.recompress(kernels.mixed(other), np.array([0, len(other)]))
    found = {(int(s), int(e), int(n)) for s, e, n in zip(y.start, y.end, y.name, strict=True)}
    inside = [(int(s) - 1000 + 77, int(e) - 1000 + 77, int(n)) for s, e, n, a, b in zip(x.start, x.end, x.name, x.left, x.right, strict=True) if a >= 1000 and b <= 1200]
    assert len(inside) > 10 and all(i in found for i in inside)


def test_xxh64_and_words():
    texts = [None, "", "Ab  c\td\n\x0be", "é" * 50 + " x", "w" * 700, "a b c d e f g"]
    k = kernels.words_of(kernels.texts_of(pa.array(texts)))
    got = [[k.buf[k.start[i] : k.end[i]].tobytes().decode() for i in range(k.first[t], k.first[t + 1])] for t in range(len(texts))]
    assert got == [words(t) for t in texts]
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 600)
    end = start + rng.integers(0, 130, 600)
    assert kernels.xxh64(buf, start, end).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), seed=42) for a, b in zip(start, end, strict=True)]


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(docs, nothing):
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min((x for x in (least.get(g), r.doc_id) if x is not None), default=None)
    want = Counter((r.doc_id, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least[g] for g in set(group))


def test_rows_without_an_id_carry_links(spark, monkeypatch):
    """1 and 2 are linked through a row that has no id."""
    rows = [(1, 0), (None, 7), (2, 0x3F), (5, 1 << 40 | 0xFFF000)]
    marked = spark.createDataFrame(rows, "id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprint", lambda *_: marked)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(marked).collect()}
    assert got == {(1, f"{0:016x}", 1), (None, f"{7:016x}", 1), (2, f"{63:016x}", 1), (5, f"{1 << 40 | 0xFFF000:016x}", 5)}


def test_rows_that_share_an_id_are_documents(spark):
    text = lambda seed: " ".join(f"w{(seed * 7919 + i * i) % 997}" for i in range(80))
    rows = [(1, text(1)), (1, text(2)), (None, text(3)), (None, text(3)), (None, text(1)), (4, text(3))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, text(1)), (1, text(2)), (4, text(3))])


def test_crowded_cells_are_divided_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False))) for b in base for _ in range(12)]
    fps = sorted({int(b) for b in base} | set(near))
    points = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}

    def classes(pairs):
        group = {f: f for f in fps}
        for a, b in pairs:
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
        return Counter(frozenset(k for k, v in group.items() if v == g) for g in set(group.values()))

    for limit in (1, 2048):
        monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
        got = [(r.a, r.b) for r in simhash.links(points.select("fp")).collect()]
        assert classes(got) == classes(want)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {200: 100, 150: 100}


def test_buckets_leave_no_table_and_follow_the_input(spark, tmp_path):
    from cliplane.llm import runtime

    before = {t.name for t in spark.catalog.listTables()}
    rows = spark.range(1000).selectExpr("id % 10 as k", "id as v")
    kept = runtime.bucketed(rows, ["k"], "test", 8)
    assert {t.name for t in spark.catalog.listTables()} == before
    joined = kept.join(kept.groupBy("k").count(), "k")
    assert joined.count() == 1000 and "Exchange hashpartitioning(k" not in kept.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    spark.range(200_000).selectExpr("id", "uuid() as t").repartition(2).write.parquet(str(tmp_path / "in"))
    files = spark.read.parquet(str(tmp_path / "in"))
    assert runtime.buckets_for(rows) == 4 and runtime.buckets_for(files) == 4
    size = sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
    runtime.BUCKET_BYTES, kept_size = size // 10, runtime.BUCKET_BYTES
    try:
        assert runtime.buckets_for(files) == 12
    finally:
        runtime.BUCKET_BYTES = kept_size


def test_hot_names_are_split(spark):
    """A frequent name's rows are split in the join with written counts; with an aggregate on that side they stay in one task."""
    from cliplane.llm.runtime import stash

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    rows = spark.range(0, 400_000, 1, 8).selectExpr("if(id % 10 < 9, 7, id) as name", "id as u1")
    counts = rows.groupBy("name").count().filter("count > 1").select("name")
    most = []
    for side in (stash(counts, "test-counts"), counts):
        joined = rows.join(side, "name").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert sum(r["count"] for r in joined) == 360_000
        most.append(max(r["count"] for r in joined))
    for k in conf:
        spark.conf.unset(k)
    assert most[0] < 200_000 < most[1]


def test_periodic_and_edited_texts(spark):
    """Texts of one word, of short periods, of two letters, and with edits, against plain windows."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        period = [rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 9))]
        words = (period * 60)[: rng.choice([30, 35, 36, 70, 110])]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += [f"{texts[1]} tail", f"head {texts[2]}", "x " * 400]
    count = Counter(tuple(w[i : i + 35]) for w in (t.split() for t in texts) for i in range(len(w) - 34))
    want = []
    for n, t in enumerate(texts):
        w = t.split()
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((n, " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, got)) == want
