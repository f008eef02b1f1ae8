"""Each stage against a plain version of it on the rows that it was given, and run() against the stages."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
from test_dedup import brute_repeats, fingerprint

from cliplane.llm import langid, mixing
from cliplane.llm.queries import vocabulary


def table(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def poisson(rate, u):
    k, total = 0, math.exp(-rate)
    while total <= u and k < rate + 12 * math.sqrt(rate) + 30:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_stages(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 80)
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(str(tmp_path / "documents.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "mixing", "packing"]
    outs = {}
    rows = given
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        rows = outs[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert rows.columns == list(corpus_pipeline.COLUMNS)

    told = {r.doc_id for r in langid.identify(given).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert table(outs["language_id"]) == Counter({k: v for k, v in table(given).items() if k[0] in told})

    first = sorted(outs["language_id"].collect(), key=lambda r: r.doc_id)
    fps, group = [fingerprint(r.text) for r in first], list(range(len(first)))
    for i in range(len(first)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    kept = {first[g].doc_id for g in group}
    assert 0 < len(kept) < len(first)
    assert table(outs["near_dedup"]) == Counter({k: v for k, v in table(outs["language_id"]).items() if k[0] in kept})

    second = outs["near_dedup"].collect()
    want = Counter((r.doc_id, x[3], r.lang, r.source, len(x[3])) for r, x in zip(second, brute_repeats([r.text for r in second]), strict=True))
    assert table(outs["substring_dedup"]) == want

    third = outs["substring_dedup"].collect()
    n = Counter(r.source for r in third)
    total = round(sum(math.sqrt(v) for v in n.values()), 6)
    want = Counter()
    for r in third:
        rate = round(math.sqrt(n[r.source]) / total * len(third) / n[r.source], 9)
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        if many := poisson(rate, u):
            want[(r.doc_id, r.text, r.lang, r.source, r.n_chars)] += many
    assert table(outs["mixing"]) == want

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()["vocabulary"])
    ids = lambda t: [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
    want = Counter(i for r in outs["mixing"].collect() for i in ids(r.text))
    got = outs["packing"].collect()
    assert Counter(np.concatenate([np.frombuffer(p.ids, "<u4") for p in got]).tolist()) == want
    sizes = Counter()
    for p in got:
        sizes[p.sequence_id] += p.length
    assert max(sizes.values()) <= 1024

    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in ran.collect()) == sum(want.values())
