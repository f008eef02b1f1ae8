import random
import re

from cliplane.llm import licenses
from cliplane.llm.license_rules import Rule

SCHEMA = "doc_id long, text string, start int, label string, detections int, rule int, _t string"


def plain(text):
    """Words and detections by plain Python: (start, end, priority, rule, label, base, kept), in order."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " ".join(words)
    at, starts = 0, {}
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    found = []
    for n, (base, r) in enumerate(licenses.EVERY):
        assert all(" " not in k for k in r.keywords)
        # Regexes consume words only, so a bound on either side takes the place of the doubled spaces.
        for m in re.finditer(f"(?<![^ ])(?:{r.regex})(?![^ ])", joined):
            s = starts[m.start()]
            e = s + len(m[0].split(" "))
            assert set(r.keywords) & set(words[s:e]), (r, m[0])
            found.append((s, e, r.priority, n, r.label, base))
    holds = lambda o, d: o[0] <= d[0] and o[1] >= d[1] and o[2] >= d[2] and (o[:2] != d[:2] or o[2] > d[2] or o[3] < d[3])
    order = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3]))
    return len(words), [(*d, not any(holds(o, d) for o in found if o is not d)) for d in order]


def example(regex):
    """A text that the regex matches: first alternatives, optional parts kept."""
    t = regex
    while (g := re.search(r"\(\?:([^()]*)\)(\?|\{0,4\})?", t)) is not None:
        t = t[: g.start()] + g[1].split("|")[0] + t[g.end() :]
    t = re.sub(r"\[0-9\]\{4\}", "2019", t).replace("[a-z0-9]+", "word").replace(".{1,80}", "some one")
    t = re.sub(r"\[([^\]])[^\]]*\]", lambda m: m[1], t)
    return re.sub(r" \?", " ", t).replace("?", "").replace(",", "")


def test_every_rule_finds_its_own_text(spark):
    texts = [example(r.regex) for _, r in licenses.EVERY]
    for text, (_, r) in zip(texts, licenses.EVERY, strict=True):
        assert re.fullmatch(r.regex, text), (r, text)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: {d["rule"] for d in x["detections"]} for x in licenses.scan(rows).collect()}
    assert [i for i in range(len(texts)) if i not in got[i]] == []


def test_scan_equals_plain_python(spark):
    rng = random.Random(3)
    lines = ["CC BY", "cc-by-nc 4.0", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "all rights reserved", "All Rights  Reserved. All rights reserved", "MIT License", "the mit", "general public", "licence", "Copyright (c) 2019 2020", "tous droits réservés", "Ünïcode cc", "by", "© 2020", "İ K", "bsd 3-clause license", "noncommercial use only"]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.choice([1, 3, 12]))) for _ in range(60)]
    texts += ["", None, " \n", "!!!", "cc by cc by cc by", "x" * 50000, "CC\x00BY\x7f4", "all rights reserved " * 400 + "word " * 2000, *texts[:3]]
    rows = [(i, t, 1, "a", 2, 3, "b") for i, t in enumerate(texts)] + [(None, "cc by", 1, "a", 2, 3, "b"), (3, texts[3], 1, "a", 2, 3, "b")]
    scanned = licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(((r["doc_id"], r["n_words"], [tuple(d[k] for k in ("start", "end", "priority", "rule", "label", "base", "kept")) for d in r["detections"]]) for r in scanned.collect()), key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    sums = {r["doc_id"]: r for r in licenses.digests(scanned).collect()}
    for i, t in enumerate(texts):
        n, found = plain(t)
        base = [d for d in found if d[5]]
        want = (n, len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in found if d[5] or d[6]})), max((d[2] for d in found if d[6]), default=0) / 4)
        assert tuple(sums[i])[1:] == want
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suppression_by_priority_and_interval(spark):
    rules = [(False, Rule(2, "long", ("a",), "a b c")), (False, Rule(2, "inner", ("b",), "b")), (False, Rule(3, "strong", ("c",), "c")), (False, Rule(2, "same", ("a",), "a b c")), (False, Rule(1, "over", ("c",), "c d"))]
    row = licenses.scan(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), rules=rules).first()
    # The inner one is held, the stronger one isn't, of equals the first stays, and what only overlaps stays.
    assert [(d["label"], d["kept"]) for d in row["detections"]] == [("long", True), ("same", False), ("inner", False), ("over", True), ("strong", True)]


def test_no_python_in_the_plan(spark):
    plan = licenses.digests(licenses.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
