import re
from unittest import mock

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cliplane.operators import grams, postings, search

SCHEMA = "video_id long, title string, analysis_title string, category string, key_message string, score int, status string, analyzed_at timestamp"


def fold(text):
    return text.upper().lower()


def meets(formula, grams):
    if formula is None:
        return True
    if isinstance(formula, str):
        return formula in grams
    return (all if formula[0] == "and" else any)(meets(p, grams) for p in formula[1])


PIECES = st.sampled_from(["a", "b", "an", "que", "xyz", "[ab]", "[a-z]", ".", "(?:ab|cde)", "(abc)", "x*", "(?:xyz)?", "(?:bc)+", "c{2,3}", r"\b", r"\w", "q|r", "é", "Ừ", "ß", "^", "$", " "])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=7).map("".join), st.text("abcdexyzq uneÉừß", max_size=14), st.randoms())
def test_what_matches_meets_the_formula(pattern, text, rng):
    try:
        re.compile(pattern)
    except re.error:
        return
    formula = postings.required(pattern)
    if re.search(pattern, text, re.IGNORECASE):
        low = fold(text)
        assert meets(formula, {low[i : i + 3] for i in range(len(low) - 2)})


def test_formulas():
    assert postings.required("an|que") is None and postings.required("th") is None and postings.required(".*") is None
    assert postings.required("abcd") == ("and", ("abc", "bcd"))
    assert postings.required("abc|XYZ") == ("or", ("abc", "xyz"))
    assert postings.required("licen[cs]e") == ("or", (("and", ("lic", "ice", "cen", "enc", "nce")), ("and", ("lic", "ice", "cen", "ens", "nse"))))
    assert postings.required("(?:abc)?def") == "def" and postings.required("(abc){2,}") == "abc"
    for odd in ("(?i)abcdef", "abc(?=def)", r"abc\x64ef", "[a-z&&[b]]cde", "abc++d"):
        assert postings.required(odd) is None


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    texts = ["Xin chào các bạn", "ỪM hôm nay", "straße STRASSE", "İstanbul", "kelvin K", "long ſubscribe", "ΣΊΣΥΦΟΣ", "abc", "ab", "", None, "a\nb c"]
    rows = [(i, t, None if i % 3 else "extra", "cat", t, 5, "analyzed", None) for i, t in enumerate(texts * 30)]
    index = postings.SearchIndex(spark, str(tmp_path / "index")).insert(spark.createDataFrame(rows[:200], SCHEMA))
    index.insert(spark.createDataFrame(rows[200:], SCHEMA))
    every = spark.createDataFrame(rows, SCHEMA)
    for q in ("chào", "ừm h", "strasse", "straße", "istanbul", "subscribe", "KELVIN k", "σίσυφος", "abc|các", "extra", "b c", "cat", "zzz", "^ab$", "a.c", "", "hôm (nay|mai)"):
        got = sorted(r.video_id for r in search.found_by(index.candidates(q), q).collect())
        assert got == sorted(r.video_id for r in search.found_by(every, q).collect()), q
    read, there = index.report("chào các")
    assert (read, there) == (30, 360) and index.report("zzz")[0] == 0 and index.report("th") == (360, 360)
    plan = index.ids(("and", ("abc", "bcd")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard" in plan.split("PartitionFilters")[1].split("]")[0]


def test_library_behind_an_index(spark, tmp_path):
    from cliplane.api import IndexedLibrary

    rows = [(i, f"title {i} {'needle' if i % 50 == 0 else 'hay'}", None, "c", None, 5, "analyzed", None) for i in range(200)]
    library = IndexedLibrary(postings.SearchIndex(spark, str(tmp_path / "index")).insert(spark.createDataFrame(rows[:100], SCHEMA)))
    assert library.count("needle") == 2
    grown = library.insert(spark.createDataFrame(rows[50:], SCHEMA))
    assert grown.count("NEEDLE|nothing") == 4 and grown.index.report("needle") == (4, 200)
    assert [r.video_id for r in grown.search("needle").collect()] == [0, 50, 100, 150]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-9000, 9000), st.text("abé\U0001F600\0 ", max_size=9), st.none() | st.text(max_size=5)), max_size=12), st.sampled_from([3, 7, 1 << 22]))
def test_trigrams_of_a_batch(rows, step):
    """Against plain Python, whatever is sorted at a time, with no list beyond its block."""
    ids, columns = np.array([r[0] for r in rows], np.int64), [pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]
    with mock.patch.object(grams, "SLICE", step):
        got = [r for b in grams.postings(ids, columns, 4096) for r in b.to_pylist()] if rows else []
    assert {(r["gram"], i) for r in got for i in r["ids"]} == {(t[k : k + 3], i) for i, *texts in rows for t in texts if t for k in range(len(t) - 2)}
    assert all(i // 4096 == r["block"] for r in got for i in r["ids"])
