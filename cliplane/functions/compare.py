"""Comparison of speech and on-screen text, and which of them leads."""

from __future__ import annotations

import difflib
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.functions import text

# Workers get what this module defines with their task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORD = 3


POPULAR_FROM = 200  # characters: from here on, those that are more than one in a hundred open no match
NO_CHARACTER = "\uffff"


@lru_cache(maxsize=4096)
def _second(b: str) -> tuple[str, dict[int, frozenset[str]]]:
    """The second text as it is searched, popular characters masked, and its substrings of a few characters; shared by rows that have the text.

    With characters masked, few are left that can open a block, and longer substrings tell no more.
    """
    if len(b) < POPULAR_FROM:
        return b, {k: frozenset([b[i : i + k] for i in range(len(b) - k + 1)]) for k in (3, 2, 1)}
    most = len(b) // 100 + 1
    popular = {c for c, n in Counter(b).items() if n > most}
    return b.translate({ord(c): NO_CHARACTER for c in popular}), {1: frozenset(b) - popular}


def _longest(a: str, places: dict[int, list[int]], find, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int]:
    """Start and length of the longest block, the first of several; length 0 if there is none."""
    top = max(places)
    for k, starts in places.items():
        i, size = alo, k - 1
        for at in range(bisect_left(starts, alo), bisect_right(starts, ahi - k)):
            p = starts[at]
            while p + size < ahi and find(a[p : p + size + 1], blo, bhi) >= 0:
                size += 1
                i = p
            # Longer blocks than the shorter substrings have been ruled out before.
            if size == k < top:
                break
        if size >= k:
            return i, size
    return alo, 0


def matched(a: str, b: str) -> int:
    """Characters in the matching blocks of two texts: the longest block, the first of several in ``a``, then in ``b``; then to its left and right.

    Blocks are looked for only where a substring of a few characters is in the other text at
    all, and by searches for plain strings.
    """
    searched, grams = _second(b)
    places = {k: [i for i in range(len(a) - k + 1) if a[i : i + k] in own] for k, own in grams.items()}
    find = searched.find
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, size = _longest(a, places, find, alo, ahi, blo, bhi)
        j = find(a[i : i + size], blo, bhi) if size else blo
        # Masked characters open no block, but lengthen one on either side.
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return total


def ratio(a: str, b: str) -> float:
    """Matched share of two normalised texts; depends on their order, as the blocks do."""
    if not a or not b:
        return 0.0
    if NO_CHARACTER in a:
        return round(difflib.SequenceMatcher(None, a, b).ratio(), 3)
    return round(2.0 * matched(a, b) / (len(a) + len(b)), 3)


def similarity(a: Column, b: Column) -> Column:
    """One Arrow UDF over a narrow projection, since no expression states the matcher."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return share(text.for_comparison(a), text.for_comparison(b))


def common_keywords(a: Column, b: Column) -> Column:
    """Words of three characters or more that both texts hold, lower-cased, sorted."""
    keys = lambda t: F.transform(F.filter(text.words(t), lambda w: F.length(w) >= MIN_WORD), F.lower)
    return F.array_sort(F.array_intersect(keys(a), keys(b)))


def relation(stt: Column, ocr: Column, similar: Column, keywords: Column) -> Column:
    """How the texts relate, and how sure that is."""
    n, s, o = F.size(keywords), text.filled(stt) != "", text.filled(ocr) != ""
    kind = F.when(~s | ~o, "independent").when(similar >= 0.6, "reinforce").when((similar >= 0.3) | (n >= 3), "complement").when((similar >= 0.1) & (n >= 1), "complement").otherwise("independent")
    sure = F.when(~s & ~o, "low").when(~s | ~o, "medium").when(similar >= 0.6, "high").when((similar >= 0.3) | (n >= 3), "medium").otherwise("low")
    return F.struct(kind.alias("relation"), sure.alias("confidence"))


def density(t: Column) -> Column:
    """Share of different words, length of words and number of words, weighed."""

    def of(w: Column) -> Column:
        n = F.size(w)
        total = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        different = F.size(F.array_distinct(F.transform(w, F.lower))) / F.nullif(n, F.lit(0))
        long = F.least(total / F.nullif(n, F.lit(0)) / 6, F.lit(1.0))
        return F.when(n == 0, 0.0).otherwise(F.bround(different * 0.4 + long * 0.3 + F.least(n / F.lit(50), F.lit(1.0)) * 0.3, 3))

    return text.let(text.words(t), of)


def prioritize(rows: DataFrame) -> DataFrame:
    """Adds the leading source of (stt, ocr, stt_quality, ocr_quality, relation) with texts, weights and confidence."""
    points = lambda q: F.when(q == "good", 1.0).when(q == "low", 0.3).otherwise(0.5)
    rows = rows.withColumns({"stt_score": points(F.col("stt_quality")) * 0.6 + density(F.col("stt")) * 0.4, "ocr_score": points(F.col("ocr_quality")) * 0.6 + density(F.col("ocr")) * 0.4})
    stt, ocr = F.col("stt"), F.col("ocr")
    s, o = text.filled(stt) != "", text.filled(ocr) != ""

    def lead(source: str, first: Column, second: Column, w_stt: float, w_ocr: float, sure: Column) -> Column:
        return F.struct(
            F.lit(source).alias("primary_source"), text.filled(first).alias("primary_text"), text.filled(second).alias("secondary_text"),
            F.lit(w_stt).alias("stt_weight"), F.lit(w_ocr).alias("ocr_weight"), sure.alias("content_confidence"),
        )

    low = lambda q: F.when(q == "low", "low").otherwise("medium")
    none, ahead = F.lit(""), F.col("stt_score") > F.col("ocr_score")
    choice = (
        F.when(~s & ~o, lead("none", none, none, 0.0, 0.0, F.lit("low")))
        .when(F.col("relation") == "reinforce", lead("merged", stt, ocr, 0.6, 0.4, F.lit("high")))
        .when((F.col("relation") == "complement") & (F.col("stt_score") >= F.col("ocr_score")), lead("merged", stt, ocr, 0.5, 0.5, F.lit("medium")))
        .when(F.col("relation") == "complement", lead("merged", ocr, stt, 0.4, 0.6, F.lit("medium")))
        .when(ahead & s, lead("stt", stt, ocr, 0.8, 0.2, low(F.col("stt_quality"))))
        .when(o, lead("ocr", ocr, stt, 0.2, 0.8, low(F.col("ocr_quality"))))
        .otherwise(lead("stt", stt, ocr, 0.5, 0.5, F.lit("low")))
    )
    return rows.withColumn("priority", choice)


def compared(chunks: DataFrame) -> DataFrame:
    """Chunks (stt, ocr and qualities of their video) with comparison and priority."""
    rows = chunks.withColumns({"similarity": similarity(F.col("stt"), F.col("ocr")), "keywords": common_keywords(F.col("stt"), F.col("ocr"))})
    rows = rows.withColumn("_r", relation(F.col("stt"), F.col("ocr"), F.col("similarity"), F.col("keywords")))
    return prioritize(rows.select("*", "_r.relation", "_r.confidence").drop("_r"))


def understood(chunks: DataFrame) -> DataFrame:
    """Compared chunks with the text that later steps read: content chunks."""
    rows = compared(chunks)
    p = F.col("priority")
    return rows.select(
        "video_id", "pos", "start", "end", "relation", "similarity", p["primary_source"].alias("source"), p["content_confidence"].alias("content_confidence"),
        text.final_text(p["primary_text"], p["secondary_text"], p["primary_source"]).alias("final_text"), text.normalize(text.clean(p["primary_text"])).alias("cleaned_text"),
    )
