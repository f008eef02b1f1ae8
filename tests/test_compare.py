"""Comparison of speech and on-screen text against plain Python, on the UDF's own output."""

import difflib
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliplane.functions import compare, text

SCHEMA = "video_id long, pos int, start double, end double, stt string, ocr string, stt_quality string, ocr_quality string"


def plain(stt, ocr, stt_quality, ocr_quality):
    """(similarity, keywords, relation, confidence, leading source, its confidence) of a chunk."""
    bare = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    a, b = bare(stt), bare(ocr)
    similar = round(difflib.SequenceMatcher(None, a, b).ratio(), 3) if a and b else 0.0
    long = lambda t: {w.lower() for w in t.split() if len(w) >= 3}
    keys = sorted(long(stt) & long(ocr))
    if not stt or not ocr:
        relation, sure = "independent", "medium" if stt or ocr else "low"
    elif similar >= 0.6:
        relation, sure = "reinforce", "high"
    elif similar >= 0.3 or len(keys) >= 3:
        relation, sure = "complement", "medium"
    else:
        relation, sure = "complement" if similar >= 0.1 and keys else "independent", "low"

    def density(t):
        w = t.split()
        if not w:
            return 0.0
        return round(len({x.lower() for x in w}) / len(w) * 0.4 + min(sum(map(len, w)) / len(w) / 6, 1.0) * 0.3 + min(len(w) / 50, 1.0) * 0.3, 3)

    points = {"good": 1.0, "low": 0.3}
    s, o = (points.get(q, 0.5) * 0.6 + density(t) * 0.4 for q, t in ((stt_quality, stt), (ocr_quality, ocr)))
    of = lambda q: "low" if q == "low" else "medium"
    if not stt and not ocr:
        lead = ("none", "low")
    elif relation == "reinforce":
        lead = ("merged", "high")
    elif relation == "complement":
        lead = ("merged", "medium")
    elif s > o and stt:
        lead = ("stt", of(stt_quality))
    elif ocr:
        lead = ("ocr", of(ocr_quality))
    else:
        lead = ("stt", "low")
    return similar, keys, relation, sure, *lead


def test_comparison_is_plain(spark):
    rng = random.Random(7)
    words = ["Chào", "các", "bạn,", "hello", "World!", "a", "of", "ẢNH", "one", "two;", "three"]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 30])))
    rows = []
    for i in range(200):
        stt = said()
        ocr = stt if i % 9 == 0 else stt.replace("hello", "one") if i % 5 == 0 else said()
        rows.append((i, 0, 0.0, 1.0, stt, ocr, rng.choice(["good", "low", "other"]), rng.choice(["good", "low", "other"])))
    # From 200 characters on, the matcher leaves out popular ones.
    rows += [(300 + i, 0, 0.0, 1.0, " ".join(rng.choice(words) for _ in range(90)), " ".join(rng.choice(words) for _ in range(80)), "good", "low") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.video_id: (r.similarity, r.keywords, r.relation, r.confidence, r.priority.primary_source, r.priority.content_confidence) for r in compare.compared(df).collect()}
    assert got == {r[0]: plain(*r[4:]) for r in rows}
    counts = {r["relation"]: r["count"] for r in compare.compared(df).groupBy("relation").count().collect()}
    assert counts == Counter(plain(*r[4:])[2] for r in rows)


def test_sentences_are_the_fold(spark):
    """The closed form against a fold over the lines."""

    def fold(t):
        if "\n" not in t:
            return t
        done, opened = [], ""
        for line in (x.strip() for x in t.split("\n")):
            if not line:
                continue
            first = line[0]
            if opened and first == first.lower() and first != first.upper():
                opened += " " + line
            elif opened and opened[-1] not in ".!?:。":
                opened += ". " + line
            else:
                done += [opened] if opened else []
                opened = line
        return "\n".join([*done, opened] if opened else done)

    rng = random.Random(8)
    pieces = ["Hello", "world", "Xin chào.", "đi", "Đi", "What?", "1 2", "。", "end:", "", "  ", "ok!", "a. b"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["", "one line", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.s for r in df.select("i", text.merge_sentences(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [fold(t) for t in texts]


def test_triggers_change_nothing(spark):
    """Patterns behind their literals against all patterns in turn, with odd letters and literals that deleting brings together."""
    rng = random.Random(9)
    pieces = ["um", "subumscribe", "Sub", "scribe", "ừm", "ỪMM", "thì là", "like and share", "like  and\tshare", "TikTok", "ſubscribe", "İnshot", "capcut", "douyın", "@you", "#ab", "#a", "you know", "ok", "à", "là", "original sound", "x"]
    texts = [rng.choice([" ", "", "\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for patterns in (text.FILLERS, text.NOISE, text.WATERMARKS):
        assert all(text.literal(p) and text.literal(p) == text.literal(p).lower() and "\\" not in text.literal(p) for p in patterns)
        both = df.select(text.gated(F.col("t"), patterns).alias("a"), text.deleted(F.col("t"), patterns).alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both]


TEXTS = st.one_of(st.text("ab", max_size=40), st.text("abcdefgh ", max_size=120), st.text("abcdefghijklmnopqrstuvwxyz ", min_size=180, max_size=260), st.text(max_size=30))


@settings(max_examples=500, deadline=None)
@given(TEXTS, TEXTS, st.booleans())
def test_ratio_is_difflibs(a, b, shared):
    if shared:
        a, b = a + b[: len(b) // 2], b + a[len(a) // 3 :]
    want = round(difflib.SequenceMatcher(None, a, b).ratio(), 3) if a and b else 0.0
    assert compare.ratio(a, b) == want


def test_ratio_takes_less_time():
    rng = random.Random(10)
    words = ["".join(rng.choice("aeioubcdnrst") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    said = [" ".join(rng.choice(words) for _ in range(33)) for _ in range(60)]
    took = []
    for f in (lambda p, q: difflib.SequenceMatcher(None, p, q).ratio(), compare.ratio):
        at = time.process_time()
        for p, q in zip(said, said[1:], strict=False):
            f(p[:199], q[:199])
        took.append(time.process_time() - at)
    assert took[1] * 2 < took[0]
