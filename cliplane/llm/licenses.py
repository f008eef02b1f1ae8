"""Licence scan by ordered signature rules.

A text becomes its words in lower case, one space apart. A keyword prefilter, one
pass over the words, tells which of some 150 keywords occur; only rules of these are
tried. Their regexes run on the words with a space on either side of each, so that
matches are whole words and touching ones don't share a space. A match's place is
read from the words after the match has been marked in the text.

Of detections that overlap, one is suppressed if another of the same or a higher
priority holds its interval; of equal intervals the higher priority stays, then the
earlier rule. In order of start, then of longer intervals, what could hold an
interval stands before it, so a running maximum of ends for each priority decides.
It is taken by doubling: k steps of one look-back each for 2^k detections, no pairs.

All of it is DataFrame functions within a row; nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplane.llm.license_rules import BASE, RULES, Rule, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OPEN, CLOSE = "\x01", "\x02"  # no word holds them
PRIORITIES = (1, 2, 3, 4)
SCHEMA = "array<struct<rule:int,priority:int,label:string,base:boolean,keywords:array<string>,pattern:string>>"

OUT = "array<struct<start:int,end:int,priority:int,rule:int,label:string,base:boolean,kept:boolean>>"

EVERY = [(True, r) for r in read(BASE)] + [(False, r) for r in read(RULES)]


def pattern(regex: str) -> str:
    """The regex over words that have a space on either side each; an optional space is an optional word bound."""
    return " (" + regex.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


def table(rules: Sequence[tuple[bool, Rule]]) -> Column:
    """The rules as a literal; Spark folds it once."""
    rows = [{"rule": i, "priority": r.priority, "label": r.label, "base": base, "keywords": list(r.keywords), "pattern": pattern(r.regex)} for i, (base, r) in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), SCHEMA)


def normalized(text: Column) -> Column:
    """Words in lower case (A-Z only), one space apart; a null text has none."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))


def matches(text: Column, rule: Column) -> Column:
    """(start, end) of a rule's matches, in words from 0, the end not included; ``text`` is spaced."""
    marked = F.split(F.trim(F.regexp_replace(text, rule["pattern"], F.lit(f" {OPEN}$1{CLOSE} "))), "  ")
    at = lambda hit: F.filter(F.transform(marked, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    return F.arrays_zip(at(lambda w: w.startswith(OPEN)).alias("start"), F.transform(at(lambda w: w.endswith(CLOSE)), lambda i: i + 1).alias("end"))


def running_max(values: Column) -> Column:
    """The maximum up to each place of an array of numbers, by doubling."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda a, step: F.transform(a, lambda x, i: F.greatest(x, F.when(i >= step, F.get(a, i - step)))))


def unsuppressed(found: Column) -> Column:
    """``found``, in order, with ``kept``: whether no other detection of the same or a higher priority holds it."""
    ends = lambda p: F.transform(found, lambda d: F.when(d["priority"] >= p, d["end"]).otherwise(-1))
    tops = F.array(*(running_max(ends(p)) for p in PRIORITIES))

    def one(d: Column, i: Column, held: Column) -> Column:
        before = F.coalesce(F.when(i > 0, F.get(F.get(held, d["priority"] - 1), i - 1)), F.lit(-1))
        return F.struct(*(d[k].alias(k) for k in ("start", "end", "priority", "rule", "label", "base")), (before < d["end"]).alias("kept"))

    # Bound once: the lambda would compute it for each detection.
    return F.get(F.transform(F.array(tops), lambda held: F.transform(found, lambda d, i: one(d, i, held))), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[tuple[bool, Rule]] = EVERY) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, detections.

    ``detections`` are (start, end, priority, rule, label, base, kept) in order of start,
    longer ones first; suppressed ones have ``kept`` false. A null or wordless text has no
    words and none. Rows that repeat an id are scanned each; null ids stay; other
    columns are ignored; an empty table stays empty. A text and its words are in
    one row; matches of one rule don't overlap each other.
    """
    every = table(rules)
    keywords = F.array(*(F.lit(k) for k in sorted({k for _, r in rules for k in r.keywords})))

    def of_rule(text: Column, rule: Column) -> Column:
        # Negated fields first, so that the order of structs is that of the scan.
        return F.transform(
            matches(text, rule),
            lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("_end"), (-rule["priority"]).alias("_priority"), rule["rule"].alias("rule"), m["end"].alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["base"].alias("base")),
        )

    def detected(text: Column, keys: Column) -> Column:
        tried = F.filter(every, lambda r: F.arrays_overlap(r["keywords"], keys))
        hit = F.filter(tried, lambda r: F.regexp(text, r["pattern"]))
        return F.array_sort(F.flatten(F.transform(hit, lambda r: of_rule(text, r))))

    kind = "array<struct<start:int,_end:int,_priority:int,rule:int,end:int,priority:int,label:string,base:boolean>>"
    words = docs.select(F.col(id_col).alias("_id"), normalized(F.col(text_col)).alias("_t"))
    split = words.withColumn("_w", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", " ")))
    keyed = split.select("_id", "_t", F.size("_w").cast("long").alias("n_words"), F.array_intersect("_w", keywords).alias("_k"))
    text = F.concat(F.lit(" "), F.replace(F.col("_t"), F.lit(" "), F.lit("  ")), F.lit(" "))
    bound = lambda keys: F.get(F.transform(F.array(text), lambda t: detected(t, keys)), F.lit(0)).cast(kind)
    found = keyed.select("_id", "n_words", F.when(F.size("_k") > 0, bound(F.col("_k"))).otherwise(F.array().cast(kind)).alias("_d"))
    return found.select(F.col("_id").alias(id_col), "n_words", F.when(F.size("_d") > 0, unsuppressed(F.col("_d"))).otherwise(F.array().cast(OUT)).alias("detections"))


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of scanned documents; the score is the highest kept priority's share of the highest there is."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    base = F.filter("detections", lambda d: d["base"])
    rows = scanned.select(F.col(id_col), "n_words", "detections", base.alias("_b"))
    starts = F.transform("_b", lambda d: d["start"])
    return rows.select(
        id_col, "n_words", F.size("_b").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("_b")).alias("base_labels"), labels(F.filter("detections", lambda d: d["base"] | d["kept"])).alias("labels"),
        (F.coalesce(F.array_max(F.transform(F.filter("detections", lambda d: d["kept"]), lambda d: d["priority"])), F.lit(0)) / F.lit(float(PRIORITIES[-1]))).alias("score"),
    )
