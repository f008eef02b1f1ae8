import json

from pyspark.sql import functions as F

from cliplane.functions import answer


def whole():
    made = {name: {f: "x" for f, _, kind in answer._fields(fields) if kind == "text"} for name, fields in answer.SECTIONS.items()}
    made["virality_factors"]["score"] = 8
    made["script_breakdown"] = [{f: 1 if kind == "whole" else "x" for f, optional, kind in answer._fields(answer.SEGMENT) if not optional} for _ in range(2)]
    return made


def changed(**paths):
    made = whole()
    for path, value in paths.items():
        *way, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        at = made
        for p in way:
            at = at[p]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(made)


CASES = [
    (changed(), []),
    (changed(general_info=...), ["general_info: missing"]),
    (changed(general_info=[1], technical_audit=None), ["general_info: not an object", "technical_audit: not an object"]),
    (changed(general_info__title=..., content_analysis__key_message=3), ["general_info.title: missing", "content_analysis.key_message: not a text"]),
    (changed(virality_factors__score=0), ["virality_factors.score: not from 1 to 10"]),
    (changed(virality_factors__score=11.0), ["virality_factors.score: not from 1 to 10"]),
    (changed(virality_factors__score="10"), []),
    (changed(virality_factors__score=2.5), ["virality_factors.score: not a whole number"]),
    (changed(virality_factors__score="high"), ["virality_factors.score: not a whole number"]),
    (changed(virality_factors__strengths=["a", "b"], virality_factors__weaknesses=None), []),
    (changed(virality_factors__strengths=["a", 1]), ["virality_factors.strengths: not a list of texts"]),
    (changed(virality_factors__strengths="a"), ["virality_factors.strengths: not a list of texts"]),
    (changed(technical_audit__transitions=4), ["technical_audit.transitions: not a text"]),
    (changed(script_breakdown=[]), []),
    (changed(script_breakdown={}), ["script_breakdown: not a list"]),
    (changed(script_breakdown__1=7), ["script_breakdown[1]: not an object"]),
    (changed(script_breakdown__0__segment_id="one", script_breakdown__1__pacing=None), ["script_breakdown[0].segment_id: not a whole number", "script_breakdown[1].pacing: null"]),
    (changed(script_breakdown__1__start_seconds="2.5", script_breakdown__0__end_seconds=True), ["script_breakdown[0].end_seconds: not a number"]),
    ("[1]", ["answer: not an object"]),
    ("no json", ["answer: not an object"]),
    ("", ["answer: not an object"]),
    (None, None),
]


def test_every_breach_is_named(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = [r.b for r in df.select("i", answer.breaches(F.col("t")).alias("b")).orderBy("i").collect()]
    assert got == [want for _, want in CASES]
