"""Validation of a model's answer about a video: every breach of its form, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliplane.functions.text import let

# The fields of an answer. A question mark means that a field may be missing or null.
SECTIONS = {
    "general_info": "title category overall_sentiment target_audience",
    "content_analysis": "main_objective key_message hook_strategy",
    "technical_audit": "editing_style sound_design cta_analysis video_quality? transitions?",
    "virality_factors": "score:score reasons improvement_suggestions strengths?:texts weaknesses?:texts",
}
SEGMENTS = "script_breakdown"
SEGMENT = "segment_id:whole time_range start_seconds?:number end_seconds?:number visual_description camera_angle audio_transcript on_screen_text pacing"
SCORE = (1, 10)


def _fields(text: str) -> list[tuple[str, bool, str]]:
    """(name, whether it may be missing, kind)."""
    named = [f.partition(":") for f in text.split()]
    return [(n.rstrip("?"), n.endswith("?"), kind or "text") for n, _, kind in named]


def _kind(value: Column) -> Column:
    """What a part of a JSON document is; null where there is none."""
    plain = {"OBJECT": "object", "ARRAY": "list", "STRING": "text", "BOOLEAN": "boolean", "VOID": "null"}
    # The first word of its schema.
    word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    found = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(found, word), F.lit("number")))


def _number(value: Column, kind: Column) -> Column:
    """A number, or a text that reads as one."""
    return F.when(kind == "number", F.try_variant_get(value, "$", "double")).when(kind == "text", F.trim(F.try_variant_get(value, "$", "string")).try_cast("double"))


def _breach(value: Column, optional: bool, kind: str) -> Column:
    """What is wrong with a field, or null."""

    def wrong(found: Column) -> Column:
        if kind == "text":
            return F.when(found != "text", "not a text")
        if kind == "texts":
            texts = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_kind(x) == "text", F.lit(False)))
            return F.when((found != "list") | ~texts, "not a list of texts")
        if kind == "number":
            return F.when(_number(value, found).isNull(), "not a number")
        whole = lambda n: F.when(F.coalesce((n != F.floor(n)) | F.isnan(n), F.lit(True)), "not a whole number")
        return let(_number(value, found), lambda n: whole(n).when(~n.between(*SCORE), f"not from {SCORE[0]} to {SCORE[1]}") if kind == "score" else whole(n))

    missing = lambda found: F.when(found.isNull(), F.lit(None) if optional else "missing").when(found == "null", F.lit(None) if optional else "null")
    return let(_kind(value), lambda found: missing(found).otherwise(wrong(found)))


def breaches(answer: Column) -> Column:
    """All breaches of a JSON answer in the order of its form, as ``place: what``; an array, empty if there is none.

    Text that is no JSON object has one. A null answer has null. Numbers may be given as texts.
    """
    named = lambda place, what: F.when(what.isNotNull(), F.concat(place, F.lit(": "), what))
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")

    def fields_of(own: Column, place: Column, fields: str) -> Column:
        field = lambda f, optional, kind: let(part(own, f), lambda x: named(F.concat(place, F.lit(f".{f}")), _breach(x, optional, kind)))
        return F.array(*(field(*f) for f in _fields(fields)))

    def section(v: Column, name: str) -> Column:
        bad = lambda kind: F.array(F.when(kind.isNull(), f"{name}: missing").otherwise(f"{name}: not an object"))
        return let(part(v, name), lambda own: let(_kind(own), lambda kind: F.when(kind == "object", fields_of(own, F.lit(name), SECTIONS[name])).otherwise(bad(kind))))

    def segments(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            place = F.concat(F.lit(f"{SEGMENTS}["), i.cast("string"), F.lit("]"))
            return F.when(_kind(x) == "object", fields_of(x, place, SEGMENT)).otherwise(F.array(F.concat(place, F.lit(": not an object"))))

        bad = lambda kind: F.array(F.when(kind.isNull(), f"{SEGMENTS}: missing").otherwise(f"{SEGMENTS}: not a list"))
        every = lambda own: F.flatten(F.transform(F.try_variant_get(own, "$", "array<variant>"), one))
        return let(part(v, SEGMENTS), lambda own: let(_kind(own), lambda kind: F.when(kind == "list", every(own)).otherwise(bad(kind))))

    def of(v: Column) -> Column:
        every = F.concat(section(v, "general_info"), section(v, "content_analysis"), segments(v), section(v, "technical_audit"), section(v, "virality_factors"))
        return F.when(_kind(v) == "object", F.filter(every, lambda b: b.isNotNull())).otherwise(F.array(F.lit("answer: not an object")))

    return F.when(answer.isNotNull(), let(F.try_parse_json(answer), of))
