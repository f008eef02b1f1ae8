"""Queries that clean and normalise texts.

RE2 knows word bounds for ASCII only, so the SQL spells them out and, as a bound
is used up by a hit, replaces twice.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplane.functions import text
from cliplane.plans.registry import query
from cliplane.sources.adapters import lines, sql, table

W = r"\p{L}\p{N}\p{M}_"
SPACE = r"[\s\x{00A0}]"


def _re(p: str) -> str:
    return p.replace(r"\w", f"[{W}]").replace(f"[^[{W}]", f"[^{W}").replace(r"\s+", f"{SPACE}+").replace("'", "''")


def _without(t: str, patterns) -> str:
    for p in patterns:
        if p.startswith(r"\b"):
            bounded = f"(^|[^{W}]){_re(p[2:-2])}($|[^{W}])"
            t = f"regexp_replace(regexp_replace({t}, '{bounded}', '\\1\\2', 'gi'), '{bounded}', '\\1\\2', 'gi')"
        else:
            t = f"regexp_replace({t}, '{_re(p)}', '', 'gi')"
    return t


def _collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def _lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"


def _noise(t: str) -> str:
    covers = " OR ".join(f"length(regexp_extract(x, '{_re(p)}', 0, 'i')) > length(x) * 0.5" for p in text.NOISE)
    return f"array_to_string(list_filter(list_transform(list_filter({_lines(t)}, lambda x: NOT ({covers})), lambda x: trim({_without('x', text.NOISE)})), lambda x: x <> ''), chr(10))"


def _meaningless(t: str) -> str:
    bad = " OR ".join(f"regexp_matches(x, '{_re(p).replace(f'[^{W}{chr(92)}s]', f'[^{W}{chr(92)}s]')}', 'i')" for p in text.MEANINGLESS)
    return f"array_to_string(list_filter({_lines(t)}, lambda x: NOT (length(x) < 3 OR {bad})), chr(10))"


FILLERS = _collapse(_without("text", text.FILLERS))
MARKS = _collapse(_without("text", text.WATERMARKS))
# Stage by stage, so that no expression holds the one before more than once.
CLEAN = f"""c1 AS (SELECT doc_id, text, {MARKS} AS t FROM documents), c2 AS (SELECT doc_id, text, {_noise('t')} AS t FROM c1),
c3 AS (SELECT doc_id, text, {_collapse(_without('t', text.FILLERS))} AS t FROM c2), cleaned AS (SELECT doc_id, text, {_collapse(_meaningless('t'))} AS t FROM c3)"""
COUNT = f"len(list_filter(regexp_split_to_array(%s, '{SPACE}+'), lambda w: w <> ''))"
FIX = f"""regexp_replace(regexp_replace({_collapse('%s')}, '{SPACE}+([.,!?:;])', '\\1', 'g'), '([.,!?:;])([A-Za-zÀ-ỹ])', '\\1 \\2', 'g')"""
SENTENCES = "array_to_string(list_transform(string_split(regexp_replace(trim(%s), '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: upper(s[1]) || s[2:]), ' ')"


# Lines as sentences: what stands before a line follows from it and the line before.
MERGED_TEXT = f"""merged AS (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN '' WHEN x[1] = lower(x[1]) AND x[1] <> upper(x[1]) THEN ' '
WHEN NOT regexp_matches(l[i - 1], '[.!?:。]$') THEN '. ' ELSE chr(10) END || x), '') ELSE text END AS t FROM (SELECT doc_id, coalesce(text, '') AS text, {_lines("coalesce(text, '')")} AS l FROM documents))"""


def _docs(spark, d, **columns) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


@query("f_1_for_comparison", f"SELECT doc_id, {_collapse(f'''regexp_replace(lower(text), '[^{W}{SPACE[1:-1]}]', '', 'g')''')} AS t FROM documents")
def f_1(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.for_comparison(F.col("text")))


@query("f_8_remove_fillers", f"SELECT doc_id, {FILLERS} AS t FROM documents")
def f_8(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.remove_fillers(F.col("text")))


@query("f_9_remove_noise", f"SELECT doc_id, {_noise('text')} AS t FROM documents")
def f_9(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.remove_noise(F.col("text")))


@query("f_10_remove_watermarks", f"SELECT doc_id, {MARKS} AS t FROM documents")
def f_10(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.remove_watermarks(F.col("text")))


@query("f_11_remove_meaningless", f"SELECT doc_id, {_meaningless('text')} AS t FROM documents")
def f_11(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.remove_meaningless(F.col("text")))


@query("f_12_clean", f"WITH {CLEAN} SELECT doc_id, t FROM cleaned")
def f_12(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.clean(F.col("text")))


@query("f_13_fix_errors", f"SELECT doc_id, {SENTENCES % 'u'} AS t FROM (SELECT doc_id, {FIX % 'text'} AS u FROM documents)")
def f_13(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.fix_errors(F.col("text")))


@query("w_9_merge_sentences", f"WITH {MERGED_TEXT} SELECT doc_id, t FROM merged")
def w_9(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.merge_sentences(F.col("text")))


@query("f_14_normalize", f"WITH {MERGED_TEXT} SELECT doc_id, {SENTENCES % 'u'} AS t FROM (SELECT doc_id, {FIX % 't'} AS u FROM merged)")
def f_14(spark, d) -> DataFrame:
    return _docs(spark, d, t=text.normalize(F.col("text")))


@query("f_15_process", f"""WITH {CLEAN}, fixed AS (SELECT *, {FIX % 't'} AS u FROM cleaned), final AS (SELECT *, {SENTENCES % 'u'} AS n FROM fixed)
SELECT doc_id, t AS cleaned, n AS normalized, CAST(greatest({COUNT % 'text'} - {COUNT % 't'}, 0) AS INTEGER) AS removed_words, CAST({COUNT % 'n'} AS INTEGER) AS word_count FROM final""")
def f_15(spark, d) -> DataFrame:
    return _docs(spark, d, p=text.process(F.col("text"))).select("doc_id", "p.cleaned", "p.normalized", "p.removed_words", "p.word_count")


@query("f_17_is_noise", sql("lines", "SELECT video_id, pos, length(line) < 2 OR " + " OR ".join(f"regexp_matches(trim(lower(line)), '{_re(p)}', 'i')" for p in text.OCR_NOISE) + " AS noise FROM lines"))
def f_17(spark, d) -> DataFrame:
    return lines(spark, d).select("video_id", "pos", text.is_noise(F.col("line")).alias("noise"))


@query("f_18_ocr_language", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'eng' ELSE 'vie+eng' END AS code FROM documents")
def f_18(spark, d) -> DataFrame:
    return _docs(spark, d, code=text.ocr_language(F.col("lang")))


@query("f_19_lines", f"SELECT doc_id, {_lines('text')} AS l FROM documents")
def f_19(spark, d) -> DataFrame:
    return _docs(spark, d, l=text.lines_of(F.col("text")))


@query("a_19_distinct_ratio", f"""SELECT doc_id, len(list_distinct(list_transform(w, lambda x: lower(x)))) / CAST(nullif(len(w), 0) AS DOUBLE) AS ratio
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '') AS w FROM documents)""")
def a_19(spark, d) -> DataFrame:
    w = text.words(F.col("text"))
    return _docs(spark, d, ratio=F.size(F.array_distinct(F.transform(w, F.lower))) / F.nullif(F.size(w), F.lit(0)))


@query("w_7_clean_ocr_lines", sql("lines", f""", s AS (SELECT video_id, pos, regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS line FROM lines), k AS (SELECT * FROM s WHERE NOT (length(line) < 2 OR """ + " OR ".join(f"regexp_matches(trim(lower(line)), '{_re(p)}', 'i')" for p in text.OCR_NOISE) + """))
SELECT video_id, min(pos) AS pos, arg_min(line, pos) AS line FROM k GROUP BY video_id, lower(line)"""))
def w_7b(spark, d) -> DataFrame:
    from cliplane.operators import timeline

    kept = lines(spark, d).withColumn("line", text.strip(F.col("line"))).filter(~text.is_noise(F.col("line")))
    return timeline.first_lines(kept)


