import random

import pytest

LANGS = {"en": "the and of to with for that this from have".split(), "fr": "le la des une été où dans pour avec être".split(), "de": "der die das und nicht für über schön groß ein".split()}


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with copies, near copies, shared passages, repeated lines, nulls, empty texts and clashing columns."""
    rng = random.Random(4)
    vocabulary = {lang: words + ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(300)] for lang, words in LANGS.items()}
    passage = " ".join(rng.choice(vocabulary["en"]) for _ in range(60))
    rows = []
    for i in range(120):
        lang = rng.choice(list(LANGS))
        words = [rng.choice(vocabulary[lang] if rng.random() < 0.5 else LANGS[lang]) for _ in range(rng.choice([3, 20, 90, 200]))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        if i % 9 == 0:
            text += passage + " tail " + str(i)
        if i % 10 == 7:
            text, lang = rows[-1][1], rows[-1][2]
        if i % 10 == 8 and rows[-1][1]:
            text, lang = rows[-1][1].replace(" ", "  ", 1) + " Extra", rows[-1][2]
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(200, None, "en", "s0", 0), (201, "", None, "s1", 0), (202, " \n ", "de", None, 3), (203, "la " * 100, "fr", "s0", 300), (204, "a b " * 60, "en", "s0", 240), (3, rows[3][1], "en", "s0", 0), (None, "no id here", "en", "s2", 10), (None, None, None, None, None)]
    rows += [(205, "x" * 3000 + " é " + "1234 " * 50, "en", "s1", 0), (206, "!!! 123 ???", "en", "s1", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, fp string, name string, score int, rest int, doc int, copy int"
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4, 5) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
