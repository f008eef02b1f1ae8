from functools import reduce

from pyspark.sql import functions as F

from cliplane.functions import compare, parse, rules, text
from cliplane.operators import flatten


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("v")).first().v


def test_cleaning(spark):
    vi = "Ừm, xin chào các bạn, hôm nay mình sẽ hướng dẫn.\nLike và subscribe nhé! @user123 #nấuăn tiktok\nBước 1 là chuẩn bị nguyên liệu."
    got = spark.createDataFrame([(vi,)], "t string").select(text.process(F.col("t")).alias("p")).first().p
    assert got.normalized.startswith(", xin chào các bạn, hôm nay mình sẽ hướng dẫn. Like và nhé!")
    assert got.removed_words == max(0, len(vi.split()) - len(got.cleaned.split()))


def test_fillers_and_lines(spark):
    assert value(spark, text.remove_fillers(F.col("t")), t="Um, I mean it is, uhh, good") == ", it is, , good"
    assert value(spark, text.remove_noise(F.col("t")), t="subscribe\nplease subscribe to my very long channel name\n\nx y") == "please to my very long channel name\nx y".replace("please to", "please  to")
    assert value(spark, text.remove_meaningless(F.col("t")), t="!!!\n0:15\n100k\nab\nhello there") == "hello there"
    assert value(spark, text.fix_errors(F.col("t")), t="  hello ,world.this is  it! yes") == "Hello, world. This is it! Yes"
    assert value(spark, text.merge_sentences(F.col("t")), t="Hello\nthere friend.\nNew one\nAnother") == "Hello there friend.\nNew one. Another"
    assert value(spark, text.word_count(F.col("t")), t="") == 0
    assert value(spark, text.clean(F.col("t")), t=None) == ""


def test_capitals_of_one_letter(spark):
    """As the SQL has them: no letter becomes two."""
    assert value(spark, text.fix_errors(F.col("t")), t="ßan que. ßlich? ᾳx. ŉx! éa. xy") == "ẞan que. ẞlich? ᾼx. ŉx! Éa. Xy"
    assert value(spark, text.fix_errors(F.col("t")), t="") == "" and value(spark, text.normalize(F.col("t")), t="one\nßer\nﬁx") == "One ßer. ﬁx"
    assert value(spark, text.process(F.col("t"))["normalized"], t="achzu. ßachzu und") == "Achzu. ẞachzu und"


def test_removed_words_without_the_rest(spark):
    """The count alone doesn't normalize; it is the one that ``process`` gives."""
    for t in ("Um, I mean it is, uhh, good\nsubscribe", "", None, "ßer. x"):
        got = spark.createDataFrame([(t,)], "t string").select(text.removed_words(F.col("t")).alias("n"), text.process(F.col("t"))["removed_words"].alias("m")).first()
        assert got.n == got.m, t


def test_noise_by_literals_first(spark):
    """The same lines as by each pattern in turn, odd letters included."""
    lines = ["see @user", "mail@", "# x", "#x", "TikTok", "TIKTOK", "tıktok", "original ſound", "ORIGINAL SOUND", "ÂM THANH GỐC", "♬", " 12:30 ", "12:30x", "10k", "1/12", "a", "plain words", "", None]
    each = lambda c: reduce(lambda a, p: a | F.trim(F.lower(c)).rlike(text.FLAGS + p), text.OCR_NOISE, F.length(c) < 2)
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", text.is_noise(F.col("t")).alias("n"), each(F.col("t")).alias("m")).collect()
    assert [(r.t, r.n) for r in rows] == [(r.t, r.m) for r in rows]


def test_comparison(spark):
    pairs = [("Hôm nay mình sẽ hướng dẫn làm bánh", "Hướng dẫn làm bánh ngon"), ("Xin chào các bạn, hôm nay mình...", "Bước 1: Chuẩn bị nguyên liệu"), ("Nhạc vui vẻ", "Follow @user123"), ("", "x"), ("", "")]
    df = spark.createDataFrame([(i, a, b, "good", "good") for i, (a, b) in enumerate(pairs)], "i int, stt string, ocr string, stt_quality string, ocr_quality string")
    got = compare.compared(df).orderBy("i").collect()
    assert [(r.similarity, r.relation, r.confidence) for r in got] == [(0.632, "reinforce", "high"), (0.25, "independent", "low"), (0.16, "independent", "low"), (0.0, "independent", "medium"), (0.0, "independent", "low")]
    assert got[0].keywords == ["bánh", "dẫn", "hướng", "làm"]
    p = got[0].priority
    assert (p.primary_source, p.stt_weight, p.ocr_weight, p.content_confidence) == ("merged", 0.6, 0.4, "high")


def test_fallback_priority(spark):
    df = spark.createDataFrame([("Hi", "", "low", "good", "independent")], "stt string, ocr string, stt_quality string, ocr_quality string, relation string")
    p = compare.prioritize(df).first().priority
    assert (p.primary_source, p.stt_weight, p.content_confidence) == ("stt", 0.5, "low")


def test_similarity_depends_on_order(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r.s for r in df.select(compare.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.25, 0.5]


def test_global_quality_and_richness(spark):
    cases = {("good", "good"): ("valid", "both", ["stt", "ocr"]), ("low", "low"): ("weak", "none", ["metadata_only"]), ("good", "low"): ("valid", "stt", ["stt"]), ("medium", "low"): ("valid", "none", ["metadata_only"])}
    for (s, o), want in cases.items():
        q = value(spark, rules.global_quality(F.col("s"), F.col("o")), s=s, o=o)
        assert (q.data_status, q.primary_source, q.usable_sources) == want
    r = spark.range(1).select(rules.richness(F.lit(50), F.lit(100)).alias("r")).first().r
    assert (r.score, r.level) == (60, "medium")


def test_readiness(spark):
    word = lambda n: " ".join(["word"] * n)
    rows = [(1, word(10), "high"), (1, word(11), "high"), (1, word(10), "medium"), (2, "Hi", "low"), (2, "", "low"), (3, word(7), "medium"), (3, "", "low")]
    chunks = spark.createDataFrame([(v, t, "", c) for v, t, c in rows], "video_id long, final_text string, cleaned_text string, content_confidence string")
    quality = spark.createDataFrame([(1, "valid"), (2, "weak"), (3, "valid"), (4, "valid")], "video_id long, data_status string")
    got = {r.video_id: r for r in rules.readiness(chunks, quality).collect()}
    assert (got[1].reasoning_ready, got[1].content_quality, got[1].issues) == (True, "high", [])
    assert got[2].issues == ["too_few_words", "no_chunks_with_content", "low_content_density", "mostly_low_confidence", "no_clear_structure", "topic_unclear", "no_context"]
    assert (got[3].reasoning_ready, got[3].content_quality) == (False, "high")
    assert got[4].issues == ["no_chunks", "no_chunks", "no_content"] and not got[4].reasoning_ready


def test_parsing(spark):
    assert value(spark, parse.video_id(F.col("u")), u="https://www.tiktok.com/@a/photo/123?x") == "123"
    assert value(spark, parse.video_id(F.col("u")), u="https://vm.tiktok.com/abc") is None
    t = lambda said: tuple(spark.range(1).select(parse.time_range(F.lit(said), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("t")).first().t)
    assert [t("00:15 - 00:30"), t("0:15-0:30"), t("01:00:05 - 01:00:10")] == [(15.0, 30.0), (None, None), (60.0, 60.0)]
    assert value(spark, flatten.to_int(F.col("v")), v=" 12 ") == 12 and value(spark, flatten.to_int(F.col("v")), v="12.5") is None
    assert value(spark, flatten.lines_of_resolution(F.col("v")), v="540p") == 540
    assert value(spark, flatten.country(F.col("v")), v="FAKE-AD") == "XX" and value(spark, flatten.country(F.col("v")), v="USA") is None


def test_items_are_displayed_in_one_pass(spark):
    import duckdb

    import __spark_entry__
    from cliplane.plans import parsing_queries

    d = "/root/testdata/sf0.001"
    raw = parsing_queries.raw(spark, d)
    joined = flatten.display_metadata(flatten.video_metadata(raw), flatten.file_metadata(raw))
    assert sorted(map(str, flatten.displayed(raw).collect())) == sorted(map(str, joined.collect()))
    shown = __spark_entry__.queries()["p_6_display_metadata"](spark, d)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS FROM '{d}/part.parquet'")
    assert sorted(map(tuple, shown.collect())) == sorted(db.execute(__spark_entry__.oracle_sql()["p_6_display_metadata"]).fetchall())
