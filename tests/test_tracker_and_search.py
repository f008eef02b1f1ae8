import pytest

from cliplane.operators import search, tracker
from cliplane.sources import files
from cliplane.streaming import queue

COLUMNS = "id string, status string, title string, type string, added_at long, attempts int, completed_at long, last_error string, last_attempt long, file_path string"


def added(spark, objects, ids):
    new = spark.createDataFrame([(i, None, "content", n) for n, i in enumerate(ids)], "id string, title string, type string, pos int")
    return tracker.add_objects(objects, new, 10)


def test_tracker(spark):
    empty = spark.createDataFrame([], COLUMNS)
    two = added(spark, empty, ["a", "b", "a"])
    assert sorted(r.id for r in two.collect()) == ["a", "b"]
    three = added(spark, two, ["b", "c"])
    assert three.count() == 3 and added(spark, three, ["b", "c"]).count() == 3
    failed = spark.createDataFrame([("a", None)], "id string, message string")
    twice = tracker.mark_error(tracker.mark_error(three, failed, 11), failed, 12)
    row = twice.filter("id = 'a'").first()
    assert (row.status, row.attempts, row.last_attempt) == ("error", 2, 12)
    row = tracker.reset_errors(twice).filter("id = 'a'").first()
    assert (row.status, row.attempts, row.last_attempt) == ("pending", 2, None)
    done = spark.createDataFrame([("b", "x"), ("zz", "y")], "id string, file_path string")
    marked = tracker.mark_completed(twice, done, 13)
    assert tuple(tracker.stats(marked).first()) == (1, 1, 1, 0)
    assert tuple(tracker.stats(empty).first()) == (0, 0, 0, 0)
    assert {r.scope: r.pending for r in tracker.stats_summary(marked).collect()}["all"] == 1
    assert tracker.clear(marked).count() == 0


def test_search_checks_its_input(spark):
    videos = spark.createDataFrame([(1, "Ừm", "", "c", "k", 5, "analyzed", None)], "video_id long, title string, analysis_title string, category string, key_message string, score int, status string, analyzed_at timestamp")
    assert search.search(videos, "ừm").first().title == "Ừm"
    assert search.search(videos, "").count() == 1
    with pytest.raises(Exception):
        search.search(videos, "*")
    with pytest.raises(ValueError):
        search.search(videos, "a", limit=101)


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\n  \nb\n")
    assert [r.id for r in files.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    rows = spark.createDataFrame([("b", "t", "content"), ("a", "t", "user"), ("a", "t", "user")], "id string, title string, type string").selectExpr("cast(ascii(id) as long) id", "title", "type")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        work = queue.work_stream(spark, str(tmp_path / "in"), "id long, title string, type string")
        queue.ingest(work, str(tmp_path / "queue"), str(tmp_path / f"check{n}"), f"s{n}")
    assert sorted(r.id for r in queue.read_queue(spark, str(tmp_path / "queue")).collect()) == [97, 98]
    files.write_json(rows, str(tmp_path / "out"))
    assert files.read_metadata(spark, str(tmp_path / "out"), "id long, title string").count() >= 1
    assert files.file_info(spark, str(tmp_path / "ids.txt")).first().suffix == ".txt"


def test_api(spark, tmp_path):
    from cliplane.api import Library, Tracker

    new = spark.createDataFrame([("a", "t", "user", 0)], "id string, title string, type string, pos int")
    t = Tracker.empty(spark).add(new, 1)
    assert t.pending().count() == 1 and t.stats().first().pending == 1 and t.summary().count() == 2
    t.save(str(tmp_path / "q"))
    assert Tracker(spark.read.parquet(str(tmp_path / "q"))).reset_all().clear().objects.count() == 0
    row = (1, "t", "a", "c", "k", 5, "analyzed", None, None, None, "u")
    columns = "video_id long, title string, analysis_title string, category string, key_message string, score int, status string, created_at timestamp, analyzed_at timestamp, error string, url string"
    library = Library(spark.createDataFrame([row], columns))
    assert library.get(1).first().video_id == "1" and library.get(2).count() == 0
    assert library.list().first().total == 1 and library.count("c") == 1 and library.analysis(1).first().has_analysis and library.stats().first().analyzed == 1
