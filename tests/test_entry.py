import __spark_entry__


def test_names_and_oracles(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["video_id", "title", "category", "score", "analyzed_at"]
