import __spark_entry__


def test_names_of_sql_are_names_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_flagship_query_has_rows(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables are not here")
    df = __spark_entry__.entry(spark)
    assert df.columns == ["track_key", "title", "artist", "n"] and 0 < df.count() <= 10
