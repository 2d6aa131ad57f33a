import os

from quaver import session


def test_stored_tables_go_at_the_end_of_a_scratch(spark):
    kept = session.stored(spark.range(5), "kept")
    with session.scratch(spark):
        inner = session.stored(spark.range(7), "gone")
        folder = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert inner.count() == 7 and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 5
