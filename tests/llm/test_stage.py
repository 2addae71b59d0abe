from spindrift.llm import _stage


def test_written_and_dropped(spark):
    table = _stage.written(spark.range(5))
    assert table.count() == 5
    assert _stage.drop_written(spark) >= 1 and _stage.drop_written(spark) == 0
