from lodestar import storage


def test_written_rows_survive_and_can_be_discarded(spark):
    df = storage.written(spark.range(5).selectExpr("id", "id % 2 as odd"), "numbers")
    assert df.count() == 5 and df.columns == ["id", "odd"]
    assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert storage.discard_written(spark) >= 1 and storage.discard_written(spark) == 0


def test_shared_folder_is_the_session_s_own(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_path(spark, "a") != storage.shared_path(spark, "a")
