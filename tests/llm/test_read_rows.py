import pytest

from meshloom.llm import common

KEY = "spark.sql.parquet.columnarReaderBatchSize"


@pytest.mark.parametrize("way", ["stored", "mapped"])
def test_parquet_is_decoded_in_small_batches(spark, tmp_path, way):
    """3,000 rows of one file, read after an operator has gone over the session; a limit of the session's own stays."""

    def batches():
        plan = spark.read.parquet(str(tmp_path / "t"))._jdf.queryExecution().executedPlan()
        assert plan.execute().count() == 3000
        return plan.child().metrics().apply("numInputBatches").value()

    def touched():
        if way == "stored":
            assert common.stored(spark.range(5), "few").count() == 5
        else:
            assert common.mapped(spark.range(5), lambda x: x, "id long").count() == 5

    spark.conf.unset(KEY)
    spark.range(3000).coalesce(1).write.parquet(str(tmp_path / "t"))
    touched()
    assert batches() == 6
    spark.conf.set(KEY, 1000)
    try:
        touched()
        assert batches() == 3
    finally:
        spark.conf.unset(KEY)
