"""A task of a fit holds a bounded number of rows."""

from pyspark.sql import functions as F

from featloom.operators import model
from featloom.session import one_file_a_task


def test_a_fit_reads_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(model, "FIT_BYTES", 8 * (1 + 32) * 100)
    df = spark.range(1000, numPartitions=1).select(F.col("id").alias("x"), (F.col("id") % 2).alias("label"))
    matrix = model.materialize_matrix(model.assemble(df, ["x"], ["label"]), "bounded")
    with one_file_a_task(spark):
        seen = matrix.groupBy(F.spark_partition_id()).count().collect()
    assert len(seen) == 10 and {r["count"] for r in seen} == {100}
    assert matrix.count() == 1000


def test_packing_of_files_is_restored(spark):
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    with one_file_a_task(spark):
        assert spark.conf.get(key) != before
    assert spark.conf.get(key) == before
