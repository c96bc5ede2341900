"""Tables that Spark takes for smaller than they are."""

from featloom.llm import simhash


def test_the_index_of_fingerprints_is_never_sent_out(spark, tmp_path):
    spark.range(300).selectExpr("id as fp").write.parquet(f"{tmp_path}/prints")
    pairs = simhash.links(spark.read.parquet(f"{tmp_path}/prints"), 2)
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
