"""Frequent values as a table, of any number."""

from pyspark.sql import functions as F

from helpers import values
from featloom.operators import encode


def test_more_frequent_values_than_a_vocabulary_may_hold(spark):
    most = encode.MAX_VALUES
    df = spark.range(2 * (most + 10)).select(
        F.concat(F.lit("C-"), F.col("id") % (most + 5)).alias("a"),
        F.when(F.col("id") >= 10, F.concat(F.lit("D-"), F.col("id"))).alias("b"), "id",
    )
    frequent = encode.fit_frequent(df, ["a", "b"], 2)
    assert frequent.count() == most + 5
    got = encode.bucket_frequent(df, ["a", "b"], frequent, "Rare")
    assert got.columns == df.columns and got.count() == df.count()
    assert got.where("a = 'Rare'").count() == 0 and got.where("b is null").count() == 10
    assert got.where("b = 'Rare'").count() == df.count() - 10


def test_a_table_of_frequent_values_buckets_as_a_vocabulary(spark):
    rows = [("x", "y"), ("x", None), (None, "x"), ("z", "y"), ("x", "y"), ("9999", "9999"), ("9999", "w")]
    df = spark.createDataFrame(rows, "`a.b` string, c string")
    columns = ["a.b", "c"]
    vocab = encode.fit_column_vocab(df, columns, 3, "Rare", null_values=["9999"])
    frequent = encode.fit_frequent(df, columns, 3, ["9999"])
    assert tuple(r.value for r in frequent.sort("value").collect()) == vocab.values
    got = encode.bucket_frequent(df, columns, frequent, "Rare")
    want = df.select(*[vocab.bucket(c).alias(c) for c in columns])
    assert values(got) == values(want)
