"""Wide rows moved as structs, and what goes with them."""

import glob

from pyspark.sql import functions as F

from helpers import values
from featloom.checks.rollup_checks import rounded_number
from featloom.operators import joins, rollup, split
from featloom.session import checkpoint_dir, limit_methods
from featloom.sources import published


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_wide_right_side_is_joined_as_one_struct(spark):
    names = ["a.b", "c`d", *[f"m{i}" for i in range(joins.PACKED_COLUMNS)]]
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "w")], "k int, v string")
    right = spark.createDataFrame(
        [(1, *range(len(names))), (3, *range(len(names))), (None, *range(len(names)))], ["k", *names]
    ).withColumn("m1", F.lit(None).cast("int"))
    row = [None if name == "m1" else i for i, name in enumerate(names)]
    nothing = [None] * len(names)
    for skew in (False, True):
        got = joins.attach(left, right, "k", skew=skew)
        assert got.columns == ["k", "v", *names]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [
            (None, "w", *nothing), (1, "x", *row), (1, "y", *row), (2, "z", *nothing)
        ]
    assert "AS __right" in optimized(got)
    assert joins.attach(left, right, "k", how="inner").count() == 2


def test_merged_components_sum_repeats_without_a_column_for_each_measure(spark):
    a = spark.createDataFrame(
        [("c1", 1.5, 1), ("c1", 2.0, None), ("c1", None, 2**31 - 1), ("c2", None, None), ("c2", None, None),
         ("c3", 4.0, 4), (None, 1.0, 1), (None, 2.0, 2)],
        "component_id string, w double, n int",
    )
    b = spark.createDataFrame([("c1", 7), ("c4", None), (None, 3)], "component_id string, f bigint")
    merged = rollup.merge_components([a, b, a.select("component_id").where("component_id = 'c3'")])
    assert values(merged) == values(spark.createDataFrame(
        [("c1", 3.5, 2**31, 7), ("c2", None, None, None), ("c3", 4.0, 4, None), ("c4", None, None, None), (None, 3.0, 3, 3)],
        "component_id string, w double, n bigint, f bigint",
    ))
    assert merged.dtypes == [("component_id", "string"), ("w", "double"), ("n", "bigint"), ("f", "bigint")]
    assert "sum(" not in optimized(merged)


def test_rounding_is_that_of_round(spark):
    odd = "0.0005D, -0.0005D, 1.0005D, 2.675D, 1.0045D, -0.0001D, 0D, -0D, double('NaN'), double('inf'), double('-inf'), " \
          "1e300D, 123456789.0005D, cast(null as double), 0.00049999999D"
    numbers = spark.sql(f"select explode(array({odd})) as x").union(
        spark.range(20000).select((F.col("id") - 10000) * 0.0005)
    ).union(spark.range(20000).select((F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 14 - 4)))
    for digits in (3, 5, 8):
        fast, plain = (c.cast("string") for c in (rounded_number(F.col("x"), digits), F.round("x", digits)))
        assert numbers.where(~fast.eqNullSafe(plain)).count() == 0
    # A number away from halves does not go through text.
    assert "rint" in optimized(numbers.select(rounded_number(F.col("x"), 3))).lower()


def test_method_limit_is_set_only_over_sparks_own(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for given, want in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, given)
            limit_methods(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_published_files_are_packed_tightly(spark, tmp_path):
    published.publish(spark.range(100), f"{tmp_path}/t")
    files = glob.glob(f"{tmp_path}/t/data/*/*.parquet")
    assert files and all(".zstd." in f for f in files)


def test_groups_of_folds_are_counted_once(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    known = set(glob.glob(f"{folder}/groups-*"))
    rows = spark.range(40).select((F.col("id") % 10).alias("g"), "id")
    folded = split.group_folds(rows, "g")
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    new, = set(glob.glob(f"{folder}/groups-*")) - known
    assert spark.read.parquet(new).agg(F.sum("__rows")).first()[0] == 40
