import datetime
import math

import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom.functions import scalars
from featloom.functions.columns import (
    by_name,
    matching,
    select_matching,
    suffix_columns,
)
from featloom.operators import clean
from featloom.operators.model import to_matrix
from featloom.plans.recipes import clean_parts, metric_threads


def one(spark, expression, **row):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()] or [F.lit(1)])
    return df.select(expression.alias("r")).first().r


def test_inverse_log_is_zero_at_zero(spark):
    assert one(spark, scalars.inverse_log(F.col("x")), x=0) == 0
    assert one(spark, scalars.inverse_log(F.col("x")), x=1.0) == pytest.approx(1 / math.log(2))
    assert one(spark, scalars.inverse_plus_one(F.col("x")), x=3.0) == 0.25
    assert one(spark, scalars.inverse_plus_one(F.col("x")), x=-1.0) is None


def test_log_label_and_back(spark):
    x = one(spark, scalars.unlog(scalars.log_label(F.col("x"))), x=12.5)
    assert x == pytest.approx(12.5)


def test_wall_volume(spark):
    volume = one(
        spark, scalars.wall_volume(F.col("d"), F.col("w"), F.col("l")), d=10.0, w=2.0, l=3.0
    )
    assert volume == pytest.approx((math.pi * 25 - math.pi * 16) * 3)


@pytest.mark.parametrize(
    "name,token",
    [("NUT-SWIVEL", "NUT"), ("TUBE AS", "TUBE"), ("CLAMP", "CLAMP"), (None, None), ("-X", None)],
)
def test_leading_token(spark, name, token):
    column = scalars.leading_token(F.col("n"))
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(column.alias("r")).first().r == token


def test_monday_is_zero_and_parts_replace_the_date(spark):
    df = spark.createDataFrame([(datetime.date(2024, 3, 4),)], "d date")
    parts = ("year", "month", "dayofyear", "dayofweek", "day")
    assert tuple(scalars.date_parts(df, "d", parts).first()) == (2024, 3, 64, 0, 4)


def test_row_sum_and_count_treat_null_as_nothing(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, None)], "q1 double, q2 double, q3 double")
    out = df.select(
        scalars.row_sum(df.columns).alias("s"), scalars.row_count_non_null(df.columns).alias("n")
    )
    assert values(out) == [(0.0, 0), (3.0, 2)]


def test_half_even_share(spark):
    assert one(spark, scalars.round_share(F.col("n"), 0.5), n=5) == 2
    assert one(spark, scalars.round_share(F.col("n"), 0.5), n=7) == 4


def test_safe_ratio(spark):
    assert one(spark, scalars.safe_ratio(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, scalars.safe_ratio(F.col("a"), F.col("b"), root=3), a=16.0, b=2.0) == 2.0


def test_flags(spark):
    df = spark.createDataFrame([("Yes",), ("Y",), ("No",), ("N",), ("maybe",), (None,)], "f string")
    got = [r.r for r in df.select(clean.decode_flag(F.col("f")).alias("r")).collect()]
    assert got == [1, 1, 0, 0, None, 0]
    got = df.select(clean.decode_flag(F.col("f"), on_null=1).alias("r")).collect()[-1].r
    assert got == 1


@pytest.mark.parametrize("word", ["maybe", None])
def test_strict_flags_fail(spark, word):
    df = spark.createDataFrame([(word,)], "f string")
    with pytest.raises(Exception, match="not a flag"):
        df.select(clean.decode_flag_strict(F.col("f"))).collect()


def test_sentinels(spark):
    df = spark.createDataFrame([(9999.0, "9999"), (5.0, "A"), (None, None)], "x double, s string")
    out = df.select(
        clean.replace_sentinel(F.col("x"), 14.4).alias("x"),
        clean.null_if_in(F.col("s"), ["9999", "NONE"]).alias("s"),
    )
    assert values(out) == [(None, None), (5.0, "A"), (14.4, None)]


def test_drop_value_keeps_nulls_and_ranges_drop_them(spark):
    df = spark.createDataFrame([(1,), (2,), (2500,), (None,)], "q int")
    assert values(clean.drop_value(df, "q", 2500)) == [(None,), (1,), (2,)]
    assert values(clean.keep_below(df, "q", 2)) == [(1,)]
    assert values(clean.keep_below(df, "q", 2, inclusive=True)) == [(1,), (2,)]
    assert values(clean.keep_between(df, "q", 1, 2500)) == [(2,)]


def test_fills(spark):
    df = spark.createDataFrame([("A", None), ("B", None), (None, None), ("A", 4.0)], "c string, w double")
    filled = df.select("c", clean.fill_by_category(F.col("w"), F.col("c"), {"A": 0.5}).alias("w"))
    assert values(filled) == [(None, None), ("A", 0.5), ("A", 4.0), ("B", None)]
    assert values(clean.fill_mean(df, ["w"]), "w") == [(4.0,)] * 4
    assert values(clean.zero_fill(df, ["w"]), "w") == [(0.0,), (0.0,), (0.0,), (4.0,)]


def test_metric_threads_read_pitch_before_size(spark):
    df = spark.createDataFrame(
        [("M10", 1.5), (".687", 16.0), ("x", 2.0)], "thread_size string, thread_pitch double"
    )
    got = {r.thread_pitch: r.thread_size for r in metric_threads(df).collect()}
    assert got == {16.93: 0.375, 16.0: 0.687, 2.0: None}


def test_part_cleaning(spark):
    df = spark.createDataFrame(
        [("a", "REQUIREMENT", 1.0), ("b", "TUBE AS.", None), ("c", None, None), ("d", "NUT", 2.0)],
        "component_id string, part_name string, weight double",
    )
    assert values(clean_parts(df)) == [
        ("b", "TUBE AS", 0.614), ("c", None, None), ("d", "NUT", 2.0)
    ]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "k int, spec1 int, other_spec2 int, `B-1` int")
    assert matching(df, r"spec\d") == ["spec1", "other_spec2"]
    assert select_matching(df, "spec", keep=["k"]).columns == ["k", "spec1", "other_spec2"]
    named = suffix_columns(df.withColumnRenamed("spec1", "spec1_nut"), "nut", skip="k")
    assert named.columns == ["k", "spec1_nut", "other_spec2_nut", "B-1_nut"]
    assert df.select(by_name("B-1")).first()[0] == 4
    with pytest.raises(ValueError, match="twice"):
        suffix_columns(df.withColumnRenamed("spec1", "k_nut"), "nut")


def test_matrix_is_all_doubles_without_nulls(spark):
    df = spark.createDataFrame([("a", 1, None)], "id string, x int, y double")
    out = to_matrix(df, exclude=["id"])
    assert out.dtypes == [("x", "double"), ("y", "double")]
    assert tuple(out.first()) == (1.0, 0.0)
