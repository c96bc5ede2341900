from collections import Counter

import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom.operators import split
from featloom.operators.joins import (
    attach,
    attach_roles,
    hot_keys,
    input_bytes,
    keep_listed,
)


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows are exact copies with one key, some have none."""
    spark.conf.set("featloom.skew.hotRows", "100")
    return spark.range(900).select(
        F.when(F.col("id") < 600, F.lit(7)).when(F.col("id") < 700, F.lit(None))
        .otherwise(F.col("id")).cast("long").alias("k"),
        F.when(F.col("id") < 600, F.lit(0)).otherwise(F.col("id")).alias("v"),
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_gives_the_same_rows(spark, skewed, how):
    right = spark.range(0, 880).select(F.col("id").alias("rk"), (F.col("id") * 2).alias("w"))
    plain = attach(skewed, right, "k", "rk", how=how, skew=False)
    salted = attach(skewed, right, "k", "rk", how=how, skew=True)
    assert plain.columns == salted.columns == ["k", "v", "w"]
    assert Counter(values(plain)) == Counter(values(salted))


def test_salting_spreads_the_hot_key(spark, skewed):
    right = spark.range(0, 880).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        spread = attach(skewed.repartition(8), right, "k", skew=True)
        tasks = spread.where("k = 7").select(F.spark_partition_id()).distinct().count()
        plain = attach(skewed.repartition(8), right, "k", skew=False)
        assert plain.where("k = 7").select(F.spark_partition_id()).distinct().count() == 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert tasks > 4


def test_hot_keys_are_a_table_with_a_salt_for_each_share(spark, skewed):
    ((_, salts),) = hot_keys(skewed, ["k"]).collect()
    assert salts == 12
    assert hot_keys(spark.range(99).select((F.col("id") % 1).alias("k")), ["k"]).isEmpty()


def test_five_thousand_hot_keys(spark, skewed):
    spark.conf.set("featloom.skew.hotRows", "4")
    try:
        left = spark.range(25_100).select(
            F.when(F.col("id") < 25_000, F.col("id") % 5000).alias("k"), F.col("id").alias("v")
        )
        right = spark.range(0, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        assert hot_keys(left, ["k"]).count() == 5000
        for how in ("left", "inner"):
            salted = attach(left, right, "k", how=how, skew=True)
            assert len(salted._jdf.queryExecution().toString()) < 20_000
            plain = attach(left, right, "k", how=how, skew=False)
            assert Counter(values(salted)) == Counter(values(plain))
    finally:
        spark.conf.set("featloom.skew.hotRows", "100")


def test_inputs_decide_about_salting(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = left.groupBy("k").agg(F.max("v").alias("w"))
    assert 0 < input_bytes(left) < 10**6

    def salted(df):
        return "__salt" in df._jdf.queryExecution().analyzed().toString()

    assert not salted(attach(left, right, "k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("featloom.skew.minBytes", "1")
    try:
        assert not salted(attach(left, right, "k"))  # small enough to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
        assert salted(attach(left, right, "k"))
        assert salted(attach(left, right, "k", hot_from=left.select("k")))
        assert not salted(attach(left, right, "k", skew=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("featloom.skew.minBytes")


def test_salted_join_of_int_and_bigint_and_of_unlike_types(spark, skewed):
    right = spark.range(0, 880).select(F.col("id").cast("int").alias("k"), F.col("id").alias("w"))
    for r in (right, right.withColumn("k", F.col("k").cast("double"))):
        plain = attach(skewed, r, "k", skew=False)
        assert Counter(values(attach(skewed, r, "k", skew=True))) == Counter(values(plain))


def test_attach_composite_keys_and_clashes(spark):
    left = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "x int, y string, v int")
    right = spark.createDataFrame([(1, "a", 9)], "x int, z string, w int")
    assert values(attach(left, right, ["x", "y"], ["x", "z"])) == [(1, "a", 5, 9), (1, "b", 6, None)]
    with pytest.raises(ValueError, match="twice"):
        attach(left, right.withColumnRenamed("w", "v"), "x")
    with pytest.raises(ValueError, match="left"):
        attach(left, right, "x", how="outer")


def test_roles_and_lists(spark):
    fact = spark.createDataFrame([("p", "q"), ("q", None)], "a string, x string")
    lookup = spark.createDataFrame([("p", "Yes"), ("q", "No")], "id string, forming string")
    out = attach_roles(
        fact, lookup, "id", {"a": {"forming": "forming_a"}, "x": {"forming": "forming_x"}}
    )
    assert values(out) == [("p", "q", "Yes", "No"), ("q", None, "No", None)]
    assert values(keep_listed(fact, "a", lookup.where("id = 'q'"), "id")) == [("q", None)]


@pytest.fixture
def grouped(spark):
    """Groups of 1 to 12 rows and one with a third of all."""
    return spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot"))
        .otherwise(F.concat(F.lit("g"), F.floor(F.sqrt(F.col("id")) * 6))).alias("g"),
        F.col("id"),
    )


def hash_order(counts, seed=42):
    return sorted(counts, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))


def brute_folds(counts, share, rule):
    total = sum(counts.values())
    quota, folds = round(total * share), int(1 / share)
    number, fold, filled, before = {}, 0, 0, 0
    for g in hash_order(counts):
        if rule == "carry":
            number[g] = min(folds - 1, before // quota)
        else:
            if fold < folds - 1 and filled >= quota:
                fold, filled = fold + 1, 0
            number[g] = fold
            filled += counts[g]
        before += counts[g]
    return number


@pytest.mark.parametrize("rule", ["reset", "carry"])
@pytest.mark.parametrize("digits", [1, 3])
def test_folds_match_brute_force(grouped, rule, digits):
    counts = Counter(r.g for r in grouped.collect())
    out = split.group_folds(grouped, "g", 0.25, rule=rule, digits=digits)
    rows = out.collect()
    assert len(rows) == 3000
    got = {r.g: r.fold for r in rows}
    assert Counter((r.g, r.fold) for r in rows) == Counter(
        {(g, f): counts[g] for g, f in got.items()}
    )
    assert got == brute_folds(counts, 0.25, rule)


def test_few_groups_leave_folds_empty(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)], "g string")
    for rule in ("reset", "carry"):
        folds = {r.fold for r in split.group_folds(df, "g", rule=rule).collect()}
        assert folds <= {0, 1, 2, 3}


def test_null_groups_stay_out_of_the_training_side(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "g string, v int")
    folded = split.group_folds(df, "g")
    assert folded.where("g is null").first().fold is None
    for _, train, test in split.recombine(folded, 4):
        assert train.count() + test.count() == 3
        assert test.where("g is null").count() == 1


def test_recombined_pairs_share_no_group(grouped):
    folded = split.group_folds(grouped, "g")
    for _, train, test in split.recombine(folded, 4):
        assert train.columns == ["g", "id"]
        assert train.select("g").intersect(test.select("g")).count() == 0
        assert train.count() + test.count() == 3000


def test_holdout_admits_groups_until_the_share_is_passed(grouped):
    counts = Counter(r.g for r in grouped.collect())
    quota, running, expected = round(3000 * 0.2), 0, {}
    for g in hash_order(counts):
        expected[g] = running <= quota
        running += counts[g]
    out = split.group_holdout(grouped, "g", 0.2)
    assert {r.g: r.is_test for r in out.collect()} == expected
    test, train = split.by_flag(out, "is_test")
    assert test.count() + train.count() == 3000


def test_row_holdout_depends_on_the_key_alone(grouped):
    first = split.row_holdout(grouped, "id", 0.3)
    again = split.row_holdout(grouped.repartition(7), "id", 0.3)
    assert values(first) == values(again)
    assert 800 < first.where("is_test").count() < 1000
