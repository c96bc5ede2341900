"""What steps leave on disk."""

import os

from helpers import values
from pyspark.sql import functions as F

from featloom.operators import encode, rollup
from featloom.session import CLEANUP_CONF, drop_files, exchanges_dropped, materialize


def test_exchange_files_go_with_the_write(spark):
    before = spark.conf.get(CLEANUP_CONF)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def exchange_files():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    known = exchange_files()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert table.count() == 7
    mine = exchange_files() - known
    table.groupBy("k").count().write.format("noop").mode("overwrite").save()
    # The query outside of a materialize leaves its files until the driver collects garbage.
    assert exchange_files() - known - mine and spark.conf.get(CLEANUP_CONF) == before
    known = exchange_files()
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert exchange_files() <= known


def test_the_setting_is_restored_by_the_last_of_several(spark):
    before = spark.conf.get(CLEANUP_CONF)
    first, second = exchanges_dropped(spark), exchanges_dropped(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP_CONF) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP_CONF) == before


def test_dropped_files_are_gone(spark):
    table = materialize(spark.range(3).toDF("a"), "with space")
    (folder,) = {f.removeprefix("file://").removeprefix("file:").rpartition("/")[0] for f in table.inputFiles()}
    drop_files(table)
    assert not os.path.exists(folder.replace("%20", " "))


def test_wide_sums_in_steps(spark):
    slots = spark.createDataFrame(
        [(None if i % 11 == 0 else f"t{i % 40}", None if i % 13 == 0 else f"c{i % 7}", float(i % 5)) for i in range(400)]
        + [("t1", "c1", None)],
        "t string, component string, quantity double",
    )
    rows = [(f"c{i}", None if i == 2 else i * 0.5, i) for i in range(6)] + [(None, 9.0, 9)]
    table = spark.createDataFrame(rows, "component_id string, `m ;{}` double, f int")
    slots, table = materialize(slots, "slots"), materialize(table, "measures")
    vocab = encode.Vocabulary(["c1", "c4"], "Rare")

    def rolled(size):
        return [
            rollup.bill_rollup(slots, table, "t", vocab, table_bytes=size),
            rollup.sum_components(slots, table, "t", table_bytes=size),
            rollup.attributes(slots, table.withColumn("f", F.col("f") + 1), "t"),
            rollup.sum_components(slots, table, "t", table_bytes=size, skew=size > 0),
        ]

    want = rolled(0)
    spark.conf.set(rollup.STEP_BYTES_CONF, "400")
    try:
        assert 1 < rollup.wide_steps(slots) <= rollup.MOST_STEPS
        for got, whole in zip(rolled(1 << 62), want):
            assert got.dtypes == whole.dtypes and values(got) == values(whole)
            assert len(values(got)) > 30
        # Every step is written by the time the sums are handed out.
        assert len(rolled(1 << 62)[0].inputFiles()) > 1
        assert values(rollup.sum_components(slots.limit(0), table, "t", table_bytes=1 << 62)) == []
    finally:
        spark.conf.unset(rollup.STEP_BYTES_CONF)
