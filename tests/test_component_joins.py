"""Joins of slots to component tables, decided by the table's size in memory."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom.operators import encode, rollup
from featloom.session import materialize_measured, row_bytes


@pytest.fixture
def slots(spark):
    """A component twice in a key, one in no table, none at all, and no quantity."""
    return spark.createDataFrame(
        [("t1", "c1", 1.0), ("t1", "c1", 2.0), ("t1", "c2", 4.0), ("t2", "c2", None), ("t3", "c9", 5.0),
         ("t4", None, 6.0), (None, "c1", 7.0), (None, "c1", 8.0)],
        "k string, component string, quantity double",
    )


@pytest.fixture
def table(spark):
    return spark.createDataFrame(
        [("c1", 1, 0.5, None), ("c2", None, 0.25, 3), ("c3", 7, 7.0, 7)],
        "component_id string, n int, w double, m bigint",
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_both_forms_give_the_same_sums(slots, table, how):
    plain = rollup.sum_components(slots, table, "k", how=how)
    for size in (1, 1 << 62):
        form = rollup.sum_components(slots, table, "k", how=how, table_bytes=size)
        assert form.dtypes == plain.dtypes
        assert Counter(values(form)) == Counter(values(plain))
    salted = rollup.sum_components(slots, table, "k", how=how, table_bytes=1 << 62, skew=True)
    assert Counter(values(salted)) == Counter(values(plain))
    assert ("t1", 2, 1.25, 3) in values(plain)


def test_size_in_memory_decides_the_plan(spark, slots, table):
    small = plan(rollup.sum_components(slots, table, "k", table_bytes=rollup.BROADCAST_BYTES))
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small and "__slots" not in small
    # Small files do not bring the broadcast back.
    large = rollup.sum_components(slots, table, "k", table_bytes=rollup.BROADCAST_BYTES + 1)
    assert "SortMergeJoin" in plan(large) and "Broadcast" not in plan(large)
    large.collect()
    assert "Broadcast" not in plan(large)
    # One partial sum stands below the join, by key and component, in place of the slots.
    below = plan(large)[plan(large).index("SortMergeJoin"):]
    assert "keys=[k#" in below and "partial_count(1)" in below
    spark.conf.set(rollup.BROADCAST_BYTES_CONF, "100")
    try:
        assert "SortMergeJoin" in plan(rollup.sum_components(slots, table, "k", table_bytes=101))
    finally:
        spark.conf.unset(rollup.BROADCAST_BYTES_CONF)


def test_bill_rollup_in_both_forms(slots, table):
    vocab = encode.Vocabulary(("c1",), "Rare")
    forms = [
        rollup.bill_rollup(slots, table, "k", vocab, prefix="q_", null_values=["c2"], table_bytes=size)
        for size in (None, 1, 1 << 62)
    ]
    assert forms[0].dtypes == forms[1].dtypes == forms[2].dtypes
    rows = [Counter(values(f)) for f in forms]
    assert rows[0] == rows[1] == rows[2]
    assert ("t1", 7.0, 3.0, None, 2, 1.25, 3) in rows[0]
    assert ("t3", 5.0, None, 5.0, None, None, None) in rows[0]


def test_empty_tables(slots, table):
    for size in (1, 1 << 62):
        assert values(rollup.sum_components(slots.limit(0), table, "k", table_bytes=size)) == []
        empty = rollup.sum_components(slots, table.limit(0), "k", table_bytes=size)
        assert set(values(empty)) == {(k, None, None, None) for k in ("t1", "t2", "t3", "t4", None)}


def test_rows_are_measured_while_they_are_written(spark, table):
    # Four columns and a word for their nulls, and the text in one word.
    stored, size = materialize_measured(table, "measured")
    assert size == 3 * (8 + 4 * 8 + 8)
    assert Counter(values(stored)) == Counter(values(table))
    assert materialize_measured(table.limit(0), "measured")[1] == 0
    texts = spark.createDataFrame([("ä" * 5,), (None,), ("",)], "`a.b` string")
    assert [r[0] for r in texts.select(row_bytes(texts.schema)).collect()] == [32, 16, 16]
    with pytest.raises(TypeError, match="pair"):
        row_bytes(table.select(F.array("n").alias("pair")).schema)


def test_a_repetitive_table_is_larger_in_memory_than_its_files(spark):
    from featloom.operators.joins import input_bytes

    wide = spark.range(20_000).select("id", *[F.lit(None).cast("double").alias(f"m{i}") for i in range(100)])
    stored, size = materialize_measured(wide, "wide")
    assert size == 20_000 * (16 + 101 * 8)
    assert input_bytes(stored) < size / 10
