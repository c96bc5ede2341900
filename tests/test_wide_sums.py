"""Sums of many measures, dealt by key first."""

from helpers import values
from featloom.operators import rollup
from featloom.session import materialize


def test_wide_sums_meet_after_one_exchange_of_the_joined_rows(spark, monkeypatch):
    slots = spark.createDataFrame(
        [("t1", "a"), ("t1", "a"), ("t1", "b"), ("t2", "b"), (None, "a"), ("t3", "none"), ("t2", None)],
        "t string, component string",
    )
    table = spark.createDataFrame([("a", 1.5, 1), ("b", None, 2), (None, 9.0, 9)], "component_id string, m double, f int")
    want = values(rollup.sum_components(slots, table, "t"))
    assert (None, 1.5, 1) in want and ("t1", 3.0, 4) in want
    for size in (0, 1 << 62):
        summed = rollup.sum_components(slots, table, "t", table_bytes=size)
        assert values(summed) == want
        # The sums are taken where the rows of a key have been brought together.
        assert "RepartitionByExpression" in summed._jdf.queryExecution().optimizedPlan().toString()
    # A table of unknown size is measured where the slots are many.
    monkeypatch.setattr(rollup, "WIDE_READ_BYTES", 100)
    slots, table = materialize(slots, "slots"), materialize(table, "measures")
    assert rollup.wide_partitions(slots) >= rollup.WIDE_PARTITIONS
    for most in (0, 1 << 30):
        spark.conf.set(rollup.BROADCAST_BYTES_CONF, str(most))
        try:
            assert values(rollup.sum_components(slots, table, "t")) == want
            inner = rollup.attributes(slots, table, "t")
            assert [row for row in values(inner) if row[0] == "t3"] == []
        finally:
            spark.conf.unset(rollup.BROADCAST_BYTES_CONF)
