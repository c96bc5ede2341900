import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom.operators import encode, reshape, rollup


@pytest.fixture
def words(spark):
    return spark.createDataFrame(
        [("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "w string"
    )


def test_distribution_leaves_nulls_out(words):
    assert values(encode.distribution(words, "w")) == [("a", 3), ("b", 2), ("c", 1)]


def test_count_at_the_cutoff_is_kept(words):
    vocab = encode.fit_column_vocab(words, "w", 2, "Rare")
    assert vocab.values == ("a", "b") and vocab.labels == ("a", "b", "Rare")
    out = words.select(vocab.bucket(F.col("w")).alias("w"))
    assert values(out) == [(None,)] + [("Rare",)] + [("a",)] * 3 + [("b",)] * 2


@pytest.mark.parametrize("skew", [False, True])
def test_unseen_and_null_become_null(spark, words, skew):
    other = spark.createDataFrame([("a",), ("c",), ("new",), (None,)], "w string")
    out = encode.bucket_rare(other, "w", encode.distribution(words, "w"), cutoff=2, skew=skew)
    assert values(out) == [(None,), (None,), ("Rare",), ("a",)]


def test_join_and_expression_buckets_agree_on_the_fitted_data(words):
    counts = encode.distribution(words, "w")
    joined = encode.bucket_rare(words, "w", counts, 2)
    vocab = encode.fit_vocab(counts, 2, "Rare")
    assert values(joined) == values(words.select(vocab.bucket(F.col("w"))))


def test_bucket_by_name_equals_bucket_by_column(spark):
    words = ["plain", "it's", "back\\slash", "per%cent", "new\nline", "q\"uote", "\\'", "rare"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(2)][:-1] + [(None,)], "`w x` string")
    vocab = encode.fit_column_vocab(df, "w x", 2, "Rare")
    assert len(vocab.values) == 7
    by_text = df.select(vocab.bucket("w x").alias("w"))
    assert values(by_text) == values(df.select(vocab.bucket(F.col("`w x`")).alias("w")))
    assert values(by_text.where("w = 'Rare'")) == [("Rare",)]


def test_null_values_come_first(spark):
    df = spark.createDataFrame([("9999",)] * 5 + [("a",)], "w string")
    out = encode.bucket_rare(df, "w", encode.distribution(df, "w"), 1, null_values=["9999"])
    assert values(out) == [(None,)] * 5 + [("a",)]
    assert encode.fit_column_vocab(df, "w", null_values=["9999"]).values == ("a",)


def test_vocabulary_refuses_too_many_values(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("w"))
    with pytest.raises(ValueError, match="more than 10"):
        encode.fit_column_vocab(df, "w", max_values=10)


def test_one_hot(words):
    vocab = encode.fit_column_vocab(words, "w")
    out = encode.one_hot(words.distinct(), "w", vocab.labels)
    assert values(out, "a", "b", "c") == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    assert out.columns == ["a", "b", "c"]
    named = encode.one_hot(words, "w", vocab.labels, prefixed=True, drop=False)
    assert named.columns == ["w", "w_a", "w_b", "w_c"]


def test_one_hot_refuses_a_name_that_exists(spark):
    df = spark.createDataFrame([("x", 1)], "w string, X int")
    with pytest.raises(ValueError, match="twice"):
        encode.one_hot(df, "w", ["x"])


def test_train_and_test_get_the_same_columns(spark, words):
    test = spark.createDataFrame([("new",), ("a",)], "w string")
    labels = encode.fit_column_vocab(words, "w").labels
    assert values(encode.one_hot(test, "w", labels)) == [(0, 0, 0), (1, 0, 0)]


def test_one_hot_vector_and_index(words):
    labels = encode.fit_column_vocab(words, "w").labels
    rows = encode.one_hot_vector(words, "w", labels, "v").collect()
    got = {r.w: r.v.toArray().tolist() for r in rows}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 0]}
    index = {r.w: r.i for r in encode.label_index(words, "w", labels, "i").collect()}
    assert index == {"a": 0, "b": 1, "c": 2, None: None}


def test_align_columns(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert tuple(encode.align_columns(df, ["a", "x", "b"]).first()) == (2, 0, 1)


@pytest.fixture
def bill(spark):
    return spark.createDataFrame(
        [("t1", "c1", 2.0, "c2", 1.0), ("t2", "c1", 5.0, None, None), ("t3", None, None, None, None)],
        "k string, component_id_1 string, quantity_1 double, component_id_2 string, quantity_2 double",
    )


def slots(bill):
    return reshape.unpivot_groups(
        bill, "k",
        {"component": ["component_id_1", "component_id_2"], "quantity": ["quantity_1", "quantity_2"]},
        slot="slot",
    )


def test_unpivot_groups_keeps_families_together(bill):
    assert values(slots(bill)) == [
        ("t1", 1, "c1", 2.0), ("t1", 2, "c2", 1.0), ("t2", 1, "c1", 5.0),
        ("t2", 2, None, None), ("t3", 1, None, None), ("t3", 2, None, None),
    ]


def test_unpivot(bill):
    long = reshape.unpivot(
        bill, "k", ["component_id_1", "component_id_2"], "c", slot="s", keep_null=False
    )
    assert values(long) == [
        ("t1", "component_id_1", "c1"), ("t1", "component_id_2", "c2"), ("t2", "component_id_1", "c1")
    ]


def test_pivot_sum_ignores_empty_slots(bill):
    wide = reshape.pivot_sum(slots(bill), "k", "component", "quantity", ["c1", "c2"])
    assert values(wide) == [("t1", 2.0, 1.0), ("t2", 5.0, 0.0)]


def test_component_quantity_pools_rare_ones(bill):
    wide = rollup.component_quantity(slots(bill), "k", cutoff=2)
    assert wide.columns == ["k", "c1", "RareComponent"]
    assert values(wide) == [("t1", 2.0, 1.0), ("t2", 5.0, 0.0)]


def test_row_counts_sum_to_filled_slots(bill):
    columns = ["component_id_1", "component_id_2"]
    vocab = encode.fit_column_vocab(bill, columns)
    row_local = bill.selectExpr("k", *rollup.row_multi_hot(columns, vocab))
    grouped = rollup.multi_hot(
        reshape.unpivot(bill, "k", columns, "c"), "k", "c", vocab.labels
    )
    assert values(row_local) == values(grouped) == [("t1", 1, 1), ("t2", 1, 0), ("t3", 0, 0)]


@pytest.mark.parametrize("unique", [True, False])
def test_spec_and_end_counts(bill, unique):
    columns = ["component_id_1", "component_id_2"]
    specs = rollup.spec_counts(
        bill.select("k", *columns), "k", columns, cutoff=2, unique_key=unique
    )
    assert values(specs, "k", "has_specs", "c1") == [("t1", 1, 1), ("t2", 1, 1), ("t3", 0, 0)]
    assert "RareSpec" not in specs.columns
    ends = rollup.end_counts(
        bill.select("k", *columns), "k", columns, cutoff=2, unique_key=unique, prefix="end_"
    )
    assert values(ends, "k", "end_c1", "end_RareEnd") == [("t1", 1, 1), ("t2", 1, 0), ("t3", 0, 0)]


def test_pooled_counts_aggregate_before_the_join(spark, bill):
    one = spark.createDataFrame([("c1", "x", "y"), ("c2", "x", "x")], "component_id string, a string, b string")
    two = spark.createDataFrame([("c1", "x")], "component_id string, v string")
    counts = rollup.pooled_counts(
        slots(bill), [(one, ["a", "b"]), (two, ["v"])], "k", cutoff=2, rare_label="Rare"
    )
    assert values(counts, "k", "x", "Rare") == [("t1", 4, 1), ("t2", 2, 1), ("t3", None, None)]


def test_bill_rollup_equals_separate_rollups(spark, bill):
    names = spark.createDataFrame([("c1", 1), ("c2", 3)], "component_id string, n int")
    weights = spark.createDataFrame([("c2", 0.5)], "component_id string, w double")
    table = rollup.merge_components([names, weights])
    vocab = encode.fit_column_vocab(slots(bill), "component")
    rolled = rollup.bill_rollup(
        slots(bill).where("component is not null"), table, "k", vocab, prefix="q_"
    )
    assert values(rolled, "k", "total_components", "q_c1", "q_c2", "n", "w") == [
        ("t1", 3.0, 2.0, 1.0, 4, 0.5), ("t2", 5.0, 5.0, None, 1, None)
    ]


def test_base_names(spark, bill):
    components = spark.createDataFrame(
        [("c1", "NUT-A"), ("c2", "NUT B"), ("c3", None)], "component_id string, name string"
    )
    counts = rollup.base_name_counts(slots(bill), components, "k", cutoff=2)
    assert values(counts, "k", "NUT") == [("t1", 2), ("t2", 1), ("t3", None)]
    names = rollup.name_counts(slots(bill), components, "k", cutoff=2)
    assert names.columns == ["k", "RareComponentName"]


def test_totals(bill):
    out = rollup.totals(
        bill, summed={"components": ["quantity_1", "quantity_2"]},
        counted={"slots": ["component_id_1", "component_id_2"]}, positive={"two": "quantity_2"},
    )
    assert values(
        out, "k", "total_slots", "has_slots", "total_components", "has_components", "two"
    ) == [("t1", 2, 1, 3.0, 1, 1), ("t2", 1, 1, 5.0, 1, 0), ("t3", 0, 0, 0.0, 0, 0)]
