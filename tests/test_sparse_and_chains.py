"""Dictionaries, sparse vectors, one-pass fits, vocabularies and models on cells."""

import random
import time

import pytest
from helpers import values
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from featloom.operators import encode, impute, metrics, model, rollup, sparse, split
from featloom.operators.impute import RegressionStep
from featloom.plans import recipes
from featloom.plans.quotes import SparseQuoteEncoder


def executions(spark):
    """How many queries the session has run to an end."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


# ---- dictionaries


def test_numbers_follow_the_order_over_all_parts(spark):
    words = [f"v{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(words)
    df = spark.createDataFrame([(w,) for w in words], "value string").repartition(7)
    got = {r.value: r.slot for r in sparse.number_rows(df, ["value"]).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_rare_values_share_the_last_slot(spark):
    rows = [("a",)] * 3 + [("b",)] * 2 + [("c",), ("d",), (None,), ("9999",), ("9999",)]
    df = spark.createDataFrame(rows, "kind string")
    fitted = sparse.fit_dictionary(df, "kind", 2, "Other", null_values=["9999"])
    assert fitted.size == 3
    assert values(fitted.table, "value", "slot") == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert values(fitted.labels, "slot", "label") == [(0, "a"), (1, "b"), (2, "Other")]


def test_counts_become_vectors(spark):
    rows = [("k1", "b", 2.0), ("k1", "a", 1.0), ("k1", "b", 3.0), ("k2", None, 5.0), ("k3", "zz", 1.0), ("k4", "a", 0.5)]
    df = spark.createDataFrame(rows, "k string, kind string, n double")
    fitted = sparse.fit_dictionary(df.where("k <> 'k3'"), "kind")
    assert values(sparse.sparse_counts(df, "k", "kind", fitted)) == [("k1", 0, 1), ("k1", 1, 2), ("k4", 0, 1)]
    vectors = sparse.count_vectors(df, "k", "kind", fitted, "v", "n")
    assert {r.k: r.v for r in vectors.collect()} == {
        "k1": SparseVector(2, {0: 1.0, 1: 5.0}), "k4": SparseVector(2, {0: 0.5})
    }
    assert values(sparse.vector_entries(vectors, "v")) == [("k1", 2, [0, 1], [1.0, 5.0]), ("k4", 2, [0], [0.5])]


def test_one_hot_vectors_keep_every_row(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "new"), (4, "a"), (4, "a")], "k int, kind string")
    fitted = sparse.fit_dictionary(df.where("k in (1, 4)"), "kind")
    got = sorted((r.k, sorted(r.v.indices)) for r in sparse.one_hot_vectors(df, "kind", fitted, "v").collect())
    assert got == [(1, [1]), (2, []), (3, []), (4, [0]), (4, [0])]


def test_twenty_thousand_suppliers_are_no_limit(spark):
    quotes = spark.range(40_000).select(
        F.concat(F.lit("S-"), F.col("id") % 20_000).alias("supplier"), (F.col("id") % 7).alias("quantity")
    )
    with pytest.raises(ValueError, match="frequent values"):
        encode.fit_column_vocab(quotes, "supplier")
    encoder = SparseQuoteEncoder.fit(quotes)
    matrix = encoder.matrix(quotes, ["quantity"], ["quantity"])
    row = matrix.where("quantity = 3").first()
    assert row.features.size == 20_001 and row.features.numNonzeros() == 2
    assert encoder.slots(["quantity"]).count() == 20_001
    assert matrix.count() == 40_000


def test_two_thousand_labels_are_planned_quickly(spark):
    tubes = spark.range(4000).select(
        "id", F.concat(F.lit("E"), F.col("id") % 2000).alias("end_a"), F.concat(F.lit("E"), F.col("id") % 1999).alias("end_x")
    )
    vocab = encode.fit_column_vocab(tubes, ["end_a", "end_x"], 2, "RareEnd")
    assert len(vocab.labels) == 2001
    began = time.perf_counter()
    wide = rollup.end_counts(tubes, "id", vocab=vocab)
    assert time.perf_counter() - began < 5
    assert len(wide.columns) == 2002


def test_matches_are_the_buckets(spark):
    df = spark.createDataFrame([("a",), ("b",), ("it's",), (None,), ("9999",), ("r",)], "`kind.x` string")
    vocab = encode.Vocabulary(("a", "it's"), "Rare")
    cells = [m.alias(f"m{i}") for i, m in enumerate(vocab.matches("kind.x", ["9999"]))]
    assert values(df.select(F.col("`kind.x`").alias("v"), *cells)) == [
        (None, 0, 0, 0), ("9999", 0, 0, 0), ("a", 1, 0, 0), ("b", 0, 0, 1), ("it's", 0, 1, 0), ("r", 0, 0, 1)
    ]


# ---- chains of fits in one pass


def table_of(spark, rows=400, seed=3):
    pick = random.Random(seed)

    def maybe(value, chance):
        return None if pick.random() < chance else value

    data = []
    for i in range(rows):
        w, h = pick.uniform(0, 9), pick.uniform(0, 5)
        a = 2 * w + h + pick.gauss(0, 1)
        b = a - 3 * h + pick.gauss(0, 1)
        data.append((i, maybe(w, 0.1), maybe(h, 0.2), maybe(a, 0.3), maybe(b, 0.4), maybe(abs(b) + 0.1, 0.3)))
    return spark.createDataFrame(data, "k int, w double, h double, a double, b double, c double")


CHAIN = (
    RegressionStep("a", ("w", "h"), alpha=0.2, normalize=True),
    RegressionStep("b", ("a", "h"), alpha=0.5),
    RegressionStep("h", ("w", "b")),
    RegressionStep("c", ("b", "w"), log_target=True),
)


def close(got, expected):
    got, expected = values(got), values(expected)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert [x is None for x in a] == [x is None for x in b]
        assert all(x is None or abs(x - y) < 1e-8 * (1 + abs(y)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_chain_in_one_pass_equals_one_pass_a_step(spark, seed):
    df = table_of(spark, seed=seed)
    close(impute.impute_chain_one_pass(df, CHAIN), impute.impute_chain(df, CHAIN))


def test_a_chain_takes_one_job(spark):
    df = table_of(spark)
    before = executions(spark)
    impute.impute_chain_one_pass(df, CHAIN)
    assert executions(spark) - before == 1


@pytest.mark.parametrize("recipe", [recipes.BOSS, recipes.NUT, recipes.STRAIGHT, recipes.THREADED, recipes.ADAPTOR])
def test_steps_of_the_recipes_are_linear(spark, recipe):
    steps = recipe.with_steps(*recipes.OPTIONAL_STEPS.get(recipe.table, ())).regressions
    names = sorted({c for s in steps for c in (s.target, *s.predictors)})
    pick = random.Random(len(names))
    rows = [tuple(None if pick.random() < 0.25 else pick.uniform(0.5, 9) for _ in names) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    close(impute.impute_chain_one_pass(df, steps), impute.impute_chain(df, steps))


def test_sentinels_and_left_out_values(spark):
    pick = random.Random(9)
    rows = [(pick.uniform(1, 5), pick.choice([0.0, 9999.0, pick.uniform(10, 90), None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "d double, r double")
    step = RegressionStep("r", ("d",), alpha=0.2, missing_value=9999, ignored_value=0)
    close(impute.impute_chain_one_pass(df, [step]), step.apply(df))


def test_chains_without_rows_or_steps(spark):
    df = table_of(spark).where("k < 0")
    assert impute.impute_chain_one_pass(df, CHAIN).count() == 0
    assert impute.impute_chain_one_pass(df, ()) is df
    with pytest.raises(ValueError, match="pass of its own"):
        impute.fit_chain(df, [CHAIN[3], RegressionStep("b", ("c",))])


# ---- vocabularies of a table, and of folds


def test_vocabularies_from_one_scan(spark):
    rows = [("a", "x", "x"), ("a", "y", None), ("b", "NONE", "x"), (None, "y", "z")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    specs = {
        "p": encode.VocabularySpec(("p",), 2, "RareP"),
        "both": encode.VocabularySpec(("q", "r"), 2, "RareQ", ("NONE",)),
        "q": encode.VocabularySpec(("q",)),
    }
    before = executions(spark)
    got = encode.fit_vocabularies(df, specs)
    assert executions(spark) - before == 1
    assert got["p"] == encode.Vocabulary(("a",), "RareP")
    assert got["both"] == encode.Vocabulary(("x", "y"), "RareQ")
    assert got["q"] == encode.Vocabulary(("NONE", "x", "y"), None)
    for name, spec in specs.items():
        assert got[name] == encode.fit_column_vocab(
            df, list(spec.columns), spec.cutoff, spec.rare_label, null_values=spec.null_values
        )
    with pytest.raises(ValueError, match="q: more than 2"):
        encode.fit_vocabularies(df, specs, max_values=2)
    with pytest.raises(ValueError, match="not text"):
        encode.fit_vocabularies(df.withColumn("n", F.lit(1)), {"n": encode.VocabularySpec(("n",))})


def test_fold_counts_are_those_of_the_sides(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 11 > 0, (F.col("id") % 4).cast("int")).alias("fold"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 13)).alias("s"),
    )
    got = values(encode.fold_counts(df, "s", 4))
    expected = []
    for i, first, second in split.recombine(df, 4):
        for side, rows in (("first", first), ("second", second)):
            expected += [(i, side, r.s, r["count"]) for r in rows.where("s is not null").groupBy("s").count().collect()]
    assert got == sorted(expected)


def test_fold_ends_need_few_jobs(spark):
    df = spark.range(5000).select((F.col("id") % 900).alias("g"))
    before = executions(spark)
    folded = split.group_folds(df, "g")
    assert executions(spark) - before <= 1
    sizes = [r["count"] for r in folded.groupBy("fold").count().orderBy("fold").collect()]
    assert sum(sizes) == 5000 and len(sizes) == 4 and min(sizes) > 1000
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert split.group_folds(df.limit(0), "g").count() == 0


# ---- models


def test_split_counts_are_those_of_the_trees(spark):
    df = spark.range(2000).select(
        (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.lit(1.0).alias("c"), ((F.col("id") % 10) * (F.col("id") % 7)).cast("double").alias("cost"),
    )
    matrix = model.with_log_label(model.assemble(df, ["a", "b", "c"], ["cost"]), "cost")
    for fitted in (model.fit_gbt(matrix, rounds=3, depth=3), model.fit_forest(matrix, trees=3, depth=3)):
        counted = {r.slot: r.splits for r in model.split_counts(fitted).collect()}
        nodes = sum(tree.numNodes for tree in fitted.trees)
        assert sum(counted.values()) == (nodes - len(fitted.trees)) // 2 and 2 not in counted
    names = {r.feature: r.score for r in model.named_splits(fitted, ["a", "b", "c"]).collect()}
    assert set(names) <= {"a", "b"}


def test_scores_with_a_row_unscored_are_no_number(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (4.0, 3.0)], "y double, p double")
    for score in (metrics.rmsle(df, "y", "p"), metrics.r2(df, "y", "p")):
        assert str(score.first()[0]) == "nan"
    assert metrics.r2(df.where("p is not null"), "y", "p").first()[0] == pytest.approx(1 - 1 / 4.5)
