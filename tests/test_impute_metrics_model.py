import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from helpers import values
from featloom.operators import impute, metrics, model, split
from featloom.operators.impute import RegressionStep


@pytest.fixture(scope="module")
def measured():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 30] + [3, -2, 10, 100]
    y = x @ [2.0, -0.5, 4.0, 0.1] + 7 + rng.normal(size=300) * 0.3
    return x, y


@pytest.fixture
def frame(spark, measured):
    x, y = measured
    rows = [
        (i, *map(float, x[i]), None if i % 5 == 0 else float(y[i])) for i in range(len(y))
    ]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double")


def ridge(x, y, alpha, normalize):
    """Centred normal equations by numpy; unit-length columns if normalised."""
    xm, ym = x.mean(axis=0), y.mean()
    xc = x - xm
    norm = np.sqrt((xc**2).sum(axis=0)) if normalize else np.ones(x.shape[1])
    z = xc / norm
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - ym)) / norm
    return w, ym - w @ xm


@pytest.mark.parametrize("alpha,normalize", [(0.0, False), (0.0, True), (0.2, False), (0.7, True)])
def test_fit_is_the_ridge_solution(frame, measured, alpha, normalize):
    x, y = measured
    known = np.arange(300) % 5 != 0
    w, b = ridge(x[known], y[known], alpha, normalize)
    fit = impute.fit_linear(frame, "y", ["a", "b", "c", "d"], alpha, normalize)
    assert fit.rows == 240
    assert np.allclose(fit.weights, w, rtol=1e-9) and fit.intercept == pytest.approx(b, rel=1e-9)
    filled = impute.impute_regression(frame, "y", ["a", "b", "c", "d"], alpha, normalize)
    for row in filled.collect():
        expected = y[row.id] if known[row.id] else x[row.id] @ w + b
        assert row.y == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("normalize", [False, True])
def test_fit_agrees_with_spark_ml(frame, normalize):
    known = frame.where("y is not null")
    n, sigma = known.agg(F.count("y"), F.stddev_pop("y")).first()
    alpha = 0.2
    ml = LinearRegression(
        solver="normal", labelCol="y", elasticNetParam=0.0, standardization=normalize,
        regParam=alpha * sigma if normalize else alpha * sigma / n,
    ).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(known))
    fit = impute.fit_linear(frame, "y", ["a", "b"], alpha, normalize)
    assert np.allclose(fit.weights, ml.coefficients.toArray(), rtol=1e-6)
    assert fit.intercept == pytest.approx(ml.intercept, rel=1e-6)


def test_rows_without_predictor_are_neither_fitted_nor_filled(frame):
    holed = frame.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    filled = {r.id: r.y for r in impute.impute_regression(holed, "y", ["a"]).collect()}
    assert filled[0] is None and filled[5] is not None


def test_no_null_target_changes_nothing(frame):
    full = frame.where("y is not null")
    assert values(impute.impute_regression(full, "y", ["a"])) == values(full)


def test_no_known_target_changes_nothing(frame):
    empty = frame.withColumn("y", F.lit(None).cast("double"))
    assert impute.impute_regression(empty, "y", ["a"]).where("y is not null").count() == 0


def test_constant_target_and_predictor(frame):
    flat = frame.withColumn("y", F.when(F.col("y").isNotNull(), F.lit(4.0))).withColumn("b", F.lit(1.0))
    filled = impute.impute_regression(flat, "y", ["a", "b"], 0.2, True)
    assert {round(r.y, 9) for r in filled.collect()} == {4.0}


def test_sentinel_targets_are_predicted_and_zeros_ignored(spark):
    rows = [(float(i), 2.0 * i + 1) for i in range(1, 20)] + [(30.0, 9999.0), (1.0, 0.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, r double")
    out = RegressionStep("r", ("x",), missing_value=9999, ignored_value=0).apply(df)
    got = values(out.where("x in (30.0, 1.0, 2.0)"))
    assert got == [(1.0, 0.0), (1.0, pytest.approx(3)), (2.0, pytest.approx(5)),
                   (2.0, pytest.approx(5)), (30.0, pytest.approx(61))]


def test_log_target_with_cube_root_input(spark):
    rows = [(float(i), math.exp(0.5 * i ** (1 / 3) + 1)) for i in range(1, 30)] + [(64.0, None)]
    df = spark.createDataFrame(rows, "w double, y double")
    step = RegressionStep("y", ("w",), log_target=True, cube_root_inputs=("w",))
    assert step.apply(df).where("w = 64.0").first().y == pytest.approx(math.exp(3))


def test_chain_uses_filled_columns(spark):
    rows = [(float(i), 3.0 * i, 6.0 * i) for i in range(1, 9)] + [(10.0, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    out = impute.impute_chain(df, [RegressionStep("y", ("x",)), RegressionStep("z", ("y",))])
    assert out.where("x = 10.0").first().z == pytest.approx(60)


def test_rmsle(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (4.0, 4.0, 0.0, 2.0)], "a double, p double, b double, q double")
    one = metrics.rmsle(df, "a", "p").first().rmsle
    assert one == pytest.approx(math.sqrt(math.log(3 / 2) ** 2 / 2))
    many = metrics.rmsle(df, ["a", "b"], ["p", "q"]).first().rmsle
    squares = (math.log(4) - math.log(5)) ** 2 + (math.log(7) - math.log(5)) ** 2
    assert many == pytest.approx(math.sqrt(squares / 4))
    assert metrics.rmsle(df, "a", "a").first().rmsle == 0


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    y, p = np.array([1.0, 2, 4]), np.array([1.5, 2, 3])
    expected = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert metrics.r2(df, "y", "p").first().r2 == pytest.approx(expected)


def test_rankings(spark):
    scores = spark.createDataFrame(
        [(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (2, "b", 9.0), (2, "c", 8.0), (2, "a", 7.0)],
        "fold int, feature string, score double",
    )
    assert [r.feature for r in metrics.top_features(scores, 2).collect()] == ["b", "c"]
    assert values(metrics.top_feature_votes(scores, 2)) == [("a", 1), ("b", 2), ("c", 1)]
    mean = metrics.cv_scores(scores, "score").first()
    assert (mean.mean_score, mean.folds) == (5.0, 6)


@pytest.fixture
def matrix(spark):
    df = spark.range(2000).select(
        F.col("id"),
        (F.col("id") % 13).cast("double").alias("x.1"),
        (F.col("id") % 7).cast("double").alias("B-2"),
    ).withColumn("cost", F.exp(F.col("`x.1`") / 4) + F.col("B-2"))
    return model.with_log_label(model.assemble(df, ["x.1", "B-2"], ["id", "cost"]), "cost")


@pytest.mark.parametrize("fit", [
    lambda m: model.fit_gbt(m, rounds=10, depth=4, features_share=1.0),
    lambda m: model.fit_gbt(m, loss="absolute", rounds=10, depth=4, features_share=1.0),
    lambda m: model.fit_forest(m, trees=5, depth=6),
])
def test_models_beat_the_mean(matrix, fit):
    fitted = fit(matrix)
    scored = model.predictions(fitted, matrix, ["id", "cost"], "p")
    mean = matrix.agg(F.expm1(F.avg("label"))).first()[0]
    error = metrics.rmsle(scored, "cost", "p").first().rmsle
    baseline = metrics.rmsle(scored.withColumn("p", F.lit(mean)), "cost", "p").first().rmsle
    assert error < baseline / 2
    # Spark normalises importances per tree, so their order says little here.
    named = dict(model.importances(fitted, ["x.1", "B-2"]))
    assert sum(named.values()) == pytest.approx(1) and min(named.values()) > 0


def test_pca_projects(matrix):
    row = model.pca(matrix, components=1).first()
    assert len(row.pca) == 1


def test_cross_validation_scores_both_ways(matrix):
    folded = split.group_folds(matrix.drop("label"), "id")
    scores, importances = model.cross_validate(
        split.recombine(folded, 4), lambda a, b: (a, b, ["x", "b"]),
        lambda m: model.fit_forest(m, trees=2, depth=5),
    )
    assert values(scores, "fold", "direction") == sorted(
        (i, d) for i in (1, 2, 3) for d in ("forward", "swapped")
    )
    assert all(r.rmsle < 0.5 for r in scores.collect())
    assert importances.count() == 6
