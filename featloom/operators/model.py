"""Feature matrix, regressors of the log label, prediction and cross-validation."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

from pyspark.ml import Model
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from featloom.functions.columns import by_name
from featloom.operators.metrics import cv_scores, rmsle, top_feature_votes
from featloom.session import (
    checkpoint_dir,
    drop_files,
    in_parallel,
    materialize,
    one_file_a_task,
    scratch_path,
)

FEATURES = "features"
DEEP = 10
LABEL = "label"
# A fit keeps its rows in memory, task by task: so many bytes in one.
FIT_BYTES = 128 << 20
UNKNOWN_WIDTH = 300


def to_matrix(df: DataFrame, exclude: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Every column but the excluded as a double, null as 0; ``keep`` ones stay as they are."""
    kept, dropped = set(keep), set(exclude)
    return df.select(
        *[
            by_name(n) if n in kept
            else F.coalesce(by_name(n).cast("double"), F.lit(0.0)).alias(n)
            for n in df.columns
            if n not in dropped
        ]
    )


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features as one vector column beside the kept columns."""
    # VectorAssembler reads names as paths, so give it plain ones.
    plain = [f"f{i}" for i in range(len(features))]
    renamed = df.select(
        *[by_name(c) for c in keep],
        *[by_name(c).cast("double").alias(p) for c, p in zip(features, plain)],
    )
    assembled = VectorAssembler(inputCols=plain, outputCol=FEATURES).transform(renamed)
    return assembled.drop(*plain)


def number_array(features: Sequence[str]) -> Column:
    """The features of a row as one array of doubles; null is 0, NaN an error as in a vector."""
    if not features:
        return F.array().cast("array<double>")
    numbers = F.array(*[F.coalesce(by_name(c).cast("double"), F.lit(0.0)) for c in features])
    odd = F.raise_error(F.lit("NaN among the features")).cast("array<double>")
    return F.when(F.array_contains(numbers, F.lit(float("nan"))), odd).otherwise(numbers)


def vector_parts(numbers: Column, width: int, slot: Column | None = None, slots: int = 0) -> Column:
    """The numbers, and a 1 in one of the further slots, as the parts a vector is stored in.

    Vectors have no constructor among Spark's functions, but written out (by
    :func:`materialize_matrix`) the parts are read back as vectors.  With more slots than
    numbers the vector is sparse.  A null slot sets none.
    """
    if slots <= width:
        hot = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: i.eqNullSafe(slot).cast("double"))
        values = F.concat(numbers, hot) if slots else numbers
        nothing = F.lit(None)
        kind, size, indices = F.lit(1), nothing.cast("int"), nothing.cast("array<int>")
    else:
        cells = F.filter(F.transform(numbers, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda c: c.x != 0)
        own = F.when(slot.isNotNull(), F.array(F.struct((slot + width).alias("i"), F.lit(1.0).alias("x"))))
        cells = F.concat(cells, F.coalesce(own, F.slice(cells, 1, 0)))
        kind, size, indices, values = F.lit(0), F.lit(width + slots), cells.i, cells.x
    return F.struct(
        kind.cast("tinyint").alias("type"), size.alias("size"), indices.alias("indices"), values.alias("values")
    )


def with_log_label(df: DataFrame, cost: str) -> DataFrame:
    return df.withColumn(LABEL, F.log1p(by_name(cost)))


def materialize_matrix(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize` for a fit: a file holds no more rows than a task can keep.

    Parts of vectors (:func:`vector_parts`) are read back as vectors.
    """
    known = df.schema[FEATURES].metadata if FEATURES in df.columns else {}
    width = known.get("ml_attr", {}).get("num_attrs", UNKNOWN_WIDTH)
    schema = None
    if FEATURES in df.columns and isinstance(df.schema[FEATURES].dataType, StructType):
        schema = StructType([
            StructField(FEATURES, VectorUDT(), True, known) if f.name == FEATURES else f for f in df.schema
        ])
    return materialize(df, name, max(1, FIT_BYTES // (8 * (width + 32))), schema)


def fit_gbt(
    matrix: DataFrame,
    loss: str = "squared",
    rounds: int = 50,
    depth: int = 5,
    step: float = 0.1,
    subsample: float = 0.7,
    features_share: float = 0.75,
    min_rows: int = 20,
    seed: int = 42,
    checkpoint_every: int = 10,
) -> Model:
    """Boosted trees on the label column.  Statistics of all splits are summed on executors.

    The running prediction is checkpointed to the shared folder, so a long run
    survives the loss of an executor without replaying every round.  Deep trees also
    keep each row's node instead of walking the tree again.
    """
    checkpoint_dir(matrix.sparkSession)
    regressor = GBTRegressor(
        featuresCol=FEATURES, labelCol=LABEL, lossType=loss, maxIter=rounds, maxDepth=depth,
        stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=str(features_share),
        minInstancesPerNode=min_rows, seed=seed, cacheNodeIds=depth > DEEP,
        checkpointInterval=checkpoint_every,
    )
    with one_file_a_task(matrix.sparkSession):
        return regressor.fit(matrix)


def fit_forest(
    matrix: DataFrame, trees: int = 50, depth: int = 15, min_rows: int = 1, seed: int = 42,
    checkpoint_every: int = 10,
) -> Model:
    checkpoint_dir(matrix.sparkSession)
    regressor = RandomForestRegressor(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_rows, seed=seed, cacheNodeIds=depth > DEEP,
        checkpointInterval=checkpoint_every,
    )
    with one_file_a_task(matrix.sparkSession):
        return regressor.fit(matrix)


def pca(matrix: DataFrame, components: int = 20, fitted_on: DataFrame | None = None) -> DataFrame:
    """Project the feature vector on its main components."""
    model = PCA(k=components, inputCol=FEATURES, outputCol="pca").fit(
        matrix if fitted_on is None else fitted_on
    )
    return model.transform(matrix)


def predictions(model: Model, matrix: DataFrame, keep: Sequence[str], cost: str = "cost") -> DataFrame:
    """The kept columns and the prediction on the scale of the cost."""
    scored = model.transform(matrix)
    return scored.select(*[by_name(c) for c in keep], F.expm1("prediction").alias(cost))


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """How much each feature lowers the loss, on the scale of Spark ML."""
    return [(name, float(s)) for name, s in zip(features, model.featureImportances.toArray())]


def split_counts(model: Model) -> DataFrame:
    """(slot, splits): at how many nodes of all trees a slot of the feature vector is split.

    The model is saved to the shared folder and its table of nodes is counted there.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    # The nodes of a forest are nested beside the number of their tree.
    split = "nodeData.split" if "nodeData" in nodes.columns else "split"
    slots = nodes.select(F.col(f"{split}.featureIndex").alias("slot")).where("slot >= 0")
    return slots.groupBy("slot").agg(F.count(F.lit(1)).alias("splits"))


def slot_table(features: Sequence[str]) -> DataFrame:
    """(slot, label) of plain columns, in their order in the feature vector."""
    return SparkSession.active().createDataFrame(list(enumerate(features)), "slot int, label string")


def named_splits(model: Model, names: Sequence[str] | DataFrame) -> DataFrame:
    """(feature, score): the number of splits by name; a long list of names is a table (slot, label)."""
    table = names if isinstance(names, DataFrame) else slot_table(names)
    return split_counts(model).join(table, "slot").select(
        F.col("label").alias("feature"), F.col("splits").cast("double").alias("score")
    )


def cross_validate(
    pairs: Iterable[tuple[int, DataFrame, DataFrame]],
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, Sequence[str] | DataFrame]],
    fit: Callable[[DataFrame], Model],
    cost: str = "cost",
    swap: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Score every pair, and its swap if asked.

    ``prepare(train, test)`` fits encodings on the first side and returns both as
    matrices with a cost and a feature vector, and the feature names.  Gives the
    scores (fold, direction, rmsle) and the importances (fold, feature, score), the
    score being the number of splits; both have a few rows per fold.
    """
    scores, ranked, spark = [], [], None
    for fold, first, second in pairs:
        spark = first.sparkSession
        train, test, features = prepare(first, second)
        # Boosting reads its input many times; written out it survives lost executors.
        train, test = in_parallel([
            lambda side=side, name=name: materialize_matrix(with_log_label(side, cost), name)
            for side, name in ((train, "fold-train"), (test, "fold-test"))
        ])
        directions = [("forward", train, test)] + ([("swapped", test, train)] if swap else [])
        for direction, a, b in directions:
            model = fit(a)
            scored = predictions(model, b, [cost], "predicted")
            scores.append((fold, direction, rmsle(scored, cost, "predicted").first()[0]))
            if direction == "forward":
                ranked.append(named_splits(model, features).withColumn("fold", F.lit(fold)))
        # Scored: the next pair's matrices take their place on disk.
        drop_files(train)
        drop_files(test)
    if spark is None:
        raise ValueError("no pair to score")
    return (
        spark.createDataFrame(scores, "fold int, direction string, rmsle double"),
        functools.reduce(DataFrame.unionByName, ranked).select("fold", "feature", "score"),
    )


def cv_summary(scores: DataFrame, importances: DataFrame, k: int = 20) -> DataFrame:
    """(feature, votes, mean_score, folds): in how many folds a feature is among the ``k``
    most split, beside the mean of all scores and their number."""
    means = cv_scores(scores)
    return top_feature_votes(importances, k).select(
        "feature", "votes", means.select("mean_score").scalar().alias("mean_score"),
        means.select("folds").scalar().alias("folds"),
    )
