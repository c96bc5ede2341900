"""Price quotes to a model matrix, scoring of a test set, cross-validation."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name
from featloom.functions.scalars import date_parts, inverse_log
from featloom.operators.clean import decode_flag, drop_value
from featloom.operators.encode import (
    MAX_VALUES,
    Vocabulary,
    fit_column_vocab,
    fold_counts,
    one_hot,
)
from featloom.operators.joins import attach, keep_listed
from featloom.operators.model import (
    FEATURES,
    assemble,
    cross_validate,
    fit_gbt,
    materialize_matrix,
    number_array,
    predictions,
    slot_table,
    to_matrix,
    vector_parts,
    with_log_label,
)
from featloom.operators.sparse import Dictionary, dictionary_of, fit_dictionary, one_hot_vectors
from featloom.operators.split import group_folds, recombine
from featloom.plans.assemblies import KEY, Cutoffs, assembly_features, usable_tubes
from featloom.plans.recipes import RECIPES, AttributeRecipe
from featloom.session import in_parallel, materialize

# Columns that are replaced by derived ones, or name the row, before a model sees it.
NOT_FEATURES = (KEY, "supplier", "annual_usage", "min_order_quantity")


def usable_quotes(
    quotes: DataFrame, tubes: DataFrame, outlier_quantity: float | None = 2500
) -> DataFrame:
    """Quotes of usable tubes; one quantity is dropped as an outlier (None: keep all)."""
    if outlier_quantity is not None:
        quotes = drop_value(quotes, "quantity", outlier_quantity)
    return keep_listed(quotes, KEY, usable_tubes(tubes))


def quote_columns(df: DataFrame) -> DataFrame:
    """Row-local features of a quote: pricing flag, date parts, inverse usage and quantities."""
    df = df.withColumns({
        "bracket_pricing": decode_flag(by_name("bracket_pricing")),
        "inv_annual_usage": inverse_log(by_name("annual_usage")),
        "inv_min_order_quantity": inverse_log(by_name("min_order_quantity")),
        "inv_quantity": inverse_log(by_name("quantity")),
    })
    return date_parts(df, "quote_date")


@dataclass(frozen=True)
class QuoteEncoder:
    """Supplier vocabulary fitted on training quotes; every value seen there is kept."""

    suppliers: Vocabulary

    @classmethod
    def fit(cls, train: DataFrame, max_values: int = MAX_VALUES) -> QuoteEncoder:
        return cls(fit_column_vocab(train, "supplier", max_values=max_values))

    def transform(self, df: DataFrame) -> DataFrame:
        return one_hot(
            quote_columns(df), "supplier", self.suppliers.labels, prefixed=True, drop=False
        )


@dataclass(frozen=True)
class SparseQuoteEncoder:
    """The same for any number of suppliers: a dictionary table and a sparse part of the vector."""

    suppliers: Dictionary

    @classmethod
    def fit(cls, train: DataFrame) -> SparseQuoteEncoder:
        return cls(fit_dictionary(train, "supplier"))

    def matrix(self, table: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """The kept columns and one vector: the features as numbers, then the suppliers."""
        kept = list(dict.fromkeys([*keep, "supplier"]))
        numbers = to_matrix(table.select(*[by_name(c) for c in [*kept, *features]]), keep=kept)
        dense = assemble(numbers, features, kept).withColumnRenamed(FEATURES, "__numbers")
        hot = one_hot_vectors(dense, "supplier", self.suppliers, "__suppliers")
        joined = VectorAssembler(inputCols=["__numbers", "__suppliers"], outputCol=FEATURES).transform(hot)
        return joined.select(*[by_name(c) for c in keep], FEATURES)

    def slots(self, features: Sequence[str]) -> DataFrame:
        """(slot, label) of that vector."""
        own = self.suppliers.labels.select(
            (F.col("slot") + len(features)).alias("slot"), F.concat(F.lit("supplier_"), F.col("label")).alias("label")
        )
        return slot_table(features).unionByName(own)

    def with_slot(self, df: DataFrame, output: str) -> DataFrame:
        """Every row with the slot of its supplier, null for null and unseen ones."""
        listed = self.suppliers.table.select("value", F.col("slot").alias(output))
        return attach(df, listed, "supplier", "value")

    def vector(self, numbers: Column, features: Sequence[str], slot: str) -> Column:
        """The parts of the same vector from an array of the features and the slot."""
        parts = vector_parts(numbers, len(features), F.col(slot), self.suppliers.size)
        return parts.alias(FEATURES, metadata={"ml_attr": {"num_attrs": len(features) + self.suppliers.size}})


def quote_features(
    quotes: DataFrame, tables: Mapping[str, DataFrame], cutoffs: Cutoffs = Cutoffs(),
    recipes: tuple[AttributeRecipe, ...] = RECIPES, outlier_quantity: float | None = 2500,
) -> DataFrame:
    """The full feature table of training quotes, one row per quote."""
    if outlier_quantity is not None:
        quotes = drop_value(quotes, "quantity", outlier_quantity)
    assemblies, encoder = in_parallel([
        lambda: assembly_features(tables, cutoffs, recipes),
        lambda: QuoteEncoder.fit(usable_quotes(quotes, tables["tube"], None), cutoffs.max_values),
    ])
    return encoder.transform(attach(quotes, assemblies, KEY, how="inner"))


def feature_names(df: DataFrame, also: Sequence[str] = ()) -> list[str]:
    skipped = {*NOT_FEATURES, *also}
    return [c for c in df.columns if c not in skipped]


def score_test_set(
    train: DataFrame,
    test: DataFrame,
    tables: Mapping[str, DataFrame],
    cutoffs: Cutoffs = Cutoffs(),
    fit: Callable[[DataFrame], Model] = fit_gbt,
    cost: str = "cost",
    row_id: str = "id",
    outlier_quantity: float | None = 2500,
) -> DataFrame:
    """(id, cost) of every test quote of a usable tube.

    Assemblies are computed once for both sides; suppliers are those of the training side.
    """
    assemblies, encoder = in_parallel([
        lambda: assembly_features(tables, cutoffs),
        lambda: SparseQuoteEncoder.fit(usable_quotes(train, tables["tube"], outlier_quantity)),
    ])
    kept = train if outlier_quantity is None else drop_value(train, "quantity", outlier_quantity)
    # Both sides in one join, before which only they are narrow: the assemblies' wide rows stay
    # where they were summed, and nothing is written but the matrix.
    given = [by_name(c) for c in train.columns if c not in (cost, row_id)]
    sides = kept.select(*given, by_name(cost), F.lit(True).alias("__train")).unionByName(
        test.select(*given, by_name(row_id), F.lit(False).alias("__train")), allowMissingColumns=True
    )
    table = quote_columns(attach(encoder.with_slot(sides, "__slot"), assemblies, KEY, how="inner"))
    features = feature_names(table, (cost, row_id, "__train", "__slot"))
    matrix = materialize_matrix(with_log_label(table.select(
        by_name(cost), by_name(row_id), "__train", encoder.vector(number_array(features), features, "__slot")
    ), cost), "matrix")
    # Boosting reads its input many times; the features behind it are computed once.
    model = fit(matrix.where("__train").drop(row_id))
    return predictions(model, matrix.where("not __train"), [row_id], cost)


def cross_validated_score(
    train: DataFrame,
    tables: Mapping[str, DataFrame],
    cutoffs: Cutoffs = Cutoffs(),
    fit: Callable[[DataFrame], Model] = fit_gbt,
    base_split: float = 0.25,
    seed: int = 42,
    cost: str = "cost",
    swap: bool = True,
    outlier_quantity: float | None = 2500,
) -> tuple[DataFrame, DataFrame]:
    """Scores and importances of whole-assembly folds, both ways round.

    Suppliers are counted once, by fold; each pair's dictionary comes from those counts.
    """
    folds = int(1 / base_split)
    usable = usable_quotes(train, tables["tube"], outlier_quantity)
    folded = materialize(group_folds(usable, KEY, base_split, seed), "folds")
    assemblies, counts = in_parallel([
        lambda: assembly_features(tables, cutoffs),
        lambda: materialize(fold_counts(folded, "supplier", folds), "fold-counts"),
    ])
    encoders = {
        pair: SparseQuoteEncoder(dictionary_of(counts.where((F.col("pair") == pair) & (F.col("side") == "first"))))
        for pair in range(1, folds)
    }
    # Slots go to the narrow rows, which then come to the assemblies, whose wide rows stay.
    slotted = folded
    for pair, encoder in encoders.items():
        slotted = encoder.with_slot(slotted, f"__slot_{pair}")
    slots = [f"__slot_{pair}" for pair in encoders]
    table = quote_columns(attach(slotted, assemblies, KEY, how="inner"))
    features = feature_names(table, (cost, "fold", *slots))
    # The features are computed and written once, as arrays; a pair adds its suppliers.
    wide = materialize(
        table.select(by_name(cost), "fold", *slots, number_array(features).alias("__numbers")), "fold-features"
    )

    def scored(fold: int, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
        encoder = encoders[fold]

        def prepare(a: DataFrame, b: DataFrame):
            vector = encoder.vector(F.col("__numbers"), features, f"__slot_{fold}")
            return *(side.select(by_name(cost), vector) for side in (a, b)), encoder.slots(features)

        return cross_validate([(fold, first, second)], prepare, fit, cost, swap)

    parts = [scored(*pair) for pair in recombine(wide, folds)]
    scores, splits = (functools.reduce(DataFrame.unionByName, side) for side in zip(*parts))
    return scores, splits
