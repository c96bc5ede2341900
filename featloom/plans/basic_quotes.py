"""The smaller quote feature set: component names and totals, no attribute tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name
from featloom.functions.scalars import date_parts, inverse_plus_one, leading_token
from featloom.operators.clean import (
    RAISE,
    decode_flag,
    decode_flag_strict,
    null_if_in,
    zero_fill,
)
from featloom.operators.encode import (
    VocabularySpec,
    bucket_rare,
    distribution,
    fit_column_vocab,
    fit_vocabularies,
    one_hot,
)
from featloom.operators.joins import attach, attach_roles
from featloom.operators.metrics import rmsle
from featloom.operators.model import (
    FEATURES,
    fit_gbt,
    materialize_matrix,
    number_array,
    predictions,
    vector_parts,
    with_log_label,
)
from featloom.operators.rollup import (
    bill_rollup,
    end_counts,
    merge_components,
    named_components,
    totals,
)
from featloom.operators.split import by_flag, group_holdout
from featloom.plans.assemblies import (
    COMPONENT_SLOTS,
    END_FLAGS,
    KEY,
    SPEC_COLUMNS,
    bill_slots,
)
from featloom.session import limit_methods, materialize


@dataclass(frozen=True)
class BasicCutoffs:
    """Counts below which a category is pooled."""

    material: int = 5
    end: int = 5
    component: int = 40
    base_name: int = 8
    name: int = 25
    supplier: int = 5


# Category words that mean "none".
NO_MATERIAL = ("9999", "NONE")
NO_COMPONENT = ("9999",)


def basic_tubes(
    tubes: DataFrame, end_forms: DataFrame, cutoffs: BasicCutoffs = BasicCutoffs()
) -> DataFrame:
    """Strict end flags, material and end indicators, pooled end counts, forming of both ends."""
    end = lambda *columns: VocabularySpec(columns, cutoffs.end, "RareEnd", NO_MATERIAL)
    vocabs = fit_vocabularies(tubes, {
        "material_id": VocabularySpec(("material_id",), cutoffs.material, "RareMaterial", NO_MATERIAL),
        "end_a": end("end_a"), "end_x": end("end_x"), "both": end("end_a", "end_x"),
    })
    ends = {c: f"{c}_bucket" for c in ("end_a", "end_x")}
    tubes = tubes.withColumns({
        **{c: decode_flag_strict(by_name(c)) for c in END_FLAGS},
        "material_id": vocabs["material_id"].bucket(
            null_if_in(by_name("material_id"), NO_MATERIAL)
        ),
        **{
            out: vocabs[c].bucket(null_if_in(by_name(c), NO_MATERIAL)) for c, out in ends.items()
        },
    })
    tubes = one_hot(
        tubes,
        ["material_id", *ends.values()],
        {"material_id": vocabs["material_id"].labels,
         **{out: vocabs[c].labels for c, out in ends.items()}},
        prefixed=True,
    )
    tubes = attach_roles(
        tubes, end_forms, "end_form_id",
        {"end_a": {"forming": "forming_a"}, "end_x": {"forming": "forming_x"}},
    )
    tubes = tubes.withColumns({
        c: decode_flag(by_name(c), on_null=0, on_other=RAISE) for c in ("forming_a", "forming_x")
    })
    return end_counts(
        tubes, KEY, ("end_a", "end_x"), cutoffs.end, "RareEnd", prefix="end_",
        null_values=NO_MATERIAL, vocab=vocabs["both"],
    )


def basic_bill(
    bill: DataFrame, components: DataFrame, cutoffs: BasicCutoffs = BasicCutoffs()
) -> DataFrame:
    """Totals, component quantities and name counts; bills without components have zeros."""
    vocab = fit_column_vocab(
        bill, COMPONENT_SLOTS["component"], cutoffs.component, "RareComponent",
        null_values=NO_COMPONENT,
    )
    vocabs = fit_vocabularies(
        components.select(by_name("name"), leading_token(by_name("name")).alias("base")), {
            "base": VocabularySpec(("base",), cutoffs.base_name, "RareNameType"),
            "name": VocabularySpec(("name",), cutoffs.name, "RareComponentName"),
        },
    )
    base_names, _ = named_components(
        components, cutoffs.base_name, "RareNameType", base=True, prefix="base_", vocab=vocabs["base"]
    )
    names, _ = named_components(
        components, cutoffs.name, "RareComponentName", prefix="name_", vocab=vocabs["name"]
    )
    table = merge_components([base_names.drop("base_RareNameType"), names])
    rolled = bill_rollup(
        bill_slots(bill), table, KEY, vocab, prefix="component_", null_values=NO_COMPONENT
    ).drop("total_components")
    summed = totals(
        bill.select(by_name(KEY), *[by_name(c) for c in COMPONENT_SLOTS["quantity"]]),
        summed={"components": COMPONENT_SLOTS["quantity"]},
    ).drop(*COMPONENT_SLOTS["quantity"])
    return zero_fill(attach(summed, rolled, KEY, skew=False))


def basic_specs(specs: DataFrame) -> DataFrame:
    return totals(specs, counted={"specs": SPEC_COLUMNS}).select(
        by_name(KEY), "total_specs", "has_specs"
    )


def basic_assemblies(
    tables: Mapping[str, DataFrame], cutoffs: BasicCutoffs = BasicCutoffs()
) -> DataFrame:
    limit_methods(tables["tube"].sparkSession)
    tubes = basic_tubes(tables["tube"], tables["tube_end_form"], cutoffs)
    bill = basic_bill(tables["bill_of_materials"], tables["components"], cutoffs)
    with_bill = attach(tubes, bill, KEY, skew=False)
    return attach(with_bill, basic_specs(tables["specs"]), KEY, skew=False)


def basic_quote_features(
    quotes: DataFrame,
    assemblies: DataFrame,
    fitted_on: DataFrame | None = None,
    cutoffs: BasicCutoffs = BasicCutoffs(),
) -> DataFrame:
    """All quotes, also those of unknown assemblies; suppliers bucketed as counted in ``fitted_on``."""
    counts = distribution(quotes if fitted_on is None else fitted_on, "supplier")
    df = bucket_rare(quotes, "supplier", counts, cutoffs.supplier, "RareSupplier")
    df = attach(df, assemblies, KEY, hot_from=quotes)
    df = df.withColumns({
        "bracket_pricing": decode_flag_strict(by_name("bracket_pricing")),
        "inv_annual_usage": inverse_plus_one(by_name("annual_usage")),
    })
    df = totals(df, positive={"has_boss": "num_boss"})
    return date_parts(
        df, "quote_date", ("year", "month", "dayofyear", "dayofweek", "day")
    )


# Columns that name a row and are no features.
NOT_FEATURES = (KEY, "supplier")


def _basic_matrices(
    train: DataFrame, test: DataFrame, tables: Mapping[str, DataFrame], cutoffs: BasicCutoffs,
    cost: str, keep: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Matrices of both sides, the first with its label; suppliers are bucketed as in training.

    Both sides meet the assemblies in one join, and nothing wide is written but the matrix.
    """
    given = [by_name(c) for c in train.columns if c not in {cost, *keep}]
    sides = train.select(*given, by_name(cost), F.lit(True).alias("__train")).unionByName(
        test.select(*given, *[by_name(c) for c in keep], F.lit(False).alias("__train")), allowMissingColumns=True
    )
    table = basic_quote_features(sides, basic_assemblies(tables, cutoffs), train, cutoffs)
    kept = list(dict.fromkeys([cost, *keep]))
    features = [c for c in table.columns if c not in {*NOT_FEATURES, *kept, "__train"}]
    parts = vector_parts(number_array(features), len(features))
    matrix = materialize_matrix(with_log_label(table.select(
        *[by_name(c) for c in kept], "__train",
        parts.alias(FEATURES, metadata={"ml_attr": {"num_attrs": len(features)}}),
    ), cost), "basic-matrix")
    return matrix.where("__train"), matrix.where("not __train")


def fit_absolute(matrix: DataFrame) -> Model:
    """Absolute loss, 1000 rounds of steps of 0.1 on 80 % of the rows, depth 15."""
    return fit_gbt(
        matrix, loss="absolute", rounds=1000, depth=15, step=0.1, subsample=0.8, features_share=1.0, min_rows=1
    )


def basic_score(
    train: DataFrame,
    test: DataFrame,
    tables: Mapping[str, DataFrame],
    cutoffs: BasicCutoffs = BasicCutoffs(),
    fit: Callable[[DataFrame], Model] = fit_absolute,
    cost: str = "cost",
    row_id: str = "id",
) -> DataFrame:
    """(id, cost) of every test quote, also those of unknown assemblies."""
    matrix, other = _basic_matrices(train, test, tables, cutoffs, cost, [row_id])
    model = fit(matrix.drop(row_id))
    return predictions(model, other, [row_id], cost)


def basic_holdout_score(
    quotes: DataFrame,
    tables: Mapping[str, DataFrame],
    cutoffs: BasicCutoffs = BasicCutoffs(),
    fit: Callable[[DataFrame], Model] = fit_absolute,
    share: float = 0.2,
    seed: int = 42,
    cost: str = "cost",
) -> DataFrame:
    """RMSLE on the quotes of whole assemblies that were held out."""
    flagged = materialize(group_holdout(quotes, KEY, share, seed), "basic-sides")
    test, train = by_flag(flagged, "is_test")
    matrix, other = _basic_matrices(train, test, tables, cutoffs, cost, [cost])
    model = fit(matrix)
    return rmsle(predictions(model, other, [cost], "predicted"), cost, "predicted")
