"""Features of an assembly: its tube, its specs and its bill of materials.

Everything is brought to one row per assembly first, so the quotes, the large
side, are joined once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name
from featloom.functions.scalars import wall_volume
from featloom.operators.clean import decode_flag, keep_below, replace_sentinel
from featloom.operators.encode import (
    MAX_VALUES,
    VocabularySpec,
    fit_column_vocab,
    fit_vocabularies,
    one_hot,
)
from featloom.operators.joins import attach, attach_roles
from featloom.operators.reshape import unpivot_groups
from featloom.operators.rollup import (
    bill_rollup,
    end_counts,
    merge_components,
    named_components,
    pooled_components,
    spec_counts,
)
from featloom.plans.recipes import RECIPES, AttributeRecipe
from featloom.session import in_parallel, limit_methods, materialize_measured

KEY = "tube_assembly_id"
END_FLAGS = ("end_a_1x", "end_a_2x", "end_x_1x", "end_x_2x")
COMPONENT_SLOTS = {
    "component": [f"component_id_{i}" for i in range(1, 9)],
    "quantity": [f"quantity_{i}" for i in range(1, 9)],
}
SPEC_COLUMNS = [f"spec{i}" for i in range(1, 11)]


@dataclass(frozen=True)
class Cutoffs:
    """Counts below which a category is pooled."""

    material: int = 50
    end: int = 20
    spec: int = 2000
    component: int = 3000
    base_name: int = 1000
    connection: int = 100
    end_form: int = 100
    # Not fixed: the longest list that may become columns; longer ones are refused.
    max_values: int = MAX_VALUES


def usable_tubes(tubes: DataFrame, max_length: float = 9999) -> DataFrame:
    """Tubes of known length; quotes of the others are dropped."""
    return keep_below(tubes, "length", max_length)


def tube_features(
    tubes: DataFrame,
    end_forms: DataFrame,
    cutoffs: Cutoffs = Cutoffs(),
    max_length: float = 9999,
    bend_default: float = 31.75,
    key: str = KEY,
    unique_key: bool = True,
) -> DataFrame:
    """Usable tubes: material and end indicators, flags, volume, forming of both ends."""
    tubes = usable_tubes(tubes, max_length)
    vocabs = fit_vocabularies(tubes, {
        "material": VocabularySpec(("material_id",), cutoffs.material, "RareMaterial"),
        "end": VocabularySpec(("end_a", "end_x"), cutoffs.end, "RareEnd"),
    }, cutoffs.max_values)
    materials = vocabs["material"]
    tubes = tubes.withColumns({
        "material_id": materials.bucket("material_id"),
        "bend_radius": replace_sentinel(by_name("bend_radius"), bend_default),
        **{c: decode_flag(by_name(c)) for c in END_FLAGS},
        "volume": wall_volume(by_name("diameter"), by_name("wall"), by_name("length")),
    })
    tubes = one_hot(tubes, "material_id", materials.labels, prefixed=True)
    tubes = attach_roles(
        tubes, end_forms, "end_form_id",
        {"end_a": {"forming": "forming_a"}, "end_x": {"forming": "forming_x"}},
    )
    tubes = tubes.withColumns(
        {c: decode_flag(by_name(c)) for c in ("forming_a", "forming_x")}
    )
    tubes = end_counts(
        tubes, key, ("end_a", "end_x"), cutoffs.end, "RareEnd", unique_key=unique_key,
        prefix="end_", vocab=vocabs["end"],
    )
    return tubes.drop("num_bracket")


def connection_sources(tables: Mapping[str, DataFrame]):
    both = ("connection_type_id_1", "connection_type_id_2")
    return [
        (tables["comp_sleeve"], ["connection_type_id"]),
        (tables["comp_boss"], ["connection_type_id"]),
        (tables["comp_adaptor"], both),
        (tables["comp_threaded"], both),
    ]


def end_form_sources(tables: Mapping[str, DataFrame]):
    both = ("end_form_id_1", "end_form_id_2")
    return [(tables["comp_adaptor"], both), (tables["comp_threaded"], both)]


def component_type_sources(tables: Mapping[str, DataFrame]):
    return [(tables[recipe.table], ["component_type_id"]) for recipe in RECIPES]


def component_table(
    tables: Mapping[str, DataFrame],
    cutoffs: Cutoffs = Cutoffs(),
    recipes: tuple[AttributeRecipe, ...] = RECIPES,
) -> DataFrame:
    """Everything known of a component in one row: names, connections, ends, attributes."""
    pooled = [
        lambda: named_components(
            tables["components"], cutoffs.base_name, "RareBaseName", base=True, prefix="base_",
            max_values=cutoffs.max_values,
        )[0],
        lambda: pooled_components(
            connection_sources(tables), cutoffs.connection, "RareConnection",
            prefix="connection_", max_values=cutoffs.max_values,
        )[0],
        lambda: pooled_components(
            end_form_sources(tables), cutoffs.end_form, "RareEndForm", prefix="end_form_",
            max_values=cutoffs.max_values,
        )[0],
    ]
    prepared = [
        lambda recipe=recipe: recipe.prepare(tables[recipe.table]) for recipe in recipes
    ]
    return merge_components(in_parallel([*pooled, *prepared]))


def bill_slots(bill: DataFrame, key: str = KEY) -> DataFrame:
    """(key, component, quantity), one row per filled slot."""
    slots = unpivot_groups(bill, key, COMPONENT_SLOTS)
    return slots.where(F.col("component").isNotNull())


def bill_features(
    bill: DataFrame,
    tables: Mapping[str, DataFrame],
    cutoffs: Cutoffs = Cutoffs(),
    recipes: tuple[AttributeRecipe, ...] = RECIPES,
    key: str = KEY,
) -> DataFrame:
    """Bill of materials to one row per assembly, by one join and one aggregation."""
    vocab, (table, table_bytes) = in_parallel([
        lambda: fit_column_vocab(
            bill, COMPONENT_SLOTS["component"], cutoffs.component, "RareComponent", cutoffs.max_values
        ),
        # Its size in memory is taken on the way and decides how the slots meet it.
        lambda: materialize_measured(component_table(tables, cutoffs, recipes), "components"),
    ])
    return bill_rollup(
        bill_slots(bill, key), table, key, vocab, prefix="component_", table_bytes=table_bytes
    )


def assembly_features(
    tables: Mapping[str, DataFrame],
    cutoffs: Cutoffs = Cutoffs(),
    recipes: tuple[AttributeRecipe, ...] = RECIPES,
    key: str = KEY,
) -> DataFrame:
    """Tube, spec and bill features of every assembly with a usable tube."""
    limit_methods(tables["tube"].sparkSession)
    tubes, specs, bill = in_parallel([
        lambda: tube_features(tables["tube"], tables["tube_end_form"], cutoffs, key=key),
        lambda: spec_counts(
            tables["specs"], key, SPEC_COLUMNS, cutoffs.spec, prefix="spec_", max_values=cutoffs.max_values
        ),
        lambda: bill_features(tables["bill_of_materials"], tables, cutoffs, recipes, key),
    ])
    # One row per assembly on every side, so no key is hot.
    return attach(attach(tubes, specs, key, skew=False), bill, key, skew=False)
