"""How each component attribute table is cleaned before its measures are summed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from featloom.functions.columns import by_name, require_unique
from featloom.operators.clean import (
    canonicalise,
    decode_flag,
    drop_value,
    fill_by_category,
    fill_constants,
    keep_below,
    override_where,
    replace_sentinel,
)
from featloom.operators.encode import VocabularySpec, fit_vocabularies
from featloom.operators.impute import RegressionStep, impute_chain_one_pass

# Thread pitch (threads per inch) and size (inches) of metric thread codes.
METRIC_PITCH = {"M6": 25.4, "M8": 20.32, "M10": 16.93, "M12": 14.51}
METRIC_SIZE = {"M6": 1 / 4, "M8": 5 / 16, "M10": 3 / 8, "M12": 1 / 2}

# Part names written in several ways.
PART_NAME_REWRITES = {
    "PLATE AS.": "PLATE AS",
    "TUBE AS.": "TUBE AS",
    "TUBE (BULK)": "TUBE",
    "TUBE AS-FUEL IN": "TUBE",
    "TUBE AS-O SUPPL": "TUBE",
    "SCREEN AS.": "SCREEN AS",
    "FLANGE AS.": "FLANGE AS",
    "ELBOW-OIL INLET": "ELBOW",
    "ELBOW-WATER": "ELBOW",
    "CLAMP-INJ LINE": "CLAMP",
    "ADAPTER-O DRAIN": "ADAPTER",
    "NUT-MALE PIPE": "NUT",
    "COVER-FRONT HSG": "COVER",
    "BRACKET AS.": "BRACKET",
    "FITTING-A/C": "FITTING",
    "TUBE AS-RH": "TUBE AS",
    "TUBE AS-LH": "TUBE AS",
}

# Weight of a part whose weight is missing, by part name.
PART_WEIGHTS = {
    "NUT-A/C": 0.032,
    "ADAPTER-O LINE": 0.277,
    "ADAPTER-A/C": 0.0585,
    "NUT-F INJ LINE": 0.044,
    "ADAPTER": 0.2255,
    "FITTING": 0.043,
    "FLANGE": 0.680,
    "PLATE AS": 0.3235,
    "WASHER": 0.018,
    "CONNECTOR-WELD": 0.0930,
    "NUT-SWIVEL": 0.01,
    "TUBE AS": 0.6140,
    "BRACKET": 0.1875,
    "ELBOW-HYDRAULIC": 2.930,
    "FLANGE AS": 0.01,
    "SCREEN AS": 0.5,
    "CONNECTOR-SEAL": 0.01,
    "TUBE": 2.1050,
    "NUT": 0.0325,
}


@dataclass(frozen=True)
class OneHotStep:
    column: str
    cutoff: int = 1
    rare_label: str | None = None


@dataclass(frozen=True)
class AttributeRecipe:
    """Steps in the order they run: flags, fixes, regressions, one-hots, measures."""

    table: str
    measures: tuple[str, ...]
    flags: tuple[str, ...] = ()
    sentinels: Mapping[str, float] = field(default_factory=dict)
    fills: Mapping[str, float] = field(default_factory=dict)
    at_most: Mapping[str, float] = field(default_factory=dict)
    metric_threads: bool = False
    regressions: tuple[RegressionStep, ...] = ()
    one_hots: tuple[OneHotStep, ...] = ()

    @property
    def suffix(self) -> str:
        return self.table.removeprefix("comp_")

    def with_steps(self, *extra: RegressionStep | OneHotStep) -> AttributeRecipe:
        """This recipe with optional steps added at the end."""
        return replace(
            self,
            regressions=self.regressions
            + tuple(s for s in extra if isinstance(s, RegressionStep)),
            one_hots=self.one_hots + tuple(s for s in extra if isinstance(s, OneHotStep)),
        )

    def prepare(self, table: DataFrame, component_id: str = "component_id") -> DataFrame:
        """One row per component: the key, then the suffixed measures, flags and indicators."""
        for column, limit in self.at_most.items():
            table = keep_below(table, column, limit, inclusive=True)
        if self.sentinels:
            table = table.withColumns(
                {c: replace_sentinel(by_name(c), k) for c, k in self.sentinels.items()}
            )
        if self.metric_threads:
            table = metric_threads(table)
        table = fill_constants(table, self.fills) if self.fills else table
        table = impute_chain_one_pass(table, self.regressions)
        measures = [by_name(m).cast("double").alias(f"{m}_{self.suffix}") for m in self.measures]
        flags = [decode_flag(by_name(f)).alias(f"{f}_{self.suffix}") for f in self.flags]
        hot, names = [], []
        specs = {s.column: VocabularySpec((s.column,), s.cutoff, s.rare_label) for s in self.one_hots}
        for column, vocab in (fit_vocabularies(table, specs) if specs else {}).items():
            wanted = [f"{column}_{label}_{self.suffix}" for label in vocab.labels]
            hot += [value.alias(name) for value, name in zip(vocab.matches(column), wanted)]
            names += wanted
        require_unique([component_id, *names])
        return table.select(by_name(component_id), *measures, *flags, *hot)


def metric_threads(table: DataFrame, size: str = "thread_size", pitch: str = "thread_pitch") -> DataFrame:
    """Metric codes to pitch and inches.

    Both are read off the code in one projection, so neither sees the other's result.
    """
    code = by_name(size)
    return table.withColumns({
        pitch: override_where(by_name(pitch), code, METRIC_PITCH),
        size: override_where(code.try_cast("double"), code, METRIC_SIZE),
    })


def clean_parts(table: DataFrame, name: str = "part_name", weight: str = "weight") -> DataFrame:
    """The catch-all part table: one name dropped, spellings merged, weights filled by name."""
    table = canonicalise(drop_value(table, name, "REQUIREMENT"), name, PART_NAME_REWRITES)
    return table.withColumn(
        weight, fill_by_category(by_name(weight), by_name(name), PART_WEIGHTS)
    )


# Sentinels, fill constants, limits, penalties and measures per table.
SLEEVE = AttributeRecipe(
    "comp_sleeve",
    sentinels={"length": 14.4},
    measures=("length", "intended_nut_pitch"),
)
ADAPTOR = AttributeRecipe(
    "comp_adaptor",
    flags=("unique_feature", "orientation"),
    fills={"thread_size_1": 0.68, "thread_pitch_1": 16.0, "nominal_size_1": 8.8},
    measures=(
        "overall_length", "length_1", "thread_size_1", "thread_pitch_1", "nominal_size_1",
        "length_2", "thread_size_2", "thread_pitch_2", "nominal_size_2", "hex_size", "weight",
    ),
)
BOSS = AttributeRecipe(
    "comp_boss",
    sentinels={"height_over_tube": 18.8},
    fills={"weight": 0.082},
    regressions=(
        RegressionStep("bolt_pattern_long", ("height_over_tube", "weight"), normalize=True),
        RegressionStep(
            "bolt_pattern_wide", ("height_over_tube", "weight", "bolt_pattern_long"),
            alpha=0.2, normalize=True,
        ),
    ),
    measures=("height_over_tube", "bolt_pattern_long", "bolt_pattern_wide", "weight"),
)
ELBOW = AttributeRecipe(
    "comp_elbow",
    flags=("groove",),
    fills={
        "bolt_pattern_long": 63.62, "bolt_pattern_wide": 33.24, "extension_length": 48.72,
        "overall_length": 83.25, "thickness": 46.55, "drop_length": 26.92,
    },
    measures=("bolt_pattern_long", "bolt_pattern_wide", "thickness", "drop_length", "weight"),
)
FLOAT = AttributeRecipe(
    "comp_float",
    flags=("orientation",),
    at_most={"weight": 2.5},
    measures=("bolt_pattern_long", "bolt_pattern_wide", "thickness", "weight"),
)
HFL = AttributeRecipe(
    "comp_hfl",
    flags=("plating", "orientation"),
    one_hots=(
        OneHotStep("corresponding_shell"), OneHotStep("coupling_class"), OneHotStep("material"),
    ),
    measures=("hose_diameter", "weight"),
)
NUT = AttributeRecipe(
    "comp_nut",
    metric_threads=True,
    fills={"weight": 0.07709},
    regressions=(
        RegressionStep(
            "hex_nut_size", ("length", "thread_pitch", "thread_size", "weight"), alpha=0.2
        ),
        RegressionStep(
            "diameter",
            ("hex_nut_size", "length", "thread_pitch", "thread_size", "weight"),
            alpha=0.2,
        ),
    ),
    measures=("hex_nut_size", "length", "thread_pitch", "diameter", "weight"),
)
STRAIGHT = AttributeRecipe(
    "comp_straight",
    flags=("orientation",),
    fills={"weight": 0.7884},
    regressions=(
        RegressionStep("bolt_pattern_wide", ("weight", "thickness"), alpha=0.2, normalize=True),
        RegressionStep("bolt_pattern_long", ("weight",), alpha=0.2, normalize=True),
        RegressionStep(
            "head_diameter", ("weight", "bolt_pattern_wide"), alpha=0.2, normalize=True
        ),
        RegressionStep("overall_length", ("weight", "bolt_pattern_wide", "thickness")),
    ),
    measures=(
        "bolt_pattern_long", "bolt_pattern_wide", "head_diameter", "overall_length",
        "thickness", "weight",
    ),
)
TEE = AttributeRecipe(
    "comp_tee",
    flags=("groove", "unique_feature"),
    one_hots=(OneHotStep("mj_class_code"),),
    measures=(
        "bolt_pattern_long", "bolt_pattern_wide", "extension_length", "overall_length",
        "thickness", "drop_length", "weight",
    ),
)
THREADED = AttributeRecipe(
    "comp_threaded",
    flags=("orientation",),
    fills={"weight": 0.2566},
    measures=(
        "adaptor_angle", "overall_length", "hex_size",
        "length_1", "thread_size_1", "thread_pitch_1",
        "length_2", "thread_size_2", "thread_pitch_2", "nominal_size_2",
        "length_3", "thread_size_3", "thread_pitch_3", "nominal_size_3",
        "length_4", "thread_size_4", "thread_pitch_4", "weight",
    ),
)
RECIPES: tuple[AttributeRecipe, ...] = (
    SLEEVE, ADAPTOR, BOSS, ELBOW, FLOAT, HFL, NUT, STRAIGHT, TEE, THREADED,
)

# Steps known for these tables but off unless added by ``with_steps``.
OPTIONAL_STEPS: dict[str, tuple[RegressionStep | OneHotStep, ...]] = {
    "comp_adaptor": (
        RegressionStep("hex_size", ("weight",), alpha=0.7, normalize=True),
        RegressionStep("overall_length", ("weight",), normalize=True),
    ),
    "comp_boss": (
        RegressionStep(
            "base_diameter", ("height_over_tube", "weight"), alpha=0.2, normalize=True
        ),
        RegressionStep(
            "shoulder_diameter", ("height_over_tube", "weight", "base_diameter"), normalize=True
        ),
        OneHotStep("type", 20, "RareBossType"),
        OneHotStep("outside_shape", 1, "RareOutsideShape"),
        OneHotStep("base_type", 1, "RareBaseType"),
    ),
    "comp_elbow": (
        OneHotStep("mj_class_code", 1, "RareClassCode"),
        OneHotStep("mj_plug_class_code", 1, "RarePlugClass"),
    ),
    "comp_nut": (
        RegressionStep("seat_angle", ("length", "hex_nut_size", "thread_pitch"), alpha=0.3),
    ),
    "comp_tee": (OneHotStep("mj_plug_class_code"),),
    "comp_threaded": (
        RegressionStep(
            "overall_length", ("weight",), alpha=0.1, normalize=True,
            log_target=True, cube_root_inputs=("weight",),
        ),
    ),
}

# Bend radius 9999 is predicted and 0 takes no part in the fit (optional).
BEND_RADIUS_STEP = RegressionStep(
    "bend_radius", ("diameter", "wall", "num_bends"), alpha=0.2,
    missing_value=9999, ignored_value=0,
)
