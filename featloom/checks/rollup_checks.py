"""Checks of roll-ups, splits, imputation, metrics, and the feature plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.checks.encode_checks import (
    BILL_SQL,
    CONNECTIONS_SQL,
    END_FORMS_SQL,
    BASE_NAMES_SQL,
    long_form,
    slots_and,
)
from featloom.checks.registry import check
from featloom.checks.row_checks import MISSING_PRICE, TUBE_VOLUME
from featloom.checks.standins import stand_in, stand_ins, table, with_stand_ins
from featloom.functions.columns import by_name
from featloom.operators import impute, metrics, rollup, split
from featloom.plans.assemblies import (
    COMPONENT_SLOTS,
    SPEC_COLUMNS,
    Cutoffs,
    tube_features as plan_tube_features,
)
from featloom.plans.basic_quotes import (
    BasicCutoffs,
    basic_assemblies,
    basic_bill as plan_basic_bill,
    basic_quote_features as plan_basic_quotes,
    basic_tubes as plan_basic_tubes,
)
from featloom.plans.quotes import quote_features as plan_quote_features
from featloom.plans.recipes import (
    BEND_RADIUS_STEP,
    BOSS,
    ELBOW,
    NUT,
    ADAPTOR,
    TEE,
    THREADED,
    OPTIONAL_STEPS,
    RECIPES,
    STRAIGHT,
    clean_parts,
)
from featloom.session import in_parallel, materialize_measured

KEY = "tube_assembly_id"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[
        F.round(by_name(c), digits).alias(c) if kind == "double" else by_name(c)
        for c, kind in df.dtypes
    ])


# ---- regression as SQL: the normal equations, solved by elimination in one-row CTEs

def regression_ctes(
    name: str, source: str, target: str, predictors: list[str], alpha: float = 0.0,
    normalize: bool = False, absent: str | None = None, ignored: str = "false",
    y: str | None = None, x: dict[str, str] | None = None, back: str = "{}",
) -> str:
    """CTEs that end in ``name``: the source with absent targets replaced by predictions."""
    absent = absent or f"{target} is null"
    inputs = [(x or {}).get(p, p) for p in predictors]
    k = len(inputs)
    columns = ", ".join(f"cast({e} as double) as x{i}" for i, e in enumerate(inputs))
    complete = " and ".join(["y is not null", *[f"x{i} is not null" for i in range(k)]])
    moments = ["count(*) as n", "avg(y) as my"]
    moments += [f"avg(x{i}) as m{i}" for i in range(k)]
    moments += [f"covar_pop(y, x{i}) * count(*) as c{i}" for i in range(k)]
    moments += [
        f"covar_pop(x{i}, x{j}) * count(*) as s{i}_{j}" for i in range(k) for j in range(i, k)
    ]
    # Each list is one CTE, so that no expression is spelled out inside another.
    steps: list[list[str]] = [[]]
    for i in range(k):
        for j in range(i, k):
            extra = ""
            if i == j and alpha:
                extra = f" + {alpha}e0 * " + (f"s{i}_{i}" if normalize else "1")
            steps[0].append(f"s{i}_{j}{extra} as a{i}_{j}")
    for j in range(k):
        steps.append([
            f"a{j}_{j}" + "".join(f" - l{j}_{m} * l{j}_{m} * d{m}" for m in range(j)) + f" as d{j}"
        ])
        steps.append([
            f"(a{j}_{i}" + "".join(f" - l{i}_{m} * l{j}_{m} * d{m}" for m in range(j))
            + f") / d{j} as l{i}_{j}"
            for i in range(j + 1, k)
        ])
    for i in range(k):
        steps.append([f"c{i}" + "".join(f" - l{i}_{m} * z{m}" for m in range(i)) + f" as z{i}"])
    for i in reversed(range(k)):
        steps.append([
            f"z{i} / d{i}" + "".join(f" - l{m}_{i} * w{m}" for m in range(i + 1, k)) + f" as w{i}"
        ])
    solved, previous = [], f"{name}_m"
    for number, columns_ in enumerate(filter(None, steps)):
        solved.append(
            f"{name}_s{number} as materialized (select *, {', '.join(columns_)} from {previous})"
        )
        previous = f"{name}_s{number}"
    predicted = "my" + "".join(
        f" + w{i} * (cast({e} as double) - m{i})" for i, e in enumerate(inputs)
    )
    return f"""{name}_fit as (select * from (select cast({y or target} as double) as y, {columns}
        from {source} where not ({absent}) and not ({ignored})) where {complete}),
    {name}_m as (select {", ".join(moments)} from {name}_fit),
    {", ".join(solved)},
    {name}_w as (select my, {", ".join(f"m{i}, w{i}" for i in range(k))} from {previous}),
    {name} as (select s.* replace (case when {absent} then {back.format(predicted)}
        else {target} end as {target}) from {source} s, {name}_w)"""


def flag_sql(column: str) -> str:
    return f"case when {column} in ('Yes', 'Y') then 1 when {column} in ('No', 'N') then 0 " \
           f"when {column} is null then 0 end"


def hot_sql(column: str, values: list[str]) -> dict[str, str]:
    return {f"{column}_{v}": f"case when {column} = '{v}' then 1 else 0 end" for v in values}


# Per table: CTEs that clean it, the last of them, its measures, flags and indicators.
P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ATTRIBUTE_SQL: dict[str, tuple[str, str, list[str], list[str], dict[str, str]]] = {
    "sleeve": (
        "sleeve_1 as (select * replace (case when length = 9999 then 14.4e0 else length end "
        "as length) from comp_sleeve)",
        "sleeve_1", ["length", "intended_nut_pitch"], [], {},
    ),
    "adaptor": (
        "adaptor_1 as (select * replace (coalesce(thread_size_1, 0.68e0) as thread_size_1, "
        "coalesce(thread_pitch_1, 16e0) as thread_pitch_1, coalesce(nominal_size_1, 8.8e0) "
        "as nominal_size_1) from comp_adaptor)",
        "adaptor_1",
        ["overall_length", "length_1", "thread_size_1", "thread_pitch_1", "nominal_size_1",
         "length_2", "thread_size_2", "thread_pitch_2", "nominal_size_2", "hex_size", "weight"],
        ["unique_feature", "orientation"], {},
    ),
    "boss": (
        "boss_1 as (select * replace (case when height_over_tube = 9999 then 18.8e0 "
        "else height_over_tube end as height_over_tube, coalesce(weight, 0.082e0) as weight) "
        "from comp_boss), "
        + regression_ctes("boss_2", "boss_1", "bolt_pattern_long",
                          ["height_over_tube", "weight"], 0, True) + ", "
        + regression_ctes("boss_3", "boss_2", "bolt_pattern_wide",
                          ["height_over_tube", "weight", "bolt_pattern_long"], 0.2, True),
        "boss_3", ["height_over_tube", "bolt_pattern_long", "bolt_pattern_wide", "weight"], [], {},
    ),
    "elbow": (
        "elbow_1 as (select * replace (coalesce(bolt_pattern_long, 63.62e0) as bolt_pattern_long, "
        "coalesce(bolt_pattern_wide, 33.24e0) as bolt_pattern_wide, "
        "coalesce(thickness, 46.55e0) as thickness, "
        "coalesce(drop_length, 26.92e0) as drop_length) from comp_elbow)",
        "elbow_1",
        ["bolt_pattern_long", "bolt_pattern_wide", "thickness", "drop_length", "weight"],
        ["groove"], {},
    ),
    "float": (
        "float_1 as (select * from comp_float where weight <= 2.5e0)",
        "float_1", ["bolt_pattern_long", "bolt_pattern_wide", "thickness", "weight"],
        ["orientation"], {},
    ),
    "hfl": (
        "hfl_1 as (select * from comp_hfl)", "hfl_1", ["hose_diameter", "weight"],
        ["plating", "orientation"],
        {**hot_sql("corresponding_shell", P_TYPES),
         **hot_sql("coupling_class", ["SP-0098", "SP-0099"]),
         **hot_sql("material", ["SP-0016", "SP-0098"])},
    ),
    "nut": (
        "nut_1 as (select * replace (case thread_size when 'M6' then 25.4e0 when 'M8' then 20.32e0 "
        "when 'M10' then 16.93e0 when 'M12' then 14.51e0 else thread_pitch end as thread_pitch, "
        "case thread_size when 'M6' then 0.25e0 when 'M8' then 0.3125e0 when 'M10' then 0.375e0 "
        "when 'M12' then 0.5e0 else try_cast(thread_size as double) end as thread_size, "
        "coalesce(weight, 0.07709e0) as weight) from comp_nut), "
        + regression_ctes("nut_2", "nut_1", "hex_nut_size",
                          ["length", "thread_pitch", "thread_size", "weight"], 0.2) + ", "
        + regression_ctes(
            "nut_3", "nut_2", "diameter",
            ["hex_nut_size", "length", "thread_pitch", "thread_size", "weight"], 0.2),
        "nut_3", ["hex_nut_size", "length", "thread_pitch", "diameter", "weight"], [], {},
    ),
    "straight": (
        "straight_1 as (select * replace (coalesce(weight, 0.7884e0) as weight) "
        "from comp_straight), "
        + regression_ctes("straight_2", "straight_1", "bolt_pattern_wide",
                          ["weight", "thickness"], 0.2, True) + ", "
        + regression_ctes("straight_3", "straight_2", "bolt_pattern_long",
                          ["weight"], 0.2, True) + ", "
        + regression_ctes("straight_4", "straight_3", "head_diameter",
                          ["weight", "bolt_pattern_wide"], 0.2, True) + ", "
        + regression_ctes("straight_5", "straight_4", "overall_length",
                          ["weight", "bolt_pattern_wide", "thickness"]),
        "straight_5",
        ["bolt_pattern_long", "bolt_pattern_wide", "head_diameter", "overall_length",
         "thickness", "weight"],
        ["orientation"], {},
    ),
    "tee": (
        "tee_1 as (select * from comp_tee)", "tee_1",
        ["bolt_pattern_long", "bolt_pattern_wide", "extension_length", "overall_length",
         "thickness", "drop_length", "weight"],
        ["groove", "unique_feature"], hot_sql("mj_class_code", ["MJ-1", "MJ-2"]),
    ),
    "threaded": (
        "threaded_1 as (select * replace (coalesce(weight, 0.2566e0) as weight) "
        "from comp_threaded)",
        "threaded_1",
        ["adaptor_angle", "overall_length", "hex_size",
         "length_1", "thread_size_1", "thread_pitch_1",
         "length_2", "thread_size_2", "thread_pitch_2", "nominal_size_2",
         "length_3", "thread_size_3", "thread_pitch_3", "nominal_size_3",
         "length_4", "thread_size_4", "thread_pitch_4", "weight"],
        ["orientation"], {},
    ),
}


def prepared_sql(kind: str) -> str:
    """CTEs of a cleaned table, ending in ``prepared_<kind>``."""
    steps, last, measures, flags, hot = ATTRIBUTE_SQL[kind]
    columns = [f"{m} as {m}_{kind}" for m in measures]
    columns += [f"{flag_sql(f)} as {f}_{kind}" for f in flags]
    columns += [f'{e} as "{name}_{kind}"' for name, e in hot.items()]
    return f"{steps}, prepared_{kind} as (select component_id, {', '.join(columns)} from {last})"


def summed_sql(kind: str, digits: int = 3) -> list[str]:
    _, _, measures, flags, hot = ATTRIBUTE_SQL[kind]
    columns = [f"round(sum({m}_{kind}), {digits}) as {m}_{kind}" for m in measures]
    names = [f"{f}_{kind}" for f in [*flags, *hot]]
    return columns + [f'cast(sum("{n}") as bigint) as "{n}"' for n in names]


def attribute_query(recipe):
    def query(spark, folder):
        slots, tables = slots_and(spark, folder, recipe.table)
        summed = rollup.attributes(slots, recipe.prepare(tables[recipe.table]), KEY)
        return rounded(summed, 3)

    return query


for _recipe in RECIPES:
    check(
        f"""with {BILL_SQL}, {with_stand_ins(_recipe.table)}, {prepared_sql(_recipe.suffix)}
        select tube_assembly_id, {", ".join(summed_sql(_recipe.suffix))}
        from slots join prepared_{_recipe.suffix} on component = component_id group by 1""",
        name=f"attributes_{_recipe.suffix}",
    )(attribute_query(_recipe))


ATTRIBUTE_TABLES = [recipe.table for recipe in RECIPES]
ATTRIBUTE_KINDS = [recipe.suffix for recipe in RECIPES]


ATTRIBUTES_SQL = f"""with {BILL_SQL}, {with_stand_ins(*ATTRIBUTE_TABLES)},
    {", ".join(prepared_sql(kind) for kind in ATTRIBUTE_KINDS)}
    select tube_assembly_id, {", ".join(c for kind in ATTRIBUTE_KINDS for c in summed_sql(kind))}
    from slots {" ".join(f"left join prepared_{kind} on component = prepared_{kind}.component_id"
                         for kind in ATTRIBUTE_KINDS)} group by 1"""


def merged_attributes(spark, folder):
    slots, tables = slots_and(spark, folder, *ATTRIBUTE_TABLES)
    prepared = in_parallel([
        lambda recipe=recipe: recipe.prepare(tables[recipe.table]) for recipe in RECIPES
    ])
    return slots, rollup.merge_components(prepared)


@check(ATTRIBUTES_SQL)
def attributes_rollup(spark, folder):
    """All ten tables at once: merged into one, joined once, summed once."""
    slots, merged = merged_attributes(spark, folder)
    return rounded(rollup.sum_components(slots, merged, KEY), 3)


@check(ATTRIBUTES_SQL)
def attributes_rollup_measured(spark, folder):
    """The same with the merged table written out and sent to the slots only if it is small in memory."""
    slots, merged = merged_attributes(spark, folder)
    table_, size = materialize_measured(merged, "attributes")
    return rounded(rollup.sum_components(slots, table_, KEY, table_bytes=size), 3)


@check(ATTRIBUTES_SQL)
def attributes_rollup_shuffled(spark, folder):
    """The form for tables too large in memory: slots summed by order and component, then shuffled."""
    slots, merged = merged_attributes(spark, folder)
    return rounded(rollup.sum_components(slots, merged, KEY, table_bytes=1 << 62), 3)


@check(f"""with {BILL_SQL}, {with_stand_ins("comp_other")},
    named as (select component_id, case part_name when 'TUBE AS.' then 'TUBE AS'
        when 'FITTING-A/C' then 'FITTING' else part_name end as part_name, weight
        from comp_other where part_name <> 'REQUIREMENT' or part_name is null),
    filled as (select component_id, coalesce(weight, case part_name when 'TUBE AS' then 0.614e0
        when 'FITTING' then 0.043e0 when 'NUT' then 0.0325e0 end) as weight from named)
    select tube_assembly_id, round(sum(weight), 6) as weight from slots
    join filled on component = component_id group by 1""")
def attributes_other(spark, folder):
    slots, tables = slots_and(spark, folder, "comp_other")
    table_ = clean_parts(tables["comp_other"]).drop("part_name")
    return rounded(rollup.attributes(slots, table_, KEY), 6)


@check(f"""with {BILL_SQL}, {with_stand_ins("comp_other")}
    select tube_assembly_id, part_name as category, count(*) as n from slots
    join comp_other on component = component_id where part_name is not null group by 1, 2""")
def part_name_counts(spark, folder):
    slots, tables = slots_and(spark, folder, "comp_other")
    hot, _ = rollup.named_components(
        tables["comp_other"], 10, "RarePartName", name="part_name"
    )
    return long_form(rollup.attributes(slots, hot, KEY), KEY, "category", "n")


# ---- optional steps of the recipes

def prepare_check(recipe, *targets: str):
    def query(spark, folder):
        full = recipe.with_steps(*OPTIONAL_STEPS[recipe.table])
        prepared = full.prepare(stand_in(spark, folder, recipe.table))
        suffixed = [f"{t}_{recipe.suffix}" for t in targets]
        hot = [c for c in prepared.columns if any(
            c.startswith(f"{s.column}_") for s in full.one_hots)]
        return rounded(prepared.select("component_id", *map(by_name, suffixed + hot)), 3)

    return query


def with_measures(recipe, *names: str):
    from dataclasses import replace
    return replace(recipe, measures=recipe.measures + names)


BOSS_FULL = with_measures(BOSS, "base_diameter", "shoulder_diameter")
check(f"""with {with_stand_ins("comp_boss")}, {ATTRIBUTE_SQL["boss"][0]}, {regression_ctes(
        "boss_4", "boss_3", "base_diameter", ["height_over_tube", "weight"], 0.2, True)},
    {regression_ctes("boss_5", "boss_4", "shoulder_diameter",
        ["height_over_tube", "weight", "base_diameter"], 0, True)}
    select component_id, round(base_diameter, 3) as base_diameter_boss,
    round(shoulder_diameter, 3) as shoulder_diameter_boss,
    {", ".join(f'{e} as "{n}_boss"' for n, e in {
        **hot_sql("type", P_TYPES), "type_RareBossType": "0",
        **hot_sql("outside_shape", ["LARGE", "SMALL"]),
        **hot_sql("base_type", ["Flat", "Saddle"])}.items())} from boss_5""",
    name="boss_optional_steps",
)(prepare_check(BOSS_FULL, "base_diameter", "shoulder_diameter"))

check(f"""with {with_stand_ins("comp_elbow")} select component_id,
    {", ".join(f'{e} as "{n}_elbow"' for n, e in {
        **hot_sql("mj_class_code", ["MJ-1", "MJ-2"]),
        **hot_sql("mj_plug_class_code", ["MJ-2", "MJ-3"])}.items())} from comp_elbow""",
    name="elbow_optional_steps",
)(prepare_check(ELBOW))

check(f"""with {with_stand_ins("comp_tee")} select component_id,
    {", ".join(f'{e} as "{n}_tee"' for n, e in {
        **hot_sql("mj_class_code", ["MJ-1", "MJ-2"]),
        **hot_sql("mj_plug_class_code", ["MJ-5", "Threaded"])}.items())} from comp_tee""",
    name="tee_optional_steps",
)(prepare_check(TEE))

check(f"""with {with_stand_ins("comp_nut")}, {ATTRIBUTE_SQL["nut"][0]}, {regression_ctes(
        "nut_4", "nut_3", "seat_angle", ["length", "hex_nut_size", "thread_pitch"], 0.3)}
    select component_id, round(seat_angle, 3) as seat_angle_nut from nut_4""",
    name="nut_optional_steps",
)(prepare_check(with_measures(NUT, "seat_angle"), "seat_angle"))

check(f"""with {with_stand_ins("comp_adaptor")}, {regression_ctes(
        "a_1", "comp_adaptor", "hex_size", ["weight"], 0.7, True)}, {regression_ctes(
        "a_2", "a_1", "overall_length", ["weight"], 0, True)}
    select component_id, round(hex_size, 3) as hex_size_adaptor,
    round(overall_length, 3) as overall_length_adaptor from a_2""",
    name="adaptor_optional_steps",
)(prepare_check(ADAPTOR, "hex_size", "overall_length"))

check(f"""with {with_stand_ins("comp_threaded")}, {ATTRIBUTE_SQL["threaded"][0]}, {regression_ctes(
        "t_2", "threaded_1", "overall_length", ["weight"], 0.1, True,
        y="ln(overall_length)", x={"weight": "cbrt(weight)"}, back="exp({})")}
    select component_id, round(overall_length, 3) as overall_length_threaded from t_2""",
    name="threaded_optional_steps",
)(prepare_check(THREADED, "overall_length"))


# ---- imputation over the lines

LINES_SQL = f"""lines as (select l_orderkey, l_linenumber, l_quantity, l_tax, l_discount,
    {MISSING_PRICE} as price from lineitem)"""


def impute_lines(spark, folder, predictors, **how):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount",
        f"{MISSING_PRICE} as price",
    )
    filled = impute.impute_regression(df, "price", predictors, **how)
    return filled.select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"))


def impute_lines_sql(predictors, alpha=0.0, normalize=False) -> str:
    ctes = regression_ctes("filled", "lines", "price", predictors, alpha, normalize)
    return f"with {LINES_SQL}, {ctes} " \
           "select l_orderkey, l_linenumber, round(price, 2) as price from filled"


@check(impute_lines_sql(["l_quantity", "l_tax"]))
def impute_ols(spark, folder):
    return impute_lines(spark, folder, ["l_quantity", "l_tax"])


@check(f"""with {LINES_SQL}, fit as (select regr_slope(price, l_quantity) / 1.2e0 as w,
    avg(price) as my, avg(l_quantity) as mx from lines where price is not null)
    select l_orderkey, l_linenumber, round(coalesce(price, my + w * (l_quantity - mx)), 2) as price
    from lines, fit""")
def impute_ridge_1(spark, folder):
    return impute_lines(spark, folder, ["l_quantity"], alpha=0.2, normalize=True)


@check(impute_lines_sql(["l_quantity", "l_discount"], 0.2, True))
def impute_ridge_2(spark, folder):
    return impute_lines(spark, folder, ["l_quantity", "l_discount"], alpha=0.2, normalize=True)


@check(impute_lines_sql(["l_quantity", "l_tax", "l_discount"], 0.3, False))
def impute_ridge_raw(spark, folder):
    return impute_lines(spark, folder, ["l_quantity", "l_tax", "l_discount"], alpha=0.3)


@check(f"""with {with_stand_ins("comp_straight")}, {ATTRIBUTE_SQL["straight"][0]}
    select component_id, round(bolt_pattern_wide, 3) as bolt_pattern_wide,
    round(bolt_pattern_long, 3) as bolt_pattern_long, round(head_diameter, 3) as head_diameter,
    round(overall_length, 3) as overall_length from straight_5""")
def impute_chain(spark, folder):
    df = stand_in(spark, folder, "comp_straight").na.fill(STRAIGHT.fills)
    filled = impute.impute_chain(df, STRAIGHT.regressions)
    return rounded(filled.select(
        "component_id", "bolt_pattern_wide", "bolt_pattern_long", "head_diameter", "overall_length"
    ), 3)


@check(f"""with {with_stand_ins("tube")}, {regression_ctes(
        "filled", "tube", "bend_radius", ["diameter", "wall", "num_bends"], 0.2,
        absent="bend_radius = 9999", ignored="bend_radius = 0")}
    select tube_assembly_id, round(bend_radius, 3) as bend_radius from filled""")
def impute_bend_radius(spark, folder):
    filled = BEND_RADIUS_STEP.apply(stand_in(spark, folder, "tube"))
    return rounded(filled.select(KEY, "bend_radius"), 3)


# ---- specs, ends, totals, tubes

SPEC_ROWS = " union all ".join(f"select tube_assembly_id, {c} as code from specs" for c in SPEC_COLUMNS)


@check(f"""with {with_stand_ins("specs")}, codes as ({SPEC_ROWS}),
    counts as (select code as v, count(*) as n from codes where code is not null group by 1)
    select tube_assembly_id, code as category, count(*) as n from codes join counts on code = v
    where counts.n >= 2000 group by 1, 2
    union all select tube_assembly_id, 'has_specs', 1 from specs
    where {" or ".join(f"{c} is not null" for c in SPEC_COLUMNS)}""")
def spec_counts(spark, folder):
    wide = rollup.spec_counts(stand_in(spark, folder, "specs"), KEY, SPEC_COLUMNS, 2000)
    return long_form(wide, KEY, "category", "n")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_PAIRS = "select user_id, event_type as a, case when value > 30 then event_type end as b from events"


@check(f"""with pairs as ({EVENT_PAIRS}), codes as (select user_id, a as code from pairs
    union all select user_id, b from pairs), grouped as (select user_id, {", ".join(
        f"cast(count(*) filter (where code = '{t}') as bigint) as \"{t}\"" for t in EVENT_TYPES)}
    from codes group by 1)
    select pairs.user_id, case when a is not null or b is not null then 1 else 0 end as has_specs,
    {", ".join(f'"{t}"' for t in EVENT_TYPES)} from pairs join grouped
    on pairs.user_id = grouped.user_id""")
def spec_counts_grouped(spark, folder):
    """Several rows per key: codes are counted per key and joined back to each row."""
    pairs = table(spark, folder, "events").selectExpr(
        "user_id", "event_type as a", "case when value > 30 then event_type end as b"
    )
    return rollup.spec_counts(pairs, "user_id", ["a", "b"], 1, unique_key=False)


ENDS = ["9999", *[f"EF-{i}" for i in range(8)], "NONE"]


def end_sql(values, prefix="", columns=("end_a", "end_x"), rare="RareEnd") -> str:
    cells = [
        " + ".join(f"case when {c} = '{v}' then 1 else 0 end" for c in columns)
        + f' as "{prefix}{v}"'
        for v in values
    ]
    return ", ".join([*cells, f'0 as "{prefix}{rare}"'])


@check(f"""with {with_stand_ins("tube")} select tube_assembly_id, {end_sql(ENDS)} from tube""")
def end_counts(spark, folder):
    tubes = stand_in(spark, folder, "tube").select(KEY, "end_a", "end_x")
    return rollup.end_counts(tubes, KEY, cutoff=20)


@check(f"""with pairs as ({EVENT_PAIRS}), codes as (select user_id, a as code from pairs
    union all select user_id, b from pairs), grouped as (select user_id, {", ".join(
        f"cast(count(*) filter (where code = '{t}') as bigint) as \"{t}\"" for t in EVENT_TYPES)},
    cast(0 as bigint) as "RareEnd" from codes group by 1)
    select grouped.* from pairs join grouped on pairs.user_id = grouped.user_id""")
def end_counts_grouped(spark, folder):
    pairs = table(spark, folder, "events").selectExpr(
        "user_id", "event_type as a", "case when value > 30 then event_type end as b"
    )
    return rollup.end_counts(pairs, "user_id", ("a", "b"), cutoff=20, unique_key=False)


@check(f"""with {with_stand_ins("bill_of_materials")} select tube_assembly_id,
    {" + ".join(f"case when component_id_{i} is null then 0 else 1 end" for i in range(1, 9))}
        as total_slots, 1 as has_slots,
    {" + ".join(f"coalesce(quantity_{i}, 0)" for i in range(1, 9))} as total_components,
    1 as has_components, case when quantity_7 > 0 then 1 else 0 end as has_seventh
    from bill_of_materials""")
def totals(spark, folder):
    df = rollup.totals(
        stand_in(spark, folder, "bill_of_materials"),
        counted={"slots": COMPONENT_SLOTS["component"]},
        summed={"components": COMPONENT_SLOTS["quantity"]},
        positive={"has_seventh": "quantity_7"},
    )
    return df.drop(*COMPONENT_SLOTS["component"], *COMPONENT_SLOTS["quantity"])


MATERIALS = ["9999", *[f"SP-{i}" for i in range(1, 6)]]
TUBE_SQL = f"""tubes as (select * from tube where length < 9999),
    tube_rows as (select tube_assembly_id, diameter, wall, length, num_bends,
    case when bend_radius = 9999 then 31.75e0 else bend_radius end as bend_radius,
    {", ".join(f"{flag_sql(c)} as {c}" for c in ("end_a_1x", "end_a_2x", "end_x_1x", "end_x_2x"))},
    num_boss, {TUBE_VOLUME} as volume,
    {", ".join(f"case when material_id = '{m}' then 1 else 0 end as \"material_id_{m}\""
               for m in MATERIALS)}, 0 as "material_id_RareMaterial",
    {flag_sql("fa.forming")} as forming_a, {flag_sql("fx.forming")} as forming_x,
    {end_sql(ENDS, "end_")}
    from tubes left join tube_end_form fa on end_a = fa.end_form_id
    left join tube_end_form fx on end_x = fx.end_form_id)"""


@check(f"""with {with_stand_ins("tube", "tube_end_form")}, {TUBE_SQL}
    select * replace (round(volume, 5) as volume) from tube_rows""")
def tube_features(spark, folder):
    tables = stand_ins(spark, folder, "tube", "tube_end_form")
    features = plan_tube_features(tables["tube"], tables["tube_end_form"], PLAN_CUTOFFS)
    return features.withColumn("volume", F.round("volume", 5))


# ---- splits

GROUPS_SQL = """g as (select l_orderkey as k, count(*) as n,
        md5('42:' || cast(l_orderkey as string)) as h from lineitem group by 1),
    r as (select k, n, sum(n) over (order by h, k) as upto, sum(n) over () as total from g),
    q as (select *, upto - n as before, round_even(total * 0.25e0, 0) as quota from r)"""


@check(f"""with {GROUPS_SQL},
    e1 as (select min(upto) as e from q where upto >= quota),
    e2 as (select min(upto) as e from q where upto >= quota + (select e from e1)),
    e3 as (select min(upto) as e from q where upto >= quota + (select e from e2))
    select l_orderkey, l_linenumber, {" + ".join(
        f"coalesce(cast(before >= (select e from e{i}) as int), 0)" for i in (1, 2, 3))} as fold
    from lineitem join q on l_orderkey = k""")
def group_folds(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return split.group_folds(df, "l_orderkey")


CARRY_SQL = f"""{GROUPS_SQL}, folded as (select l_orderkey, l_linenumber,
    cast(least(3, floor(before / quota)) as int) as fold from lineitem join q on l_orderkey = k)"""


@check(f"with {CARRY_SQL} select * from folded")
def group_folds_carry(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return split.group_folds(df, "l_orderkey", rule="carry")


@check(f"with {CARRY_SQL} " + " union all ".join(
    f"select {i} as pair, case when fold in (0, {i}) then 'train' else 'test' end as side, "
    "count(*) as n, count(distinct l_orderkey) as groups from folded group by 1, 2"
    for i in (1, 2, 3)))
def recombine(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    folded = split.group_folds(df, "l_orderkey", rule="carry")
    parts = []
    for i, train, test in split.recombine(folded, 4):
        for side, rows in (("train", train), ("test", test)):
            parts.append(rows.agg(
                F.lit(i).alias("pair"), F.lit(side).alias("side"),
                F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("groups"),
            ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@check("""with g as (select l_orderkey as k, count(*) as n,
        md5('42:' || cast(l_orderkey as string)) as h from lineitem group by 1),
    r as (select k, sum(n) over (order by h, k) - n as before, sum(n) over () as total from g)
    select l_orderkey, l_linenumber, before <= round_even(total * 0.2e0, 0) as is_test
    from lineitem join r on l_orderkey = k""")
def group_holdout(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return split.group_holdout(df, "l_orderkey")


@check("""select l_orderkey, l_linenumber, l_partkey, not (cast('0x' || substr(md5('42|' ||
    cast(l_orderkey as string) || '|' || cast(l_linenumber as string) || '|' ||
    cast(l_partkey as string)), 1, 8) as bigint) / 4294967296e0 < 1 - 0.2e0) as is_test
    from lineitem""")
def row_holdout(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return split.row_holdout(df, ["l_orderkey", "l_linenumber", "l_partkey"], share=0.2)


# ---- metrics

def scored_lines(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_linenumber", "l_partkey", "l_extendedprice as answer",
        "l_quantity as answer_2", "l_quantity * 1000e0 as guess", "25e0 as guess_2",
    )


ERROR_SQL = "pow(ln(1 + l_quantity * 1000e0) - ln(1 + l_extendedprice), 2)"


@check(f"select round(sqrt(avg({ERROR_SQL})), 8) as rmsle from lineitem")
def rmsle(spark, folder):
    return rounded(metrics.rmsle(scored_lines(spark, folder), "answer", "guess"), 8)


@check("""select round(sqrt(sum(pow(ln(1 + l_quantity * 1000e0 + 25) -
    ln(1 + l_extendedprice + l_quantity), 2)) / (count(*) * 2)), 8) as rmsle from lineitem""")
def rmsle_multi(spark, folder):
    scored = scored_lines(spark, folder)
    return rounded(
        metrics.rmsle(scored, ["answer", "answer_2"], ["guess", "guess_2"]), 8
    )


@check("""select round(1 - sum(pow(l_extendedprice - l_quantity * 1000e0, 2)) /
    (var_pop(l_extendedprice) * count(*)), 8) as r2 from lineitem""")
def r2(spark, folder):
    return rounded(metrics.r2(scored_lines(spark, folder), "answer", "guess"), 8)


@check(f"""select round(avg(s), 8) as mean_score, count(*) as folds from
    (select sqrt(avg({ERROR_SQL})) as s from lineitem group by l_returnflag)""")
def cv_scores(spark, folder):
    scores = metrics.rmsle(scored_lines(spark, folder), "answer", "guess", by=["l_returnflag"])
    return rounded(metrics.cv_scores(scores), 8)


BRAND_SCORES = """select l_linenumber as fold, p_brand as feature, sum(l_quantity) as score
    from lineitem join part on l_partkey = p_partkey group by 1, 2"""


def brand_scores(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    lines = table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(
        F.col("l_linenumber").alias("fold"), F.col("p_brand").alias("feature")
    ).agg(F.sum("l_quantity").alias("score"))


@check(f"""select feature, sum(score) as score from ({BRAND_SCORES}) group by 1
    order by score desc, feature limit 20""")
def top_features(spark, folder):
    scores = brand_scores(spark, folder).groupBy("feature").agg(F.sum("score").alias("score"))
    return metrics.top_features(scores, 20)


@check(f"""select feature, count(*) as votes from (select *, row_number() over (partition by fold
    order by score desc, feature) as r from ({BRAND_SCORES})) where r <= 20 group by 1""")
def top_feature_votes(spark, folder):
    return metrics.top_feature_votes(brand_scores(spark, folder), 20)


# ---- the feature plans

# Low cutoffs keep every category at any scale, so that the columns can be written in SQL;
# pooling of rare ones is checked above.
PLAN_CUTOFFS = Cutoffs(
    material=5, end=5, spec=20, base_name=5, connection=5, end_form=5
)
BASE_NAMES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
CONNECTIONS = [f"B-{i}" for i in range(8)]
END_FORMS = ["9999", *[f"A-{i}" for i in range(7)]]
SPECS = ["SP-A", "SP-AF", "SP-AO", "SP-F", "SP-N", "SP-NF", "SP-NO", "SP-O", "SP-R", "SP-RF",
         "SP-RO"]
SUPPLIERS = [f"S-{i}" for i in range(25)]
KINDS = ATTRIBUTE_KINDS


def pooled_sql(name: str, source: str, values: list[str], prefix: str, rare: str) -> str:
    cells = ", ".join(
        f"count(*) filter (where value = '{v}') as \"{prefix}{v}\"" for v in values
    )
    return f'{name} as (select component_id, {cells}, 0 as "{prefix}{rare}" ' \
           f"from ({source}) group by 1)"


def bill_sql() -> str:
    """CTEs that end in ``bill``: one row per assembly with every component feature."""
    names = BASE_NAMES_SQL.replace("as name", "as value")
    counted = [
        pooled_sql("base_names", names, BASE_NAMES, "base_", "RareBaseName"),
        pooled_sql("connections", CONNECTIONS_SQL, CONNECTIONS, "connection_", "RareConnection"),
        pooled_sql("end_forms", END_FORMS_SQL, END_FORMS, "end_form_", "RareEndForm"),
    ]
    count_names = [
        *[f"base_{v}" for v in [*BASE_NAMES, "RareBaseName"]],
        *[f"connection_{v}" for v in [*CONNECTIONS, "RareConnection"]],
        *[f"end_form_{v}" for v in [*END_FORMS, "RareEndForm"]],
    ]
    sums = [f'cast(sum("{n}") as bigint) as "{n}"' for n in count_names]
    for kind in KINDS:
        sums += summed_sql(kind)
    joins = " ".join(
        f"left join {t} on component = {t}.component_id"
        for t in ["base_names", "connections", "end_forms", *[f"prepared_{k}" for k in KINDS]]
    )
    return ", ".join(counted + [prepared_sql(k) for k in KINDS]) + f""",
        bill as (select tube_assembly_id, sum(quantity) as total_components,
        sum(quantity) as "component_RareComponent", {", ".join(sums)}
        from slots {joins} group by 1)"""


SPEC_SQL = f"""spec_rows as (select tube_assembly_id,
    case when {" or ".join(f"{c} is not null" for c in SPEC_COLUMNS)} then 1 else 0 end as has_specs,
    {", ".join(" + ".join(f"case when {c} = '{v}' then 1 else 0 end" for c in SPEC_COLUMNS)
               + f' as "spec_{v}"' for v in SPECS)} from specs)"""


def rounded_number(x: Column, digits: int) -> Column:
    """``round`` of a double, which goes through text and is slow on wide tables.

    Away from halves the nearest whole number of units is the rounded one, and dividing it by a
    power of ten gives the double nearest to that decimal, as ``round`` does.  Halves, large numbers
    and what is no number are left to ``round``.
    """
    scaled = x * float(10**digits)
    clear = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-5)
    # Adding 0 makes 0 of -0.
    return F.when(clear, F.rint(scaled) / float(10**digits) + 0.0).otherwise(F.round(x, digits))


def rounded_features(features: DataFrame) -> DataFrame:
    inverse = {"inv_annual_usage", "inv_min_order_quantity", "inv_quantity"}
    exact = {"cost", "wall", "total_components", "component_RareComponent"}
    digits = {**{c: 8 for c in inverse}, "volume": 5}
    return features.select(*[
        rounded_number(by_name(c), digits.get(c, 3)).alias(c)
        if kind == "double" and c not in exact else by_name(c)
        for c, kind in features.dtypes
    ])


PLAN_TABLES = (
    "quotes", "tube", "tube_end_form", "specs", "components", *[r.table for r in RECIPES],
)


@check(f"""with {BILL_SQL}, {with_stand_ins(*PLAN_TABLES)}, {TUBE_SQL}, {SPEC_SQL}, {bill_sql()}
    select q.* exclude (quote_date) replace ({flag_sql("bracket_pricing")} as bracket_pricing),
    t.* exclude (tube_assembly_id) replace (round(volume, 5) as volume),
    s.* exclude (tube_assembly_id), b.* exclude (tube_assembly_id),
    {", ".join(f"round(case when {c} = 0 then 0 else 1 / ln(1 + {c}) end, 8) as inv_{c}"
               for c in ("annual_usage", "min_order_quantity", "quantity"))},
    cast(year(quote_date) as int) as year, cast(month(quote_date) as int) as month,
    cast(dayofyear(quote_date) as int) as dayofyear,
    cast(isodow(quote_date) - 1 as int) as dayofweek,
    {", ".join(f"case when supplier = '{v}' then 1 else 0 end as \"supplier_{v}\""
               for v in SUPPLIERS)}
    from quotes q join tube_rows t on q.tube_assembly_id = t.tube_assembly_id
    left join spec_rows s on q.tube_assembly_id = s.tube_assembly_id
    left join bill b on q.tube_assembly_id = b.tube_assembly_id
    where quantity <> 50""")
def quote_features(spark, folder):
    """Every quote with tube, spec, bill, attribute, date and supplier features."""
    tables = stand_ins(spark, folder)
    features = plan_quote_features(
        stand_in(spark, folder, "quotes"), tables, PLAN_CUTOFFS, outlier_quantity=50
    )
    return rounded_features(features)


BASIC_CUTOFFS = BasicCutoffs(component=10**6, base_name=5, name=10**6, supplier=5)
BASIC_MATERIALS = [f"SP-{i}" for i in range(1, 6)]
BASIC_ENDS = [f"EF-{i}" for i in range(8)]


def prefixed_sql(column: str, values: list[str], rare: str, out: str) -> str:
    cells = [f"case when {column} = '{v}' then 1 else 0 end as \"{out}_{v}\"" for v in values]
    return ", ".join([*cells, f'0 as "{out}_{rare}"'])


BASIC_TUBE_SQL = f"""strict_tube as (select * replace (coalesce(end_x_2x, 'N') as end_x_2x) from tube),
    basic_tubes as (select tube_assembly_id, diameter, wall, length, num_bends, bend_radius,
    {", ".join(f"{flag_sql(c)} as {c}" for c in ("end_a_1x", "end_a_2x", "end_x_1x", "end_x_2x"))},
    num_boss, num_bracket,
    {prefixed_sql("material_id", BASIC_MATERIALS, "RareMaterial", "material_id")},
    {prefixed_sql("end_a", BASIC_ENDS, "RareEnd", "end_a_bucket")},
    {prefixed_sql("end_x", BASIC_ENDS, "RareEnd", "end_x_bucket")},
    {flag_sql("fa.forming")} as forming_a, {flag_sql("fx.forming")} as forming_x,
    {end_sql(BASIC_ENDS, "end_")}
    from strict_tube left join tube_end_form fa on end_a = fa.end_form_id
    left join tube_end_form fx on end_x = fx.end_form_id)"""


def basic_tables(spark, folder):
    tables = stand_ins(
        spark, folder, "tube", "tube_end_form", "bill_of_materials", "components", "specs"
    )
    return {**tables, "tube": tables["tube"].na.fill({"end_x_2x": "N"})}


@check(f"""with {with_stand_ins("tube", "tube_end_form")}, {BASIC_TUBE_SQL}
    select * from basic_tubes""")
def basic_tubes(spark, folder):
    tables = basic_tables(spark, folder)
    return plan_basic_tubes(tables["tube"], tables["tube_end_form"], BASIC_CUTOFFS)


def basic_bill_sql() -> str:
    base = ", ".join(
        f"count(*) filter (where base = '{v}') as \"base_{v}\"" for v in BASE_NAMES
    )
    quantities = " + ".join(f"coalesce(quantity_{i}, 0)" for i in range(1, 9))
    return f"""named as (select component_id, name,
        nullif(regexp_extract(name, '^([^ -]+)', 1), '') as base from components),
    basic_rolled as (select tube_assembly_id, sum(quantity) as "component_RareComponent", {base},
        count(name) as "name_RareComponentName"
        from slots left join named on component = component_id group by 1),
    basic_bill as (select b.tube_assembly_id, {quantities} as total_components,
        case when {quantities} > 0 then 1 else 0 end as has_components,
        r.* exclude (tube_assembly_id)
        from bill_of_materials b left join basic_rolled r on b.tube_assembly_id = r.tube_assembly_id)"""


@check(f"""with {BILL_SQL}, {with_stand_ins("components")}, {basic_bill_sql()}
    select * from basic_bill""")
def basic_bill(spark, folder):
    tables = basic_tables(spark, folder)
    return plan_basic_bill(tables["bill_of_materials"], tables["components"], BASIC_CUTOFFS)


@check(f"""with {BILL_SQL}, {with_stand_ins("quotes", "tube", "tube_end_form", "components", "specs")},
    {BASIC_TUBE_SQL}, {basic_bill_sql()},
    basic_specs as (select tube_assembly_id, {" + ".join(
        f"case when {c} is null then 0 else 1 end" for c in SPEC_COLUMNS)} as total_specs, 1 as has_specs
        from specs)
    select q.* exclude (quote_date) replace (case bracket_pricing when 'Yes' then 1 else 0 end
        as bracket_pricing), t.* exclude (tube_assembly_id), b.* exclude (tube_assembly_id),
    s.* exclude (tube_assembly_id), round(1 / (1 + annual_usage), 8) as inv_annual_usage,
    case when num_boss > 0 then 1 else 0 end as has_boss,
    cast(year(quote_date) as int) as year, cast(month(quote_date) as int) as month,
    cast(dayofyear(quote_date) as int) as dayofyear,
    cast(isodow(quote_date) - 1 as int) as dayofweek, cast(day(quote_date) as int) as day
    from quotes q left join basic_tubes t on q.tube_assembly_id = t.tube_assembly_id
    left join basic_bill b on q.tube_assembly_id = b.tube_assembly_id
    left join basic_specs s on q.tube_assembly_id = s.tube_assembly_id""")
def basic_quote_features(spark, folder):
    """The smaller feature set, for every quote."""
    quotes = stand_in(spark, folder, "quotes").na.fill({"bracket_pricing": "No"})
    features = plan_basic_quotes(
        quotes, basic_assemblies(basic_tables(spark, folder), BASIC_CUTOFFS), cutoffs=BASIC_CUTOFFS
    )
    return features.withColumn("inv_annual_usage", F.round("inv_annual_usage", 8))
