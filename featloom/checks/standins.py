"""The library's input tables, derived from the given tables.

Each stand-in is a list of expressions in the SQL both engines read, so the
Spark side (``selectExpr``) and the checking side (a CTE) start from the same rows.
All derive from whole tables.  Missing values and sentinels are put in by CASE,
as the given tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(prefix: str, number: str) -> str:
    return f"'{prefix}-' || cast({number} as string)"


def _measure(j: int, missing: int = 0) -> str:
    """The j-th number of a part: at most two decimals, some null if ``missing`` > 0."""
    value = f"cast(((p_partkey * {2 * j + 3}) % 97) * 0.25e0 + p_size * 0.1e0 as double)"
    if not missing:
        return value
    return f"case when (p_partkey + {j}) % {missing} = 1 then null else {value} end"


def _target(j: int, missing: int) -> str:
    """A number that follows the size of the part, some null."""
    value = f"cast(p_size * 0.5e0 + ((p_partkey * {j}) % 31) * 0.25e0 as double)"
    return f"case when (p_partkey + {j}) % {missing} = 1 then null else {value} end"


_FLAG = "case when p_type = 'SMALL' then 'Yes' when p_type = 'LARGE' then 'No' end"
_FLAG_2 = "case when p_size > 40 then 'Yes' else 'No' end"

# name -> (given table, {column: expression})
ROW_TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "tube": ("orders", {
        "tube_assembly_id": _id("TA", "o_orderkey"),
        "material_id": "case when o_custkey % 50 = 9 then '9999' "
                       "else 'SP-' || substr(o_orderpriority, 1, 1) end",
        "diameter": "cast(6.35e0 + o_custkey % 20 as double)",
        "wall": "cast(0.7e0 + (o_custkey % 5) * 0.1e0 as double)",
        "length": "cast(case when o_custkey % 40 = 7 then 9999 "
                  "else floor(o_totalprice / 1000) end as double)",
        "num_bends": "cast(o_custkey % 7 as int)",
        "bend_radius": "cast(case when o_orderkey % 13 = 5 then 9999 "
                       "when o_orderkey % 11 = 3 then 0 "
                       "else 10 + o_custkey % 30 + 3 * (o_custkey % 7) end as double)",
        "end_a_1x": "case when o_orderstatus = 'O' then 'Y' else 'N' end",
        "end_a_2x": "case when o_orderkey % 2 = 0 then 'Y' else 'N' end",
        "end_x_1x": "case when o_custkey % 3 = 0 then 'Y' else 'N' end",
        "end_x_2x": "case when o_custkey % 3 = 1 then 'Y' when o_custkey % 3 = 2 then 'N' end",
        "end_a": "case when o_custkey % 9 = 8 then '9999' else "
                 + _id("EF", "o_custkey % 9") + " end",
        "end_x": "case when o_orderkey % 10 = 9 then 'NONE' when o_orderkey % 10 = 8 then null "
                 "else " + _id("EF", "o_orderkey % 10") + " end",
        "num_boss": "cast(o_orderkey % 3 as int)",
        "num_bracket": "cast(o_orderkey % 2 as int)",
    }),
    "tube_end_form": ("nation", {
        "end_form_id": _id("EF", "n_nationkey"),
        "forming": "case when n_regionkey in (0, 1) then 'Yes' "
                   "when n_regionkey in (2, 3) then 'No' end",
    }),
    "components": ("part", {
        "component_id": _id("C", "p_partkey"),
        "name": "case when p_partkey % 101 = 17 then null else replace(p_name, ' ', '-') end",
    }),
    "comp_sleeve": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 6"),
        "connection_type_id": _id("B", "p_size % 5"),
        "length": "case when p_size = 50 then 9999e0 else " + _measure(1) + " end",
        "intended_nut_pitch": _measure(2),
    }),
    "comp_adaptor": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 7"),
        "end_form_id_1": _id("A", "p_size % 4"),
        "end_form_id_2": "case when p_size % 8 = 0 then '9999' else "
                         + _id("A", "p_partkey % 6") + " end",
        "connection_type_id_1": _id("B", "p_partkey % 7"),
        "connection_type_id_2": "case when p_size % 9 = 0 then null else "
                                + _id("B", "p_partkey % 4") + " end",
        "overall_length": _measure(3, 12),
        "length_1": _measure(4, 3),
        "thread_size_1": _measure(5, 4),
        "thread_pitch_1": _measure(6, 4),
        "nominal_size_1": _measure(7, 5),
        "length_2": _measure(8, 3),
        "thread_size_2": "case when p_size = 49 then 9999e0 else " + _measure(9, 9) + " end",
        "thread_pitch_2": _measure(10, 9),
        "nominal_size_2": _measure(11, 7),
        "hex_size": _target(7, 8),
        "unique_feature": _FLAG,
        "orientation": _FLAG_2,
        "weight": _measure(12, 11),
    }),
    "comp_boss": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 3"),
        "type": "case when p_size % 10 = 4 then null else p_type end",
        "outside_shape": "case when p_type in ('SMALL', 'LARGE') then p_type end",
        "base_type": "case when p_size < 30 then 'Flat' else 'Saddle' end",
        "connection_type_id": _id("B", "p_size % 4"),
        "height_over_tube": "case when p_size = 48 then 9999e0 else " + _measure(1) + " end",
        "bolt_pattern_long": _target(5, 3),
        "bolt_pattern_wide": _target(11, 4),
        "base_diameter": _target(13, 5),
        "shoulder_diameter": _target(17, 6),
        "weight": _measure(2, 10),
    }),
    "comp_elbow": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 4"),
        "bolt_pattern_long": _measure(1, 7),
        "bolt_pattern_wide": _measure(2, 6),
        "extension_length": _measure(3, 8),
        "overall_length": _measure(4, 9),
        "thickness": _measure(5, 5),
        "drop_length": "case when p_size = 47 then 9999e0 else " + _measure(6, 6) + " end",
        "mj_class_code": "case when p_size % 3 = 0 then null else "
                         + _id("MJ", "p_size % 3") + " end",
        "mj_plug_class_code": "case when p_size % 4 < 2 then null else "
                              + _id("MJ", "p_size % 4") + " end",
        "groove": _FLAG,
        "weight": _measure(7, 13),
    }),
    "comp_float": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 2"),
        "bolt_pattern_long": _measure(1),
        "bolt_pattern_wide": _measure(2),
        "thickness": _measure(3),
        "orientation": _FLAG_2,
        "weight": "cast(p_size * 0.1e0 as double)",
    }),
    "comp_hfl": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 2"),
        "hose_diameter": _measure(1),
        "corresponding_shell": "p_type",
        "coupling_class": "case when p_size < 25 then 'SP-0098' when p_size < 45 then 'SP-0099' end",
        "material": "case when p_size % 2 = 0 then 'SP-0098' else 'SP-0016' end",
        "plating": _FLAG,
        "orientation": _FLAG_2,
        "weight": _measure(2),
    }),
    "comp_nut": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 2"),
        "hex_nut_size": _target(3, 3),
        "seat_angle": _target(19, 5),
        "length": _measure(1),
        "thread_size": "case p_size % 6 when 0 then 'M6' when 1 then 'M8' when 2 then 'M10' "
                       "when 3 then 'M12' when 4 then '.687' else '1.187' end",
        "thread_pitch": _measure(2),
        "diameter": _target(7, 4),
        "weight": _measure(3, 15),
    }),
    "comp_straight": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 5"),
        "bolt_pattern_long": _target(3, 5),
        "bolt_pattern_wide": _target(5, 3),
        "head_diameter": _target(7, 2),
        "overall_length": _target(11, 4),
        "thickness": _measure(1),
        "orientation": _FLAG_2,
        "weight": _measure(2, 9),
    }),
    "comp_tee": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": "'OTHER'",
        "bolt_pattern_long": _measure(1),
        "bolt_pattern_wide": _measure(2),
        "extension_length": _measure(3),
        "overall_length": _measure(4),
        "thickness": _measure(5),
        "drop_length": _measure(6),
        "mj_class_code": "case when p_size % 3 = 0 then null else "
                         + _id("MJ", "p_size % 3") + " end",
        "mj_plug_class_code": "case when p_size % 2 = 0 then 'Threaded' else 'MJ-5' end",
        "groove": _FLAG,
        "unique_feature": _FLAG_2,
        "weight": _measure(7),
    }),
    "comp_threaded": ("part", {
        "component_id": _id("C", "p_partkey"),
        "component_type_id": _id("CP", "p_size % 9"),
        "end_form_id_1": _id("A", "p_partkey % 5"),
        "end_form_id_2": "case when p_size % 6 = 0 then null else "
                         + _id("A", "p_size % 7") + " end",
        "connection_type_id_1": _id("B", "p_partkey % 6"),
        "connection_type_id_2": "case when p_size % 5 = 0 then null else "
                                + _id("B", "p_size % 8") + " end",
        "adaptor_angle": _measure(1, 2),
        "overall_length": "case when p_partkey % 4 = 1 then null "
                          "else cast(1 + p_size * 0.5e0 as double) end",
        "hex_size": _measure(3, 5),
        **{
            f"{name}_{i}": _measure(3 + 4 * i + j, 3 + i)
            for i in range(1, 5)
            for j, name in enumerate(("length", "thread_size", "thread_pitch"))
        },
        "nominal_size_2": _measure(20, 4),
        "nominal_size_3": _measure(21, 5),
        "orientation": _FLAG_2,
        "weight": _measure(22, 14),
    }),
    "comp_other": ("part", {
        "component_id": _id("C", "p_partkey"),
        "part_name": "case p_type when 'SMALL' then 'TUBE AS.' when 'LARGE' then 'NUT' "
                     "when 'PROMO' then 'REQUIREMENT' when 'MEDIUM' then 'FITTING-A/C' "
                     "when 'ECONOMY' then 'GASKET' end",
        "weight": _measure(1, 3),
    }),
}

# One row per order.  Slot i holds the lowest part of line i and slot 8 the
# highest part of the order, so a part may come twice and slots may be empty.
ORDER_TABLES: dict[str, dict[str, str]] = {
    "bill_of_materials": {
        **{
            f"component_id_{i}":
                "'C-' || cast(min(case when l_linenumber = "
                f"{i} then l_partkey end) as string)"
            for i in range(1, 8)
        },
        "component_id_8": "'C-' || cast(max(l_partkey) as string)",
        **{
            f"quantity_{i}": f"sum(case when l_linenumber = {i} then l_quantity end)"
            for i in range(1, 8)
        },
        "quantity_8": "cast(count(*) as double)",
    },
    "specs": {
        **{
            f"spec{i}": f"'SP-' || min(case when l_linenumber = {i} "
                        "then l_returnflag || l_linestatus end)"
            for i in range(1, 8)
        },
        "spec8": "'SP-' || max(case when l_quantity > 45 then l_returnflag end)",
        "spec9": "'SP-' || max(case when l_tax > 0.07 then l_linestatus end)",
        "spec10": "cast(null as string)",
    },
}

QUOTES: dict[str, str] = {
    "tube_assembly_id": _id("TA", "l_orderkey"),
    "supplier": _id("S", "l_partkey % 25"),
    "quote_date": "cast(l_shipdate as date)",
    "annual_usage": "cast(floor(l_extendedprice / 100) as int)",
    "min_order_quantity": "l_linenumber - 1",
    "bracket_pricing": "case l_returnflag when 'A' then 'Yes' when 'N' then 'No' end",
    "quantity": "cast(l_quantity as int)",
    "cost": "l_extendedprice",
}

ORDER_KEY = _id("TA", "l_orderkey")


def stand_in(
    spark: SparkSession, folder: str, name: str, given: dict[str, DataFrame] | None = None
) -> DataFrame:
    """``given`` holds tables already opened, so that each file is looked at once."""
    given = {} if given is None else given

    def opened(source: str) -> DataFrame:
        if source not in given:
            given[source] = table(spark, folder, source)
        return given[source]

    if name == "quotes":
        return opened("lineitem").selectExpr(*[f"{e} as {c}" for c, e in QUOTES.items()])
    if name in ORDER_TABLES:
        aggregates = [F.expr(e).alias(c) for c, e in ORDER_TABLES[name].items()]
        grouped = opened("lineitem").groupBy("l_orderkey").agg(*aggregates)
        return grouped.selectExpr(f"{ORDER_KEY} as tube_assembly_id", *ORDER_TABLES[name])
    source, columns = ROW_TABLES[name]
    return opened(source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])


def stand_ins(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    wanted, given = names or [*ROW_TABLES, *ORDER_TABLES], {}
    return {name: stand_in(spark, folder, name, given) for name in wanted}


def stand_in_sql(name: str) -> str:
    """The same table as a query."""
    if name == "quotes":
        columns = ", ".join(f"{e} as {c}" for c, e in QUOTES.items())
        return f"select {columns} from lineitem"
    if name in ORDER_TABLES:
        columns = ", ".join(f"{e} as {c}" for c, e in ORDER_TABLES[name].items())
        return (
            f"select {ORDER_KEY} as tube_assembly_id, {columns} from lineitem group by l_orderkey"
        )
    source, columns = ROW_TABLES[name]
    return f"select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source}"


def with_stand_ins(*names: str) -> str:
    """``name as (query)`` items for a WITH clause."""
    return ", ".join(f"{name} as ({stand_in_sql(name)})" for name in names)
