"""Checks of row-local operators: columns, scalars, cleaning, CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from featloom.checks.registry import check
from featloom.checks.standins import stand_in, table, with_stand_ins
from featloom.functions import scalars
from featloom.functions.columns import (
    apply_columns,
    matching,
    select_matching,
    suffix_columns,
)
from featloom.operators import clean
from featloom.operators.model import to_matrix
from featloom.operators.split import by_flag
from featloom.plans.recipes import clean_parts, metric_threads
from featloom.session import scratch_path
from featloom.sources.csv_tables import read_csv_table, write_csv_table

# Shared by the Spark and SQL forms: missing values and words put in by CASE.
YES_NO = "case l_returnflag when 'A' then 'Yes' when 'N' then 'No' end"
YES_NO_OTHER = "case l_returnflag when 'A' then 'Y' when 'N' then 'N' else 'maybe' end"
SENTINEL = "case when l_discount = 0.1e0 then 9999e0 else l_discount end"
MISSING_PRICE = "case when l_linenumber = 7 then null else l_extendedprice end"
MISSING_TAX = "case when l_quantity > 45 then null else l_tax end"
WORDS = "case l_linenumber when 1 then '9999' when 2 then 'NONE' else l_returnflag end"


def lines(spark, folder, *expressions: str):
    return table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", *expressions)


@check("""select l_orderkey as order_id, l_linenumber as line, l_quantity as quantity,
    round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem""")
def project_rename_drop(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
        .withColumnsRenamed(
            {"l_orderkey": "order_id", "l_linenumber": "line", "l_quantity": "quantity"}
        )
        .withColumns({"revenue": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)})
        .drop("l_extendedprice", "l_discount")
    )


@check("""select l_orderkey, case when l_discount > 0 then 1 else 0 end as has_discount,
    case when l_quantity > 25 then 1 else 0 end as is_bulk,
    case when (case when l_linenumber = 7 then null else l_extendedprice end) > 0
        then 1 else 0 end as has_price from lineitem""")
def derived_flag(spark, folder):
    df = lines(spark, folder, "l_discount", "l_quantity", f"{MISSING_PRICE} as price")
    return df.select(
        "l_orderkey",
        scalars.is_positive(F.col("l_discount")).alias("has_discount"),
        scalars.flag(F.col("l_quantity") > 25).alias("is_bulk"),
        scalars.is_positive(F.col("price")).alias("has_price"),
    )


@check(f"""select case when price is null then 'missing' else 'known' end as side,
    count(*) as n, sum(l_quantity) as quantity
    from (select l_quantity, {MISSING_PRICE} as price from lineitem) group by 1""")
def not_null_split(spark, folder):
    df = lines(spark, folder, "l_quantity", f"{MISSING_PRICE} as price")
    known, missing = by_flag(df.withColumn("known", F.col("price").isNotNull()), "known")

    def measured(side, name):
        return side.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).select(
            F.lit(name).alias("side"), "n", "quantity"
        )

    return measured(known, "known").unionByName(measured(missing, "missing"))


@check("""select l_orderkey, l_linenumber, l_returnflag from lineitem
    where l_returnflag in ('A', 'R') and l_linenumber in (1, 3)""")
def in_set(spark, folder):
    df = lines(spark, folder, "l_returnflag")
    return df.where(F.col("l_returnflag").isin("A", "R") & F.col("l_linenumber").isin(1, 3))


@check(f"""select l_orderkey, l_linenumber, price, tax from
    (select l_orderkey, l_linenumber, {MISSING_PRICE} as price, {MISSING_TAX} as tax from lineitem)
    where price is not null and tax is not null""")
def drop_any_null(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", f"{MISSING_TAX} as tax")
    return df.na.drop("any", subset=["price", "tax"])


@check(f"""select l_orderkey, l_linenumber, coalesce({MISSING_PRICE}, 0) as price,
    coalesce({MISSING_TAX}, 0) as tax from lineitem""")
def zero_fill(spark, folder):
    return clean.zero_fill(
        lines(spark, folder, f"{MISSING_PRICE} as price", f"{MISSING_TAX} as tax")
    )


@check(f"""select cast(l_linenumber as double) as l_linenumber,
    coalesce(cast({MISSING_PRICE} as double), 0) as price, l_quantity from lineitem""",
    name="to_matrix")
def matrix(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", "l_quantity", "l_returnflag")
    return to_matrix(df, exclude=["l_orderkey", "l_returnflag"])


@check("""select 'customer' as kind, c_nationkey as nation, c_acctbal as balance from customer
    union all select 'supplier', s_nationkey, s_acctbal from supplier""")
def union_all(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(
        "'customer' as kind", "c_nationkey as nation", "c_acctbal as balance"
    )
    suppliers = table(spark, folder, "supplier").selectExpr(
        "s_acctbal as balance", "s_nationkey as nation", "'supplier' as kind"
    )
    return customers.unionByName(suppliers)


@check("""select l_orderkey, round(ln(l_quantity), 8) as log_q, round(exp(l_discount), 8) as exp_d,
    round(cbrt(l_extendedprice), 8) as cube_root, round(sqrt(l_extendedprice), 8) as square_root,
    l_quantity * l_quantity as squared from lineitem""")
def root_log_exp(spark, folder):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.round(F.log(q), 8).alias("log_q"),
        F.round(F.exp("l_discount"), 8).alias("exp_d"),
        F.round(F.cbrt(price), 8).alias("cube_root"),
        F.round(F.sqrt(price), 8).alias("square_root"),
        (q * q).alias("squared"),
    )


@check("""select l_returnflag, cast(round_even(count(*) * 0.25e0, 0) as bigint) as quarter,
    cast(floor(count(*) * 0.2e0) as bigint) as fifth from lineitem group by l_returnflag""")
def round_share(spark, folder):
    rows = F.count(F.lit(1))
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        scalars.round_share(rows, 0.25).alias("quarter"),
        F.floor(rows * F.lit(0.2)).alias("fifth"),
    )


@check("""select l_orderkey, l_linenumber,
    round(l_extendedprice / nullif(l_linenumber - 1, 0), 6) as ratio,
    round(cbrt(l_extendedprice / nullif(l_quantity, 0)), 6) as cube_ratio,
    round(cbrt(dayofyear(l_shipdate) / nullif(l_quantity, 0)), 6) as doy_quantity,
    (l_linenumber - 1) * l_quantity as total from lineitem""")
def safe_ratio(spark, folder):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(scalars.safe_ratio(price, F.col("l_linenumber") - 1), 6).alias("ratio"),
        F.round(scalars.safe_ratio(price, q, root=3), 6).alias("cube_ratio"),
        F.round(scalars.safe_ratio(F.dayofyear("l_shipdate"), q, root=3), 6).alias("doy_quantity"),
        ((F.col("l_linenumber") - 1) * q).alias("total"),
    )


TUBE_VOLUME = (
    "((pi() * pow(diameter / 2, 2)) - (pi() * pow((diameter - wall) / 2, 2))) * length"
)


@check(f"""with {with_stand_ins("tube")} select tube_assembly_id, round({TUBE_VOLUME}, 6) as volume
    from tube""")
def wall_volume(spark, folder):
    volume = scalars.wall_volume(F.col("diameter"), F.col("wall"), F.col("length"))
    return stand_in(spark, folder, "tube").select(
        "tube_assembly_id", F.round(volume, 6).alias("volume")
    )


@check(f"""with {with_stand_ins("tube")} select tube_assembly_id,
    round(case when {TUBE_VOLUME} = 0 then 0 else 1 / ln(1 + {TUBE_VOLUME}) end, 8) as inv_volume
    from tube""")
def inverse_log_volume(spark, folder):
    volume = scalars.wall_volume(F.col("diameter"), F.col("wall"), F.col("length"))
    return stand_in(spark, folder, "tube").select(
        "tube_assembly_id", F.round(scalars.inverse_log(volume), 8).alias("inv_volume")
    )


@check("""select l_orderkey, l_linenumber, round(case when l_linenumber = 1 then 0
    else 1 / ln(1 + (l_linenumber - 1)) end, 8) as inv_line,
    round(1 / ln(1 + l_quantity), 8) as inv_quantity from lineitem""")
def inverse_log(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(scalars.inverse_log(F.col("l_linenumber") - 1), 8).alias("inv_line"),
        F.round(scalars.inverse_log(F.col("l_quantity")), 8).alias("inv_quantity"),
    )


@check("""select l_orderkey, l_linenumber, round(1 / (1 + l_quantity), 8) as inv_quantity,
    round(ln(1 + l_quantity), 8) as log_quantity from lineitem""")
def inverse_plus_one(spark, folder):
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(scalars.inverse_plus_one(q), 8).alias("inv_quantity"),
        F.round(scalars.log_label(q), 8).alias("log_quantity"),
    )


@check("""select l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 8) as label,
    round(exp(ln(1 + l_extendedprice)) - 1, 4) as cost from lineitem""")
def log_label(spark, folder):
    label = scalars.log_label(F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(label, 8).alias("label"), F.round(scalars.unlog(label), 4).alias("cost"),
    )


@check("""select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month,
    dayofyear(o_orderdate) as dayofyear, isodow(o_orderdate) - 1 as dayofweek,
    day(o_orderdate) as day from orders""")
def date_parts(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    df = scalars.date_parts(
        df, "o_orderdate", ("year", "month", "dayofyear", "dayofweek", "day")
    )
    return apply_columns(df, [c for c in df.columns if c != "o_orderkey"], lambda c: c.cast("long"))


@check(f"""select l_orderkey, l_linenumber, round(coalesce({MISSING_PRICE}, 0)
    + coalesce({MISSING_TAX}, 0) + l_quantity, 4) as total from lineitem""")
def row_sum(spark, folder):
    df = lines(
        spark, folder, f"{MISSING_PRICE} as m_price", f"{MISSING_TAX} as m_tax", "l_quantity as m_q"
    )
    total = scalars.row_sum(matching(df, "^m_"))
    return df.select("l_orderkey", "l_linenumber", F.round(total, 4).alias("total"))


@check(f"""select l_orderkey, l_linenumber,
    case when {MISSING_PRICE} is null then 0 else 1 end
    + case when {MISSING_TAX} is null then 0 else 1 end as filled from lineitem""")
def row_count_non_null(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as m_price", f"{MISSING_TAX} as m_tax")
    filled = scalars.row_count_non_null(matching(df, "m_"))
    return df.select("l_orderkey", "l_linenumber", filled.alias("filled"))


@check(f"""with {with_stand_ins("components")} select component_id,
    nullif(regexp_extract(name, '^([^ -]+)', 1), '') as base_name from components""")
def leading_token(spark, folder):
    return stand_in(spark, folder, "components").select(
        "component_id", scalars.leading_token(F.col("name")).alias("base_name")
    )


@check("select l_orderkey, l_quantity, l_linenumber from lineitem", name="select_matching")
def select_by_pattern(spark, folder):
    return select_matching(
        table(spark, folder, "lineitem"), "(quantity|number)$", keep=["l_orderkey"]
    )


@check("""select p_partkey, p_size as p_size_part, p_retailprice as p_retailprice_part
    from part""", name="suffix_columns")
def suffixed_columns(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    df = df.withColumnRenamed("p_size", "p_size_part")
    return suffix_columns(df, "part", skip="p_partkey")


@check(f"""select l_orderkey, l_linenumber, case {YES_NO} when 'Yes' then 1 else 0 end as bracket,
    case {YES_NO_OTHER} when 'Y' then 1 when 'N' then 0 end as other from lineitem""")
def flag_decode(spark, folder):
    df = lines(spark, folder, f"{YES_NO} as f", f"{YES_NO_OTHER} as g")
    return df.select(
        "l_orderkey", "l_linenumber",
        clean.decode_flag(F.col("f")).alias("bracket"),
        clean.decode_flag(F.col("g")).alias("other"),
    )


@check("""select l_orderkey, l_linenumber, case when l_linestatus = 'O' then 1 else 0 end as is_open
    from lineitem""")
def flag_decode_strict(spark, folder):
    df = lines(spark, folder, "case l_linestatus when 'O' then 'Y' else 'N' end as f")
    return df.select(
        "l_orderkey", "l_linenumber", clean.decode_flag_strict(F.col("f")).alias("is_open")
    )


@check(f"""select l_orderkey, l_linenumber, case coalesce({YES_NO}, 'No') when 'Yes' then 1
    when 'No' then 0 end as f_no, case coalesce({YES_NO}, 'Yes') when 'Yes' then 1
    when 'No' then 0 end as f_yes from lineitem""")
def flag_decode_default(spark, folder):
    df = lines(spark, folder, f"{YES_NO} as f")
    return df.select(
        "l_orderkey", "l_linenumber",
        clean.decode_flag(F.col("f"), on_null=0, on_other=clean.RAISE).alias("f_no"),
        clean.decode_flag(F.col("f"), on_null=1, on_other=clean.RAISE).alias("f_yes"),
    )


@check(f"""select l_orderkey, l_linenumber, case when d = 9999 then 0.05e0 else d end as discount
    from (select *, {SENTINEL} as d from lineitem)""")
def sentinel_replace(spark, folder):
    df = lines(spark, folder, f"{SENTINEL} as d")
    return df.select(
        "l_orderkey", "l_linenumber", clean.replace_sentinel(F.col("d"), 0.05).alias("discount")
    )


@check(f"""select l_orderkey, l_linenumber, case when w in ('9999', 'NONE') then null else w end as word
    from (select *, {WORDS} as w from lineitem)""")
def null_if_in(spark, folder):
    df = lines(spark, folder, f"{WORDS} as w")
    return df.select(
        "l_orderkey", "l_linenumber", clean.null_if_in(F.col("w"), ["9999", "NONE"]).alias("word")
    )


@check(f"""select l_orderkey, l_linenumber, coalesce({MISSING_PRICE}, 63.62) as price,
    coalesce({MISSING_TAX}, 0.04) as tax from lineitem""")
def fill_constants(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", f"{MISSING_TAX} as tax")
    return clean.fill_constants(df, {"price": 63.62, "tax": 0.04})


CATEGORY_DEFAULTS = {"A": 10.5, "N": 20.25}


@check(f"""select l_orderkey, l_linenumber, coalesce({MISSING_PRICE},
    case l_returnflag when 'A' then 10.5 when 'N' then 20.25 end) as price from lineitem""")
def fill_by_category(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", "l_returnflag")
    filled = clean.fill_by_category(F.col("price"), F.col("l_returnflag"), CATEGORY_DEFAULTS)
    return df.select("l_orderkey", "l_linenumber", filled.alias("price"))


@check("""select p_partkey, case p_type when 'LARGE' then 'BIG' when 'ECONOMY' then 'CHEAP'
    when 'PROMO' then 'CHEAP' else p_type end as p_type from part""")
def canonicalise(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_type")
    return clean.canonicalise(
        df, "p_type", {"LARGE": "BIG", "ECONOMY": "CHEAP", "PROMO": "CHEAP"}
    )


@check(f"""with {with_stand_ins("comp_nut")} select component_id,
    round(case thread_size when 'M6' then 25.4e0 when 'M8' then 20.32e0 when 'M10' then 16.93e0
        when 'M12' then 14.51e0 else thread_pitch end, 6) as thread_pitch,
    case thread_size when 'M6' then 0.25e0 when 'M8' then 0.3125e0 when 'M10' then 0.375e0
        when 'M12' then 0.5e0 else try_cast(thread_size as double) end as thread_size
    from comp_nut""")
def override_where(spark, folder):
    df = metric_threads(stand_in(spark, folder, "comp_nut"))
    return df.select("component_id", F.round("thread_pitch", 6).alias("thread_pitch"), "thread_size")


@check(f"""with {with_stand_ins("comp_other")},
    named as (select component_id, case part_name when 'TUBE AS.' then 'TUBE AS'
        when 'FITTING-A/C' then 'FITTING' else part_name end as part_name, weight
        from comp_other where part_name <> 'REQUIREMENT' or part_name is null)
    select component_id, part_name, coalesce(weight, case part_name when 'TUBE AS' then 0.614e0
        when 'FITTING' then 0.043e0 when 'NUT' then 0.0325e0 end) as weight from named""")
def part_cleaning(spark, folder):
    return clean_parts(stand_in(spark, folder, "comp_other"))


@check(f"""select l_orderkey, l_linenumber, round(coalesce({MISSING_PRICE},
    (select avg({MISSING_PRICE}) from lineitem)), 4) as price from lineitem""")
def fill_mean(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price")
    filled = clean.fill_mean(df, ["price"])
    return filled.select("l_orderkey", "l_linenumber", F.round("price", 4).alias("price"))


@check(f"""select l_orderkey, l_linenumber, price from
    (select *, {MISSING_PRICE} as price from lineitem) where (l_quantity <> 25)
    and (price <> 1000 or price is null)""")
def drop_value(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", "l_quantity")
    df = clean.drop_value(clean.drop_value(df, "l_quantity", 25), "price", 1000)
    return df.drop("l_quantity")


@check(f"""select l_orderkey, l_linenumber, price, l_quantity from
    (select *, {MISSING_PRICE} as price from lineitem)
    where price < 40000 and l_quantity <= 30""")
def keep_below(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", "l_quantity")
    return clean.keep_below(
        clean.keep_below(df, "price", 40000), "l_quantity", 30, inclusive=True
    )


@check(f"""select l_orderkey, l_linenumber, price, l_quantity from
    (select *, {MISSING_PRICE} as price from lineitem)
    where price > 1000 and price < 40000 and l_quantity between 5 and 30""")
def keep_between(spark, folder):
    df = lines(spark, folder, f"{MISSING_PRICE} as price", "l_quantity")
    df = clean.keep_between(df, "price", 1000, 40000)
    return clean.keep_between(df, "l_quantity", 5, 30, inclusive=True)


@check("""select p_partkey, p_name, p_brand, p_size, p_retailprice,
    case when p_size > 40 then null else p_type end as p_type,
    cast(date '2020-01-01' + cast(p_size as integer) as date) as quoted from part""")
def csv_round_trip(spark, folder):
    """Write the whole part table as CSV in the shared folder and read it back."""
    df = table(spark, folder, "part").selectExpr(
        "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
        "case when p_size > 40 then null else p_type end as p_type",
        "date_add(date '2020-01-01', p_size) as quoted",
    )
    path = scratch_path(spark, "parts-csv")
    write_csv_table(df, path)
    return read_csv_table(
        spark, path,
        "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double, "
        "p_type string, quoted date",
    )


@check("""select p_partkey, p_size + 1.0e0 as p_size, p_retailprice + 1.0e0 as p_retailprice
    from part""")
def column_functions(spark, folder):
    """A caller's Column -> Column function over several columns."""
    df = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return apply_columns(df, ["p_size", "p_retailprice"], lambda c: c + F.lit(1.0))
