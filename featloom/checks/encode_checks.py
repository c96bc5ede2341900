"""Checks of distributions, buckets, one-hot columns, reshaping and joins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.checks.registry import check
from featloom.checks.row_checks import WORDS, YES_NO
from featloom.checks.standins import stand_in, stand_ins, table, with_stand_ins
from featloom.functions.columns import by_name
from featloom.operators import encode, reshape, rollup
from featloom.operators.joins import (
    HOT_ROWS,
    HOT_ROWS_CONF,
    attach,
    attach_roles,
    keep_listed,
)
from featloom.plans.assemblies import (
    COMPONENT_SLOTS,
    bill_slots,
    component_type_sources,
    connection_sources,
    end_form_sources,
)
from featloom.plans.recipes import RECIPES

SLOTS_SQL = " union all ".join(
    f"select tube_assembly_id, component_id_{i} as component, quantity_{i} as quantity "
    "from bill_of_materials"
    for i in range(1, 9)
)
BILL_SQL = f"{with_stand_ins('bill_of_materials')}, all_slots as ({SLOTS_SQL}), " \
    "slots as (select * from all_slots where component is not null)"


def long_form(df: DataFrame, key: str, category: str, value: str, kind: str = "long") -> DataFrame:
    """(key, category, value) of the non-zero cells, to compare results whose columns follow the data."""
    names = [c for c in df.columns if c != key]
    cast = df.select(by_name(key), *[by_name(c).cast(kind).alias(c) for c in names])
    return reshape.unpivot(cast, key, names, value, slot=category).where(F.col(value) != 0)


@check(f"""select value, count(*) as n from (select {WORDS} as value from lineitem)
    where value is not null group by value""")
def distribution(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(f"{WORDS} as word")
    return encode.distribution(df, "word")


@check(f"with {BILL_SQL} select component as value, count(*) as n from slots group by component")
def pooled_distribution(spark, folder):
    return encode.distribution(
        stand_in(spark, folder, "bill_of_materials"), COMPONENT_SLOTS["component"]
    )


@check("""with counts as (select p_brand as value, count(*) as n from part where p_size <= 48
        group by p_brand),
    applied as (select l_orderkey, l_linenumber, case when l_quantity > 48 then null
        else 'Brand#' || cast(l_partkey % 30 as string) end as brand from lineitem)
    select l_orderkey, l_linenumber, case when n < 75 then 'Rare' when n is not null then brand end
    as brand from applied left join counts on brand = value""")
def bucket_rare(spark, folder):
    """Fitted on one table, applied to another that has nulls and unseen values."""
    counts = encode.distribution(
        table(spark, folder, "part").selectExpr("case when p_size <= 48 then p_brand end as b"), "b"
    )
    applied = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "case when l_quantity > 48 then null "
        "else 'Brand#' || cast(l_partkey % 30 as string) end as brand",
    )
    return encode.bucket_rare(applied, "brand", counts, cutoff=75)


@check(f"""with cleaned as (select l_orderkey, l_linenumber, nullif(nullif(w, '9999'), 'NONE') as word
        from (select *, {WORDS} as w from lineitem)),
    counts as (select word as value, count(*) as n from cleaned where word is not null group by word)
    select l_orderkey, l_linenumber, case when n < 14300 then 'RareWord' when n is not null
    then word end as word from cleaned left join counts on word = value""")
def bucket_rare_sentinel(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{WORDS} as word"
    )
    counts = encode.distribution(df, "word")
    return encode.bucket_rare(
        df, "word", counts, cutoff=14300, rare_label="RareWord", null_values=["9999", "NONE"]
    )


@check(f"""with {BILL_SQL}, counts as (select component as value, count(*) as n from slots group by 1)
    select b.tube_assembly_id, {", ".join(
        f"case when c{i}.n < 50 then 'RareComponent' when c{i}.n is not null "
        f"then component_id_{i} end as component_id_{i}" for i in range(1, 9))}
    from bill_of_materials b {" ".join(
        f"left join counts c{i} on component_id_{i} = c{i}.value" for i in range(1, 9))}""")
def bucket_rare_multi(spark, folder):
    """Eight columns bucketed by their pooled distribution, whose frequent values may be any number."""
    bill, columns = stand_in(spark, folder, "bill_of_materials"), COMPONENT_SLOTS["component"]
    frequent = encode.fit_frequent(bill, columns, 50)
    return encode.bucket_frequent(
        bill.select("tube_assembly_id", *columns), columns, frequent, "RareComponent"
    )


@check(f"""select l_orderkey, l_linenumber, case when f = 'No' then 1 else 0 end as "No",
    case when f = 'Yes' then 1 else 0 end as "Yes" from (select *, {YES_NO} as f from lineitem)""")
def one_hot(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{YES_NO} as bracket"
    )
    return encode.one_hot(df, "bracket", encode.fit_column_vocab(df, "bracket").labels)


@check("""select l_orderkey, l_linenumber, """ + ", ".join(
    f"case when l_returnflag = '{v}' then 1 else 0 end as \"l_returnflag_{v}\"" for v in "ANR"
) + ", " + ", ".join(
    f"case when l_linestatus = '{v}' then 1 else 0 end as \"l_linestatus_{v}\"" for v in "FO"
) + " from lineitem")
def one_hot_prefixed(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    columns = ["l_returnflag", "l_linestatus"]
    labels = {c: encode.fit_column_vocab(df, c).labels for c in columns}
    return encode.one_hot(df, columns, labels, prefixed=True)


@check("""select p_partkey, coalesce(slot, 0) as slot, case when slot is null then 0.0e0
    else 1.0e0 end as total from part left join (select p_type as t,
    cast(row_number() over (order by p_type) as bigint) as slot
    from (select distinct p_type from part where p_size <= 45)) on t = p_type and p_size <= 45""")
def one_hot_vector(spark, folder):
    df = table(spark, folder, "part").selectExpr(
        "p_partkey", "case when p_size <= 45 then p_type end as kind"
    )
    encoded = encode.one_hot_vector(df, "kind", encode.fit_column_vocab(df, "kind").labels, "v")
    slots = encoded.select("p_partkey", vector_to_array("v").alias("v"))
    return slots.select(
        "p_partkey",
        F.array_position("v", F.lit(1.0)).alias("slot"),
        F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


STATUS = """case when year(l_shipdate) >= 2000 and l_quantity > 40 then 'new'
    else l_returnflag || l_linestatus end"""


@check(f"""select case when year(l_shipdate) < 2000 then 'train' else 'test' end as side,
    l_orderkey, l_linenumber, {", ".join(
        f"case when {STATUS} = '{v}' then 1 else 0 end as status_{v}"
        for v in ("AF", "AO", "NF", "NO", "RF", "RO"))} from lineitem""")
def vocab_train_apply_test(spark, folder):
    """The vocabulary comes from the training side alone; values new in the test have no column."""
    df = table(spark, folder, "lineitem").selectExpr(
        "case when year(l_shipdate) < 2000 then 'train' else 'test' end as side",
        "l_orderkey", "l_linenumber", f"{STATUS} as status",
    )
    train, test = df.where("side = 'train'"), df.where("side = 'test'")
    vocab = encode.fit_column_vocab(train, "status")
    encoded = [encode.one_hot(d, "status", vocab.labels, prefixed=True) for d in (train, test)]
    return encoded[0].unionByName(encoded[1])


@check("""select p_partkey, cast(slot as int) as kind from part left join (select p_type as t,
    row_number() over (order by p_type) - 1 as slot from (select distinct p_type from part
    where p_size > 5)) on t = p_type and p_size > 5""")
def label_index(spark, folder):
    df = table(spark, folder, "part").selectExpr(
        "p_partkey", "case when p_size > 5 then p_type end as p_type"
    )
    labels = encode.fit_column_vocab(df, "p_type").labels
    return encode.label_index(df, "p_type", labels, "kind").drop("p_type")


@check("select p_partkey, p_size, 0 as extra, p_retailprice from part")
def align_columns(spark, folder):
    df = table(spark, folder, "part").select("p_retailprice", "p_partkey", "p_size", "p_brand")
    return encode.align_columns(df, ["p_partkey", "p_size", "extra", "p_retailprice"])


@check(f"with {with_stand_ins('bill_of_materials')} " + " union all ".join(
    f"select tube_assembly_id, 'component_id_{i}' as slot, component_id_{i} as component "
    "from bill_of_materials" for i in range(1, 9)))
def unpivot(spark, folder):
    bill = stand_in(spark, folder, "bill_of_materials")
    return reshape.unpivot(
        bill, "tube_assembly_id", COMPONENT_SLOTS["component"], "component", slot="slot"
    )


@check(f"with {with_stand_ins('bill_of_materials')} " + " union all ".join(
    f"select tube_assembly_id, {i} as slot, component_id_{i} as component, "
    f"quantity_{i} as quantity from bill_of_materials" for i in range(1, 9)))
def unpivot_groups(spark, folder):
    bill = stand_in(spark, folder, "bill_of_materials")
    return reshape.unpivot_groups(bill, "tube_assembly_id", COMPONENT_SLOTS, slot="slot")


@check(f"""select l_orderkey,
    coalesce(sum(case when f = 'Yes' then l_quantity end), 0) as "qty_Yes",
    coalesce(sum(case when f = 'No' then l_quantity end), 0) as "qty_No"
    from (select *, {YES_NO} as f from lineitem) where f is not null group by l_orderkey""")
def pivot_sum(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", f"{YES_NO} as bracket", "l_quantity"
    )
    return reshape.pivot_sum(
        df, "l_orderkey", "bracket", "l_quantity", ["Yes", "No"], prefix="qty_"
    )


@check("""select l_suppkey, """ + ", ".join(
    f"coalesce(max(case when l_returnflag = '{v}' then l_quantity end), 0) as \"{v}\"" for v in "ANR"
) + " from lineitem group by l_suppkey")
def pivot_max(spark, folder):
    """The aggregate is the caller's choice."""
    df = table(spark, folder, "lineitem")
    return reshape.pivot_sum(df, "l_suppkey", "l_returnflag", "l_quantity", "ANR", agg="max")


CONNECTIONS_SQL = """select component_id, connection_type_id as value from comp_sleeve
    union all select component_id, connection_type_id from comp_boss
    union all select component_id, connection_type_id_1 from comp_adaptor
    union all select component_id, connection_type_id_2 from comp_adaptor
    union all select component_id, connection_type_id_1 from comp_threaded
    union all select component_id, connection_type_id_2 from comp_threaded"""
END_FORMS_SQL = """select component_id, end_form_id_1 as value from comp_adaptor
    union all select component_id, end_form_id_2 from comp_adaptor
    union all select component_id, end_form_id_1 from comp_threaded
    union all select component_id, end_form_id_2 from comp_threaded"""
CONNECTION_TABLES = ("comp_sleeve", "comp_boss", "comp_adaptor", "comp_threaded")
END_FORM_TABLES = ("comp_adaptor", "comp_threaded")


@check(f"with {with_stand_ins(*CONNECTION_TABLES)} {CONNECTIONS_SQL}")
def pool_attribute(spark, folder):
    tables = stand_ins(spark, folder, *CONNECTION_TABLES)
    return reshape.pool_attribute(connection_sources(tables), "component_id", "value")


@check("""select l_suppkey, sum(l_quantity) as l_quantity, sum(cast(l_linenumber as bigint))::bigint
    as l_linenumber from lineitem group by l_suppkey""")
def sum_by(spark, folder):
    return rollup.sum_by(
        table(spark, folder, "lineitem"), "l_suppkey", ["l_quantity", "l_linenumber"]
    )


@check("""select l_suppkey, l_returnflag, sum(l_quantity) as l_quantity from lineitem
    group by l_suppkey, l_returnflag""")
def sum_by_composite(spark, folder):
    return rollup.sum_by(
        table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_quantity"]
    )


@check("""select user_id, """ + ", ".join(
    f"cast(count(*) filter (where event_type = '{v}') as bigint) as \"n_{v}\""
    for v in ("click", "error", "purchase", "signup", "view")) + " from events group by user_id")
def multi_hot(spark, folder):
    events = table(spark, folder, "events")
    labels = encode.fit_column_vocab(events, "event_type").labels
    return rollup.multi_hot(events, "user_id", "event_type", labels, prefix="n_")


ORDER_ROLLUP = "select l_orderkey, count(*) as n, sum(l_quantity) as quantity from lineitem group by 1"


def order_rollup(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@check("""select l_orderkey, l_linenumber, o_custkey, o_orderpriority from lineitem
    join orders on l_orderkey = o_orderkey""")
def attach_inner(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey as l_orderkey", "o_custkey", "o_orderpriority"
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return attach(lines, orders, "l_orderkey", how="inner")


@check(f"""select o_orderkey as l_orderkey, o_custkey, n, quantity from orders
    left join ({ORDER_ROLLUP}) on o_orderkey = l_orderkey""")
def attach_left(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey")
    return attach(orders, order_rollup(spark, folder), "l_orderkey")


@check(f"""select o_orderkey, o_custkey, n, quantity from orders
    left join ({ORDER_ROLLUP}) on o_orderkey = l_orderkey""")
def attach_diff_keys(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return attach(orders, order_rollup(spark, folder), "o_orderkey", "l_orderkey")


@check("""select l_orderkey, l_linenumber, s_name, s_acctbal from (select *,
    case when l_quantity > 48 then null when l_linenumber < 4 then 7 else l_suppkey end as supp
    from lineitem) left join supplier on supp = s_suppkey""")
def attach_salted(spark, folder):
    """A key with nearly half of the rows and one of nulls, spread over salts."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "case when l_quantity > 48 then null when l_linenumber < 4 then 7 else l_suppkey end as supp",
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    before = spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS))
    spark.conf.set(HOT_ROWS_CONF, "1000")
    try:
        return attach(lines, suppliers, "supp", "s_suppkey", skew=True).drop("supp")
    finally:
        spark.conf.set(HOT_ROWS_CONF, before)


@check("""select o_orderkey, cn.n_name as customer_nation, cn.n_regionkey as customer_region,
    sn.n_name as other_nation from (select o_orderkey, c_nationkey,
        case when o_orderkey % 30 < 28 then cast(o_orderkey % 30 as int) end as other
        from orders join customer on o_custkey = c_custkey)
    left join nation cn on c_nationkey = cn.n_nationkey
    left join nation sn on other = sn.n_nationkey""", name="attach_roles")
def roles(spark, folder):
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).selectExpr(
        "o_orderkey", "c_nationkey",
        "case when o_orderkey % 30 < 28 then cast(o_orderkey % 30 as int) end as other",
    )
    return attach_roles(
        orders, table(spark, folder, "nation"), "n_nationkey",
        {"c_nationkey": {"n_name": "customer_nation", "n_regionkey": "customer_region"},
         "other": {"n_name": "other_nation"}},
    ).drop("c_nationkey", "other")


@check("select distinct l_returnflag, l_linestatus from lineitem order by 1, 2")
def distinct_sorted(spark, folder):
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus")
    return df.distinct().orderBy("l_returnflag", "l_linestatus")


@check("""select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in
    (select o_orderkey from orders where o_orderpriority = '1-URGENT')""")
def semi_join(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return keep_listed(lines, "l_orderkey", urgent, "o_orderkey")


def bucket_sql(source: str, column: str, cutoff: int, label: str, key: str = "component_id") -> str:
    """(key, bucket) rows of a source, bucketed by its own distribution."""
    return f"""select {key}, case when n < {cutoff} then '{label}' else {column} end as bucket
        from ({source}) join (select {column} as v, count(*) as n from ({source})
        where {column} is not null group by 1) on {column} = v"""


def slot_counts_sql(bucketed: str) -> str:
    return f"""select tube_assembly_id, bucket as category, count(*) as n from slots
        join ({bucketed}) on component = component_id group by 1, 2"""


@check("""with slots as (select l_orderkey, p_brand as component, l_quantity as quantity
        from lineitem join part on l_partkey = p_partkey),
    counts as (select component as v, count(*) as n from slots group by 1)
    select l_orderkey, case when n < 2400 then 'RareComponent' else component end as component,
    sum(quantity) as quantity from slots join counts on component = v group by 1, 2""")
def component_quantity(spark, folder):
    brands = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("component"))
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_quantity as quantity"
    )
    slots = attach(lines, brands, "l_partkey", "p_partkey", how="inner").drop("l_partkey")
    wide = rollup.component_quantity(slots, "l_orderkey", cutoff=2400)
    return long_form(wide, "l_orderkey", "component", "quantity", "double")


def slots_and(spark, folder, *names):
    return bill_slots(stand_in(spark, folder, "bill_of_materials")), stand_ins(spark, folder, *names)


BASE_NAMES_SQL = """select component_id, nullif(regexp_extract(name, '^([^ -]+)', 1), '') as name
    from components"""


@check(f"""with {BILL_SQL}, {with_stand_ins('components')}
    {slot_counts_sql(bucket_sql(BASE_NAMES_SQL, "name", 250, "RareBaseName"))}""")
def base_name_counts(spark, folder):
    slots, tables = slots_and(spark, folder, "components")
    wide = rollup.base_name_counts(slots, tables["components"], "tube_assembly_id", cutoff=250)
    return long_form(wide, "tube_assembly_id", "category", "n")


@check(f"""with {BILL_SQL}, {with_stand_ins('components')}
    {slot_counts_sql(bucket_sql("select * from components", "name", 30, "RareComponentName"))}""")
def name_counts(spark, folder):
    slots, tables = slots_and(spark, folder, "components")
    wide = rollup.name_counts(slots, tables["components"], "tube_assembly_id", cutoff=30)
    return long_form(wide, "tube_assembly_id", "category", "n")


@check(f"""with {BILL_SQL}, {with_stand_ins(*CONNECTION_TABLES)}
    {slot_counts_sql(bucket_sql(CONNECTIONS_SQL, "value", 1000, "RareConnection"))}""")
def pooled_counts(spark, folder):
    slots, tables = slots_and(spark, folder, *CONNECTION_TABLES)
    wide = rollup.pooled_counts(
        slots, connection_sources(tables), "tube_assembly_id", 1000, "RareConnection"
    )
    return long_form(wide, "tube_assembly_id", "category", "n")


@check(f"""with {BILL_SQL}, {with_stand_ins(*END_FORM_TABLES)}
    {slot_counts_sql(bucket_sql(END_FORMS_SQL, "value", 1000, "RareEndForm"))}""")
def end_form_counts(spark, folder):
    slots, tables = slots_and(spark, folder, *END_FORM_TABLES)
    wide = rollup.pooled_counts(
        slots, end_form_sources(tables), "tube_assembly_id", 1000, "RareEndForm"
    )
    return long_form(wide, "tube_assembly_id", "category", "n")


TYPE_TABLES = tuple(recipe.table for recipe in RECIPES)
TYPES_SQL = " union all ".join(
    f"select component_id, component_type_id as value from {t}" for t in TYPE_TABLES
)


@check(f"""with {BILL_SQL}, {with_stand_ins(*TYPE_TABLES)}
    {slot_counts_sql(bucket_sql(TYPES_SQL, "value", 1500, "RareComponentType"))}""")
def component_type_counts(spark, folder):
    slots, tables = slots_and(spark, folder, *TYPE_TABLES)
    wide = rollup.pooled_counts(
        slots, component_type_sources(tables), "tube_assembly_id", 1500, "RareComponentType"
    )
    return long_form(wide, "tube_assembly_id", "category", "n")
