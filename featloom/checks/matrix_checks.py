"""Checks of sparse counts, one-pass fits, and models whose answer SQL can give.

A regression tree that is deep enough to part all cells of its features predicts the mean
label of each cell, and one of depth 0 the mean of all; so do boosted trees, as the
residuals of later rounds have mean 0.  With absolute loss a round adds the step times the
mean sign of the residuals.  That makes whole plans comparable with SQL, rows, labels,
folds and scales included.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.checks.encode_checks import BILL_SQL
from featloom.checks.registry import ORACLES, check
from featloom.checks.rollup_checks import (
    BASIC_CUTOFFS,
    GROUPS_SQL,
    KEY,
    PLAN_CUTOFFS,
    basic_tables,
    rounded,
    scored_lines,
)
from featloom.checks.standins import stand_in, stand_ins, table, with_stand_ins
from featloom.functions.columns import by_name
from featloom.operators import encode, impute, metrics, model, sparse, split
from featloom.plans.assemblies import COMPONENT_SLOTS, bill_slots, tube_features
from featloom.plans.basic_quotes import basic_holdout_score as plan_basic_holdout
from featloom.plans.basic_quotes import basic_score as plan_basic_score
from featloom.plans.quotes import SparseQuoteEncoder, quote_columns
from featloom.plans.quotes import cross_validated_score as plan_cross_validation
from featloom.plans.quotes import score_test_set as plan_score
from featloom.plans.recipes import STRAIGHT
from featloom.session import materialize, scratch_path
from featloom.sources.csv_tables import load_tables, read_csv_table, write_csv_table


def listed(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text, which both engines write alike."""
    return df.withColumns({c: F.array_join(by_name(c).cast("array<string>"), ",") for c in columns})


# ---- sparse counts

DICTIONARY_SQL = """counts as (select component as value, count(*) as n from slots group by 1),
    frequent as (select value, row_number() over (order by value) - 1 as slot from counts where n >= 33),
    dictionary as (select value, slot from frequent union all
        select value, (select count(*) from frequent) as slot from counts where n < 33)"""


@check(f"""with {BILL_SQL}, {DICTIONARY_SQL},
    summed as (select tube_assembly_id, slot, sum(quantity) as amount from slots
        join dictionary on component = value group by 1, 2)
    select tube_assembly_id, string_agg(cast(slot as varchar), ',' order by slot) as indices,
    string_agg(cast(amount as varchar), ',' order by slot) as "values" from summed group by 1""")
def sparse_counts(spark, folder):
    """Quantities of any number of components by assembly, the rare ones in one slot."""
    bill = stand_in(spark, folder, "bill_of_materials")
    dictionary = sparse.fit_dictionary(bill, COMPONENT_SLOTS["component"], 33, "RareComponent")
    long = sparse.sparse_counts(bill_slots(bill), KEY, "component", dictionary, "quantity")
    vectors = sparse.to_vectors(sparse.entries(long, KEY), dictionary.size, "v")
    return listed(sparse.vector_entries(vectors, "v").drop("size"), "indices", "values")


QUOTE_NUMBERS = ["bracket_pricing", "quantity", "year", "month", "dayofweek"]


@check("""with rows as (select l_orderkey, l_linenumber, 'S-' || cast(l_partkey as string) as supplier,
        [case when l_returnflag = 'A' then 1 else 0 end, l_quantity, year(l_shipdate),
         month(l_shipdate), isodow(l_shipdate) - 1] as numbers from lineitem),
    suppliers as (select supplier as s, row_number() over (order by supplier) + 4 as slot
        from (select distinct supplier from rows))
    select l_orderkey, l_linenumber, cast((select count(*) + 5 from suppliers) as int) as size,
    array_to_string(list_filter(range(5), lambda i: numbers[i + 1] <> 0) || [slot], ',') as indices,
    array_to_string(list_filter(numbers, lambda x: x <> 0)::double[] || [1.0e0], ',') as "values"
    from rows join suppliers on supplier = s""")
def sparse_quote_matrix(spark, folder):
    """Quote numbers and a one-hot of as many suppliers as there are parts, in one vector."""
    quotes = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "'S-' || cast(l_partkey as string) as supplier",
        "cast(l_shipdate as date) as quote_date", "cast(l_quantity as int) as quantity",
        "1 as annual_usage", "1 as min_order_quantity",
        "case l_returnflag when 'A' then 'Yes' when 'N' then 'No' end as bracket_pricing",
    )
    encoder = SparseQuoteEncoder.fit(quotes)
    matrix = encoder.matrix(quote_columns(quotes), QUOTE_NUMBERS, ["l_orderkey", "l_linenumber"])
    return listed(sparse.vector_entries(matrix, model.FEATURES), "indices", "values")


def counted_sql(name: str, columns: list[str], cutoff: int, also: str = "true") -> str:
    cells = " union all ".join(f"select {c} as value from tube" for c in columns)
    return f"select '{name}' as name, value, count(*) as n from ({cells}) where value is not null " \
           f"and {also} group by 2 having count(*) >= {cutoff}"


@check(f"with {with_stand_ins('tube')} " + " union all ".join([
    counted_sql("material", ["material_id"], 5, "value not in ('9999', 'NONE')"),
    counted_sql("ends", ["end_a", "end_x"], 1600), counted_sql("end_a", ["end_a"], 1),
]))
def frequent_values_multi(spark, folder):
    """Three vocabularies of a table, one over two pooled columns, from one scan."""
    return encode.frequent_values(stand_in(spark, folder, "tube"), {
        "material": encode.VocabularySpec(("material_id",), 5, "Rare", ("9999", "NONE")),
        "ends": encode.VocabularySpec(("end_a", "end_x"), 1600, "Rare"),
        "end_a": encode.VocabularySpec(("end_a",)),
    })


CARRIED = "least(3, floor(before / quota))"


@check(f"with {GROUPS_SQL}, v as (select {CARRIED} as fold, 'S-' || cast(l_partkey as string) as value "
       "from lineitem join q on l_orderkey = k) " + " union all ".join(
    f"select {i} as pair, case when fold in (0, {i}) then 'first' else 'second' end as side, value, "
    "count(*) as n from v group by 2, 3" for i in (1, 2, 3)))
def fold_vocabularies(spark, folder):
    """Counts of every side of every pair of folds from one count by fold."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "'S-' || cast(l_partkey as string) as supplier"
    )
    return encode.fold_counts(split.group_folds(lines, "l_orderkey", rule="carry"), "supplier", 4)


@check(ORACLES["impute_chain"])
def impute_chain_one_pass(spark, folder):
    """Four fits that build on each other, from one aggregation."""
    df = stand_in(spark, folder, "comp_straight").na.fill(STRAIGHT.fills)
    targets = [step.target for step in STRAIGHT.regressions]
    filled = impute.impute_chain_one_pass(df, STRAIGHT.regressions)
    return rounded(filled.select("component_id", *targets), 3)


# ---- scores of rows without a score

@check("select true as rmsle_is_nan, true as r2_is_nan, count(*) as n from lineitem")
def unscored_rows(spark, folder):
    """One row in fifty has no prediction: no score may pass for one of all rows."""
    lines = scored_lines(spark, folder).withColumn("guess", F.expr("case when l_partkey % 50 <> 7 then guess end"))
    scores = [metrics.rmsle(lines, "answer", "guess"), metrics.r2(lines, "answer", "guess")]
    return lines.agg(F.count(F.lit(1)).alias("n")).select(
        F.isnan(scores[0].scalar()).alias("rmsle_is_nan"), F.isnan(scores[1].scalar()).alias("r2_is_nan"), "n"
    )


# ---- models on cells

CELLS = ["is_return", "is_open"]
CELL_SQL = "(l_returnflag = 'R')::int * 2 + (l_linestatus = 'O')::int"


def exact_gbt(rounds: int, depth: int, loss: str = "squared"):
    """Boosting that sees every row and feature, so that its answer is a mean."""
    return lambda matrix: model.fit_gbt(
        matrix, loss=loss, rounds=rounds, depth=depth, subsample=1.0, features_share=1.0, min_rows=1
    )


def cell_matrix(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("l_linenumber_id"), F.col("l_extendedprice").alias("cost"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_return"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"),
    )
    return model.assemble(lines, CELLS, ["l_orderkey", "l_linenumber_id", "cost"])


def cell_predictions(spark, folder, fit):
    matrix = model.materialize_matrix(model.with_log_label(cell_matrix(spark, folder), "cost"), "cells")
    scored = model.predictions(fit(matrix), matrix, ["l_orderkey", "l_linenumber_id"], "predicted")
    return rounded(scored, 4)


MEANS_SQL = f"""rows as (select l_orderkey, l_linenumber as l_linenumber_id, {CELL_SQL} as cell,
        ln(1 + l_extendedprice) as y from lineitem),
    means as (select cell, avg(y) as m from rows group by 1)"""


@check(f"""with {MEANS_SQL} select l_orderkey, l_linenumber_id, round(exp(m) - 1, 4) as predicted
    from rows join means using (cell)""")
def gbt_cells(spark, folder):
    """Boosted trees that part three cells predict the mean label of each."""
    return cell_predictions(spark, folder, exact_gbt(3, 2))


@check(f"""with {MEANS_SQL}, signs as (select cell, m, avg(case when y < m then -1e0 else 1e0 end) as s
        from rows join means using (cell) group by 1, 2)
    select l_orderkey, l_linenumber_id, round(exp(m + 0.1e0 * s) - 1, 4) as predicted
    from rows join signs using (cell)""")
def gbt_absolute_cells(spark, folder):
    """With absolute loss the second round is a step along the mean sign."""
    return cell_predictions(spark, folder, exact_gbt(2, 2, "absolute"))


@check("""select l_orderkey, l_linenumber as l_linenumber_id,
    round(10.0e0 * l_linenumber * l_linenumber, 4) as predicted from lineitem""")
def forest_cells(spark, folder):
    """Every tree of a forest, whatever rows it drew, learns a cost that the cell decides."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("l_linenumber_id"),
        (F.col("l_linenumber") * F.col("l_linenumber") * 10.0).alias("cost"), "l_linenumber",
    )
    matrix = model.with_log_label(model.assemble(lines, ["l_linenumber"], ["l_orderkey", "l_linenumber_id", "cost"]), "cost")
    matrix = model.materialize_matrix(matrix, "forest")
    fitted = model.fit_forest(matrix, trees=5, depth=6)
    return rounded(model.predictions(fitted, matrix, ["l_orderkey", "l_linenumber_id"], "predicted"), 4)


@check("""with m as (select var_samp(l_quantity) as a, var_samp(l_linenumber) as d,
        covar_samp(l_quantity, l_linenumber) as b from lineitem)
    select round((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2, 4) as variance_1,
    round((a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2, 4) as variance_2, 0.0e0 as covariance from m""")
def pca_variances(spark, folder):
    """Of two columns: the components' variances are the eigenvalues, and they do not correlate."""
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_linenumber")
    projected = model.pca(model.assemble(lines, ["l_quantity", "l_linenumber"]), components=2)
    parts = projected.select(vector_to_array("pca").alias("p")).select(
        F.col("p")[0].alias("a"), F.col("p")[1].alias("b")
    )
    return parts.agg(
        F.round(F.var_samp("a"), 4).alias("variance_1"), F.round(F.var_samp("b"), 4).alias("variance_2"),
        F.abs(F.round(F.covar_samp("a", "b"), 4)).alias("covariance"),
    )


def pair_scores_sql(rows: str, means: str, on: str) -> str:
    """Scores of the means of each side on the other, for each pair of folds."""
    parts = []
    for i in (1, 2, 3):
        for direction, train in (("forward", f"fold in (0, {i})"), ("swapped", f"fold not in (0, {i})")):
            parts.append(
                f"select {i} as fold, '{direction}' as direction, round(sqrt(avg(pow(m - y, 2))), 6) as rmsle "
                f"from {rows} join (select {means} avg(y) as m from {rows} where {train} group by all) on {on} "
                f"where not ({train})"
            )
    return " union all ".join(parts)


@check(f"""with {GROUPS_SQL}, rows as (select {CARRIED} as fold, {CELL_SQL} as cell,
        ln(1 + l_extendedprice) as y from lineitem join q on l_orderkey = k)
    {pair_scores_sql("rows", "cell as c,", "cell = c")}""")
def swap_scores_cells(spark, folder):
    """Each pair of folds scored both ways by models of the cells."""
    folded = split.group_folds(cell_matrix(spark, folder), "l_orderkey", rule="carry")
    scores, _ = model.cross_validate(
        split.recombine(materialize(folded, "cell-folds"), 4),
        lambda train, test: (train, test, CELLS), exact_gbt(1, 2),
    )
    return rounded(scores, 6)


STEPS = ["l_linenumber", "l_tax", "l_discount"]


def step_matrix(spark, folder):
    """A cost that two columns decide, by one step each, the first the larger."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "expm1(4e0 * cast(l_linenumber > 3 as int) + cast(l_tax > 0.045 as int)) as cost", *STEPS
    )
    return model.assemble(lines, STEPS, ["l_orderkey", "cost"])


@check("""select 'l_linenumber' as feature, cast(count(distinct l_linenumber > 3) - 1 as double) as score
    from lineitem union all
    select 'l_tax', cast(sum(n - 1) as double) from (select count(distinct l_tax > 0.045) as n
        from lineitem group by l_linenumber > 3)""")
def split_counts(spark, folder):
    """The table of nodes of a tree that splits once at the top and once on either side."""
    matrix = model.materialize_matrix(model.with_log_label(step_matrix(spark, folder), "cost"), "steps")
    return model.named_splits(exact_gbt(1, 2)(matrix), STEPS)


@check("""select feature, cast(3 as bigint) as votes, 0.0e0 as mean_score, cast(6 as bigint) as folds
    from (select 'l_linenumber' as feature from lineitem limit 1)
    union all select 'l_tax', 3, 0, 6 from (select 1 from lineitem limit 1)""")
def cv_votes(spark, folder):
    """Votes by splits of real fits, beside the mean of the scores: the fits leave no error."""
    folded = split.group_folds(step_matrix(spark, folder), "l_orderkey")
    scores, splits = model.cross_validate(
        split.recombine(materialize(folded, "step-folds"), 4),
        lambda train, test: (train, test, STEPS), exact_gbt(1, 2),
    )
    return rounded(model.cv_summary(scores, splits), 6)


# ---- whole plans with a model that predicts the mean

SIDES_SQL = """g as (select tube_assembly_id as k, count(*) as n,
        md5('42:' || tube_assembly_id) as h from quotes group by 1),
    r as (select k, sum(n) over (order by h, k) - n as before, sum(n) over () as total from g),
    sided as (select quotes.*, before <= round_even(total * 0.2e0, 0) as is_test
        from quotes join r on tube_assembly_id = k)"""
#: A row is named by its columns, as the quotes have no number.
ROW_NAME = "concat_ws('|', tube_assembly_id, supplier, cast(quote_date as string), " \
           "cast(annual_usage as string), cast(min_order_quantity as string), cast(quantity as string))"


def quote_sides(spark, folder, **fill):
    quotes = stand_in(spark, folder, "quotes").na.fill(fill) if fill else stand_in(spark, folder, "quotes")
    flagged = materialize(split.group_holdout(quotes, KEY, share=0.2), "sides")
    test, train = split.by_flag(flagged, "is_test")
    return train, test.selectExpr(f"{ROW_NAME} as id", "*").drop("cost")


USABLE = "quantity <> 50 and tube_assembly_id in (select tube_assembly_id from tube where length < 9999)"
SCORE_SQL = f"""with {with_stand_ins("quotes", "tube")}, {SIDES_SQL}
    select {ROW_NAME} as id, round((select exp(avg(ln(1 + cost))) - 1 from sided
        where not is_test and {USABLE}), 3) as cost from sided
    where is_test and tube_assembly_id in (select tube_assembly_id from tube where length < 9999)"""


def mean_scores(spark, folder):
    train, test = quote_sides(spark, folder)
    return plan_score(
        train, test, stand_ins(spark, folder), PLAN_CUTOFFS, fit=exact_gbt(1, 0), outlier_quantity=50
    )


@check(SCORE_SQL)
def score_test_set_mean(spark, folder):
    """The scoring plan end to end: which rows train, which are scored, and on what scale."""
    return rounded(mean_scores(spark, folder), 3)


@check(SCORE_SQL)
def predictions_csv(spark, folder):
    """The same, written as CSV and read back."""
    path = scratch_path(spark, "predictions.csv")
    write_csv_table(mean_scores(spark, folder), path)
    return rounded(read_csv_table(spark, path, "id string, cost double"), 3)


@check(f"""with {with_stand_ins("quotes", "tube")},
    usable as (select * from quotes where {USABLE}),
    g as (select tube_assembly_id as k, count(*) as n, md5('42:' || tube_assembly_id) as h from usable group by 1),
    r as (select k, n, sum(n) over (order by h, k) as upto, sum(n) over () as total from g),
    q as (select *, upto - n as before, round_even(total * 0.25e0, 0) as quota from r),
    e1 as (select min(upto) as e from q where upto >= quota),
    e2 as (select min(upto) as e from q where upto >= quota + (select e from e1)),
    e3 as (select min(upto) as e from q where upto >= quota + (select e from e2)),
    rows as (select ln(1 + cost) as y, {" + ".join(
        f"coalesce(cast(before >= (select e from e{i}) as int), 0)" for i in (1, 2, 3))} as fold
        from usable join q on tube_assembly_id = k)
    {pair_scores_sql("rows", "", "true")}""")
def cross_validated_mean(spark, folder):
    """The cross-validation plan end to end, its folds and both directions."""
    scores, _ = plan_cross_validation(
        stand_in(spark, folder, "quotes"), stand_ins(spark, folder), PLAN_CUTOFFS, fit=exact_gbt(1, 0),
        outlier_quantity=50,
    )
    return rounded(scores, 6)


BASIC_SQL = f"""with {with_stand_ins("quotes")}, {SIDES_SQL},
    mean as (select avg(ln(1 + cost)) as m from sided where not is_test),
    sign as (select m, avg(case when ln(1 + cost) < m then -1e0 else 1e0 end) as s
        from sided, mean where not is_test group by 1)"""


@check(f"""{BASIC_SQL} select {ROW_NAME} as id,
    round((select exp(m + 0.1e0 * s) - 1 from sign), 3) as cost from sided where is_test""")
def basic_score(spark, folder):
    """The smaller plan end to end, with absolute loss: every test quote has a cost."""
    train, test = quote_sides(spark, folder, bracket_pricing="No")
    tables = basic_tables(spark, folder)
    return rounded(
        plan_basic_score(train, test, tables, BASIC_CUTOFFS, fit=exact_gbt(2, 0, "absolute")), 3
    )


@check(f"""{BASIC_SQL} select round(sqrt(avg(pow(m + 0.1e0 * s - ln(1 + cost), 2))), 6) as rmsle
    from sided, sign where is_test""")
def basic_holdout_score(spark, folder):
    """The smaller plan scored on whole assemblies that were held out."""
    quotes = stand_in(spark, folder, "quotes").na.fill({"bracket_pricing": "No"})
    tables = basic_tables(spark, folder)
    return rounded(plan_basic_holdout(quotes, tables, BASIC_CUTOFFS, fit=exact_gbt(2, 0, "absolute")), 6)


# ---- the catalogue through files

@check(ORACLES["tube_features"])
def load_tables_features(spark, folder):
    """Tables written as CSV, opened by the catalogue, taken to features."""
    path = scratch_path(spark, "catalogue")
    names = ["tube", "tube_end_form"]
    for name, df in stand_ins(spark, folder, *names).items():
        write_csv_table(df, f"{path}/{name}.csv")
    tables = load_tables(spark, path, names)
    features = tube_features(tables["tube"], tables["tube_end_form"], PLAN_CUTOFFS)
    return features.withColumn("volume", F.round("volume", 5))
