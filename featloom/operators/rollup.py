"""Rolling slots, dimensions and attributes up to one row per key.

Roll-ups of one key share a single aggregation where they can: the per-component
tables are merged into one (they are dimensions), the slots are joined to it
once, and one ``groupBy`` sums everything.

A table of a hundred measures, most of them null, takes a small part of its memory on
disk, so the size of its files does not tell whether it can go to every task.  Where the
caller knows its size in memory (``table_bytes``), that decides: up to
``featloom.broadcast.maxBytes`` the table goes to the slots; beyond, the slots are summed
by key and component first and both sides are shuffled by component.  A row of measures then
moves for each of them, so slots that read much are taken in steps, a share of the keys each:
on disk are the moved rows of one step and the sums of those before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, IntegralType, LongType

from featloom.functions.columns import as_list, by_name, require_unique
from featloom.functions.scalars import (
    flag,
    is_positive,
    leading_token,
    row_count_non_null,
    row_sum,
)
from featloom.operators.clean import null_if_in
from featloom.operators.encode import (
    MAX_VALUES,
    Vocabulary,
    distribution,
    fit_column_vocab,
    fit_vocab,
    quoted,
)
from featloom.operators.joins import attach, input_bytes, packed_columns, packed_field, reads_much
from featloom.operators.reshape import pivot_sum, pool_attribute, unpivot
from featloom.session import drop_files, materialize, materialize_measured

# Component tables of more bytes in memory than this are not sent to every task.
BROADCAST_BYTES_CONF = "featloom.broadcast.maxBytes"
BROADCAST_BYTES = 64 << 20
# Slots that read more bytes than this meet a table that is shuffled in several steps.
STEP_BYTES_CONF = "featloom.wide.stepBytes"
STEP_BYTES = 1 << 30
MOST_STEPS = 64


def sum_by(
    df: DataFrame, keys: str | Iterable[str], measures: Sequence[str]
) -> DataFrame:
    """Sums of an explicit list of measures; combines on the map side."""
    return df.groupBy(*[by_name(k) for k in as_list(keys)]).agg(
        *[F.sum(by_name(m)).alias(m) for m in measures]
    )


def occurrence_counts(value: Column, labels: Iterable, prefix: str = "") -> list[Column]:
    return [
        F.sum(F.coalesce((value == label).cast("int"), F.lit(0))).alias(f"{prefix}{label}")
        for label in labels
    ]


def multi_hot(
    df: DataFrame, keys: str | Iterable[str], category: str, labels: Iterable, prefix: str = ""
) -> DataFrame:
    """How often each label occurs per key; a key with none of them has zeros."""
    keys, labels = as_list(keys), list(labels)
    require_unique([*keys, *[f"{prefix}{label}" for label in labels]])
    return df.groupBy(*[by_name(k) for k in keys]).agg(
        *occurrence_counts(by_name(category), labels, prefix)
    )


def row_multi_hot(
    columns: Sequence[str], vocab: Vocabulary, prefix: str = "", null_values: Sequence = ()
) -> list[str]:
    """The same counts across columns of one row: no shuffle, for tables unique by key.

    Texts for ``selectExpr``, which takes thousands of them in one call.
    """
    by_column = [vocab.match_sql(c, null_values) for c in columns]
    return [
        f"{' + '.join(cells)} as {quoted(f'{prefix}{label}')}"
        for label, cells in zip(vocab.labels, zip(*by_column))
    ]


def component_quantity(
    slots: DataFrame,
    key: str,
    component: str = "component",
    quantity: str = "quantity",
    cutoff: int = 3000,
    rare_label: str = "RareComponent",
    vocab: Vocabulary | None = None,
    prefix: str = "",
) -> DataFrame:
    """Quantity of each frequent component per key, the others pooled."""
    if vocab is None:
        vocab = fit_column_vocab(slots, component, cutoff, rare_label)
    bucketed = slots.withColumn(component, vocab.bucket(component))
    return pivot_sum(bucketed, key, component, quantity, vocab.labels, prefix=prefix)


def named_components(
    components: DataFrame,
    cutoff: int,
    rare_label: str,
    component_id: str = "component_id",
    name: str = "name",
    base: bool = False,
    prefix: str = "",
    vocab: Vocabulary | None = None,
    max_values: int = MAX_VALUES,
) -> tuple[DataFrame, Vocabulary]:
    """One-hot names (or leading tokens of names), one row per component."""
    value = leading_token(by_name(name)) if base else by_name(name)
    named = components.select(by_name(component_id), value.alias("__name"))
    if vocab is None:
        vocab = fit_column_vocab(named, "__name", cutoff, rare_label, max_values)
    hot = [m.alias(f"{prefix}{label}") for label, m in zip(vocab.labels, vocab.matches("__name"))]
    return named.select(by_name(component_id), *hot), vocab


def pooled_components(
    sources: Iterable[tuple[DataFrame, Sequence[str]]],
    cutoff: int,
    rare_label: str,
    component_id: str = "component_id",
    prefix: str = "",
    max_values: int = MAX_VALUES,
) -> tuple[DataFrame, Vocabulary]:
    """Counts of an attribute pooled over sibling tables, one row per component.

    The fan-out side is aggregated here, before any join to the slots.
    """
    long = pool_attribute(sources, component_id, "__value")
    vocab = fit_vocab(distribution(long, "__value"), cutoff, rare_label, max_values=max_values)
    bucketed = long.withColumn("__value", vocab.bucket("__value"))
    return multi_hot(bucketed, component_id, "__value", vocab.labels, prefix), vocab


def summed_slots(
    slots: DataFrame, key: str, component: str = "component", quantity: str | None = None
) -> DataFrame:
    """(key, component, quantity, __slots): a key's slots of one component as one row."""
    sums = [F.count(F.lit(1)).alias("__slots")]
    if quantity is not None:
        sums.insert(0, F.sum(by_name(quantity)).alias(quantity))
    return slots.groupBy(by_name(key), by_name(component)).agg(*sums)


# Wide rows mostly compress so well that bytes say little of their memory: the partitions they
# are summed in are counted by the bytes the plan reads, so many to one.
WIDE_READ_BYTES = 2 << 20
WIDE_PARTITIONS = 8
MOST_PARTITIONS = 10_000
UNKNOWN_BYTES = 1 << 55
MEASURES = "__measures"


def wide_partitions(df: DataFrame) -> int | None:
    """Partitions to sum wide rows in; None where the input is small, or its size not known."""
    read = input_bytes(df)
    # Spark gives a source without statistics the largest number there is.
    if read is None or read >= UNKNOWN_BYTES or read // WIDE_READ_BYTES < WIDE_PARTITIONS:
        return None
    return min(read // WIDE_READ_BYTES, MOST_PARTITIONS)


def wide_steps(slots: DataFrame) -> int:
    """In how many steps slots meet a table that is shuffled."""
    read = input_bytes(slots)
    if read is None or read >= UNKNOWN_BYTES:
        return 1
    step = int(slots.sparkSession.conf.get(STEP_BYTES_CONF, str(STEP_BYTES)))
    return max(1, min(-(-read // step), MOST_STEPS))


def dealt_by(df: DataFrame, key: str, steps: int = 1) -> DataFrame:
    """Rows of a key in one partition, of which there are enough to sum wide rows in memory.

    Sums by the key need no further exchange then.  AQE puts together those of a small input.
    """
    wanted = wide_partitions(df)
    if wanted is None:
        return df.repartition(by_name(key))
    return df.repartition(max(wanted // steps, WIDE_PARTITIONS), by_name(key))


Summed = Callable[[DataFrame, Column | None], DataFrame]


def _with_measures(
    slots: DataFrame, table: DataFrame, key: str, component: str, component_id: str,
    quantity: str | None, how: str, skew: bool | None, table_bytes: int | None, summed: Summed,
) -> DataFrame:
    """``summed`` of the slots with the measures of their component.

    It is also given how many slots a row stands for, if not one.  The measures are one struct,
    which joins and exchanges copy in one piece.
    """
    slots = slots.select(*[by_name(c) for c in (key, component, quantity) if c is not None])
    measures = [c for c in table.columns if c != component_id]
    pack = [by_name(component_id), *([packed_columns(measures, MEASURES)] if measures else [])]
    if table_bytes is None:
        if skew is not None or wide_partitions(slots) is None:
            return summed(attach(slots, table.select(*pack), component, component_id, how=how, skew=skew), None)
        table, table_bytes = materialize_measured(table, "component-measures")
    most = int(slots.sparkSession.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES)))
    if table_bytes <= most:
        # The slots are narrow: dealt by key here, their sums need no exchange of wide rows.
        sent = F.broadcast(table.select(*pack))
        return summed(attach(dealt_by(slots, key), sent, component, component_id, how=how, skew=False), None)
    skew, steps = reads_much(slots) if skew is None else skew, wide_steps(slots)
    own = summed_slots(slots, key, component, quantity)
    if steps > 1:
        own = slots = materialize(own, "summed-slots")
        if not _is_source(table):
            table = materialize(table, "component-measures")
    table = table.select(*pack)

    def step(rows: DataFrame, hot_from: DataFrame) -> DataFrame:
        # The hint keeps Spark from sending the table out for its small files.
        joined = attach(
            rows, table.hint("merge"), component, component_id,
            how=how, skew=skew, hot_from=hot_from.select(by_name(component)),
        )
        # Dealt by component, rows of a key do not meet: summing them before the exchange only spills.
        return summed(dealt_by(joined, key, steps), F.col("__slots"))

    if steps == 1:
        return step(own, slots)
    share = F.pmod(F.xxhash64(by_name(key)), F.lit(steps))
    parts = [step(own.where(share == i), slots.where(share == i)) for i in range(steps)]
    # Names are numbers in the files, as labels may be any text.
    numbered = [
        materialize(part.toDF(*[f"c{i}" for i in range(len(part.columns))]), "wide-sums").toDF(*part.columns)
        for part in parts
    ]
    drop_files(own)
    return functools.reduce(DataFrame.unionByName, numbered)


def _is_source(df: DataFrame) -> bool:
    """Whether the rows are read from files as they are."""
    try:
        return df._jdf.queryExecution().optimizedPlan().children().isEmpty()
    except AttributeError:
        return False


def sum_components(
    slots: DataFrame,
    table: DataFrame,
    key: str,
    component: str = "component",
    component_id: str = "component_id",
    how: str = "left",
    skew: bool | None = None,
    table_bytes: int | None = None,
) -> DataFrame:
    """Slots joined to a one-row-per-component table, its measures summed per key.

    ``table_bytes``: the table's size in memory (see above); None leaves the join of small slots
    to Spark, and for others the table is written out to take its size.
    """
    measures = [c for c in table.columns if c != component_id]
    return _with_measures(
        slots, table, key, component, component_id, None, how, skew, table_bytes,
        lambda joined, times: joined.groupBy(by_name(key)).agg(*_summed(measures, times)),
    )


def _summed(measures: Sequence[str], times: Column | None) -> list[Column]:
    fields = [packed_field(MEASURES, i) for i in range(len(measures))]
    return [F.sum(f if times is None else f * times).alias(m) for m, f in zip(measures, fields)]


def attributes(
    slots: DataFrame,
    table: DataFrame,
    key: str,
    component: str = "component",
    component_id: str = "component_id",
) -> DataFrame:
    """Measures of the components a key holds, summed; keys without any drop out."""
    return sum_components(slots, table, key, component, component_id, how="inner")


def base_name_counts(
    slots: DataFrame, components: DataFrame, key: str,
    cutoff: int = 1000, rare_label: str = "RareBaseName",
) -> DataFrame:
    table, _ = named_components(components, cutoff, rare_label, base=True)
    return sum_components(slots, table, key)


def name_counts(
    slots: DataFrame, components: DataFrame, key: str,
    cutoff: int = 200, rare_label: str = "RareComponentName",
) -> DataFrame:
    table, _ = named_components(components, cutoff, rare_label)
    return sum_components(slots, table, key)


def pooled_counts(
    slots: DataFrame,
    sources: Iterable[tuple[DataFrame, Sequence[str]]],
    key: str,
    cutoff: int,
    rare_label: str,
) -> DataFrame:
    table, _ = pooled_components(sources, cutoff, rare_label)
    return sum_components(slots, table, key)


def merge_components(tables: Sequence[DataFrame], component_id: str = "component_id") -> DataFrame:
    """One row per component with the measures of all tables: one exchange for any number.

    A table's measures are one struct, so a stacked row holds no column for each measure of the
    others.  A component mostly has one row in a table, whose values are its sums.
    """
    measures = [[c for c in t.columns if c != component_id] for t in tables]
    require_unique([component_id, *[c for names in measures for c in names]])
    packs = [(t, names, f"__table_{i}") for i, (t, names) in enumerate(zip(tables, measures)) if names]
    stacked = functools.reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [t.select(by_name(component_id), packed_columns(names, pack)) for t, names, pack in packs]
        + [t.select(by_name(component_id)) for t, names in zip(tables, measures) if not names],
    )
    listed = dealt_by(stacked, component_id).groupBy(by_name(component_id)).agg(
        *[F.collect_list(pack).alias(pack) for _, _, pack in packs]
    )
    return listed.select(by_name(component_id), *[
        _sum_listed(pack, i, t.schema[name].dataType).alias(name)
        for t, names, pack in packs for i, name in enumerate(names)
    ])


def _sum_listed(pack: str, i: int, kind: DataType) -> Column:
    """``sum`` of a field over a list of structs: null passed over, and null if nothing is left."""
    if isinstance(kind, DecimalType):
        wide = DecimalType(min(38, kind.precision + 10), kind.scale)
    else:
        wide = LongType() if isinstance(kind, IntegralType) else DoubleType()
    values = F.filter(F.transform(F.col(pack), lambda row: row.getField(f"f{i}").cast(wide)), F.isnotnull)
    total = F.aggregate(
        values, F.lit(None).cast(wide),
        lambda total, x: (F.coalesce(total, F.lit(0).cast(wide)) + x).cast(wide),
    )
    return F.when(F.size(pack) <= 1, F.get(pack, F.lit(0)).getField(f"f{i}").cast(wide)).otherwise(total)


def bill_rollup(
    slots: DataFrame,
    component_table: DataFrame,
    key: str,
    vocab: Vocabulary | None = None,
    component: str = "component",
    quantity: str = "quantity",
    component_id: str = "component_id",
    prefix: str = "",
    null_values: Sequence[str] = (),
    skew: bool | None = None,
    table_bytes: int | None = None,
) -> DataFrame:
    """Component quantities, total quantity and every component measure in one aggregation.

    Components among ``null_values`` get no quantity column but keep their measures.
    ``table_bytes`` is the component table's size in memory, if known.
    """
    measures = [c for c in component_table.columns if c != component_id]
    quantities: list[Column] = [F.sum(by_name(quantity)).alias("total_components")]
    names = ["total_components"]
    if vocab is not None:
        bucketed = vocab.bucket(
            null_if_in(by_name(component), null_values) if null_values else component
        )
        quantities += [
            F.sum(F.when(F.col("__bucket") == label, by_name(quantity))).alias(
                f"{prefix}{label}"
            )
            for label in vocab.labels
        ]
        names += [f"{prefix}{label}" for label in vocab.labels]
    require_unique([key, *names, *measures])

    def summed(joined: DataFrame, times: Column | None) -> DataFrame:
        if vocab is not None:
            joined = joined.withColumn("__bucket", bucketed)
        return joined.groupBy(by_name(key)).agg(*quantities, *_summed(measures, times))

    return _with_measures(
        slots, component_table, key, component, component_id, quantity, "left", skew, table_bytes, summed
    )


def spec_counts(
    specs: DataFrame,
    key: str,
    columns: Sequence[str],
    cutoff: int = 2000,
    rare_label: str = "RareSpec",
    unique_key: bool = True,
    prefix: str = "",
    max_values: int = MAX_VALUES,
) -> DataFrame:
    """``has_specs`` and the count of every frequent code; rare codes and the total are left out.

    With one row per key the counts are row-local.  Otherwise they are grouped
    and joined back to every row of the key.
    """
    vocab = fit_column_vocab(specs, columns, cutoff, rare_label, max_values)
    codes = vocab.values
    require_unique([key, "has_specs", *[f"{prefix}{code}" for code in codes]])
    has_specs = is_positive(row_count_non_null(columns)).alias("has_specs")
    kept = [by_name(c) for c in specs.columns if c not in columns]
    if unique_key:
        flagged = specs.select("*", has_specs)
        names = [quoted(c) for c in flagged.columns if c not in columns]
        return flagged.selectExpr(*names, *row_multi_hot(columns, Vocabulary(codes), prefix))
    grouped = multi_hot(unpivot(specs, key, columns, "__code"), key, "__code", codes, prefix)
    return attach(specs.select(*kept, has_specs), grouped, key, hot_from=specs)


def end_counts(
    tubes: DataFrame,
    key: str,
    columns: Sequence[str] = ("end_a", "end_x"),
    cutoff: int = 20,
    rare_label: str = "RareEnd",
    unique_key: bool = True,
    drop: bool = True,
    prefix: str = "",
    null_values: Sequence[str] = (),
    vocab: Vocabulary | None = None,
) -> DataFrame:
    """Counts of end codes over the end columns, added to each row."""
    if vocab is None:
        vocab = fit_column_vocab(tubes, columns, cutoff, rare_label, null_values=null_values)

    def bucket(value: Column) -> Column:
        return vocab.bucket(null_if_in(value, null_values) if null_values else value)

    kept = [c for c in tubes.columns if not (drop and c in columns)]
    require_unique([*kept, *[f"{prefix}{label}" for label in vocab.labels]])
    kept_columns = [by_name(c) for c in kept]
    if unique_key:
        return tubes.selectExpr(*map(quoted, kept), *row_multi_hot(columns, vocab, prefix, null_values))
    long = unpivot(tubes, key, columns, "__end")
    long = long.withColumn("__end", bucket(F.col("__end")))
    grouped = multi_hot(long, key, "__end", vocab.labels, prefix)
    return attach(tubes.select(*kept_columns), grouped, key, how="inner", hot_from=tubes)


def totals(
    df: DataFrame,
    counted: Mapping[str, Sequence[str]] | None = None,
    summed: Mapping[str, Sequence[str]] | None = None,
    positive: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row totals with their flags.

    ``counted``: ``{"specs": columns}`` gives ``total_specs`` (non-null columns)
    and ``has_specs``; ``summed`` does so with a sum; ``positive``:
    ``{"has_boss": "num_boss"}`` flags a column above 0.
    """
    added: list[Column] = []
    for name, columns in (counted or {}).items():
        total = row_count_non_null(columns)
        added += [total.alias(f"total_{name}"), flag(total > 0).alias(f"has_{name}")]
    for name, columns in (summed or {}).items():
        total = row_sum(columns)
        added += [total.alias(f"total_{name}"), flag(total > 0).alias(f"has_{name}")]
    for name, column in (positive or {}).items():
        added.append(is_positive(by_name(column)).alias(name))
    return df.select("*", *added)
