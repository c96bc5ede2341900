"""Categorical encoding: distributions, rare-value buckets, one-hot columns.

A vocabulary is fitted once, on the training side, and then applied as plain
expressions to any table, so train and test get the same columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import as_list, by_name, require_unique
from featloom.operators.clean import null_if_in
from featloom.operators.joins import attach
from featloom.operators.reshape import unpivot
from featloom.session import materialize

MAX_VALUES = 10_000


def distribution(
    df: DataFrame, columns: str | Sequence[str], value: str = "value", count: str = "n"
) -> DataFrame:
    """(value, count) without nulls; several columns are pooled in one scan."""
    columns = as_list(columns)
    if len(columns) == 1:
        pooled = df.select(by_name(columns[0]).alias(value))
    else:
        pooled = unpivot(df, [], columns, value)
    return (
        pooled.where(by_name(value).isNotNull())
        .groupBy(by_name(value))
        .agg(F.count(F.lit(1)).alias(count))
    )


@dataclass(frozen=True)
class Vocabulary:
    """The frequent values of a column, sorted, and the label for the others."""

    values: tuple
    rare_label: str | None = None

    @property
    def labels(self) -> tuple:
        return self.values if self.rare_label is None else (*self.values, self.rare_label)

    def bucket(self, value: Column | str) -> Column:
        """Frequent values as they are, others as the rare label.

        Right for data the vocabulary was fitted on, where every value has been
        counted, and for any data if there is no rare label (cutoff 1): there a
        value outside the vocabulary is an unseen one and becomes null.  Other
        data needs :func:`bucket_rare`.  A column given by name is quicker to
        plan when the vocabulary is long.
        """
        column = by_name(value) if isinstance(value, str) else value
        if not self.values:
            known = F.lit(False)
        elif isinstance(value, str) and all(isinstance(v, str) for v in self.values):
            # One parsed list instead of a call into the JVM per value.
            known = F.expr(f"{quoted(value)} in ({', '.join(map(_text_literal, self.values))})")
        else:
            known = column.isin(*self.values)
        kept = F.when(known, column)
        if self.rare_label is None:
            return kept
        return kept.when(column.isNotNull(), F.lit(self.rare_label))

    def match_sql(self, column: str, null_values: Sequence = ()) -> list[str]:
        """0 or 1 for each label, in the order of ``labels``, never null, as SQL text.

        A label is compared with the column itself and the list of values is written out
        once, for the rare label, so the text grows with the values, not their square.
        """
        name = quoted(column)
        known = [_literal(v) for v in self.values]
        found = [f"coalesce(cast({name} = {v} as int), 0)" for v in known]
        if self.rare_label is None:
            return found
        listed = ", ".join([*known, *map(_literal, null_values)])
        rare = f"{name} is not null" + (f" and {name} not in ({listed})" if listed else "")
        return [*found, f"cast({rare} as int)"]

    def matches(self, column: str, null_values: Sequence = ()) -> list[Column]:
        return [F.expr(text) for text in self.match_sql(column, null_values)]


def _literal(value) -> str:
    return _text_literal(value) if isinstance(value, str) else repr(value)


def quoted(column: str) -> str:
    """A column name as SQL writes it."""
    return f"`{column.replace('`', '``')}`"


def _text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_vocab(
    counts: DataFrame,
    cutoff: int = 1,
    rare_label: str | None = None,
    value: str = "value",
    count: str = "n",
    max_values: int = MAX_VALUES,
) -> Vocabulary:
    """Values counted at least ``cutoff`` times.

    They become columns, so a list longer than ``max_values`` is refused rather
    than shortened.  No more than ``max_values + 1`` rows reach the driver.
    """
    frequent = counts.where(by_name(count) >= cutoff).select(by_name(value).alias("v"))
    values = [row.v for row in frequent.limit(max_values + 1).collect()]
    if len(values) > max_values:
        raise ValueError(f"more than {max_values} frequent values: raise the cutoff")
    return Vocabulary(tuple(sorted(values)), rare_label if cutoff > 1 else None)


def fit_frequent(
    df: DataFrame, columns: str | Sequence[str], cutoff: int, null_values: Sequence = ()
) -> DataFrame:
    """(value) of the values counted at least ``cutoff`` times: a vocabulary of any length, as a table."""
    counts = distribution(df, columns)
    if null_values:
        counts = counts.where(~F.col("value").isin(*null_values))
    return materialize(counts.where(F.col("n") >= cutoff).select("value"), "frequent-values")


def bucket_frequent(
    df: DataFrame, columns: str | Sequence[str], frequent: DataFrame, rare_label: str | None = None,
    skew: bool | None = None,
) -> DataFrame:
    """What :meth:`Vocabulary.bucket` gives, for a table of frequent values: no list becomes a plan.

    The table is written out, so Spark knows its size and sends a small one to every task.
    """
    listed = frequent.select(by_name("value").alias("__value"), F.lit(True).alias("__frequent"))
    original = df.columns
    for column in as_list(columns):
        c = by_name(column)
        bucketed = F.when(F.col("__frequent"), c).when(c.isNotNull(), F.lit(rare_label))
        df = attach(df, listed, column, "__value", skew=skew).select(
            *[bucketed.alias(n) if n == column else by_name(n) for n in original]
        )
    return df


def fit_column_vocab(
    df: DataFrame,
    columns: str | Sequence[str],
    cutoff: int = 1,
    rare_label: str | None = None,
    max_values: int = MAX_VALUES,
    null_values: Sequence = (),
) -> Vocabulary:
    """Count the columns, pooled, and keep the frequent values; ``null_values`` do not count."""
    counts = distribution(df, columns)
    if null_values:
        counts = counts.where(~F.col("value").isin(*null_values))
    return fit_vocab(counts, cutoff, rare_label, max_values=max_values)


@dataclass(frozen=True)
class VocabularySpec:
    """A vocabulary to fit: columns counted together, and where to cut."""

    columns: tuple[str, ...]
    cutoff: int = 1
    rare_label: str | None = None
    null_values: tuple = ()


def frequent_values(df: DataFrame, specs: Mapping[str, VocabularySpec]) -> DataFrame:
    """(name, value, n): the frequent values of all vocabularies, counted exactly in one scan.

    A cell gives one row for each vocabulary that counts its column; equal cells are added
    up before the one exchange.  Columns must be text.
    """
    odd = sorted({c for s in specs.values() for c in s.columns if dict(df.dtypes)[c] != "string"})
    if odd:
        raise ValueError(f"not text: {odd}")
    cells = [
        F.struct(F.lit(name).alias("name"), by_name(c).alias("value"))
        for name, spec in specs.items() for c in spec.columns
    ]
    counts = (
        df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
        .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    kept = F.lit(False)
    for name, spec in specs.items():
        fits = (F.col("name") == name) & (F.col("n") >= spec.cutoff)
        if spec.null_values:
            fits = fits & ~F.col("value").isin(*spec.null_values)
        kept = kept | fits
    return counts.where(kept)


def fit_vocabularies(
    df: DataFrame, specs: Mapping[str, VocabularySpec], max_values: int = MAX_VALUES
) -> dict[str, Vocabulary]:
    """All vocabularies of a table in one job; each at most ``max_values`` long, or none is made."""
    found: dict[str, list] = {name: [] for name in specs}
    for row in frequent_values(df, specs).limit(max_values * len(specs) + 1).collect():
        found[row.name].append(row.value)
    for name, values in found.items():
        if len(values) > max_values:
            raise ValueError(f"{name}: more than {max_values} frequent values: raise the cutoff")
    return {
        name: Vocabulary(tuple(sorted(values)), specs[name].rare_label if specs[name].cutoff > 1 else None)
        for name, values in found.items()
    }


def fold_counts(df: DataFrame, column: str, folds: int, fold: str = "fold") -> DataFrame:
    """(pair, side, value, n): how often each side of each pair of folds has a value.

    The column is counted once, by fold.  Side ``first`` of pair i is folds 0 and i;
    ``second`` is what the total leaves, rows without a fold among it.
    """
    by_fold = df.where(by_name(column).isNotNull()).groupBy(by_name(column).alias("value")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(by_name(fold) == i, 1)).alias(f"n{i}") for i in range(folds)],
    )
    first = [F.col("n0") + F.col(f"n{i}") for i in range(1, folds)]
    sides = [
        F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), n.alias("n"))
        for i, f in enumerate(first, 1) for side, n in (("first", f), ("second", F.col("total") - f))
    ]
    return by_fold.select("value", F.inline(F.array(*sides))).where("n > 0").select("pair", "side", "value", "n")


def bucket_rare(
    df: DataFrame,
    columns: str | Sequence[str],
    counts: DataFrame,
    cutoff: int = 1,
    rare_label: str = "Rare",
    null_values: Iterable = (),
    value: str = "value",
    count: str = "n",
    skew: bool | None = None,
) -> DataFrame:
    """Bucket columns against a fitted distribution of any size.

    Counted below ``cutoff``: the rare label.  Not counted at all, null, or one
    of ``null_values``: null.  Otherwise unchanged.
    """
    null_values = list(null_values)
    seen = counts.select(by_name(value).alias("__value"), by_name(count).alias("__count"))
    original = df.columns
    for column in as_list(columns):
        c = by_name(column)
        cleaned = null_if_in(c, null_values) if null_values else c
        bucketed = F.when(F.col("__count") < cutoff, F.lit(rare_label)).when(
            F.col("__count").isNotNull(), c
        )
        df = attach(
            df.withColumn(column, cleaned) if null_values else df,
            seen, column, "__value", skew=skew,
        ).select(
            *[bucketed.alias(n) if n == column else by_name(n) for n in original]
        )
    return df


def indicators(value: Column, labels: Iterable, prefix: str = "") -> list[Column]:
    """0/1 columns, one per label; null gives all zeros."""
    return [
        F.coalesce((value == label).cast("int"), F.lit(0)).alias(f"{prefix}{label}")
        for label in labels
    ]


def one_hot(
    df: DataFrame,
    columns: str | Sequence[str],
    labels: Iterable | dict[str, Iterable],
    prefixed: bool = False,
    drop: bool = True,
) -> DataFrame:
    """0/1 columns per label, in one projection; ``column_label`` names if prefixed."""
    columns = as_list(columns)
    by_column = labels if isinstance(labels, dict) else {c: list(labels) for c in columns}
    added: list[Column] = []
    names = [n for n in df.columns if not (drop and n in columns)]
    output = list(names)
    for column in columns:
        prefix = f"{column}_" if prefixed else ""
        wanted = list(by_column[column])
        added += indicators(by_name(column), wanted, prefix)
        output += [f"{prefix}{label}" for label in wanted]
    require_unique(output)
    return df.select(*[by_name(n) for n in names], *added)


def one_hot_vector(df: DataFrame, column: str, labels: Sequence[str], output: str) -> DataFrame:
    """A sparse one-hot vector, for vocabularies too wide for columns; null gives all zeros."""
    from pyspark.ml.feature import OneHotEncoder

    indexed = label_index(df, column, labels, "__slot")
    indexed = indexed.withColumn("__slot", F.coalesce("__slot", F.lit(len(labels))))
    # Encoding len(labels) + 1 slots and dropping the last leaves null and unseen all zero.
    sizes = df.sparkSession.range(len(labels) + 1).select(F.col("id").cast("int").alias("__slot"))
    encoder = OneHotEncoder(inputCol="__slot", outputCol=output, dropLast=True).fit(sizes)
    return encoder.transform(indexed).drop("__slot")


def label_index(df: DataFrame, column: str, labels: Sequence[str], output: str) -> DataFrame:
    """Position of the value in the sorted labels; null for null and unseen values."""
    from pyspark.ml.feature import StringIndexerModel

    ordered = sorted(labels)
    model = StringIndexerModel.from_labels(
        ordered, inputCol=column, outputCol="__index", handleInvalid="keep"
    )
    index = F.col("__index").cast("int")
    return model.transform(df).select(
        *[by_name(n) for n in df.columns],
        F.when(index < len(ordered), index).alias(output),
    )


def align_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; missing ones are 0."""
    present = set(df.columns)
    return df.select(*[by_name(c) if c in present else F.lit(0).alias(c) for c in columns])
