"""Wide to long and back.  Wide to long is row-local; back is one aggregation."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import as_list, by_name, require_unique


def unpivot(
    df: DataFrame,
    keys: str | Iterable[str],
    columns: Sequence[str],
    value: str,
    slot: str | None = None,
    keep_null: bool = True,
) -> DataFrame:
    """One row per column of the family."""
    long = df.unpivot(
        [by_name(k) for k in as_list(keys)],
        [by_name(c) for c in columns],
        slot or "__slot",
        value,
    )
    if slot is None:
        long = long.drop("__slot")
    return long if keep_null else long.where(by_name(value).isNotNull())


def unpivot_groups(
    df: DataFrame,
    keys: str | Iterable[str],
    groups: Mapping[str, Sequence[str]],
    slot: str | None = None,
) -> DataFrame:
    """Parallel families side by side: row i holds the i-th column of every family."""
    if len({len(columns) for columns in groups.values()}) != 1:
        raise ValueError("families must have the same number of columns")
    rows = [
        F.struct(
            *([F.lit(i).alias(slot)] if slot else []),
            *[by_name(c).alias(name) for name, c in zip(groups, parallel)],
        )
        for i, parallel in enumerate(zip(*groups.values()), start=1)
    ]
    return df.select(*[by_name(k) for k in as_list(keys)], F.inline(F.array(*rows)))


def pivot_measures(
    category: Column,
    value: Column,
    values: Iterable,
    agg: str = "sum",
    prefix: str = "",
) -> list[Column]:
    """One conditional aggregate per category, 0 where the key lacks it.

    Conditional aggregates combine on the map side and need one exchange, where
    the built-in pivot groups twice.
    """
    combine = getattr(F, agg)
    return [
        F.coalesce(combine(F.when(category == v, value)), F.lit(0)).alias(f"{prefix}{v}")
        for v in values
    ]


def pivot_sum(
    df: DataFrame,
    keys: str | Iterable[str],
    category: str,
    value: str,
    values: Iterable,
    agg: str = "sum",
    prefix: str = "",
) -> DataFrame:
    """Long to wide over a given list of categories; keys with none of them drop out."""
    keys, values = as_list(keys), list(values)
    require_unique([*keys, *[f"{prefix}{v}" for v in values]])
    measures = pivot_measures(by_name(category), by_name(value), values, agg, prefix)
    return (
        df.where(by_name(category).isNotNull())
        .groupBy(*[by_name(k) for k in keys])
        .agg(*measures)
    )


def pool_attribute(
    sources: Iterable[tuple[DataFrame, Sequence[str]]], key: str, value: str
) -> DataFrame:
    """(key, value) rows of sibling tables that hold one attribute under several names."""
    return functools.reduce(
        DataFrame.unionByName,
        [unpivot(df, key, columns, value) for df, columns in sources],
    )
