"""Decoding, sentinels, fills and row filters.  All row-local."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name

# The words a flag column may hold.
YES_WORDS = ("Yes", "Y")
NO_WORDS = ("No", "N")

RAISE = "raise"


def decode_flag(
    value: Column, on_null: int | str | None = 0, on_other: str | None = None
) -> Column:
    """Yes/Y to 1 and No/N to 0.

    ``on_null`` is the number for null; ``RAISE`` for either argument fails the
    job on such a row.  Other words give null.
    """
    def failure(what: Column) -> Column:
        return F.raise_error(F.concat(F.lit("not a flag: "), what)).cast("int")

    for_null = failure(F.lit("null")) if on_null == RAISE else F.lit(on_null).cast("int")
    for_other = failure(value) if on_other == RAISE else F.lit(None).cast("int")
    return (
        F.when(value.isNull(), for_null)
        .when(value.isin(*YES_WORDS), F.lit(1))
        .when(value.isin(*NO_WORDS), F.lit(0))
        .otherwise(for_other)
    )


def decode_flag_strict(value: Column) -> Column:
    return decode_flag(value, on_null=RAISE, on_other=RAISE)


def replace_sentinel(value: Column, replacement, sentinel=9999) -> Column:
    return F.when(value == sentinel, F.lit(replacement)).otherwise(value)


def null_if_in(value: Column, words: Iterable) -> Column:
    return F.when(~value.isin(*words), value)


def fill_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(constants))


def zero_fill(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return df.na.fill(0, subset=None if columns is None else list(columns))


def fill_by_category(value: Column, category: Column, defaults: Mapping) -> Column:
    """Null becomes the default of its category; other categories stay null."""
    pairs = [F.lit(x) for pair in defaults.items() for x in pair]
    return F.coalesce(value, F.try_element_at(F.create_map(*pairs), category))


def canonicalise(df: DataFrame, column: str, rewrites: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(rewrites), subset=[column])


def override_where(value: Column, selector: Column, overrides: Mapping) -> Column:
    """Where the selector equals a key, its override; elsewhere the value itself."""
    chosen: Column | None = None
    for key, override in overrides.items():
        hit, new = selector == key, F.lit(override)
        chosen = F.when(hit, new) if chosen is None else chosen.when(hit, new)
    return value if chosen is None else chosen.otherwise(value)


def fit_means(df: DataFrame, columns: Iterable[str]) -> dict[str, float]:
    """Means of the non-missing values: one aggregate row reaches the driver."""
    columns = list(columns)
    row = df.agg(*[F.avg(by_name(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fill_mean(df: DataFrame, columns: Iterable[str], fitted_on: DataFrame | None = None) -> DataFrame:
    return df.na.fill(fit_means(df if fitted_on is None else fitted_on, columns))


def drop_value(df: DataFrame, column: str, value) -> DataFrame:
    """Rows that differ from the value; a null differs."""
    c = by_name(column)
    return df.where((c != value) | c.isNull())


def keep_below(df: DataFrame, column: str, limit, inclusive: bool = False) -> DataFrame:
    c = by_name(column)
    return df.where(c <= limit if inclusive else c < limit)


def keep_between(df: DataFrame, column: str, low, high, inclusive: bool = False) -> DataFrame:
    c = by_name(column)
    return df.where(c.between(low, high) if inclusive else (c > low) & (c < high))
