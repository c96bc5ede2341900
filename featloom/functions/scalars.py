"""Row-local expressions.  All are built-ins, so they stay inside code generation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "dayofyear": F.dayofyear,
    "dayofweek": F.weekday,  # Monday is 0
    "day": F.dayofmonth,
}


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def is_positive(value: Column) -> Column:
    return flag(value > 0)


def inverse_log(value: Column) -> Column:
    """1 / ln(1 + x), and 0 at x = 0."""
    return F.when(value == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), F.log1p(value)))


def inverse_plus_one(value: Column) -> Column:
    return F.try_divide(F.lit(1.0), 1 + value)


def log_label(value: Column) -> Column:
    return F.log1p(value)


def unlog(value: Column) -> Column:
    return F.expm1(value)


def safe_ratio(numerator: Column, denominator: Column, root: int = 1) -> Column:
    """A ratio or a root of one; null where the denominator is 0."""
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if root == 1:
        return ratio
    return F.cbrt(ratio) if root == 3 else F.pow(ratio, 1.0 / root)


def wall_volume(diameter: Column, wall: Column, length: Column) -> Column:
    """Difference of the discs of diameter d and d - w, times the length."""
    def disc(d: Column) -> Column:
        return F.pi() * F.pow(d / 2, 2)

    return (disc(diameter) - disc(diameter - wall)) * length


def round_share(total: Column, share: float) -> Column:
    """Rows that make up a share, rounding halves to the even number."""
    return F.bround(total * F.lit(float(share))).cast("long")


def leading_token(name: Column) -> Column:
    """Text up to the first blank or hyphen; null where there is none."""
    return F.nullif(F.regexp_extract(name, "^([^ -]+)", 1), F.lit(""))


def date_parts(
    df: DataFrame,
    date: str,
    parts: Iterable[str] = ("year", "month", "dayofyear", "dayofweek"),
    drop: bool = True,
) -> DataFrame:
    added = [DATE_PARTS[p](by_name(date)).alias(p) for p in parts]
    kept = [by_name(n) for n in df.columns if not (drop and n == date)]
    return df.select(*kept, *added)


def row_count_non_null(columns: Iterable[str]) -> Column:
    return functools.reduce(
        operator.add, [by_name(c).isNotNull().cast("int") for c in columns]
    )


def row_sum(columns: Iterable[str]) -> Column:
    """Sum across columns of one row, null counting as 0."""
    return functools.reduce(
        operator.add, [F.coalesce(by_name(c).cast("double"), F.lit(0.0)) for c in columns]
    )
