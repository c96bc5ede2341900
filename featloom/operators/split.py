"""Splits that keep a group on one side.

Groups are drawn in the order of a seeded hash of their label, so a split can be
repeated on any cluster.  The running row count that decides where a fold ends is
taken in two levels, hash buckets and then groups inside a bucket, so that no
task sees all groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.functions.columns import as_list, by_name
from featloom.functions.scalars import round_share
from featloom.operators.joins import attach
from featloom.session import materialize

# Hex digits of the hash that name a bucket: 4096 buckets.  Add one per 16-fold
# growth of the number of groups beyond about 10^10.
BUCKET_DIGITS = 3


def _counted_groups(
    df: DataFrame, label: str, seed: int, digits: int, written: bool = False
) -> DataFrame:
    """(label, rows, order, bucket), one row per group; combines on the map side.

    ``written``: the counts are taken once, where two steps of the caller would each take them.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), by_name(label).cast("string")))
    counts = df.where(by_name(label).isNotNull()).groupBy(by_name(label)).agg(F.count(F.lit(1)).alias("__rows"))
    if written:
        counts = materialize(counts, "groups")
    return counts.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, digits))


def _bucket_offsets(groups: DataFrame) -> DataFrame:
    """Rows before each bucket, and in total.  One task, over at most 16**digits rows."""
    buckets = groups.groupBy("__bucket").agg(F.sum("__rows").alias("__in_bucket"))
    so_far = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return buckets.select(
        F.col("__bucket").alias("__bucket_key"),
        "__in_bucket",
        (F.sum("__in_bucket").over(so_far) - F.col("__in_bucket")).alias("__offset"),
        F.sum("__in_bucket").over(everything).alias("__total"),
    )


def _running(groups: DataFrame, offsets: DataFrame, label: str) -> DataFrame:
    """(label, before, upto, total): rows of the groups drawn before, and with, this one."""
    inside = (
        Window.partitionBy("__bucket")
        .orderBy("__order", by_name(label))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("__offset") + F.sum("__rows").over(inside)
    # The bucket table is bounded by its key, 16**digits values.
    joined = groups.join(
        F.broadcast(offsets), F.col("__bucket") == F.col("__bucket_key")
    )
    return joined.select(
        by_name(label),
        "__bucket",
        (upto - F.col("__rows")).alias("__before"),
        upto.alias("__upto"),
        "__total",
    )


def _quota_ends(running: DataFrame, share: float, folds: int) -> list[Column]:
    """Row counts at which the folds but the last close, as expressions; null where none does.

    A fold closes with the group that brings it to the quota, and the next one starts
    counting from 0, so each end is the least running count that reaches the end before
    plus the quota.  They are scalar subqueries, one inside the other: the numbers never
    come to the driver and no job runs for them alone.
    """
    quota = round_share(F.col("__total"), share)
    ends: list[Column] = []
    start: Column = F.lit(0)
    for _ in range(folds - 1):
        reached = F.when(F.col("__upto") >= start + quota, F.col("__upto"))
        start = running.agg(F.min(reached).alias("__end")).scalar()
        ends.append(start)
    return ends


def group_folds(
    df: DataFrame,
    label: str,
    base_split: float = 0.25,
    seed: int = 42,
    rule: str = "reset",
    fold: str = "fold",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Number the folds; all rows of a group share one.

    ``reset``: a fold takes groups until it holds its quota of rows, then the
    next starts from 0; the last takes the rest.  The running counts of the groups
    are written out, as each end is looked up in them.  ``carry``: a group
    goes to the fold in which its first row falls, so an overfull fold shortens
    the next; one lazy pass.  A null label gets a null fold.
    """
    folds = math.floor(1 / base_split)
    if rule == "reset":
        groups = _counted_groups(df, label, seed, digits, written=True)
        running = materialize(_running(groups, _bucket_offsets(groups), label), "running")
        number: Column = F.lit(0)
        for end in _quota_ends(running, base_split, folds):
            number = number + F.coalesce((F.col("__before") >= end).cast("int"), F.lit(0))
    elif rule == "carry":
        groups = _counted_groups(df, label, seed, digits)
        running = _running(groups, _bucket_offsets(groups), label)
        quota = round_share(F.col("__total"), base_split)
        number = F.least(
            F.lit(folds - 1), F.floor(F.try_divide(F.col("__before"), quota)).cast("int")
        )
        number = F.coalesce(number, F.lit(folds - 1))
    else:
        raise ValueError("rule must be 'reset' or 'carry'")
    return attach(df, running.select(by_name(label), number.alias(fold)), label)


def recombine(
    df: DataFrame, folds: int, fold: str = "fold"
) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """For i = 1..: folds 0 and i against the rest."""
    for i in range(1, folds):
        chosen = F.coalesce(by_name(fold).isin(0, i), F.lit(False))
        yield i, df.where(chosen).drop(fold), df.where(~chosen).drop(fold)


def by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the flag, rows without or with null)."""
    on = F.coalesce(by_name(flag).cast("boolean"), F.lit(False))
    return df.where(on).drop(flag), df.where(~on).drop(flag)


def group_holdout(
    df: DataFrame,
    label: str,
    share: float = 0.2,
    seed: int = 42,
    flag: str = "is_test",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Flag whole groups as test until the rows flagged exceed the share."""
    groups = _counted_groups(df, label, seed, digits)
    running = _running(groups, _bucket_offsets(groups), label)
    admitted = F.col("__before") <= round_share(F.col("__total"), share)
    flagged = attach(df, running.select(by_name(label), admitted.alias(flag)), label)
    return flagged.withColumn(flag, F.coalesce(by_name(flag), F.lit(False)))


def unit_hash(keys: str | Iterable[str], seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key values alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[by_name(k).cast("string") for k in as_list(keys)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(16**8)


def row_holdout(
    df: DataFrame, keys: str | Sequence[str], share: float = 0.5, seed: int = 42,
    flag: str = "is_test",
) -> DataFrame:
    """Flag rows as test by a hash of the columns that identify them; no shuffle."""
    return df.withColumn(flag, ~(unit_hash(keys, seed) < 1 - share))
