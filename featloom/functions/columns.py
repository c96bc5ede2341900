"""Choosing and naming columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_name(name: str) -> Column:
    """Column of exactly this name, whatever characters it holds (``B-002``, ``a.b``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names in which the pattern occurs anywhere."""
    found = re.compile(pattern)
    return [name for name in df.columns if found.search(name)]


def select_matching(df: DataFrame, pattern: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = list(keep)
    names = keep + [name for name in matching(df, pattern) if name not in keep]
    return df.select(*[by_name(name) for name in names])


def suffix_columns(df: DataFrame, suffix: str, skip: str | Iterable[str] = ()) -> DataFrame:
    """Append ``_suffix`` to every name but the skipped and those that end in it already."""
    skipped = set(as_list(skip))
    renamed = {
        name: f"{name}_{suffix}"
        for name in df.columns
        if name not in skipped and not name.endswith(suffix)
    }
    require_unique([renamed.get(name, name) for name in df.columns])
    return df.select(*[by_name(n).alias(renamed.get(n, n)) for n in df.columns])


def apply_columns(
    df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]
) -> DataFrame:
    """Replace each named column by ``fn`` of it, in one projection."""
    chosen = set(names)
    return df.select(
        *[fn(by_name(n)).alias(n) if n in chosen else by_name(n) for n in df.columns]
    )


def require_unique(names: Iterable[str]) -> None:
    """Spark resolves names without regard to case, so equal-but-for-case is a clash."""
    seen: set[str] = set()
    for name in names:
        if name.lower() in seen:
            raise ValueError(f"column {name!r} would occur twice")
        seen.add(name.lower())
