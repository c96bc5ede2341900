"""Filling nulls with a linear regression on other columns.

A fit is one aggregation: counts, means and covariances combine on the map side
and one row reaches the driver, whose k equations are solved there (k is the
number of predictors).  The prediction is a column expression.

A chain of fits, each of which sees what the ones before have filled, is one aggregation
too (``impute_chain_one_pass``): moments are taken once for each pattern of missing
columns.  Within a pattern a fill is a linear map of columns that are there, so the
moments after it follow from those before, without the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.columns import by_name


@dataclass(frozen=True)
class LinearFit:
    predictors: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    rows: int

    def predict(self, inputs: Mapping[str, Column] | None = None) -> Column:
        """Null where a predictor is null."""
        inputs = inputs or {}
        total = F.lit(self.intercept)
        for name, weight in zip(self.predictors, self.weights):
            total = total + F.lit(weight) * inputs.get(name, by_name(name)).cast("double")
        return total


def fit_linear(
    df: DataFrame,
    target: str | Column,
    predictors: Sequence[str],
    alpha: float = 0.0,
    normalize: bool = False,
    inputs: Mapping[str, Column] | None = None,
    usable: Column | None = None,
) -> LinearFit | None:
    """Least squares with an intercept, ridge penalty ``alpha``.

    ``normalize`` scales every centred predictor to unit length before the
    penalty applies.  Rows with a null target or predictor are not fitted.
    ``inputs`` replaces a predictor by an expression.  None without any row.
    """
    inputs = inputs or {}
    y = by_name(target) if isinstance(target, str) else target
    x = [inputs.get(p, by_name(p)) for p in predictors]
    k = len(x)
    names = [f"x{i}" for i in range(k)]
    complete = y.isNotNull() if usable is None else usable & y.isNotNull()
    for c in x:
        complete = complete & c.isNotNull()
    data = df.where(complete).select(
        y.cast("double").alias("y"), *[c.cast("double").alias(n) for c, n in zip(x, names)]
    )
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("my"),
        *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.covar_pop(n, "y").alias(f"c{i}") for i, n in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    if n == 0:
        return None
    scatter, moment = np.zeros((k, k)), np.zeros(k)
    for i, j in pairs:
        scatter[i, j] = scatter[j, i] = row[f"s{i}_{j}"] * n
    for i in range(k):
        moment[i] = row[f"c{i}"] * n
    means = np.array([row[f"m{i}"] for i in range(k)])
    return _solve(predictors, scatter, moment, means, row["my"], n, alpha, normalize)


def _solve(
    predictors: Sequence[str], scatter: np.ndarray, moment: np.ndarray, means: np.ndarray, mean: float,
    rows: int, alpha: float, normalize: bool,
) -> LinearFit:
    penalty = np.diag(scatter) if normalize else np.ones(len(scatter))
    # Least squares, so that a constant predictor gets weight 0 instead of failing.
    weights = np.linalg.lstsq(scatter + alpha * np.diag(penalty), moment, rcond=None)[0]
    return LinearFit(
        tuple(predictors), tuple(float(w) for w in weights), float(mean - weights @ means), rows
    )


def impute_regression(
    df: DataFrame,
    target: str,
    predictors: Sequence[str],
    alpha: float = 0.0,
    normalize: bool = False,
    inputs: Mapping[str, Column] | None = None,
    log_target: bool = False,
    missing: Column | None = None,
    ignored: Column | None = None,
    fitted_on: DataFrame | None = None,
) -> DataFrame:
    """Replace missing targets by predictions and leave the others untouched.

    ``missing`` says which rows to predict (default: null targets); they and the
    ``ignored`` ones are not fitted.  ``log_target`` fits the logarithm.  A row
    that lacks a predictor keeps its null.
    """
    y = by_name(target)
    absent = y.isNull() if missing is None else F.coalesce(missing, F.lit(False)) | y.isNull()
    usable = ~absent
    if ignored is not None:
        usable = usable & ~F.coalesce(ignored, F.lit(False))
    fit = fit_linear(
        df if fitted_on is None else fitted_on,
        F.log(y) if log_target else y,
        predictors, alpha, normalize, inputs, usable,
    )
    if fit is None:
        return df
    predicted = fit.predict(inputs)
    if log_target:
        predicted = F.exp(predicted)
    filled = F.when(absent, predicted).otherwise(y.cast("double"))
    return df.select(
        *[filled.alias(target) if n == target else by_name(n) for n in df.columns]
    )


@dataclass(frozen=True)
class RegressionStep:
    """One imputation of a chain; later steps see the columns filled by earlier ones."""

    target: str
    predictors: tuple[str, ...]
    alpha: float = 0.0
    normalize: bool = False
    log_target: bool = False
    cube_root_inputs: tuple[str, ...] = ()
    missing_value: float | None = None
    ignored_value: float | None = None

    def fill(self, df: DataFrame, fit: LinearFit | None) -> DataFrame:
        """Missing targets replaced by the predictions of a fit; none, if there was no row to fit."""
        if fit is None:
            return df
        y = by_name(self.target)
        absent = y.isNull()
        if self.missing_value is not None:
            absent = absent | F.coalesce(y == self.missing_value, F.lit(False))
        predicted = fit.predict({c: F.cbrt(by_name(c)) for c in self.cube_root_inputs})
        if self.log_target:
            predicted = F.exp(predicted)
        filled = F.when(absent, predicted).otherwise(y.cast("double"))
        return df.select(
            *[filled.alias(self.target) if n == self.target else by_name(n) for n in df.columns]
        )

    def apply(self, df: DataFrame) -> DataFrame:
        y = by_name(self.target)
        return impute_regression(
            df, self.target, self.predictors, self.alpha, self.normalize,
            inputs={c: F.cbrt(by_name(c)) for c in self.cube_root_inputs},
            log_target=self.log_target,
            missing=None if self.missing_value is None else y == self.missing_value,
            ignored=None if self.ignored_value is None else y == self.ignored_value,
        )


def impute_chain(df: DataFrame, steps: Sequence[RegressionStep]) -> DataFrame:
    for step in steps:
        df = step.apply(df)
    return df


@dataclass
class _Pattern:
    """Moments of the rows that lack the same columns; those of a missing column are not used."""

    rows: int
    known: np.ndarray
    ignored: np.ndarray
    means: np.ndarray
    scatter: np.ndarray

    def fill(self, place: int, sources: list[int], fit: LinearFit) -> None:
        """The missing column becomes the prediction from columns that are there."""
        self.known[place] = True
        weights = np.zeros(len(self.means))
        weights[sources] = fit.weights
        self.means[place] = fit.intercept + weights @ self.means
        self.scatter[place, :] = weights @ self.scatter
        self.scatter[:, place] = self.scatter[place, :]
        self.scatter[place, place] = weights @ self.scatter[:, place]


def chain_moments(df: DataFrame, steps: Sequence[RegressionStep]) -> tuple[list[str], list[_Pattern]]:
    """Names of the columns of a chain, and their moments by pattern of missing values.

    One aggregation; at most two to the number of columns rows reach the driver.
    """
    inputs: dict[str, Column] = {}
    for step in steps:
        for c in step.predictors:
            if c in step.cube_root_inputs:
                inputs.setdefault(_cube(c), F.cbrt(by_name(c).cast("double")))
            else:
                inputs.setdefault(c, by_name(c).cast("double"))
        y = by_name(step.target)
        if step.missing_value is not None:
            y = F.when(y != step.missing_value, y)
        if step.log_target:
            inputs[_log(step.target)] = F.log(y.cast("double"))
        else:
            inputs[step.target] = y.cast("double")
    names = list(inputs)
    columns = [f"c{i}" for i in range(len(names))]
    ignored = [
        F.lit(False) if s.ignored_value is None
        else F.coalesce(by_name(s.target) == s.ignored_value, F.lit(False)) for s in steps
    ]
    flags = lambda marks: F.concat(*[m.cast("int").cast("string") for m in marks])
    data = df.select(
        flags([inputs[n].isNotNull() for n in names]).alias("known"), flags(ignored).alias("ignored"),
        *[inputs[n].alias(c) for n, c in zip(names, columns)],
    )
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    table = data.groupBy("known", "ignored").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"s{i}_{j}") for i, j in pairs],
    )
    patterns = []
    for row in table.collect():
        scatter = np.zeros((len(names), len(names)))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = (row[f"s{i}_{j}"] or 0.0) * row["rows"]
        patterns.append(_Pattern(
            row["rows"], np.array([k == "1" for k in row["known"]]), np.array([k == "1" for k in row["ignored"]]),
            np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), scatter,
        ))
    return names, patterns


def _cube(name: str) -> str:
    return f"cube root of {name}"


def _log(name: str) -> str:
    return f"logarithm of {name}"


def fit_chain(df: DataFrame, steps: Sequence[RegressionStep]) -> list[LinearFit | None]:
    """The fits that the steps would make one after the other, from one pass over the rows."""
    _require_linear(steps)
    names, patterns = chain_moments(df, steps)
    fits = []
    for number, step in enumerate(steps):
        target = names.index(_log(step.target) if step.log_target else step.target)
        sources = [names.index(_cube(c) if c in step.cube_root_inputs else c) for c in step.predictors]
        ready = [p for p in patterns if p.known[sources].all()]
        used = [p for p in ready if p.known[target] and not p.ignored[number]]
        rows = sum(p.rows for p in used)
        if not rows:
            fits.append(None)
            continue
        of = [*sources, target]
        means = sum(p.rows * p.means[of] for p in used) / rows
        scatter = sum(
            p.scatter[np.ix_(of, of)] + p.rows * np.outer(p.means[of] - means, p.means[of] - means) for p in used
        )
        k = len(sources)
        fit = _solve(
            step.predictors, scatter[:k, :k], scatter[:k, k], means[:k], means[k], rows, step.alpha, step.normalize
        )
        fits.append(fit)
        for p in ready:
            if not p.known[target]:
                p.fill(target, sources, fit)
    return fits


def _require_linear(steps: Sequence[RegressionStep]) -> None:
    """A column filled on another scale, or twice, is no linear map of the columns before."""
    bent: set[str] = set()
    filled: set[str] = set()
    for step in steps:
        if bent & set(step.predictors) or filled & set(step.cube_root_inputs) or step.target in filled:
            raise ValueError(f"{step.target} needs a pass of its own")
        if any(later.missing_value is not None and later.target in step.predictors for later in steps):
            raise ValueError("a sentinel cannot be a predictor of the chain that replaces it")
        filled.add(step.target)
        if step.log_target:
            bent.add(step.target)


def impute_chain_one_pass(df: DataFrame, steps: Sequence[RegressionStep]) -> DataFrame:
    """As :func:`impute_chain`, with one job for the whole chain."""
    if not steps:
        return df
    for step, fit in zip(steps, fit_chain(df, steps)):
        df = step.fill(df, fit)
    return df
