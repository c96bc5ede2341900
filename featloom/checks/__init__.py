"""Queries over the given tables that exercise every operator, with SQL to compare to."""

from featloom.checks import (  # noqa: F401
    encode_checks,
    matrix_checks,
    model_checks,
    rollup_checks,
    row_checks,
    sink_checks,
)
from featloom.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
