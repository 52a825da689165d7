"""Missing-value rules that differ from SQL's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def na_agg(agg: Callable[[Column], Column], value: Column | str) -> Column:
    """An aggregate that is NULL as soon as one input is NULL (SQL aggregates skip NULLs)."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(F.lit(1)) == F.count(column), agg(column))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """A two-way choice that is NULL where the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)
