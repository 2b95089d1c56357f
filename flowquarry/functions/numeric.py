"""Small column helpers for arithmetic that must never yield NULL, NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """``top / bottom`` as double; ``default`` where the divisor is 0 or NULL."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def finite(value: Column) -> Column:
    """The value itself, or 0.0 where it is NULL, NaN or infinite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0 (also for NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def tags(*named: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in named]))


def to_number(value: Column) -> Column:
    """Any text or number as a finite double, 0.0 where that fails."""
    return finite(value.try_cast("double"))
