"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join a lookup with unique keys; a hot key is split into ``salts`` shares of its rows.

    The lookup is repeated per salt. No broadcast hint: when it is small at run time
    the adaptive plan broadcasts it anyway, and otherwise the salt keeps tasks even.
    """
    # Never NULL, so the join adds no null check that would hash every input row once more.
    salt = F.coalesce(F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"), F.lit(0))
    rows = rows.withColumn("_salt", salt)
    spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(spread, [*on, "_salt"], how).drop("_salt")


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without joining them."""
    names = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])
