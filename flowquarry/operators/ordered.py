"""Order-dependent operators that never gather one key, or all rows, in a single task.

A plain window puts every row of its partition key into one task. Here rows are
range-partitioned and sorted on the full order instead, so the work is spread
evenly whatever the key distribution is, and only one small row per slice has to
be stitched. The sorted frame is checkpointed because row positions must be the
same for every later reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.runtime import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def arrange(df: DataFrame, *order: str | Column) -> DataFrame:
    """Globally sorted copy of ``df`` with ``_slice`` (range partition) and ``_pos`` (row in it).

    The order should end in a unique column: that makes positions reproducible and
    lets a single hot key spread over many slices.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    placed = placed.withColumn("_pos", F.col("_at") - F.shiftleft("_slice", _ROW_BITS)).drop("_at")
    return cut_lineage(placed)


def _all_slices() -> Window:
    # One row per slice reaches this window, never the data itself.
    return Window.orderBy("_slice")


def row_numbers(
    placed: DataFrame, part: Sequence[str] = (), name: str = "rn", total: str | None = None
) -> DataFrame:
    """Exact 1-based row number within ``part``; ``placed`` must be sorted by ``part`` first.

    ``total`` names an extra column with the number of rows of the part.
    """
    segments = placed.groupBy("_slice", *part).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = (Window.partitionBy(*part).orderBy("_slice") if part else _all_slices()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*part) if part else _all_slices().rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    segments = segments.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        segments = segments.withColumn(total, F.sum("_n").over(whole))
    segments = segments.drop("_n")
    segments = segments.withColumnsRenamed({"_slice": "_s", **{c: f"_k{i}" for i, c in enumerate(part)}})
    match = F.col("_slice") == F.col("_s")
    for i, c in enumerate(part):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    numbered = placed.join(segments, match)
    numbered = numbered.withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
    return numbered.drop("_s", "_first", "_before", *[f"_k{i}" for i in range(len(part))])


def previous(placed: DataFrame, part: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Value of the preceding row with equal ``part`` (NULL keys are equal); new name -> source column."""
    sources = [*part, *columns.values()]
    packed = placed.withColumn("_row", F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(sources)]))
    in_slice = Window.partitionBy("_slice").orderBy("_pos")
    packed = packed.withColumn("_prev", F.lag("_row").over(in_slice))
    edges = packed.groupBy("_slice").agg(F.max_by("_row", "_pos").alias("_last"))
    edges = edges.select(F.col("_slice").alias("_s"), F.lag("_last").over(_all_slices()).alias("_edge"))
    joined = packed.join(edges, F.col("_slice") == F.col("_s"))
    joined = joined.withColumn("_prev", F.when(F.col("_pos") == 0, F.col("_edge")).otherwise(F.col("_prev")))
    same = F.col("_prev").isNotNull()
    for i, c in enumerate(part):
        same = same & F.col(f"_prev.f{i}").eqNullSafe(F.col(c))
    for j, name in enumerate(columns):
        joined = joined.withColumn(name, F.when(same, F.col(f"_prev.f{len(part) + j}")))
    return joined.drop("_row", "_prev", "_s", "_edge")


def running_total(placed: DataFrame, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over all rows up to and including this one, in sorted order."""
    placed = placed.withColumn("_amount", amount.cast("long"))
    in_slice = Window.partitionBy("_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_slice").agg(F.sum("_amount").alias("_sum"))
    before = _all_slices().rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_slice").alias("_s"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry")
    )
    joined = placed.join(carry, F.col("_slice") == F.col("_s"))
    joined = joined.withColumn(name, F.sum("_amount").over(in_slice) + F.col("_carry"))
    return joined.drop("_amount", "_s", "_carry")


def without_positions(df: DataFrame) -> DataFrame:
    return df.drop("_slice", "_pos")


def top_n_per_group(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, salt: Column, salts: int = 64, name: str = "rn"
) -> DataFrame:
    """First ``n`` rows of every group; a hot group is cut down in ``salts`` shares first."""
    share = df.withColumn("_share", F.pmod(F.xxhash64(salt), F.lit(salts)))
    per_share = Window.partitionBy(*part, "_share").orderBy(*order)
    share = share.withColumn(name, F.row_number().over(per_share)).filter(F.col(name) <= n).drop("_share")
    whole = Window.partitionBy(*part).orderBy(*order)
    return share.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= n)


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of numeric columns, one row per column: ``field, q0, q1, ...``.

    Values are counted first, so duplicates collapse before the sort, and the sorted
    distinct values are spread over range slices instead of one aggregation buffer.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns])
    counted = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("field", "value")
    counted = counted.agg(F.count("*").alias("n"))
    placed = arrange(counted, "field", "value")
    upto = running_total(placed, F.col("n"), "upto")
    # The running total goes on across fields; each field's own start is its first row's.
    starts = upto.groupBy("field").agg((F.min(F.col("upto") - F.col("n"))).alias("_start"), F.sum("n").alias("_n"))
    inside = upto.join(starts, "field").withColumn("upto", F.col("upto") - F.col("_start"))
    aggs = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        aggs += [
            F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"lo{i}"),
            F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"hi{i}"),
            F.max(at - F.floor(at)).alias(f"w{i}"),
        ]
    found = inside.groupBy("field").agg(*aggs)
    return found.select("field", *[
        (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}")
        for i in range(len(shares))
    ])
