"""Data preparation: profiles, encoding, scaling, exact splits and input checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.numeric import ratio, tags, to_number
from flowquarry.operators.ordered import arrange, exact_quantiles, row_numbers, without_positions
from flowquarry.operators.skew import salted_lookup
from flowquarry.schemas import CATEGORICAL, FEATURES, NUMERIC, REQUIRED


#: Entries up to which a dictionary of category codes is broadcast: a few MB at the most.
MOST_CODES = 20_000


def drop_columns(df: DataFrame, names: Sequence[str] = ("id", "attack_cat")) -> DataFrame:
    """Remove the named columns; absent ones are ignored."""
    return df.drop(*names)


def null_profile(df: DataFrame) -> DataFrame:
    """Columns holding NULLs, with their number and percentage."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in df.columns])
    found = counts.select("_rows", F.inline(rows)).filter(F.col("nulls") > 0)
    return found.select("field", "nulls", (ratio(F.col("nulls"), F.col("_rows")) * 100).alias("percent"))


def null_drop_report(df: DataFrame) -> DataFrame:
    """Rows before, rows removed by dropping any NULL, and their percentage."""
    incomplete = F.lit(False)
    for c in df.columns:
        incomplete = incomplete | F.col(c).isNull()
    report = df.agg(F.count("*").alias("rows_before"), F.count_if(incomplete).alias("removed"))
    return report.withColumn("percent", ratio(F.col("removed"), F.col("rows_before")) * 100)


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; one number each reaches the driver."""
    return {row["field"]: row["q0"] for row in exact_quantiles(df, columns, [0.5]).collect()}


def median_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace NULLs of numeric columns by the column's median."""
    values = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(values.get(c))) for c in columns})


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # over one row per class
    return counts.withColumn("percent", ratio(F.col("n"), whole) * 100)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every value of the given columns."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("left_field"), F.lit(b).alias("right_field"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])
    return sums.select(F.inline(rows))


def row_slice(df: DataFrame, order: Sequence[str], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` in the given order."""
    return df.orderBy(*order).offset(start).limit(size)


def encoder_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes 0..k-1 of the sorted distinct values of each column: ``field, value, code``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    distinct = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()
    numbered = row_numbers(arrange(distinct, "field", "value"), ["field"])
    return numbered.select("field", "value", (F.col("rn") - 1).cast("int").alias("code"))


def encoder_transform(df: DataFrame, codes: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Replace categories by codes; a value never seen while fitting becomes code 0.

    A dictionary of at most ``MOST_CODES`` entries, as counted here, is broadcast
    and the rows stay where they are; a larger one is joined on salted keys.
    """
    small = codes.limit(MOST_CODES + 1).count() <= MOST_CODES
    for c in columns:
        known = codes.filter(F.col("field") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        df = df.withColumn(c, F.col(c).cast("string"))
        df = df.join(F.broadcast(known), c, "left") if small else salted_lookup(df, known, [c], key, "left")
        df = df.withColumn(c, F.coalesce(F.col("_code"), F.lit(0))).drop("_code")
    return df


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Everything unparsable becomes 0."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def ordered_features(df: DataFrame, names: Sequence[str] = FEATURES, strict: bool = True) -> DataFrame:
    """The features in model order; missing ones raise, or are skipped when not strict."""
    missing = [c for c in names if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[c for c in names if c in df.columns])


@dataclass
class Scaler:
    """Mean and population deviation per column; a few numbers, kept on the driver."""

    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        deviations = {c: row[f"s_{c}"] or 1.0 for c in columns}
        return cls({c: row[f"m_{c}"] for c in columns}, deviations)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(float(self.means[c]))) / F.lit(float(self.deviations[c])) for c in self.means
        })

    def as_table(self, spark) -> DataFrame:
        rows = [(c, float(self.means[c]), float(self.deviations[c])) for c in self.means]
        return spark.createDataFrame(rows, "field string, mean double, deviation double")


def ranked_in_class(df: DataFrame, order: Sequence[str], label: str | None = "label") -> DataFrame:
    """Position ``rn`` and size ``n_class`` of every row within its class, in a fixed pseudo-random order."""
    part = [label] if label else []
    return without_positions(row_numbers(arrange(df, *part, *order), part, "rn", "n_class"))


def split_three(df: DataFrame, order: Sequence[str], label: str | None = "label", test: int = 20, val: int = 15) -> DataFrame:
    """Exact test / validation / training split in percent, per class unless ``label`` is None."""
    ranked = ranked_in_class(df, order, label)
    place = F.col("rn") * 100
    part = (
        F.when(place <= F.col("n_class") * test, "test")
        .when(place <= F.col("n_class") * (test + val), "val").otherwise("train")
    )
    return ranked.withColumn("split", part).drop("rn", "n_class")


def split_report(split: DataFrame, label: str = "label") -> DataFrame:
    return split.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("attack")
    )


def stratified_sample(df: DataFrame, order: Sequence[str], share: float, label: str = "label") -> DataFrame:
    """``floor(n * share)`` rows of every class, without replacement."""
    ranked = ranked_in_class(df, order, label)
    return ranked.filter(F.col("rn") <= F.floor(F.col("n_class") * F.lit(share))).drop("rn", "n_class")


def round_share(number: int, rounds: int, start: float = 0.2, end: float = 1.0) -> float:
    """Training share of a progressive round: linear from ``start`` to ``end``."""
    return start + (end - start) * (number / max(1, rounds - 1))


def round_sizes(df: DataFrame, rounds: int = 25, label: str = "label") -> DataFrame:
    """Rows per round and class of a progressive training run."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    sized = counts.withColumn("round", step)
    share = F.lit(0.2) + F.lit(0.8) * (F.col("round") / F.lit(float(max(1, rounds - 1))))
    return sized.select("round", label, F.floor(F.col("n") * share).cast("bigint").alias("size"))


def input_errors(columns: Sequence[str]) -> Column:
    """Names of the problems of one record: required fields missing, numbers that do not parse."""
    problems = [
        (f"missing:{c}", F.col(c).isNull()) if c in columns else (f"missing:{c}", F.lit(True)) for c in REQUIRED
    ]
    for c in NUMERIC:
        if c in columns:
            problems.append((f"number:{c}", F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()))
    return tags(*problems)


def validate(df: DataFrame) -> DataFrame:
    """Adds ``errors`` and ``valid``."""
    checked = df.withColumn("errors", input_errors(df.columns))
    return checked.withColumn("valid", F.size("errors") == 0)


def preprocess(df: DataFrame, codes: DataFrame | None, scaler: Scaler | None, key: Sequence[str]) -> DataFrame:
    """Records to model input: encode, coerce, order, scale; ``key`` columns pass through."""
    features = [c for c in FEATURES if c in df.columns]
    categories = [c for c in CATEGORICAL if c in features]
    out = df.select(*key, *features)
    if codes is not None:
        out = encoder_transform(out, codes, categories, key)
    out = coerce_numbers(out, features)
    if scaler is not None:
        out = scaler.transform(out)
    return out.select(*key, *features)
