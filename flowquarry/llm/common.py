"""Helpers shared by the training-data operators: tables, splits, Arrow batches, staged results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.runtime import ship_package, staging_path, table

#: Words are runs of anything but the ASCII white space; only A-Z are lower-cased.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows handed to a Python worker at once: with texts of any length a batch stays small.
ROWS_PER_BATCH = 1000


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with Arrow batches bounded for long texts."""
    bounded(spark)
    return table(spark, folder, name)


def bounded(spark: SparkSession) -> None:
    """Ship this package and bound the rows of an Arrow batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def held_out(key: Column, modulus: int, share: int = 2) -> Column:
    """True for held-out rows; a row without a key is never held out."""
    return F.coalesce(remainder(key, modulus) == share, F.lit(False))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: cuts lineage and survives lost executors."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: whatever was made of them has been written itself."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``work`` to every Arrow batch; batches for which it returns None are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def unused(name: str, columns: list[str]) -> str:
    """A column name that no input column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokens(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; a null text has none."""
    # bytes.lower() touches A-Z alone and bytes.split() cuts at exactly the six ASCII white-space bytes.
    return text.encode().lower().split() if text else []
