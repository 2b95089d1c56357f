"""The corpus pipeline: from raw documents to packed sequences, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import language, mixing, packing, simhash, substrings
from flowquarry.llm.common import held_out, load, staged


def known_languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Language ID: documents without letters, or unlike any language learnt from these documents, go."""
    learnt = language.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    return language.keep_known(docs, learnt)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """SimHash: of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Substring dedup: passages that repeat across documents stay in the first alone; every document stays."""
    return substrings.cut(docs, substrings.repeated_spans(docs))


def weighted_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Mixing: sources weigh 3, 1, 2, repeating, and share 150% of all words; repeated documents come as repeated rows."""
    return mixing.take(docs, F.array("source"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packing: the token ids of all documents in sequences of at most 2048, a row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language", known_languages),
    ("simhash", near_duplicates),
    ("substrings", without_repeats),
    ("mixing", weighted_sources),
    ("packing", packed),
]

#: Fingerprints and random hyperdimensional vectors have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages applied to the documents, each written as Parquet and read again."""
    docs = load(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
