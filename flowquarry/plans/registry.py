"""Catalogue of runnable queries: a Spark builder each, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    sql: str | None
    covers: str


CATALOGUE: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``covers`` lists the survey rows it implements."""

    def register(build: Builder) -> Builder:
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Entry(build, sql, covers)
        return build

    return register
