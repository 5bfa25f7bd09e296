"""Registered queries: each runs operators over the given tables, most with an SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: Sequence[str], sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function of (spark, folder). ``covers`` names the inventory rows it shows."""
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, tuple(covers), run, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; the SQL twins round alike."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
