"""Small driver-made tables and size-checked joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only while its row count is known to be at most this.
BROADCAST_ROWS = 200_000
# Column chunks keep generated code of wide aggregates within the JVM method limit.
COLUMNS_PER_PASS = 60

_SALT = "__salt"
_SIDE = "__side"


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """A DataFrame over rows whose number is bounded by arguments, not by data."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


@contextmanager
def reused(df: DataFrame, on: bool):
    """Keep a narrow input while several passes read it.

    Worth it where the rows come out of joins; a plain scan is cheaper read again. A lost
    block is computed anew from its source.
    """
    if not on:
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def chunked(items: Sequence, size: int = COLUMNS_PER_PASS):
    for i in range(0, len(items), size):
        yield items[i : i + size]


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def join_null_safe(left: DataFrame, right: DataFrame, names: Sequence[str], how: str, small: bool) -> DataFrame:
    """Equi-join in which null keys meet; the right side is broadcast if ``small``."""
    renamed = right.select(
        *[F.col(n).alias(f"__r_{n}") for n in names],
        *[c for c in right.columns if c not in names],
    )
    cond = reduce(lambda a, b: a & b, [left[n].eqNullSafe(renamed[f"__r_{n}"]) for n in names])
    side = F.broadcast(renamed) if small else renamed
    return left.join(side, cond, how).drop(*[f"__r_{n}" for n in names])


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    *,
    table_rows: int,
    weight: str | None = None,
    hot_share: float = 1 / 2000,
    salts: int = 256,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left-join the values of ``table`` (unique on ``keys``) to every row of ``df``.

    Up to ``broadcast_rows`` the table is broadcast and ``df`` is not shuffled. Beyond
    that, keys carrying more than ``hot_share`` of the rows counted in ``weight`` (there
    are at most ``1/hot_share`` of them) are broadcast, and only the remaining keys, none of
    which is heavy, meet in a shuffled join. Rows already served spread over salted
    keys so that they load no single task.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    if table_rows <= broadcast_rows or weight is None:
        side = table.select(*keys, *values)
        return df.join(F.broadcast(side) if table_rows <= broadcast_rows else side, list(keys), "left")

    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > total * hot_share
    hot = table.filter(is_hot).select(*keys, *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias(_SIDE))
    cold = table.filter(~is_hot).select(
        *[F.col(k).alias(f"__ck_{k}") for k in keys], *[F.col(v).alias(f"__c_{v}") for v in values], F.lit(0).alias("__cold"))
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int") + 1
    salted = df.join(F.broadcast(hot), list(keys), "left").withColumn(
        _SALT, F.when(F.col(_SIDE) | any_null, spread).otherwise(F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__ck_{k}") for k in keys], F.col(_SALT) == F.col("__cold"))
    return salted.join(cold, on, "left").select(
        *df.columns, *[F.when(F.col(_SIDE), F.col(f"__h_{v}")).otherwise(F.col(f"__c_{v}")).alias(v) for v in values])
