"""Binary targets, label twins, and exact-size deterministic splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.hashcuts import Ranks, assign_blocks, hash_cuts
from ..plans.quantiles import exact_quantiles, medians

SPLITS = ("train", "test", "oot", "etrc")
NUMERIC_SHARE = 0.8


def mode_of(df: DataFrame, col: str):
    """Most frequent non-null value; of equals, the smallest."""
    top = (
        df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), F.col(col)).first()
    )
    return None if top is None else top[col]


def _is_binary_value(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.BooleanType):
        return F.lit(True)
    if isinstance(dtype, T.StringType):
        return F.col(col).isin("0", "1")
    if isinstance(dtype, T.NumericType):
        return F.col(col).isin(0, 1)
    return F.lit(False)


def _number(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType)):
        x = F.col(col).try_cast("double")
        return F.when(~F.isnan(x), x)
    return F.lit(None).cast("double")


def binarize_target(
    df: DataFrame,
    col: str,
    positive_class=None,
    threshold: float | None = None,
    out: str = "__target__",
) -> DataFrame:
    """Replace ``col`` by a 0/1 column. The first rule that applies decides:

    1. values are already 0/1: kept, and a null is an error;
    2. ``positive_class``: equal as text, null gives 0;
    3. ``threshold``: above it, null gives 0;
    4. over 80 % of rows read as numbers: above the median, null gives 0;
    5. not the most common value, and null gives 1.
    """
    if out != col and out in df.columns:
        raise ValueError(f"column {out!r} already exists")
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(col).isNull()).alias("nulls"),
        F.count_if(F.col(col).isNotNull() & ~_is_binary_value(df, col)).alias("other"),
        F.count(_number(df, col)).alias("numbers"),
    ).first()
    if facts["other"] == 0:
        if facts["nulls"]:
            raise ValueError(f"target {col!r} is 0/1 but has {facts['nulls']} nulls")
        y = F.col(col).cast("int")
    elif positive_class is not None:
        y = F.coalesce(F.col(col).cast("string") == F.lit(str(positive_class)), F.lit(False)).cast("int")
    elif threshold is not None:
        y = F.coalesce(_number(df, col) > float(threshold), F.lit(False)).cast("int")
    elif facts["numbers"] > facts["rows"] * NUMERIC_SHARE:
        mid = medians(df.select(_number(df, col).alias("v")), ["v"])["v"]
        y = F.coalesce(_number(df, col) > mid, F.lit(False)).cast("int")
    else:
        y = F.coalesce(F.col(col) != F.lit(mode_of(df, col)), F.lit(True)).cast("int")
    return df.withColumn("__y", y).drop(col).withColumnRenamed("__y", out)


def check_target(df: DataFrame, col: str) -> DataFrame:
    """Raise unless ``col`` exists and holds exactly two classes; returns the table."""
    if col not in df.columns:
        raise ValueError(f"target column {col!r} not found")
    classes = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(3).count()
    if classes != 2:
        raise ValueError(f"target {col!r} has {'more than two' if classes > 2 else classes} classes, not two")
    return df


def decision_label(y, positive: str = "default", negative: str = "no_default") -> Column:
    return F.when((F.col(y) if isinstance(y, str) else y) == 1, positive).otherwise(negative)


def top_quantile_flag(df: DataFrame, col: str, rate: float = 0.15, out: str = "flag") -> DataFrame:
    """1 for rows above the ``1 - rate`` quantile."""
    cut = exact_quantiles(df, [col], [1 - Fraction(str(rate))])[col]
    if cut is None:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, F.coalesce(F.col(col) > cut[0], F.lit(False)).cast("int"))


def stratified_split(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    seed: int = 42,
    train_size: float = 0.6,
    test_size: float = 0.2,
    oot_size: float = 0.1,
    etrc_size: float = 0.1,
    out: str = "split",
    **kw,
) -> DataFrame:
    """Four-way split with exact sizes in every class, by the order of a hash of ``keys``.

    ``keys`` must identify a row. "oot" is random here; see ``split_by_time``.
    """
    shares = [Fraction(str(s)) for s in (train_size, test_size, oot_size, etrc_size)]
    if abs(float(sum(shares)) - 1.0) > 1e-8:
        raise ValueError("split sizes must sum to 1")
    bounds = [sum(shares[: i + 1]) for i in range(3)]
    cuts = hash_cuts(df, keys, seed, F.col(target), Ranks(bounds, half_up=True), **kw)
    names = F.array(*[F.lit(s) for s in SPLITS])
    return assign_blocks(df, keys, seed, F.col(target), cuts, out).withColumn(out, F.element_at(names, F.col(out) + 1))


def stratified_folds(
    df: DataFrame, target: str, keys: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold", **kw
) -> DataFrame:
    """Fold 0..k-1 per row; within each class fold sizes differ by at most one."""
    cuts = hash_cuts(df, keys, seed, F.col(target), Ranks([Fraction(i, k) for i in range(1, k)]), **kw)
    return assign_blocks(df, keys, seed, F.col(target), cuts, out)


def folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold", **kw) -> DataFrame:
    """Plain folds, without strata."""
    cuts = hash_cuts(df, keys, seed, F.lit("all"), Ranks([Fraction(i, k) for i in range(1, k)]), **kw)
    return assign_blocks(df, keys, seed, F.lit("all"), cuts, out)


def split_by_time(df: DataFrame, ts: str, cut: str | None = None, recent: float = 0.1, out: str = "split") -> DataFrame:
    """"oot" from ``cut`` on, else from the time that leaves the latest ``recent`` share."""
    at = F.col(ts).cast("timestamp")
    if cut is not None:
        late = at >= F.lit(cut).cast("timestamp")
    else:
        micros = df.select(F.unix_micros(at).alias("t"))
        limit = exact_quantiles(micros, ["t"], [1 - Fraction(str(recent))])["t"]
        late = F.unix_micros(at) > F.lit(limit[0] if limit else 0.0)
    return df.withColumn(out, F.when(late, "oot").otherwise("train"))
