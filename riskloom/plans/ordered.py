"""Running totals and row numbers over a global order, without a one-task window.

The order is cut into buckets at values of the column's own type: sketch quantiles of numbers
and times, sampled splitters of all else. Cuts are compared as the rows themselves are, so no
two values share a place that a sort would tell apart. A bucket is a pure function of the row's
own values, so a retried task puts each row where it was. Totals per bucket are tiny; their
running sum is the offset added to a window that runs inside a bucket. Sketch and sample only
decide balance: results are exact whatever they answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import join_null_safe, local_table

ROWS_PER_BUCKET = 2_000_000
MAX_SPLITS = 4_096
FAN = 16
GROUPS_ON_DRIVER = 10_000
TIE_CUTS = 1_000  # of one heavy value, at most
SAMPLED = 20  # values drawn for each splitter of a column that has no sketch
FEW_VALUES = 500  # of a sample of twice as many expected values
SPLITTER_CHARS = 1_000  # a longer splitter is cut off, which only moves it

BUCKET = "__bucket"
SUB = "__sub"
_CUTS = "__cuts"
_HEAVY = "__heavy"


@dataclass
class Order:
    """How each ``by`` group of a table is cut along ``column``."""

    by: list[str]
    column: str
    totals: DataFrame
    total_names: list[str]
    few_groups: bool
    literals: dict | None = None
    cuts: DataFrame | None = None
    sub_cuts: DataFrame | None = None
    tiebreak: str | None = None
    literal_cuts: dict[str, list] | None = None
    _key: str = field(default="__pos")

    def with_totals(self, df: DataFrame) -> DataFrame:
        """Add the per-group totals: as literals, by a checked broadcast, or by a join."""
        if self.literals is not None:
            return df.withColumns({n: F.lit(v) for n, v in self.literals.items()})
        return join_null_safe(df, self.totals, self.by, "left", self.few_groups)

    def with_bucket(self, df: DataFrame) -> DataFrame:
        if self.cuts is None:
            return df.withColumns({BUCKET: F.lit(0), SUB: F.lit(0)})
        out = df.withColumn(self._key, F.col(self.column))
        if self.by:
            out = join_null_safe(out, self.cuts, self.by, "left", True)
        else:
            kinds = {f.name: f.dataType for f in self.cuts.schema.fields}
            out = out.withColumns({n: F.array(*[F.lit(c) for c in v]).cast(kinds[n]) for n, v in self.literal_cuts.items()})
        out = _place(out, F.col(self._key), self.cuts, BUCKET)
        if self.sub_cuts is None:
            return out.withColumn(SUB, F.lit(0)).drop(self._key)
        out = join_null_safe(out, self.sub_cuts, [*self.by, self._key], "left", True)
        return _place(out, F.col(self.tiebreak), self.sub_cuts, SUB).drop(self._key)


def _levels(cuts: Sequence) -> list[list]:
    """The sorted cuts, and every FAN-th of them, and so on; the coarsest first."""
    levels = [list(cuts)]
    while len(levels[0]) > FAN:
        levels.insert(0, levels[0][FAN - 1 :: FAN])
    return levels


def _level_columns(depth: int) -> list[str]:
    return [f"{_CUTS}{i}" for i in range(depth)]


def _padded(cuts: Sequence, depth: int) -> list[list]:
    levels = _levels(cuts)
    return [[]] * (depth - len(levels)) + levels


def _cuts_at_or_below(df: DataFrame, x: Column, cuts: DataFrame, out: str) -> DataFrame:
    """Count the cuts <= x by descending the levels: FAN comparisons each, however many cuts."""
    df = df.withColumn(out, F.lit(0))
    for name in (c for c in cuts.columns if c.startswith(_CUTS)):  # a column per step, so that no step is computed twice
        part = F.filter(F.slice(name, F.col(out) * FAN + 1, FAN), lambda c: c <= x)
        df = df.withColumn(out, F.col(out) * FAN + F.size(part))
    return df


def _place(df: DataFrame, x: Column, cuts: DataFrame, out: str) -> DataFrame:
    """Number the ranges between cuts, and each cut by itself, so that a heavy value shares its bucket with no other."""
    names = [c for c in cuts.columns if c.startswith(_CUTS)]
    df = _cuts_at_or_below(df, x, cuts, out)
    missing = F.col(names[-1]).isNull() | x.isNull()
    on_cut = F.coalesce(F.get(names[-1], F.col(out) - 1) == x, F.lit(False)).cast("int")
    return df.withColumn(out, F.when(missing, 0).otherwise(2 * F.col(out) - on_cut)).drop(*names)


def _splitters(df: DataFrame, keys: Sequence[str], column: str, fine: int, size: int) -> DataFrame:
    """``keys``, ``q``: values that part the rows of each group evenly, ``fine`` of them in the largest group.

    A value asked for more than once holds at least one step of rows. ``keys`` may be none, ``df`` holds cut groups only.
    """
    kind = df.schema[column].dataType
    n = F.count(F.lit(1)).alias("__n")
    step = F.greatest(F.lit(1), F.floor(F.lit(fine) * size / F.col("__n"))).cast("int")
    wide = isinstance(kind, T.DecimalType) and kind.precision > 15  # more digits than the sketch's doubles
    if not wide and isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        probs = [i / fine for i in range(1, fine)]
        found = df.groupBy(*keys).agg(n, F.percentile_approx(column, probs, 10 * fine).alias("q"))
        return found.withColumn("__step", step).select(*keys, F.expr("filter(q, (x, i) -> i % __step = 0)").alias("q"))
    # No sketch tells such values apart: SAMPLED of them per splitter are drawn from every group, by its size.
    value = F.substring(column, 1, SPLITTER_CHARS) if isinstance(kind, T.StringType) else F.col(column)
    drawn = df.filter(F.col(column).isNotNull() & (F.rand(7) < F.lit(4.0 * SAMPLED / size)))
    found = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("q"))
    return found.select(*keys, F.expr(f"filter(q, (x, i) -> i % {SAMPLED} = {SAMPLED // 2})").alias("q"))


def _many_valued(df: DataFrame, by: Sequence[str], column: str, size: int) -> set[tuple]:
    """The groups that may have more than ``size`` distinct values, by a sample.

    Each value has a row, so of more than ``size`` values at least FEW_VALUES times two are expected among the drawn rows.
    A group with at most FEW_VALUES there has no more than ``size``, but for a chance of some e^-125. Only groups with more come here.
    """
    rate = min(1.0, 2 * FEW_VALUES / size)
    drawn = df.select(*by, column).filter(F.rand(11) < rate).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__d"))
    return {tuple(r[b] for b in by) for r in drawn.filter(F.col("__d") > rate * size / 2).collect()}


def plan_order(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    totals: Mapping[str, Column] | None = None,
    *,
    tiebreak: str | None = None,
    descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    by_value: bool = False,
) -> Order:
    """Count each group of ``df``, and cut those that are too big for one task.

    ``by_value`` says that the rows to be ordered are one for each value of ``column`` in a group, so that a group is as big
    as its values are many; where a sample shows that they are few, it is not cut.
    """
    by = list(by)
    spark = df.sparkSession
    aggs = {"__n": F.count(F.lit(1)), **(totals or {})}
    grouped = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    names = list(aggs)
    rows = grouped.limit(GROUPS_ON_DRIVER + 1).collect()
    few = len(rows) <= GROUPS_ON_DRIVER
    literals = None
    if few:
        if not by:
            literals = rows[0].asDict()
        table = local_table(spark, rows, grouped.schema)
        n_all, n_max = sum(r["__n"] for r in rows), max((r["__n"] for r in rows), default=0)
    else:
        table = grouped
        top = grouped.agg(F.sum("__n"), F.max("__n")).first()
        n_all, n_max = top
    order = Order(by, column, table, names, few, literals, tiebreak=tiebreak)
    size = max(rows_per_bucket, n_all // MAX_SPLITS)
    if n_max <= size:
        return order

    # Only groups above ``size`` rows are cut: at most n_all / size of them. No other group is read again.
    fine = max(100, min(MAX_SPLITS, 4 * -(-n_max // size)))
    large = df.select(*by, column, *([tiebreak] if tiebreak and tiebreak not in (*by, column) else []))
    if by:
        held = rows if few else grouped.filter(F.col("__n") > size).collect()
        names_of = [tuple(r[b] for b in by) for r in held if r["__n"] > size]
        if by_value:
            many = _many_valued(large, by, column, size)
            names_of = [g for g in names_of if g in many]
        if not names_of:
            return order
        large = join_null_safe(large, local_table(spark, names_of, T.StructType([grouped.schema[b] for b in by])), by, "inner", True)
    elif by_value and not _many_valued(large, by, column, size):
        return order
    cut_rows, heavy = [], []
    for r in _splitters(large, by, column, fine, size).collect():
        q = [v for v in r["q"] or [] if v == v]
        key, distinct = tuple(r[b] for b in by), sorted(set(q))
        cut_rows.append((*key, distinct))
        heavy += [(*key, v) for v, times in Counter(q).items() if times > 1]
    if not any(r[-1] for r in cut_rows):
        return order
    by_fields = [grouped.schema[b] for b in by]
    depth = max(len(_levels(r[-1])) for r in cut_rows)
    order.cuts = _cut_table(spark, by_fields, cut_rows, depth, df.schema[column].dataType)
    if not by:
        order.literal_cuts = dict(zip(_level_columns(depth), _padded(cut_rows[0][-1], depth)))
    if heavy and tiebreak:
        order.sub_cuts = _cut_ties(large, order, by_fields, heavy, size)
    return order


def _cut_table(spark, key_fields, rows, depth, kind=T.DoubleType()):
    cuts = [T.StructField(n, T.ArrayType(kind)) for n in _level_columns(depth)]
    return local_table(spark, [(*r[:-1], *_padded(r[-1], depth)) for r in rows], T.StructType([*key_fields, *cuts]))


def _cut_ties(large, order, by_fields, heavy, size):
    """Cut the rows that tie on a heavy value along the tie-break column."""
    spark, by, key = large.sparkSession, order.by, order._key
    fields = [*by_fields, T.StructField(key, large.schema[order.column].dataType)]
    spots = local_table(spark, heavy, T.StructType(fields))
    tied = join_null_safe(large.withColumn(key, F.col(order.column)), spots, [*by, key], "inner", True)
    cut = _splitters(tied, [*by, key], order.tiebreak, TIE_CUTS, size)
    rows = [(*r[:-1], sorted({v for v in r["q"] or [] if v == v})) for r in cut.collect()]
    depth = max((len(_levels(r[-1])) for r in rows), default=1)
    return _cut_table(spark, fields, rows, depth, large.schema[order.tiebreak].dataType)


def _sort_keys(order: Order, descending: bool):
    first = F.col(order.column).desc() if descending else F.col(order.column).asc()
    return [first, F.col(order.tiebreak).asc()] if order.tiebreak else [first]


def _bucket_keys(descending: bool):
    return [F.col(BUCKET).desc() if descending else F.col(BUCKET).asc(), F.col(SUB).asc()]


def bucket_totals(df: DataFrame, order: Order, columns: Sequence[str]) -> DataFrame:
    """Add ``cum_<c>``: the total of ``c`` up to and including each row of its bucket, not of its group.

    For measures that sum up per bucket: of each bucket, the caller aggregates by ``order.by``, BUCKET and SUB, and
    ``before_buckets`` adds what lies before it. The rows are then read once and meet no table of offsets.
    """
    local = Window.partitionBy(*order.by, BUCKET, SUB).orderBy(*_sort_keys(order, False))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    return order.with_bucket(df).withColumns({f"cum_{c}": F.sum(c).over(upto) for c in columns})


def before_buckets(parts: DataFrame, order: Order, columns: Sequence[str]) -> DataFrame:
    """Add ``before_<c>`` to a table of one row per bucket: the total of ``c`` over the buckets of its group before it."""
    if order.cuts is None:
        return parts.withColumns({f"before_{c}": F.lit(0).cast("bigint") for c in columns})
    # at most one row per uncut group plus the bounded number of cuts
    before = Window.partitionBy(*order.by).orderBy(*_bucket_keys(False)).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})


def running_totals(
    df: DataFrame,
    order: Order,
    columns: Sequence[str],
    *,
    descending: bool = False,
    following: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<c>``: the total of ``c`` up to and including each row of its group.

    ``following`` adds ``next_<c>``, the value on the next row of the order.
    """
    by = order.by
    keyed = order.with_bucket(df)
    local = Window.partitionBy(*by, BUCKET, SUB).orderBy(*_sort_keys(order, descending))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumns({
        **{f"cum_{c}": F.sum(c).over(upto) for c in columns},
        **{f"next_{c}": F.lead(c).over(local) for c in following},
    })
    if order.cuts is not None:
        # Bucket totals: at most one row per uncut group plus the bounded number of cuts.
        lead_keys = F.struct(*([(-F.col(order.column)).alias("k")] if descending else [F.col(order.column).alias("k")]))
        totals = keyed.groupBy(*by, BUCKET, SUB).agg(
            *[F.sum(c).alias(f"__t_{c}") for c in columns],
            *[F.min_by(c, lead_keys).alias(f"__f_{c}") for c in following],
        )
        across = Window.partitionBy(*by).orderBy(*_bucket_keys(descending))
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *by, BUCKET, SUB,
            *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns],
            *[F.lead(f"__f_{c}").over(across).alias(f"__n_{c}") for c in following],
        )
        out = join_null_safe(out, offsets, [*by, BUCKET, SUB], "left", order.few_groups)
        out = out.withColumns({
            **{f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__o_{c}") for c in columns},
            **{f"next_{c}": F.coalesce(F.col(f"next_{c}"), F.col(f"__n_{c}")) for c in following},
        }).drop(*[f"__o_{c}" for c in columns], *[f"__n_{c}" for c in following])
    return out.drop(BUCKET, SUB)


def row_numbers(df: DataFrame, order: Order, name: str, *, descending: bool = False) -> DataFrame:
    """Add the 1-based position of each row in its group's order."""
    by = order.by
    keyed = order.with_bucket(df)
    local = Window.partitionBy(*by, BUCKET, SUB).orderBy(*_sort_keys(order, descending))
    out = keyed.withColumn(name, F.row_number().over(local).cast("bigint"))
    if order.cuts is not None:
        across = Window.partitionBy(*by).orderBy(*_bucket_keys(descending))
        offsets = (
            keyed.groupBy(*by, BUCKET, SUB).agg(F.count(F.lit(1)).alias("__c"))
            .select(*by, BUCKET, SUB,
                    F.coalesce(F.sum("__c").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
        )
        out = join_null_safe(out, offsets, [*by, BUCKET, SUB], "left", order.few_groups)
        out = out.withColumn(name, F.col(name) + F.col("__o")).drop("__o")
    return out.drop(BUCKET, SUB)
