"""Exact linear-interpolated quantiles that never hold a column in one task.

A column with few distinct values or few rows is counted by value and read off its running total.
Any other column is first narrowed: each wanted rank is bracketed between two sketch
quantiles, the rows below the bracket are counted exactly, and the bracket shrinks by
the sketch accuracy at each pass until the rows within it fit the limit. Every pass
is an aggregate with map-side combine; only scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import chunked, local_table

MAX_DISTINCT = 20_000
# Rows of a range that are counted by value without asking how many values they have.
ROWS_PER_DISTINCT = 50
SKETCH_ACCURACY = 10_000
MAX_PASSES = 6


def as_number(col: Column, dtype: str = "double") -> Column:
    """Cast to double with NaN read as null."""
    x = col.cast("double")
    return F.when(~F.isnan(x), x) if dtype in ("double", "float") else x


@dataclass
class _Bracket:
    """Closed value range [low, high] known to hold the wanted ranks."""

    column: str
    ranks: tuple[int, ...]
    low: float
    high: float
    below: int
    inside: int
    distinct: int
    stuck: bool = False

    def done(self, limit: int) -> bool:
        return self.stuck or self.low == self.high or self.distinct * 1.1 <= limit or self.inside <= ROWS_PER_DISTINCT * limit


def _as_fraction(p) -> Fraction:
    return p if isinstance(p, Fraction) else Fraction(str(p)).limit_denominator(10**9)


@dataclass(frozen=True)
class ColumnFacts:
    """What one pass tells about a column of numbers."""

    rows: int
    distinct: int
    low: float | None
    high: float | None


def facts_columns(col: Column, tag: str) -> list[Column]:
    """Aggregates that ``read_facts`` turns into facts; they fit into any wider pass."""
    return [F.count(col).alias(f"{tag}n"), F.approx_count_distinct(col).alias(f"{tag}d"),
            F.min(col).alias(f"{tag}a"), F.max(col).alias(f"{tag}b")]


def read_facts(row, tag: str) -> ColumnFacts:
    return ColumnFacts(row[f"{tag}n"], row[f"{tag}d"], row[f"{tag}a"], row[f"{tag}b"])


def _first_brackets(df, cols, wanted, known):
    facts = dict(known or {})
    for part in chunked([c for c in cols if c not in facts]):
        row = df.agg(*[a for i, c in enumerate(part) for a in facts_columns(F.col(c), f"c{i}_")]).first()
        facts |= {c: read_facts(row, f"c{i}_") for i, c in enumerate(part)}
    out = [
        _Bracket(c, ranks, f.low, f.high, 0, f.rows, f.distinct)
        for c in cols for f in [facts[c]] if f.rows for ranks in wanted(f.rows)
    ]
    return out, {c: facts[c].rows for c in cols}


def _code(x: Column, bounds: list[float], first: int = 0) -> Column:
    """2 i + 1 at the i-th bound and 2 i between the bounds before it and after it, by binary search."""
    if not bounds:
        return F.lit(2 * first)
    mid = len(bounds) // 2
    return (
        F.when(x < bounds[mid], _code(x, bounds[:mid], first)).when(x == bounds[mid], 2 * (first + mid) + 1)
        .otherwise(_code(x, bounds[mid + 1 :], first + mid + 1)))


def _narrow(df, brackets, accuracy):
    """One round of two passes: a sketch for each range that brackets share, then one count of all that the sketches propose."""
    shared: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.column, b.low, b.high), []).append(b)
    slack = 2.0 / accuracy
    proposed: dict[int, tuple[float, float]] = {}
    for part in chunked(list(shared.items())):
        asks = [
            [p for b in group for p in (
                max(0.0, (b.ranks[0] - b.below) / b.inside - slack), min(1.0, (b.ranks[-1] - b.below + 1) / b.inside + slack))]
            for _, group in part
        ]
        row = df.agg(*[
            F.percentile_approx(F.when(F.col(c).between(lo, hi), F.col(c)), ask, accuracy).alias(f"q{i}")
            for i, (((c, lo, hi), _), ask) in enumerate(zip(part, asks))]).first()
        for (_, group), ask, q in zip(part, asks, row):
            for j, b in enumerate(group):
                proposed[id(b)] = (b.low if ask[2 * j] == 0.0 else q[2 * j], b.high if ask[2 * j + 1] == 1.0 else q[2 * j + 1])

    columns = list(dict.fromkeys(b.column for b in brackets))
    for part in chunked(columns):
        bounds = {c: sorted({x for b in brackets if b.column == c for x in proposed[id(b)]}) for c in part}
        cells = F.array(*[
            F.struct(F.lit(i).alias("c"), F.when(F.col(c).isNotNull(), _code(F.col(c), bounds[c])).alias("code")) for i, c in enumerate(part)])
        counted = df.select(F.explode(cells).alias("e")).select("e.*").filter(F.col("code").isNotNull()).groupBy("c", "code").count()
        found = {(part[r["c"]], r["code"]): r["count"] for r in counted.collect()}  # at most 2 x bounds + 1 a column
        for b in brackets:
            if b.column not in bounds:
                continue
            lo, hi = proposed[id(b)]
            at = bounds[b.column]
            first, last = 2 * at.index(lo) + 1, 2 * at.index(hi) + 1
            own = {k: v for (c, k), v in found.items() if c == b.column}
            below = sum(v for k, v in own.items() if k < first)
            n = sum(v for k, v in own.items() if first <= k <= last)
            if below <= b.ranks[0] and b.ranks[-1] < below + n and (lo, hi) != (b.low, b.high):
                b.low, b.high, b.below, b.inside, b.distinct = lo, hi, below, n, min(b.distinct, n)
            else:
                b.stuck = True


def _read_off(df, brackets):
    """Values at the wanted ranks of all narrow brackets, in one grouped pass."""
    spark = df.sparkSession
    found = {}
    open_ = []
    for i, b in enumerate(brackets):
        if b.low == b.high:
            found.update({(b.column, r): b.low for r in b.ranks})
        else:
            open_.append((i, b))
    if not open_:
        return found
    shared = {}
    for i, b in open_:
        key = (b.column, b.low, b.high, b.below)
        shared.setdefault(key, []).extend(b.ranks)
    ranges = list(shared.items())
    for part in chunked(list(enumerate(ranges)), 200):
        # one element per range; Catalyst turns the explode into a generate with no shuffle
        cells = F.array(*[
            F.struct(F.lit(i).alias("range"), F.when(F.col(c).between(lo, hi), F.col(c)).alias("v"))
            for i, ((c, lo, hi, _), _r) in part
        ])
        counts = (
            df.select(F.explode(F.filter(cells, lambda e: e["v"].isNotNull())).alias("e")).select("e.range", "e.v")
            .groupBy("range", "v").agg(F.count(F.lit(1)).alias("n"))
        )
        w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(w))
        asked = local_table(
            spark,
            [(i, r, r - below) for i, ((_c, _l, _h, below), ranks) in part for r in sorted(set(ranks))],
            "range int, rank bigint, local bigint",
        )
        hits = (
            upto.join(F.broadcast(asked), "range")
            .filter((F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("n")))
            .select("range", "rank", "v").collect()
        )
        names = {i: key[0] for i, (key, _r) in part}
        found.update({(names[h["range"]], h["rank"]): h["v"] for h in hits})
    return found


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probabilities: Sequence,
    *,
    max_distinct: int = MAX_DISTINCT,
    accuracy: int = SKETCH_ACCURACY,
    known: dict[str, ColumnFacts] | None = None,
) -> dict[str, list[float] | None]:
    """``{column: [quantile per probability]}``; a column without values maps to None.

    ``known`` holds facts that an earlier pass over the same rows has found.

    Positions are ``p * (n - 1)`` in exact rational arithmetic, so an edge that falls on
    a data point is that data point, to the bit.
    """
    cols = list(dict.fromkeys(cols))
    dtypes = dict(df.dtypes)
    values = df.select(*[as_number(F.col(c), dtypes[c]).alias(c) for c in cols])
    probs = [_as_fraction(p) for p in probabilities]

    def wanted(n):
        groups = []
        for p in probs:
            pos = p * (n - 1)
            low = pos.numerator // pos.denominator
            groups.append((low, low + 1) if pos != low else (low,))
        return list(dict.fromkeys(groups))

    brackets, sizes = _first_brackets(values, cols, wanted, known)
    for _ in range(MAX_PASSES):
        wide = [b for b in brackets if not b.done(max_distinct)]
        if not wide:
            break
        _narrow(values, wide, accuracy)
    at = _read_off(values, brackets)

    result: dict[str, list[float] | None] = {}
    for c in cols:
        if not sizes[c]:
            result[c] = None
            continue
        edges = []
        for p in probs:
            pos = p * (sizes[c] - 1)
            low = pos.numerator // pos.denominator
            part = pos - low
            a = at[(c, low)]
            edges.append(a if part == 0 else a + (at[(c, low + 1)] - a) * (part.numerator / part.denominator))
        result[c] = edges
    return result


def medians(df: DataFrame, cols: Sequence[str], **kw) -> dict[str, float | None]:
    return {c: v and v[0] for c, v in exact_quantiles(df, cols, [Fraction(1, 2)], **kw).items()}
