"""Bin indices over fixed edges, as plain comparisons that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in terms], F.lit(0))


def _binned(col: Column, edges: Sequence[float], passes) -> Column:
    x = col.cast("double")
    # the guard stands outside, so that each edge costs one plain comparison
    return F.when(x.isNotNull() & ~F.isnan(x), _count([passes(x, F.lit(float(e))) for e in edges]))


def bin_left_closed(col: Column, inner: Sequence[float]) -> Column:
    """0-based bin: the number of inner edges <= x. Null and NaN have no bin."""
    return _binned(col, inner, lambda x, e: x >= e)


def bin_right_closed(col: Column, inner: Sequence[float]) -> Column:
    """0-based bin: the number of inner edges < x. Null and NaN have no bin."""
    return _binned(col, inner, lambda x, e: x > e)


def distinct_edges(edges: Sequence[float] | None) -> list[float]:
    """Sorted edges without repeats, as a duplicate quantile would open an empty bin."""
    return sorted(set(edges or []))


def uniform_edges(low: float, high: float, n_bins: int) -> list[float]:
    return [low + (high - low) * i / n_bins for i in range(n_bins)] + [high]


def lookup_literal(index: Column, values: Sequence[float]) -> Column:
    """Element of a short literal list by 0-based index; null index gives null."""
    # element_at over a literal array is planned as never null, so the null index is kept apart
    return F.when(index.isNotNull(), F.element_at(F.array(*[F.lit(float(v)) for v in values]), (index + 1).cast("int")))
