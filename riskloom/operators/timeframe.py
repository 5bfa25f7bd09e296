"""Lags, rolling and trailing statistics per entity, calendar spines, ordered features.

Entities that one task can hold use a plain window. When some entity is larger, every
entity is cut into blocks of consecutive rows, and each block carries along the few rows
before it that its frames look back at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.bins import bin_right_closed, distinct_edges
from ..functions.derive import z_score
from ..plans.ordered import ROWS_PER_BUCKET, plan_order, row_numbers
from ..plans.quantiles import as_number, exact_quantiles
from ..plans.rows import chunked
from .roles import is_numeric

_BLOCK, _HALO, _POS = "__block", "__halo", "__rn"


def with_frames(
    df: DataFrame, entity: Sequence[str], order: str, columns: Callable[[WindowSpec], dict[str, Column]], depth: int,
    rows_per_block: int = ROWS_PER_BUCKET, tiebreak: str | None = None,
) -> DataFrame:
    """Add window columns that look back at most ``depth`` rows within each entity.

    Rows of an entity with equal ``order`` come in the order of ``tiebreak``; without one, such
    rows have no defined sequence. A frame may look back over any number of blocks.
    """
    entity = list(entity)
    plan = plan_order(df, entity, order, tiebreak=tiebreak, rows_per_bucket=rows_per_block)
    if plan.cuts is None:
        return df.withColumns(columns(Window.partitionBy(*entity).orderBy(order, *([tiebreak] if tiebreak else []))))
    ranked = row_numbers(df, plan, _POS)
    at = F.col(_POS) - 1
    block = F.floor(at / rows_per_block)
    own = F.struct(block.alias(_BLOCK), F.lit(False).alias(_HALO))
    # A row is carried along to every later block whose first row is at most ``depth`` rows on.
    reach = F.floor((at + depth) / rows_per_block)
    tails = F.transform(F.sequence(block + 1, F.greatest(reach, block + 1)), lambda b: F.struct(b.alias(_BLOCK), F.lit(True).alias(_HALO)))
    cells = F.when(reach > block, F.concat(F.array(own), tails)).otherwise(F.array(own))
    spread = ranked.withColumn("__e", F.explode(cells)).withColumns({_BLOCK: F.col(f"__e.{_BLOCK}"), _HALO: F.col(f"__e.{_HALO}")})
    framed = spread.withColumns(columns(Window.partitionBy(*entity, _BLOCK).orderBy(_POS)))
    return framed.filter(~F.col(_HALO)).drop("__e", _BLOCK, _HALO, _POS)


def lags(df: DataFrame, entity: Sequence[str], order: str, col: str, periods: Sequence[int] = (1, 3, 6, 12), **kw) -> DataFrame:
    """Earlier value, change and relative change per lag."""
    def make(w):
        out = {}
        for k in periods:
            before = F.lag(col, k).over(w)
            out |= {
                f"{col}_lag_{k}": before,
                f"{col}_chg_{k}": F.col(col) - before,
                f"{col}_pct_chg_{k}": F.try_divide(F.col(col) - before, before),
            }
        return out

    return with_frames(df, entity, order, make, max(periods), **kw)


def rolling(df: DataFrame, entity: Sequence[str], order: str, col: str, windows: Sequence[int] = (3, 6, 12), **kw) -> DataFrame:
    """Mean, max, min and population deviation over the last k rows, the current one included."""
    def make(w):
        out = {}
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            out |= {
                f"{col}_avg_{k}": F.avg(col).over(frame), f"{col}_max_{k}": F.max(col).over(frame),
                f"{col}_min_{k}": F.min(col).over(frame), f"{col}_std_{k}": F.stddev_pop(col).over(frame),
            }
        return out

    return with_frames(df, entity, order, make, max(windows) - 1, **kw)


def trends(
    df: DataFrame, entity: Sequence[str], order: str, col: str, index: str, windows: Sequence[int] = (3, 6),
    momentum: int = 6, **kw,
) -> DataFrame:
    """Direction against the mean of the k rows before (-1, 0, 1), and the slope over recent rows."""
    def make(w):
        out = {}
        for k in windows:
            mean = F.avg(col).over(w.rowsBetween(-k, -1))
            out[f"{col}_trend_{k}"] = F.signum(F.col(col) - mean).cast("int")
        out[f"{col}_momentum"] = F.regr_slope(F.col(col), F.col(index)).over(w.rowsBetween(-(momentum - 1), 0))
        return out

    return with_frames(df, entity, order, make, max(*windows, momentum), **kw)


def trailing_means(df: DataFrame, entity: Sequence[str], order: str, col: str, windows: Sequence[int] = (4, 12), **kw) -> DataFrame:
    """Mean of the k rows before, the current one excluded; the first row stands for itself."""
    def make(w):
        return {f"{col}_trail_{k}": F.coalesce(F.avg(col).over(w.rowsBetween(-k, -1)), F.col(col)) for k in windows}

    return with_frames(df, entity, order, make, max(windows), **kw)


def trailing_variation(
    df: DataFrame, entity: Sequence[str], order: str, col: str, window: int = 8, first: float = 0.1, **kw
) -> DataFrame:
    """Population deviation over mean of the rows before; the first row gets a stated value."""
    def make(w):
        frame = w.rowsBetween(-window, -1)
        ratio = F.stddev_pop(col).over(frame) / (F.avg(col).over(frame) + 1e-6)
        return {f"{col}_cv": F.round(F.coalesce(ratio, F.lit(first)), 3)}

    return with_frames(df, entity, order, make, window, **kw)


def entity_spine(entities: DataFrame, start: str, end: str, step: str = "1 month", period: str = "period") -> DataFrame:
    """Each entity repeated for every period, with its attributes; made within the row, not joined."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))
    return entities.withColumn(period, F.explode(days))


def on_spine(spine: DataFrame, facts: DataFrame, keys: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Facts laid on the spine; in a period without facts numbers are ``fill``. A null among the facts stays null."""
    out = spine.join(facts.withColumn("__here", F.lit(True)), list(keys), "left")
    filled = {
        f.name: F.when(F.col("__here").isNull(), F.lit(fill).cast(f.dataType)).otherwise(F.col(f.name))
        for f in facts.schema.fields if f.name not in keys and is_numeric(f.dataType)}
    return out.withColumns(filled).drop("__here")


def period_bounds(facts: DataFrame, period: str) -> tuple:
    """First and last period of the facts, for a spine that leaves none of them out."""
    row = facts.agg(F.min(period).alias("a"), F.max(period).alias("b")).first()
    return row["a"], row["b"]


def percentile_position(df: DataFrame, col: str, id: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zero-based rank over the row count, ties in the order of ``id``."""
    order = plan_order(df, [], col, tiebreak=id, rows_per_bucket=rows_per_bucket)
    ranked = order.with_totals(row_numbers(df, order, _POS))
    return ranked.withColumn(out, (F.col(_POS) - 1) / F.col("__n")).drop(_POS, "__n")


def quantile_bins(df: DataFrame, col: str, out: str, q: int = 10, **kw) -> DataFrame:
    """0-based quantile bin, closed on the right, lowest included, equal edges merged."""
    edges = distinct_edges(exact_quantiles(df, [col], [Fraction(i, q) for i in range(q + 1)], **kw)[col])
    return df.withColumn(out, bin_right_closed(F.col(col), edges[1:-1]))


def population_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, as driver numbers."""
    out = {}
    for part in chunked(list(cols)):
        row = df.agg(*[f(c).alias(f"{t}{i}") for i, c in enumerate(part) for t, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        out |= {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(part)}
    return out


def z_scores(df: DataFrame, cols: Sequence[str], suffix: str = "_zscore", eps: float = 1e-8) -> DataFrame:
    moments = population_moments(df, cols)
    return df.withColumns({c + suffix: z_score(c, m, s, eps) for c, (m, s) in moments.items()})


def scaled_features(df: DataFrame, cols: Sequence[str], id: str | None = None) -> DataFrame:
    """Log, root, z-score and decile of each column after a median fill, and rank share if ``id`` is given."""
    from ..functions.derive import root_of_size, signed_free_log

    filled = df
    edges = exact_quantiles(df, cols, [Fraction(1, 2)])
    dtypes = dict(df.dtypes)
    filled = filled.withColumns({c: F.coalesce(as_number(F.col(c), dtypes[c]), F.lit(edges[c][0])) for c in cols if edges[c]})
    out = filled.withColumns({
        **{f"{c}_log": signed_free_log(c) for c in cols}, **{f"{c}_sqrt": root_of_size(c) for c in cols},
    })
    out = z_scores(out, cols)
    deciles = exact_quantiles(filled, cols, [Fraction(i, 10) for i in range(11)])
    out = out.withColumns({f"{c}_decile": bin_right_closed(F.col(c), distinct_edges(deciles[c])[1:-1]) for c in cols})
    for c in cols if id else ():
        out = percentile_position(out, c, id, f"{c}_pctl")
    return out
