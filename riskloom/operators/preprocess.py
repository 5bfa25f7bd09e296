"""Model preprocessing: impute, standardise, one-hot, assemble; all kept in one PipelineModel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import as_number, medians
from ..plans.rows import chunked
from .profile import value_counts
from .roles import roles

MISSING = "__MISSING__"
# Up to so many levels have a slot each; a column of more is hashed into a fixed number of slots.
MAX_LEVELS = 10_000
HASH_SLOTS = 4_096
# Five standard errors of the distinct-count sketch: nearer to the limit the levels are counted.
SKETCH_ERROR = 0.05


def fill_missing(col: Column, value: str = MISSING) -> Column:
    """Text of a value, with a sentinel or mode in place of null."""
    return F.coalesce(col.cast("string"), F.lit(value))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, one grouped pass; ties go to the smallest."""
    if not cols:
        return {}
    rows = (
        value_counts(df, cols).filter(F.col("value").isNotNull()).groupBy("position")
        .agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("mode")).collect()
    )
    found = {df.columns[r["position"]]: r["mode"] for r in rows}
    return {c: found.get(c) for c in cols}


@dataclass
class NumericState:
    median: float
    mean: float
    std: float


def fit_numeric(df: DataFrame, cols: Sequence[str]) -> dict[str, NumericState]:
    """Exact median, then mean and population deviation of the filled column."""
    dtypes = dict(df.dtypes)
    mids = {c: m if m is not None else 0.0 for c, m in medians(df, cols).items()} if cols else {}
    out: dict[str, NumericState] = {}
    for part in chunked(list(cols)):
        aggs = []
        for i, c in enumerate(part):
            x = F.coalesce(as_number(F.col(c), dtypes[c]), F.lit(mids[c]))
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            out[c] = NumericState(mids[c], row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0)
    return out


def standardised(col: Column, s: NumericState, dtype: str = "double") -> Column:
    """Filled and standardised; a constant column is only centred."""
    return (F.coalesce(as_number(col, dtype), F.lit(s.median)) - F.lit(s.mean)) / F.lit(s.std or 1.0)


def impute(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """Median for numbers, mode for strings."""
    dtypes = dict(df.dtypes)
    mids = medians(df, numeric) if numeric else {}
    tops = modes(df, categorical)
    out = {c: F.coalesce(as_number(F.col(c), dtypes[c]), F.lit(m)) for c, m in mids.items() if m is not None}
    out |= {c: F.coalesce(F.col(c), F.lit(m)) for c, m in tops.items() if m is not None}
    return df.withColumns(out) if out else df


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    state = fit_numeric(df, cols)
    dtypes = dict(df.dtypes)
    return df.withColumns({c: standardised(F.col(c), state[c], dtypes[c]) for c in cols})


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level; an unknown or null value has none set."""
    return df.withColumns({
        f"{col}_{v}": F.coalesce(F.col(col).cast("string") == v, F.lit(False)).cast("int") for v in levels
    })


def levels_of(df: DataFrame, col: str, limit: int = MAX_LEVELS) -> list[str]:
    """Sorted levels of a column that is known to have few."""
    rows = df.select(F.col(col).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col!r} has more than {limit} levels; use the target encoder")
    return sorted(r["v"] for r in rows)


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def wide_columns(df: DataFrame, cols: Sequence[str], limit: int = MAX_LEVELS) -> list[str]:
    """Columns of more than ``limit`` distinct values: by a sketch where that leaves no doubt, else counted."""
    wide = []
    for part in chunked(list(cols)):
        row = df.agg(*[F.approx_count_distinct(c, SKETCH_ERROR).alias(f"d{i}") for i, c in enumerate(part)]).first()
        for i, c in enumerate(part):
            n, doubt = row[f"d{i}"], 5 * SKETCH_ERROR
            if n * (1 - doubt) > limit:
                wide.append(c)
            elif n * (1 + doubt) >= limit and df.select(c).filter(F.col(c).isNotNull()).distinct().limit(limit + 1).count() > limit:
                wide.append(c)
    return wide


def fit_preprocessor(
    df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
    exclude: Sequence[str] = (), out: str = "features", max_levels: int = MAX_LEVELS, hash_slots: int = HASH_SLOTS,
) -> PipelineModel:
    """Numeric block then categorical block as one vector.

    Filling and scaling are written into a SQL stage, so that the fitted pipeline
    saves, loads and scores with built-in expressions only. A column of more than ``max_levels``
    levels gets ``hash_slots`` slots, in one of which each level counts; its levels stay where they are.
    """
    found = roles(df, exclude)
    numeric = found.numeric if numeric is None else list(numeric)
    categorical = found.categorical if categorical is None else list(categorical)
    wide = wide_columns(df, categorical, max_levels)
    narrow = [c for c in categorical if c not in wide]
    state = fit_numeric(df, numeric)
    tops = modes(df, categorical)
    exprs = []
    for c in numeric:
        s = state[c]
        exprs.append(
            f"(coalesce(nanvl(cast({_quote(c)} as double), null), double('{s.median!r}')) - double('{s.mean!r}'))"
            f" / double('{(s.std or 1.0)!r}') AS {_quote('num__' + c)}"
        )
    for c in categorical:
        exprs.append(f"coalesce(cast({_quote(c)} as string), {_text(tops[c] or MISSING)}) AS {_quote('cat__' + c)}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    inputs = [f"num__{c}" for c in numeric]
    if narrow:
        # "keep" adds one slot for unknown levels; dropping the last leaves it all zero
        stages += [
            StringIndexer(inputCols=[f"cat__{c}" for c in narrow], outputCols=[f"ix__{c}" for c in narrow],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"ix__{c}" for c in narrow], outputCols=[f"oh__{c}" for c in narrow], dropLast=True),
        ]
    stages += [FeatureHasher(inputCols=[f"cat__{c}"], outputCol=f"fh__{c}", numFeatures=hash_slots) for c in wide]
    inputs += [f"fh__{c}" if c in wide else f"oh__{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def slot_groups(model: PipelineModel) -> list[tuple[str, list[str]]]:
    """Slots of the assembled vector in order, by source column: ``num__x``, ``cat__x_level`` or, hashed, ``cat__x#slot``."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    indexer = next((s for s in model.stages if isinstance(s, StringIndexerModel)), None)
    levels = dict(zip(indexer.getInputCols(), indexer.labelsArray)) if indexer is not None else {}
    slots = {s.getInputCols()[0]: s.getNumFeatures() for s in model.stages if isinstance(s, FeatureHasher)}
    groups = []
    for name in assembler.getInputCols():
        kind, column = name.split("__", 1)
        if kind == "num":
            groups.append((column, [name]))
        elif kind == "oh":
            groups.append((column, [f"cat__{column}_{v}" for v in levels[f"cat__{column}"]]))
        else:
            groups.append((column, [f"cat__{column}#{i}" for i in range(slots[f"cat__{column}"])]))
    return groups


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the assembled vector's slots."""
    return [name for _, names in slot_groups(model) for name in names]


def plain_name(name: str) -> str:
    return name.removeprefix("num__").removeprefix("cat__")
