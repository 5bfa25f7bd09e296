"""Weight of evidence, target and adaptive encoders.

A fit is one grouped pass over ``(feature, category or bin)``; a hot category is counted
with map-side combine. Applying a fit shuffles nothing while its table is small, and
otherwise isolates the hot categories (see ``plans.rows.attach``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import iv_strength
from ..functions.bins import bin_left_closed, distinct_edges, lookup_literal
from ..plans.quantiles import as_number, exact_quantiles, facts_columns, read_facts
from ..plans.rows import BROADCAST_ROWS, attach, chunked, local_table, reused
from ..session import settle
from .preprocess import MISSING, levels_of, modes
from .roles import is_numeric
from .target import folds as plain_folds

MAP_LITERAL = 64


def _value(df: DataFrame, c: str) -> Column:
    dtype = dict(df.dtypes)[c]
    return as_number(F.col(c), dtype) if dtype in ("double", "float") else F.col(c)


def exact_few(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of columns that a sketch has shown to have few values."""
    found: dict[str, int] = {}
    for part in chunked(list(cols)):
        row = df.agg(*[F.size(F.collect_set(_value(df, c))).alias(f"n{i}") for i, c in enumerate(part)]).first()
        found |= {c: row[f"n{i}"] for i, c in enumerate(part)}
    return found


def cardinalities(df: DataFrame, cols: Sequence[str], exact_to: int) -> dict[str, int]:
    """Distinct non-null values per column: exact up to ``exact_to``, a sketch beyond."""
    found: dict[str, int] = {}
    for part in chunked(list(cols)):
        row = df.agg(*[F.approx_count_distinct(_value(df, c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        found |= {c: row[f"d{i}"] for i, c in enumerate(part)}
    return found | exact_few(df, [c for c in cols if exact_to and found[c] <= 2 * exact_to + 50])


def _woe_columns(counts: DataFrame, total_events: int, total_others: int, r: float) -> DataFrame:
    e = (F.col("events") + r) / (total_events + r)
    n = (F.col("non_events") + r) / (total_others + r)
    return counts.withColumns({
        "event_rate": F.col("events") / F.greatest(F.col("count"), F.lit(1)),
        "woe": F.log(e / n),
        "iv": (e - n) * F.log(e / n),
    })


BIN_COLUMNS = ["feature", "kind", "bin", "lower", "upper", "count", "events", "non_events", "event_rate", "woe", "iv"]


@dataclass
class WOEModel:
    """Fitted bins: a table, and the edges of the numeric features."""

    bins: DataFrame
    edges: dict[str, list[float]]
    kinds: dict[str, str]
    sizes: dict[str, int]
    fills: dict[str, str]

    def iv(self) -> DataFrame:
        """Information value per feature with its strength, strongest first."""
        return (
            self.bins.groupBy("feature").agg(F.sum("iv").alias("iv"))
            .withColumn("strength", iv_strength(F.col("iv"))).orderBy(F.desc("iv"), "feature")
        )

    def report(self, feature: str) -> DataFrame:
        if feature not in self.kinds:
            raise ValueError(f"feature {feature!r} not found")
        return self.bins.filter(F.col("feature") == feature)

    def transform(self, df: DataFrame, suffix: str = "_woe") -> DataFrame:
        """Add one WOE column per fitted feature; an unknown category gives 0."""
        here = [f for f in self.kinds if f in df.columns]
        # a numeric feature has at most n_bins + 1 rows
        few = [f for f in here if self.kinds[f] == "numeric" or self.sizes[f] <= MAP_LITERAL]
        rows: dict[str, dict[str, float]] = {f: {} for f in few}
        if few:
            for r in self.bins.filter(F.col("feature").isin(few)).select("feature", "bin", "woe").collect():
                rows[r["feature"]][r["bin"]] = r["woe"]
        out = {}
        for f in few:
            if self.kinds[f] == "numeric":
                edges = self.edges[f]
                values = [rows[f].get(str(i), 0.0) for i in range(max(len(edges) - 1, 1))]
                binned = lookup_literal(bin_left_closed(F.col(f), edges[1:-1]), values)
                out[f + suffix] = F.coalesce(binned, F.lit(rows[f].get(MISSING, 0.0)))
            elif not rows[f]:
                out[f + suffix] = F.lit(0.0)
            else:
                pairs = [F.lit(v) for kv in rows[f].items() for v in kv]
                key = F.coalesce(F.col(f).cast("string"), F.lit(MISSING))
                out[f + suffix] = F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.0))
        df = df.withColumns(out) if out else df
        for f in [f for f in here if f not in few]:
            table = self.bins.filter(F.col("feature") == f).select(
                F.col("bin").alias("__k"), F.col("woe").alias(f + suffix), F.col("count").alias("__n"))
            keyed = df.withColumn("__k", F.coalesce(F.col(f).cast("string"), F.lit(MISSING)))
            df = attach(keyed, table, ["__k"], table_rows=self.sizes[f], weight="__n").drop("__k")
            df = df.withColumn(f + suffix, F.coalesce(F.col(f + suffix), F.lit(0.0)))
        return df


def _kept(table: DataFrame, rows: int, name: str) -> tuple[DataFrame, dict[str, int]]:
    """A fitted table, local if ``rows`` says it is small, else written by feature; and its exact rows per feature."""
    if rows <= BROADCAST_ROWS:
        held = table.collect()
        return local_table(table.sparkSession, held, table.schema), dict(Counter(r["feature"] for r in held))
    table = settle(table, name, by=("feature",))
    return table, {r["feature"]: r["count"] for r in table.groupBy("feature").count().collect()}


class WOEEncoder:
    """``woe = ln(event share / non-event share)``, both smoothed by ``regularization``.

    Strings and columns of fewer than ``n_bins`` values are taken by category, other
    numbers by exact quantile bins that are closed on the left.
    """

    def __init__(
        self, n_bins: int = 10, regularization: float = 0.5, handle_missing: str = "separate", persist_input: bool = False,
        **quantile_options,
    ):
        self.n_bins = n_bins
        self.regularization = regularization
        self.handle_missing = handle_missing
        self.persist_input = persist_input
        self.quantile_options = quantile_options

    def _survey(self, df: DataFrame, features: Sequence[str], label: str | None):
        """One pass for the facts of every feature and the class totals; then the routing."""
        numbers = [f for f in features if is_numeric(df.schema[f].dataType)]
        dtypes = dict(df.dtypes)
        facts, sizes, totals = {}, {}, (0, 0)
        for at, part in enumerate(chunked(list(features))):
            aggs = []
            for i, f in enumerate(part):
                aggs += (facts_columns(as_number(F.col(f), dtypes[f]), f"f{i}_") if f in numbers
                         else [F.approx_count_distinct(f).alias(f"f{i}_d")])
            if at == 0 and label is not None:
                aggs += [F.count_if(F.col(label) == 1).alias("e"), F.count_if(F.col(label) == 0).alias("n")]
            row = df.agg(*aggs).first()
            if at == 0 and label is not None:
                totals = row["e"], row["n"]
            facts |= {f: read_facts(row, f"f{i}_") for i, f in enumerate(part) if f in numbers}
            sizes |= {f: row[f"f{i}_d"] for i, f in enumerate(part)}
        sizes |= exact_few(df, [f for f in numbers if sizes[f] <= 2 * self.n_bins + 50])
        kinds = {f: "numeric" if f in numbers and sizes[f] >= self.n_bins else "categorical" for f in features}
        return kinds, sizes, facts, totals

    def route(self, df: DataFrame, features: Sequence[str]) -> dict[str, str]:
        """How each feature is taken: numeric or categorical."""
        return self._survey(df, features, None)[0]

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> WOEModel:
        with reused(df.select(*dict.fromkeys([*features, label])), self.persist_input) as narrow:
            return self._fit(narrow, features, label)

    def _fit(self, df: DataFrame, features: Sequence[str], label: str) -> WOEModel:
        kinds, sizes, facts, totals = self._survey(df, features, label)
        numeric = [f for f in features if kinds[f] == "numeric"]
        categorical = [f for f in features if kinds[f] == "categorical"]
        separate = self.handle_missing == "separate"
        steps = [Fraction(i, self.n_bins) for i in range(self.n_bins + 1)]
        quantiles = exact_quantiles(df, numeric, steps, known=facts, **self.quantile_options) if numeric else {}
        edges = {f: distinct_edges(q) for f, q in quantiles.items()}
        fills = {} if separate else {c: v or "UNKNOWN" for c, v in modes(df, categorical).items()}

        keys = []
        for f in features:
            if kinds[f] == "numeric":
                b = bin_left_closed(F.col(f), edges[f][1:-1]).cast("string")
                keys.append((f, F.coalesce(b, F.lit(MISSING)) if separate else b))
            else:
                keys.append((f, F.coalesce(F.col(f).cast("string"), F.lit(fills.get(f, MISSING)))))
        cells = F.array(*[F.struct(F.lit(i).alias("i"), k.alias("bin")) for i, (_f, k) in enumerate(keys)])
        y = F.col(label)
        counts = (
            df.select(y.alias("y"), F.explode(cells).alias("e")).select("y", "e.i", "e.bin")
            .filter(F.col("bin").isNotNull())
            .groupBy("i", "bin").agg(
                F.count(F.lit(1)).alias("count"),
                F.count_if(F.col("y") == 1).alias("events"),
                F.count_if(F.col("y") == 0).alias("non_events"),
            )
        )
        order = {f: i for i, f in enumerate(features)}
        spine = [
            (order[f], str(b), lower, upper)
            for f in numeric for b, (lower, upper) in enumerate(zip(edges[f][:-1], edges[f][1:]))
        ]
        spark = df.sparkSession
        frame = local_table(spark, spine, "i int, bin string, lower double, upper double")
        # every numeric bin has a row, also an empty one: smoothing gives it a weight
        binned = counts.join(F.broadcast(frame), ["i", "bin"], "full_outer")
        zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("count", "events", "non_events")}
        table = _woe_columns(binned.withColumns(zero), *totals, self.regularization)
        names = F.array(*[F.lit(f) for f in features])
        kind = F.array(*[F.lit(kinds[f]) for f in features])
        table = table.withColumns({
            "feature": F.element_at(names, F.col("i") + 1), "kind": F.element_at(kind, F.col("i") + 1),
        }).select(*BIN_COLUMNS)
        rows = int(sum(sizes[f] * 1.1 + 2 for f in categorical)) + len(spine) + len(numeric)
        table, held = _kept(table, rows, "woe")
        return WOEModel(table, edges, kinds, {f: held.get(f, 0) for f in features}, fills)


@dataclass
class TargetModel:
    table: DataFrame
    global_mean: float
    features: list[str]
    sizes: dict[str, int]
    separate: bool

    def transform(self, df: DataFrame, suffix: str = "_te") -> DataFrame:
        """Add the encoding of each feature; unknown and null give the global mean."""
        for f in [f for f in self.features if f in df.columns]:
            table = self.table.filter(F.col("feature") == f).select(
                F.col("category").alias("__k"), F.col("encoding").alias(f + suffix), F.col("n").alias("__n"))
            df = attach(df.withColumn("__k", _key(f, self.separate)), table, ["__k"],
                        table_rows=self.sizes[f], weight="__n").drop("__k")
            df = df.withColumn(f + suffix, F.coalesce(F.col(f + suffix), F.lit(self.global_mean)))
        return df


def _key(f: str, separate: bool) -> Column:
    key = F.col(f).cast("string")
    return F.coalesce(key, F.lit(MISSING)) if separate else key


class TargetEncoder:
    """``(sum + global mean * smoothing) / (n + smoothing)`` per category."""

    def __init__(self, smoothing: float = 1.0, n_folds: int = 5, handle_missing: str = "global_mean"):
        self.smoothing = smoothing
        self.n_folds = n_folds
        self.separate = handle_missing == "separate"

    def _sums(self, df, features, label, by=()):
        cells = F.array(*[F.struct(F.lit(f).alias("feature"), _key(f, self.separate).alias("category")) for f in features])
        return (
            df.select(*by, F.col(label).alias("y"), F.explode(cells).alias("e")).select(*by, "y", "e.feature", "e.category")
            .filter(F.col("category").isNotNull())
            .groupBy("feature", "category", *by).agg(F.count("y").alias("n"), F.sum("y").alias("s"))
        )

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> TargetModel:
        features = list(features)
        mean = df.agg(F.avg(label)).first()[0]
        mean = 0.5 if mean is None else mean
        sizes = {f: int(n * 1.1) + 2 for f, n in cardinalities(df, features, 0).items()}
        table = self._sums(df, features, label).select(
            "feature", "category", "n",
            ((F.col("s") + F.lit(mean) * self.smoothing) / (F.col("n") + self.smoothing)).alias("encoding"),
        )
        table, held = _kept(table, sum(sizes.values()), "target")
        return TargetModel(table, mean, features, {f: held.get(f, 0) for f in features}, self.separate)

    def fit_transform(
        self, df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], suffix: str = "_te",
        fold: str | None = None, seed: int = 42,
    ) -> DataFrame:
        """Encode each row from the other folds only.

        One aggregate by (category, fold); a window over a category's few folds gives its
        total, and the own fold is subtracted. Smoothing uses the all-row mean.
        """
        features = list(features)
        mean = df.agg(F.avg(label)).first()[0]
        mean = 0.5 if mean is None else mean
        if fold is None:
            df, fold = plain_folds(df, keys, self.n_folds, seed, out="__fold"), "__fold"
        sizes = cardinalities(df, features, 0)
        sums = self._sums(df, features, label, [fold])
        whole = Window.partitionBy("feature", "category")
        others_n = F.sum("n").over(whole) - F.col("n")
        others_s = F.sum("s").over(whole) - F.col("s")
        table = sums.select(
            "feature", "category", fold, "n",
            F.when(others_n > 0, (others_s + F.lit(mean) * self.smoothing) / (others_n + self.smoothing))
            .otherwise(F.lit(mean)).alias("encoding"),
        )
        table, held = _kept(table, sum(sizes.values()) * self.n_folds, "oof")
        for f in features:
            side = table.filter(F.col("feature") == f).select(
                F.col("category").alias("__k"), fold, F.col("encoding").alias(f + suffix), F.col("n").alias("__n"))
            df = attach(df.withColumn("__k", _key(f, self.separate)), side, ["__k", fold],
                        table_rows=held.get(f, 0), weight="__n").drop("__k")
            df = df.withColumn(f + suffix, F.coalesce(F.col(f + suffix), F.lit(mean)))
        return df.drop("__fold")


@dataclass
class SmartModel:
    strategies: dict[str, str]
    levels: dict[str, list[str]]
    nulls: dict[str, bool]
    woe: WOEModel | None
    target: TargetModel | None

    def summary(self, spark) -> DataFrame:
        return local_table(spark, self.strategies.items(), "feature string, strategy string")

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each fitted column by its encoding: ``col_level`` columns, or one number."""
        out = {}
        for f, levels in self.levels.items():
            key = F.col(f).cast("string")
            out |= {f"{f}_{v}": F.coalesce(key == v, F.lit(False)).cast("int") for v in levels}
            if self.nulls[f]:
                out[f"{f}_null"] = key.isNull().cast("int")
        df = df.withColumns(out) if out else df
        for model, suffix in ((self.woe, "__w"), (self.target, "__t")):
            if model is not None:
                df = model.transform(df, suffix)
        coded = [f for f, s in self.strategies.items() if s != "onehot"]
        for f in coded:
            suffix = "__w" if self.strategies[f] == "woe" else "__t"
            df = df.drop(f).withColumnRenamed(f + suffix, f)
        return df.drop(*self.levels)


class SmartEncoder:
    """One-hot up to 5 values, WOE up to 50, target encoding beyond."""

    def __init__(self, low: int = 5, high: int = 50, woe_regularization: float = 0.5, target_smoothing: float = 1.0):
        self.low, self.high = low, high
        self.woe_regularization = woe_regularization
        self.target_smoothing = target_smoothing

    def choose(self, df: DataFrame, features: Sequence[str]) -> dict[str, str]:
        sizes = cardinalities(df, features, self.high)
        return {
            f: "onehot" if sizes[f] <= self.low else "woe" if sizes[f] <= self.high else "target" for f in features
        }

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> SmartModel:
        chosen = self.choose(df, features)
        pick = lambda s: [f for f in features if chosen[f] == s]
        hot = pick("onehot")
        levels = {f: levels_of(df, f) for f in hot}
        nulls = {}
        if hot:
            row = df.agg(*[F.max(F.col(f).isNull()).alias(f"n{i}") for i, f in enumerate(hot)]).first()
            nulls = {f: bool(row[f"n{i}"]) for i, f in enumerate(hot)}
        woe = WOEEncoder(regularization=self.woe_regularization).fit(df, pick("woe"), label) if pick("woe") else None
        target = TargetEncoder(self.target_smoothing).fit(df, pick("target"), label) if pick("target") else None
        return SmartModel(chosen, levels, nulls, woe, target)
