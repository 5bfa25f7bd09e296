"""Population and characteristic stability, in batch and per time window.

A frozen baseline is a handful of edges and shares. Comparing any amount of data with it
is one aggregate that keeps one counter per bin, so a row costs a few comparisons and
the shuffle carries one row per task, feature and group.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bands import psi_status
from ..functions.bins import bin_left_closed, distinct_edges, uniform_edges
from ..plans.quantiles import as_number, exact_quantiles
from ..plans.rows import chunked, local_table
from ..session import claim, fresh_path
from .roles import roles

# The floor of a share, and the alert limits.
SHARE_FLOOR = 1e-6
ALERT = 0.25
WARNING = 0.10
ALERT_SHARE = 0.2
ALERT_COUNT = 5

BASELINE_SCHEMA = "feature string, inner array<double>, expected array<double>, rows bigint"


def _clip_share(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1 - SHARE_FLOOR)), F.lit(SHARE_FLOOR))


@dataclass
class Baseline:
    """Inner edges and clipped shares per feature."""

    inner: dict[str, list[float]]
    expected: dict[str, list[float]]
    rows: dict[str, int]

    @property
    def features(self) -> list[str]:
        return list(self.inner)

    def table(self, spark: SparkSession) -> DataFrame:
        return local_table(
            spark, [(f, self.inner[f], self.expected[f], self.rows[f]) for f in self.inner], BASELINE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Baseline":
        rows = spark.read.schema(BASELINE_SCHEMA).parquet(path).collect()
        return cls({r["feature"]: list(r["inner"]) for r in rows},
                   {r["feature"]: list(r["expected"]) for r in rows},
                   {r["feature"]: r["rows"] for r in rows})


def numeric_features(df: DataFrame) -> list[str]:
    return roles(df, bool_as="categorical").numeric


def fit_baseline(
    df: DataFrame, features: Sequence[str] | None = None, n_bins: int = 10, strategy: str = "quantile", **quantile_options
) -> Baseline:
    """Freeze bins and shares. Fewer than three distinct edges fall back to a split at the median."""
    features = list(features or numeric_features(df))
    dtypes = dict(df.dtypes)
    narrow = df.select(*features)
    if strategy == "quantile":
        asks = [Fraction(i, n_bins) for i in range(n_bins + 1)] + [Fraction(1, 2)]
        quantiles = exact_quantiles(narrow, features, asks, **quantile_options)
        edges = {f: distinct_edges(q[:-1]) if q else [] for f, q in quantiles.items()}
        mids = {f: q[-1] if q else None for f, q in quantiles.items()}
    elif strategy == "uniform":
        edges, mids = {}, {}
        for part in chunked(features):
            row = narrow.agg(*[
                g(as_number(F.col(f), dtypes[f])).alias(f"{t}{i}") for i, f in enumerate(part) for t, g in (("a", F.min), ("b", F.max))
            ]).first()
            for i, f in enumerate(part):
                edges[f] = distinct_edges(uniform_edges(row[f"a{i}"], row[f"b{i}"], n_bins)) if row[f"a{i}"] is not None else []
        short = [f for f in features if len(edges[f]) < 3]
        if short:
            mids = {f: q and q[0] for f, q in exact_quantiles(narrow, short, [Fraction(1, 2)], **quantile_options).items()}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    inner = {}
    for f in features:
        if not edges[f]:
            inner[f] = []
        elif len(edges[f]) < 3:
            inner[f] = [mids[f]]
        else:
            inner[f] = edges[f][1:-1]
    counts = {r["feature"]: r["counts"] for r in bin_counts(df, inner).collect()}
    expected, rows = {}, {}
    for f in features:
        got = list(counts[f][: len(inner[f]) + 1]) if f in counts else [0] * (len(inner[f]) + 1)
        n = sum(got)
        rows[f] = n
        expected[f] = [min(max(c / n if n else 0.0, SHARE_FLOOR), 1 - SHARE_FLOOR) for c in got]
    return Baseline(inner, expected, rows)


def binned_rows(df: DataFrame, inner: dict[str, list[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, bin), a row per row and feature; null values have a null bin."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), bin_left_closed(F.col(f), e).alias("bin"))
        for f, e in inner.items()
    ])
    return df.select(*by, F.explode(cells).alias("__e")).select(*by, "__e.feature", "__e.bin")


def counters(width: int) -> Column:
    return F.array(*[F.count_if(F.col("bin") == i) for i in range(width)]).alias("counts")


def bin_counts(df: DataFrame, inner: dict[str, list[float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, counts): one counter per bin, additive over any grouping."""
    width = max((len(e) for e in inner.values()), default=0) + 1
    return binned_rows(df, inner, by).groupBy(*by, "feature").agg(counters(width))


def score_counts(
    counts: DataFrame, baseline: Baseline, by: Sequence[str] = (), details: bool = False, features: Sequence[str] | None = None
) -> DataFrame:
    """PSI of counted bins against the baseline, whose table is as small as the feature list."""
    spark = counts.sparkSession
    base = baseline.table(spark).drop("rows")
    if not by:  # a feature without any current rows still has its row, with null PSI
        known = base.filter(F.col("feature").isin(features)) if features is not None else base
        joined = known.join(F.broadcast(counts), "feature", "left")
    else:
        joined = counts.join(F.broadcast(base), "feature")
    own = F.slice("counts", 1, F.size("expected"))
    rows = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)
    shaped = joined.withColumn("rows", F.coalesce(rows, F.lit(0))).withColumn(
        "actual", F.when(F.col("rows") > 0, F.transform(own, lambda c: _clip_share(c / F.col("rows")))))
    parts = F.zip_with("actual", "expected", lambda a, e: (a - e) * F.log(a / e))
    shaped = shaped.withColumn("parts", parts)
    psi = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    if not details:
        return shaped.select(
            *by, "feature", psi.alias("psi"), psi_status(psi).alias("status"),
            F.size("expected").alias("n_bins"), F.col("rows").alias("n_rows"))
    at = F.col("pos")
    return shaped.select(*by, "feature", "inner", "expected", "actual", F.posexplode("parts").alias("pos", "psi_contribution")).select(
        *by, "feature", (at + 1).alias("bin"),
        F.try_element_at("inner", F.when(at > 0, at)).alias("lower"),
        F.try_element_at("inner", at + 1).alias("upper"),
        F.element_at("expected", at + 1).alias("expected_pct"),
        F.element_at("actual", at + 1).alias("actual_pct"),
        "psi_contribution",
    )


def _shared(baseline: Baseline, current: DataFrame) -> dict[str, list[float]]:
    return {f: e for f, e in baseline.inner.items() if f in current.columns}


def psi_against(baseline: Baseline, current: DataFrame, by: Sequence[str] = (), details: bool = False) -> DataFrame:
    """PSI of each baseline feature that ``current`` has; one row per feature and group."""
    shared = _shared(baseline, current)
    return score_counts(bin_counts(current, shared, by), baseline, by, details, list(shared))


def psi(
    expected: DataFrame, actual: DataFrame, column: str, n_bins: int = 10, strategy: str = "quantile", details: bool = False
) -> DataFrame:
    return psi_against(fit_baseline(expected, [column], n_bins, strategy), actual, details=details)


def psi_matrix(
    expected: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None, n_bins: int = 10, strategy: str = "quantile"
) -> DataFrame:
    """PSI of many columns, largest first; a column the current data lacks is skipped."""
    columns = [c for c in (columns or numeric_features(expected)) if c in actual.columns]
    out = psi_against(fit_baseline(expected, columns, n_bins, strategy), actual)
    return out.orderBy(F.desc("psi"), "feature")


def csi_feature(expected: DataFrame, actual: DataFrame, feature: str, **kw) -> DataFrame:
    for name, df in (("baseline", expected), ("current data", actual)):
        if feature not in df.columns:
            raise ValueError(f"feature {feature!r} not in {name}")
    return psi(expected, actual, feature, **kw)


def csi_overall(scores: DataFrame, n_features: int, alert_threshold: float = ALERT) -> DataFrame:
    """One row: how many features drift, and whether that is a warning or an alert."""
    drifts = F.col("psi") >= alert_threshold
    found = scores.agg(
        F.count_if(drifts).alias("n_drifting"),
        F.array_sort(F.collect_list(F.when(drifts, F.col("feature")))).alias("drifting_features"),
    )
    n = F.col("n_drifting")
    status = (
        F.when((n / float(max(n_features, 1)) >= ALERT_SHARE) | (n >= ALERT_COUNT), "alert")
        .when(n >= 1, "warning").otherwise("stable")
    )
    return found.select(status.alias("overall_status"), F.lit(n_features).cast("bigint").alias("n_features"),
                        "n_drifting", "drifting_features")


def csi_summary(scores: DataFrame, alert_threshold: float = ALERT) -> DataFrame:
    return scores.select(
        "feature", F.col("psi").alias("csi"), "status", (F.col("psi") >= alert_threshold).alias("is_drifting")
    ).orderBy(F.desc("csi"), "feature")


def drifting_features(scores: DataFrame, threshold: float | None = None) -> DataFrame:
    """Names at or above the threshold; None means the default, and 0 means 0."""
    limit = ALERT if threshold is None else threshold
    return scores.filter(F.col("psi") >= limit).select("feature")


def _side_stats(df: DataFrame, features: Sequence[str], prefix: str) -> DataFrame:
    dtypes = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), as_number(F.col(f), dtypes[f]).alias("v")) for f in features])
    return (
        df.select(F.explode(cells).alias("e")).select("e.feature", "e.v").groupBy("feature").agg(
            F.avg("v").alias(f"{prefix}_mean"),
            F.stddev_samp("v").alias(f"{prefix}_std"),
            (F.count_if(F.col("v").isNull()) * 100.0 / F.count(F.lit(1))).alias(f"{prefix}_missing_pct"),
        )
    )


def drift_report(expected: DataFrame, actual: DataFrame, features: Sequence[str] | None = None, n_bins: int = 10) -> DataFrame:
    """CSI with means, deviations, their change, and missing shares; largest drift first."""
    features = [f for f in (features or numeric_features(expected)) if f in actual.columns]
    scores = psi_against(fit_baseline(expected, features, n_bins), actual)
    # all three sides have one row per feature
    out = scores.join(F.broadcast(_side_stats(expected, features, "baseline")), "feature").join(
        F.broadcast(_side_stats(actual, features, "current")), "feature")
    return out.select(
        "feature", F.col("psi").alias("csi"), "status", "baseline_mean", "current_mean",
        (F.col("current_mean") - F.col("baseline_mean")).alias("mean_shift"),
        "baseline_std", "current_std",
        (F.col("current_std") / F.greatest(F.col("baseline_std"), F.lit(1e-8))).alias("std_ratio"),
        "baseline_missing_pct", "current_missing_pct",
    ).orderBy(F.desc("csi"), "feature")


def psi_by_window(current: DataFrame, baseline: Baseline, ts: str, width: str, slide: str | None = None) -> DataFrame:
    """PSI per time window and feature against the frozen baseline."""
    start = F.window(F.col(ts), width, slide).start if slide else F.window(F.col(ts), width).start
    keyed = current.select(*_shared(baseline, current), start.alias("window_start"))
    return psi_against(baseline, keyed, ["window_start"])


def category_parts(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """(category, expected_pct, actual_pct, psi_contribution), joined after counting."""
    def shares(df, name):
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(
            F.count(F.lit(1)).alias(name))
        n = df.agg(F.count(column)).first()[0]
        return counts, n

    e, ne = shares(expected, "__e")
    a, na = shares(actual, "__a")
    both = e.join(a, "category", "full_outer")

    def pct(name, n):
        return _clip_share(F.coalesce(F.col(name), F.lit(0)) / F.lit(float(n) if n else None))

    out = both.select("category", pct("__e", ne).alias("expected_pct"), pct("__a", na).alias("actual_pct"))
    gap = (F.col("actual_pct") - F.col("expected_pct")) * F.log(F.col("actual_pct") / F.col("expected_pct"))
    return out.withColumn("psi_contribution", gap)


def psi_categorical(expected: DataFrame, actual: DataFrame, column: str) -> DataFrame:
    """PSI over categories instead of bins, for columns whose values have no order."""
    return category_parts(expected, actual, column).agg(
        F.sum("psi_contribution").alias("psi"), F.count(F.lit(1)).alias("n_categories")
    ).select(F.lit(column).alias("feature"), "psi", psi_status(F.col("psi")).alias("status"), "n_categories")


class DriftMonitor:
    """A frozen baseline with a history table of checks.

    History and baselines live in parquet folders below ``path``, one for each check and version, so they outlive
    the session and any number of jobs can write at the same time. Each baseline has a version and a reset starts a new one; a
    monitor opened on the path goes on with the newest. Outside tests name a shared path.
    """

    STATE = f"version int, {BASELINE_SCHEMA}"

    HISTORY = "baseline_version int, checked_at timestamp, feature string, psi double, status string"

    def __init__(self, spark: SparkSession, baseline: Baseline | None = None, path: str | None = None,
                 alert_threshold: float = ALERT, warning_threshold: float = WARNING):
        self.spark = spark
        self.root = path or fresh_path(spark, "drift-monitor")
        self.path = f"{self.root}/history"
        self.alert_threshold = alert_threshold
        self.warning_threshold = warning_threshold
        self.version, self.baseline = self._newest()
        if self.version == 0:
            if baseline is None:
                raise ValueError(f"no baseline is stored at {self.root}")
            self.reset_baseline(baseline)

    def _read(self, path: str, schema: str) -> DataFrame:
        """The table, without rows while its folder is not there."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_table(self.spark, [], schema)

    def _newest(self) -> tuple[int, Baseline | None]:
        rows = self._read(f"{self.root}/baselines", self.STATE)
        top = rows.agg(F.max("version")).first()[0]
        if top is None:
            return 0, None
        found = rows.filter(F.col("version") == top).collect()  # one row per feature
        return top, Baseline(*({r["feature"]: x for r in found if (x := (list(r[k]) if k != "rows" else r[k])) is not None} for k in ("inner", "expected", "rows")))

    def check(self, current: DataFrame, at: str | None = None) -> DataFrame:
        """Score the data, append to the history, and return this check's rows."""
        stamp = F.lit(at).cast("timestamp") if at else F.current_timestamp()
        rows = psi_against(self.baseline, current).select(
            F.lit(self.version).alias("baseline_version"), stamp.alias("checked_at"), "feature", "psi", "status")
        done = local_table(self.spark, rows.collect(), self.HISTORY)  # one row per feature
        done.coalesce(1).write.parquet(f"{self.path}/check={uuid.uuid4().hex}")
        return done

    def history(self) -> DataFrame:
        """All checks against the current baseline; none yet gives no rows."""
        rows = self._read(self.path, f"{self.HISTORY}, check string").drop("check")
        return rows.filter(F.col("baseline_version") == self.version)

    def trend(self, feature: str | None = None) -> DataFrame:
        rows = self.history()
        if feature is not None:
            rows = rows.filter(F.col("feature") == feature)
        return rows.select("checked_at", "feature", "psi", "status").orderBy("checked_at", "feature")

    def latest(self) -> DataFrame:
        newest = Window.partitionBy("feature").orderBy(F.desc("checked_at"))
        return self.history().withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") == 1).drop("__r")

    def summary(self) -> DataFrame:
        return csi_summary(self.latest(), self.alert_threshold)

    def overall(self) -> DataFrame:
        return csi_overall(self.latest(), len(self.baseline.features), self.alert_threshold)

    def is_drifting(self) -> bool:
        top = self.latest().agg(F.max("psi")).first()[0]
        return top is not None and top >= self.alert_threshold

    def reset_baseline(self, baseline: Baseline) -> None:
        """Store a baseline under the next version; earlier checks no longer count.

        A version is claimed by a file that only one monitor can create, so baselines reset at the same time
        get versions of their own, and the highest stored one counts for monitors opened later.
        """
        version = self._newest()[0] + 1
        while not claim(self.spark, f"{self.root}/versions/{version}"):
            version += 1
        self.version, self.baseline = version, baseline
        baseline.table(self.spark).coalesce(1).write.parquet(f"{self.root}/baselines/version={version}")
